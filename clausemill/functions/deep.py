"""Fragments and their signals: who acts, what a fragment is about, and how it is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import matching as M
from ..sources import deep_pack as P
from . import shape
from . import text as T
from .binding import bound, each, let, quoted, replaced, told

# Fixed patterns: what starts a new fragment, a list item, another party's duty, and what may stand before a leading role.
UP = shape.UPPER
CAPITAL = f"[{UP}]"
SMALL = "[a-zа-яёß-öø-ÿ]"
REF = r"(?:(?:clause|section|article|пункт|раздел)\s+)?\d+(?:\.\d+){%d,5}[.)]?"
OBLIGED = "обязан(?:а|ы)?|обязуется|должен(?:а|ы)?|shall|must|undertakes"
BREAKS = (
    (rf"(?<![{UP}\s])([{UP}\s]{{6,}})(?={CAPITAL}{SMALL}{{2,}}\s+(?:обязан|обязуется|вправе|должен|shall|must|undertakes|may)(?![0-9A-Za-z_]))", "$1\n"),
    (rf"(?i)((?:{OBLIGED}|вправе|may)):\s*(?=[0-9{T.LETTER}])", "$1:\n"),
    (rf"([:.;])(?=\d+(?:\.\d+){{1,5}}[.)]?(?:\s|{CAPITAL}))", "$1\n"),
    (rf"({REF % 1})(?={CAPITAL})", "$1\n"),
    (rf"([.!?])\s+(?={CAPITAL})", "$1\n"),
    (rf"([.!?])\s+({REF % 0})(?=\s+{CAPITAL})", "$1\n$2"),
    (rf"\s+({REF % 0})(?=\s+{CAPITAL})", "\n$1"),
)
LIST_ITEM = r"(?iu)^(?:\(?[a-zа-яё]\)|\d+(?:\.\d+){0,20}[.)]|[-–—*])\s*"
FOREIGN = (r"(?iu)^\s*(?:\d+(?:\.\d+){0,20}[.)]?\s*)?(?:[A-Za-zА-ЯЁ][A-Za-zА-Яа-яЁё-]{2,}(?:\s+[A-Za-zА-Яа-яЁё-]{2,}){0,2})\s+"
           rf"(?:{OBLIGED})(?![0-9A-Za-z_])")
BOUNDARY = r"(?iu)(?:[.;:!?,]\s*|[-–—*]\s*|\d+(?:\.\d+){0,20}[.)]?\s*|(?:clause|section|article|пункт|раздел)\s+\d+(?:\.\d+){0,20}[.)]?\s*)$"
EMBEDDED = (
    rf"[.!?]{REF % 0}(?=\s*{CAPITAL})",
    rf"[.!?]\s+{REF % 0}(?=\s+{CAPITAL})",
    rf"\s+{REF % 0}(?=\s+{CAPITAL})",
)


# A number opens a line that begins a clause, and neither a number nor a label ends the line before: here no pattern of BREAKS reaches from one line to the next.
# Nor does one that tells an unclean text: no hyphen or third line break stands there, and no line goes on.
STRETCH = (rf"\n(?=\n?\d)(?<=[^\s\d\x{{2010}}\x{{2011}}-]\n)(?<!\d[.)]\n)(?!(?<=[enтл]\n)(?<=(?:clause|section|article|пункт|раздел)\n))(?!\d[0-9{T.LETTER}](?<=[{T.LETTER}]\n\d.))"
           r"(?:\n|(?=\d+(?:\.\d+){0,20}[.)]))")
MARK = "\x1e"


def stretches(whole: Column) -> Column:
    """A text in parts that are clean if it is. Those of a normalized one are broken by themselves as they are in the text, and each is one or more whole clauses."""
    # split compiles a pattern for each text anew, but not a single character
    marked = F.split(F.regexp_replace(whole, STRETCH, MARK), MARK, -1)
    return F.when(F.contains(whole, F.lit(MARK)), F.split(whole, STRETCH, -1)).otherwise(marked)


def broken(whole: Column) -> Column:
    """The pieces of a normalized text: at lines, ; and bullets, and before what begins a new statement. None of a text that is nothing but separators."""
    cut = reduce(lambda c, b: F.regexp_replace(c, b[0], b[1]), BREAKS, whole)
    return F.filter(F.transform(F.split(cut, r"\n+|[;\x{2022}]+", -1), T.normalize_text), lambda x: x != "")


def clean_fragments(whole: Column) -> Column:
    """The pieces of a normalized clause, itself if there are none. Never empty but for an empty text."""
    return bound(broken(whole), lambda p: F.when(F.size(p) > 0, p).otherwise(F.filter(F.array(whole), lambda x: x != "")))


def fragments(text: Column) -> Column:
    """The pieces of a clause, normalized first."""
    return bound(T.normalize_text(text), clean_fragments)


def hits(norm: Column, terms: Column) -> Column:
    """How many of the terms, an array, the text contains."""
    return F.size(F.filter(terms, lambda t: F.contains(norm, t)))


def positions(norm: Column, terms: Column) -> Column:
    """Sorted start offsets (from 0) of all non-overlapping occurrences of all terms, an array."""
    return told(M.positions_sql("s.norm", "s.terms"), norm=norm, terms=terms)


def reach_counts(norm: Column, lists: Column, pairs: list[tuple[int, int, int | Column, int | Column]]) -> Column:
    """For each pair (a, b, back, on) of the lists of terms: how many places of list a have one of list b at most `on` before or `back` behind them.

    The places of all lists are one expression, and the counts of all pairs another: the plan doesn't grow with their number.
    """
    def pair(a: int, b: int, back: int | Column, on: int | Column) -> Column:
        if isinstance(back, Column) or isinstance(on, Column):
            return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("back", back), ("on", on))])
        return F.expr(f"named_struct('a', {a}, 'b', {b}, 'back', {back}, 'on', {on})")

    places = f"transform(s.lists, terms -> {M.positions_sql('s.norm', 'terms')})"
    counts = f"transform(s.pairs, p -> {M.reach_count_sql('at[p.a]', 'at[p.b]', 'p.back', 'p.on')})"
    return told(let("at", places, counts), norm=norm, lists=lists, pairs=F.array(*[pair(*p) for p in pairs]))


def phrases(*words: str) -> Column:
    return F.expr("array(" + ", ".join(map(quoted, words)) + ")")


def signal(name: str) -> Column:
    return phrases(*P.SIGNALS[name])


def signal_hits(norm: str, signals: dict) -> Column:
    """A struct with the number of phrases of every signal that the column norm contains; one SQL expression, as there are hundreds of phrases."""
    return F.expr("named_struct(" + ", ".join(f"{quoted(name)}, {M.hits_sql(norm, words)}" for name, words in signals.items()) + ")")


def reference_like(norm: Column) -> Column:
    """A fragment that only refers or gives an example: a neutral word, and an opening or phrase that says so."""
    starts = reduce(lambda a, b: a | b, [norm.startswith(s) for s in P.REFERENCE_STARTS])
    parts = reduce(lambda a, b: a | b, [F.contains(norm, F.lit(s)) for s in P.REFERENCE_PARTS])
    return (M.marker_hits(norm, list(P.SIGNALS["reference_neutral"])) > 0) & (starts | parts)


def continuation_like(fragment: Column, norm: Column) -> Column:
    """A list item, or a fragment with an obligation."""
    return F.regexp_like(fragment, F.lit(LIST_ITEM)) | (M.marker_hits(norm, list(P.SIGNALS["obligations"])) > 0)


def role_forms(role: Column) -> Column:
    """The role as it is looked for: the whole name, its words, and case forms of Russian ones by their ending."""

    cases = lambda e, cs: f"array(t, {', '.join(f'concat(substring(t, 1, length(t) - {len(e)}), {quoted(c)})' for c in cs)})"
    whens = " ".join(f"WHEN endswith(t, {quoted(e)}) AND regexp_like(t, '^[а-яё-]+$') THEN {cases(e, cs)}" for e, cs in P.ROLE_ENDINGS)
    folded = F.lower(T.fold_diacritics(T.collapse_ws(role)))
    tokens = T.tokenize_unique(role)
    every = F.concat(F.array(folded), F.flatten(each(tokens, f"t -> CASE {whens} ELSE array(t) END")))
    return F.array_distinct(F.filter(F.transform(every, lambda t: T.fold_diacritics(t)), lambda t: F.coalesce(t, F.lit("")) != ""))


def role_action_lead(norm: Column, roles: Column) -> Column:
    """The role stands within the first 72 characters, at a boundary, and an action follows within 96."""

    before = "substring(s.norm, greatest(p - 20, 0) + 1, p - greatest(p - 20, 0))"
    leads = f"p <= 72 AND (p = 0 OR regexp_like({before}, {quoted(BOUNDARY)})) AND exists(x.a, a -> a >= p AND a - p <= 96)"
    found = f"named_struct('r', {M.positions_sql('s.norm', 's.roles')}, 'a', {M.positions_sql('s.norm', 's.acts')})"
    return told(let("x", found, f"exists(x.r, p -> {leads})"), norm=norm, roles=roles, acts=signal("role_action"))


def role_lead_fragment(fragment: Column, norm: Column, roles: Column, acts: Column | None = None) -> Column:
    """A short fragment that opens a list of the role's duties; acts is its role_action_lead, if that is there already."""
    lead = F.trim(F.regexp_replace(shape.trim_lead(fragment), r":\s*$", ""))
    short = bound(lead, lambda x: (x != "") & (F.length(x) <= 88) & (F.size(F.split(x, r"\s+")) <= 10))
    opens = F.regexp_like(fragment, F.lit(r":\s*$")) | (M.marker_hits(norm, list(P.SIGNALS["carry_lead"])) > 0)
    acts = role_action_lead(norm, roles) if acts is None else acts
    return acts & (M.marker_hits(norm, list(P.SIGNALS["obligations"])) > 0) & short & opens


def foreign_role_lead(fragment: Column, norm: Column, roles: Column, acts: Column | None = None) -> Column:
    """The fragment opens with another party's duty; acts as in role_lead_fragment."""
    acts = role_action_lead(norm, roles) if acts is None else acts
    return ~acts & F.regexp_like(fragment, F.lit(FOREIGN))


def counterparty_terms(roles: Column) -> Column:
    """Forms of the common parties, of five characters and more, but for those of the chosen role."""
    common = F.flatten(F.transform(phrases(*P.PARTIES), role_forms))
    return F.array_except(F.filter(F.array_distinct(common), lambda t: F.length(t) >= 5), roles)


def _of_rule(rule: Column, table: dict) -> Column:
    """The phrases of the rule, none for a rule that the table doesn't have."""
    out = F.array().cast("array<string>")
    for name, words in table.items():
        out = F.when(rule == name, phrases(*words)).otherwise(out)
    return out


def benefits(rule: Column, norm: Column, roles: Column, others: Column) -> Column:
    """(burden, beneficial): liability or a penalty that the other side bears; a match that is to the chosen role's good, no risk of theirs.

    The rules ask the same six questions, of phrases of their own: they are asked once, and only for the rules that ask them.
    """
    unilateral = rule == "unilateral"
    lists = F.array(roles, others, _of_rule(rule, P.BURDEN), _of_rule(rule, {"liability": P.RECOVERY_SUBJECT}), _of_rule(rule, P.BENEFIT))
    good = (F.when(unilateral, 72).otherwise(96), F.when(unilateral, 0).otherwise(96))
    asked = reach_counts(norm, lists, [(0, 2, 112, 0), (0, 3, 88, 88), (0, 4, *good), (1, 2, 112, 0), (1, 3, 88, 88), (1, 4, 96, 96)])
    excluded = M.marker_hits(norm, list(P.RECOVERY_EXCLUDED)) > 0
    named, no_other = (F.size(roles) > 0) & (hits(norm, roles) > 0), hits(norm, others) == 0

    def burden(n: Column) -> Column:
        own, own_subject, _, theirs, their_subject, their_good = (n[i] > 0 for i in range(6))
        liability = ~(own | (excluded & own_subject)) & ~their_good & (theirs | (excluded & their_subject))
        known = (F.size(roles) > 0) & (hits(norm, others) > 0)
        return known & F.when(rule == "liability", liability).when(rule == "penalties", ~own & ~their_good & theirs).otherwise(False)

    def both(n: Column, burden: Column) -> Column:
        generic = F.when(rule == "liability", M.marker_hits(norm, list(P.GENERIC_BENEFIT["liability"])) > 0).otherwise(M.marker_hits(norm, list(P.GENERIC_BENEFIT["penalties"])) > 0)
        own_good = named & (n[2] > 0)
        good = F.when(unilateral, own_good).otherwise(burden | (generic & no_other) | own_good)
        return F.struct(burden.alias("burden"), good.alias("beneficial"))

    other = F.struct(F.lit(False).alias("burden"), F.lit(False).alias("beneficial"))
    return F.when(rule.isin("liability", "penalties", "unilateral"), bound(asked, lambda n: bound(burden(n), lambda b: both(n, b)))).otherwise(other)


def acceptance_excluded(rule: Column, fragment: Column, h: Column, clause_h: Column) -> Column:
    """Acceptance titles, headings, fragments that speak against it, and those of clauses that make it clear elsewhere."""
    title = F.regexp_like(shape.trim_lead(fragment), F.lit(r"(?iu)^(?:acceptance acts?\s*$|акты?\s+приемки|акты?\s+сдачи[-\s]приемки)"))
    return (rule == "acceptance") & (
        title | shape.heading_like(fragment) | (h["acceptance_negative"] >= 2) | ((clause_h["acceptance_clarity"] >= 2) & (h["acceptance_clarity"] == 0)))


def embedded_boundary_sql(text: str) -> str:
    """SQL: how many characters stand before the first clause number inside the text, by the first of three patterns that occurs; -1 without any."""
    out = "-1"
    for p in reversed(EMBEDDED):
        # Spark's regexp_instr gives no place of a match with lookahead groups of its own: the part before the match does
        out = let("head", f"split(t, {quoted(p)}, 2)", f"CASE WHEN size(head) > 1 THEN length(head[0]) + 1 ELSE {out} END")
    # a number behind white space or an end, and a capital behind it, is in all three
    any_ = rf"[.!?\s]{REF % 0}\s*{CAPITAL}"
    return let("t", text, f"CASE WHEN regexp_like(t, {quoted(any_)}) THEN {out} ELSE -1 END")


def embedded_boundary(text: Column) -> Column:
    """How many characters stand before the first clause number inside the text, by the first of three patterns that occurs; -1 without any."""
    return each(F.array(text), f"x -> {embedded_boundary_sql('x')}")[0]


def excerpt_sql(text: str, most: int) -> str:
    strip = shape.strip_trailing_marker_sql
    until = let("b", embedded_boundary_sql("u"), "CASE WHEN b >= 0 THEN trim(substring(u, 1, b)) ELSE u END")
    end = f"length(regexp_extract(c, {quoted(r'(?s)^(.*[.!?]) ')}, 1))"
    whole = f"CASE WHEN r.b >= 0 OR regexp_like(c, {quoted(r'[.!?]$')}) THEN c ELSE concat(rtrim(c), '...') END"
    shown = let("e", end, f"CASE WHEN c = '' THEN '' WHEN e - 1 >= 60 THEN trim({strip('substring(c, 1, e)')}) ELSE {whole} END")
    raw = f"substring(v, 1, {most})"
    cut = let("r", f"named_struct('raw', {raw}, 'b', {embedded_boundary_sql(raw)})",
              let("c", f"trim({strip('CASE WHEN r.b >= 0 THEN trim(substring(r.raw, 1, r.b)) ELSE r.raw END')})", shown))
    body = let("u", shape.trim_lead_sql(text), strip(until))
    return let("v", body, f"CASE WHEN v = '' OR {shape.heading_like_sql('v')} THEN '' WHEN length(v) <= {most} THEN v ELSE {cut} END")


def excerpt(text: Column, most: int = 240) -> Column:
    """The clause without its lead and without what belongs to the next one, cut to most characters; empty for headings.

    A cut falls on a sentence end from 60 on, on an embedded boundary, or gets an ellipsis.
    """
    return each(F.array(text), f"y -> {excerpt_sql('y', most)}")[0]


def summary_item(text: Column) -> Column:
    """A line for a summary: numbers mended, references at the end dropped, 520 characters at most, no bare label."""
    mended = replaced("z", (r"(?<![0-9A-Za-z_])(\d+(?:\.\d+){1,5}),(\d+(?:\.\d+){0,5}[.)]?)", "$1.$2"), (r":\s*\d+(?:[.,]\d+){0,5}[.)]?\s*$", ":"))
    line = replaced(excerpt_sql(f"trim({mended})", 520), (r":\s*\d+(?:[.,]\d+){0,5}[.)]?\s*$", ""), (rf"^[{T.LETTER}][{T.LETTER}\s-]{{1,48}}:\s*$", ""))
    return each(F.array(T.normalize_text(text)), f"z -> trim({line})")[0]


def preview_items(items: Column, most: int = 3, chars: int = 220) -> Column:
    """The first distinct items, each cut at its last punctuation from 80 characters on, else at a blank, else hard."""

    def trim(x: Column) -> Column:
        return F.when(F.length(x) <= chars, x).otherwise(cut(x))

    def cut(x: Column) -> Column:
        head = F.substring(x, F.lit(1), F.lit(chars))
        mark = F.regexp_extract(head, rf"(?s)^(.{{{min(80, chars) - 1},}}[.!?;])", 1)
        soft = F.regexp_extract(F.substring(x, F.lit(1), F.lit(chars - 2)), rf"(?s)^(.{{{min(80, chars // 2)},}}) ", 1)
        rest = F.when(soft != "", soft).otherwise(F.substring(x, F.lit(1), F.lit(chars - 3)))
        return F.when(mark != "", F.trim(mark)).otherwise(F.concat(F.trim(rest), F.lit("...")))

    trimmed = F.transform(F.transform(items, lambda x: F.trim(T.collapse_ws(x))), trim)
    return F.slice(T.unique_strings(trimmed), 1, most)


def inline_evidence(text: Column, language: Column) -> Column:
    """A report text split before the earliest evidence phrase of its language: (primary, evidence)."""
    low = F.lower(text)

    def at(words: tuple[str, ...]) -> Column:
        found = [F.nullif(F.locate(w, low), F.lit(0)) for w in words]
        return F.least(*found) if len(found) > 1 else found[0]

    place = at(P.EVIDENCE["ru"])
    for lang, words in P.EVIDENCE.items():
        place = F.when(language == lang, at(words)).otherwise(place)
    return bound(place, lambda p: F.when(p.isNull(), F.struct(F.trim(text).alias("primary"), F.array().cast("array<string>").alias("evidence"))).otherwise(
        F.struct(F.trim(F.substring(text, F.lit(1), p - 1)).alias("primary"), F.array(F.trim(F.substring(text, p, F.length(text)))).alias("evidence"))))
