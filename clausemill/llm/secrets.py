"""Secret scans through a trigram inverted index, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: group is the part that must have least characters (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed patterns of the contract (the first three) and further public token formats.
# access and hex have their least length in the pattern: their matches are the longest
# runs, so that a run that is too short holds no other match.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def _runs(parsed, limit: int = 64) -> list[list[str]]:
    """The alternatives of a pattern, each as the literal runs that a match must hold; "\\0" breaks runs."""
    alts = [""]
    for op, arg in parsed:
        if op is K.LITERAL:
            here = [chr(arg).lower()]
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 6:
            here = [chr(c).lower() for _, c in arg]
        elif op is K.SUBPATTERN:
            here = _runs(arg[3], limit)
        elif op is K.BRANCH:
            here = [x for branch in arg[1] for x in _runs(branch, limit)]
        elif op is K.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            here = ["", *_runs(arg[2], limit)]
        elif op is K.MAX_REPEAT and arg[0] >= 1:
            here = [x + "\0" for x in _runs(arg[2], limit)]
        else:
            here = ["\0"]
        if len(alts) * len(here) > limit:
            here = ["\0"]
        alts = list(dict.fromkeys(a + h for a in alts for h in here))
    return alts


def trigram_query(pattern: str) -> list[set[str]]:
    """A Boolean query in lower-case trigrams: any of the sets, all of a set; [] where some alternative has none."""
    query = []
    for alt in _runs(parser.parse(pattern)):
        need = {run[i : i + 3] for run in alt.split("\0") for i in range(len(run) - 2)}
        if not need:
            return []
        query.append(need)
    return query


def trigram_postings(docs: DataFrame, vocabulary: list[str], row: str) -> DataFrame:
    """(trigram, row) for every trigram of vocabulary in every whole text, letters in either case."""
    found = F.filter(F.array(*[F.lit(t) for t in vocabulary]), lambda t: F.contains(F.col("_low"), t))
    low = docs.select(row, F.lower("text").alias("_low"))
    return low.select(F.explode(found).alias("trigram"), row)


def _spans(text: Column, rule: Rule) -> Column:
    """Matches as structs (start, end) in code points: the gaps between them give their places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("len"),
        F.transform(part, lambda x: F.length(x)).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"))
        kept = F.when(F.coalesce(x["part"], F.lit(-1)) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    walked = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def _named(no: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secrets: array of (start, kind_no, kind, end), sorted; kind_no is the rule's place in rules.

    For each rule, leftmost non-overlapping matches, of which those too short are
    dropped. Null text has none; repeated rows have the same; extra columns stay, but for one
    named secrets, whose place the result takes.

    Each rule's pattern gives a Boolean trigram query. The index holds the postings of
    all trigrams that some query names; a row is a candidate for a rule where some
    alternative has all its trigrams, found by grouping postings. Only candidates run
    the rule's pattern. A rule that has an alternative without a mandatory trigram scans
    all texts. Joining candidates back moves each text once.
    """
    scratch = Scratch(docs.sparkSession)
    side = Aside(docs)
    row = F.xxhash64(*side.every())
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    terms = [(kind, alt, len(need), t) for kind, q in queries.items() for alt, need in enumerate(q) for t in sorted(need)]
    told = side.rows.withColumns({"_row": row, "text": side["text"]})
    if terms:
        query = docs.sparkSession.createDataFrame(terms, "kind string, alt int, need int, trigram string")
        postings = trigram_postings(told, sorted({t[3] for t in terms}), "_row")
        # the query table has a few rows for each rule of a fixed list; a row's equal postings (repeated rows) count once
        hits = postings.join(F.broadcast(query), "trigram").groupBy("_row", "kind", "alt", "need").agg(F.count_distinct("trigram").alias("n"))
        candidates = hits.where(F.col("n") == F.col("need")).groupBy("_row").agg(F.collect_set("kind").alias("_kinds"))
        told = told.join(scratch.write(candidates, "candidates").hint("merge"), "_row", "left")
    else:
        told = told.withColumn("_kinds", F.lit(None).cast("array<string>"))
    text = F.coalesce("text", F.lit(""))
    found = []
    for no, r in enumerate(rules):
        spans = _spans(text, r)
        if queries[r.kind]:
            spans = F.when(F.array_contains("_kinds", r.kind), spans)
        spans = F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>"))
        found.append(F.transform(spans, _named(no, r.kind)))
    return told.withColumn("secrets", F.array_sort(F.concat(*found))).select(*side.back("secrets"), "secrets")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
