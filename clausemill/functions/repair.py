"""Repair of damaged text: wrong code pages, lost and extra spaces, page layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import deep_pack as P
from . import text as T
from .binding import bound, each, quoted

# The characters of code page 1251 from 0x80 on, and the byte of each as a character: a rule, not a list. The page leaves 0x98 open.
_HIGH = [(bytes([b]).decode("cp1251") if b != 0x98 else chr(b), chr(b)) for b in range(0x80, 0x100)]
CP1251, BYTES = "".join(c for c, _ in _HIGH), "".join(b for _, b in _HIGH)
# Fixed value: what UTF-8 read as code page 1251 is full of: the lead bytes of Cyrillic, and what Latin letters with marks give.
MOJIBAKE = "[РС]|[ÃÂÐÑ]"


# Fixed value: the one-letter words that are put right though they are too short to tell. И lacks its second byte, as the page leaves 0x98 open.
ONE_LETTER = "аАвВиИсСкКоОуУ"
SHORT_TOKENS = {c.encode().decode("cp1251", errors="ignore"): c for c in ONE_LETTER}
# What a text has that holds such a token, or one with enough markers: two of them at most four apart.
GUARD = rf"(?:{MOJIBAKE})\S{{0,3}}(?:{MOJIBAKE})|(?<!\S)(?:{'|'.join(SHORT_TOKENS)})(?!\S)"
GUARD_FIRST = "".join(sorted({*"РСÃÂÐÑ", *(t[0] for t in SHORT_TOKENS)}))


def mojibake_score(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MOJIBAKE))


def suspicious(token: Column) -> Column:
    """A token that is to be looked at: a known short one, or one of four characters or more that are markers for 35 % and more."""
    return F.array_contains(F.expr(f"array({', '.join(map(quoted, SHORT_TOKENS))})"), token) | ((F.length(token) >= 4) & (mojibake_score(token) >= F.length(token) * F.lit(0.35)))


def repaired_token(token: Column) -> Column:
    """A token read as code page 1251 that was UTF-8, read again; as it is where that isn't valid or no better. Short ones by the table."""
    score = mojibake_score(token)
    known = ~F.regexp_like(token, F.lit(rf"[^\x00-\x7F{CP1251}]"))
    # translate makes each byte a character of Latin-1, so that encoding it gives the bytes
    again = F.try_validate_utf8(F.encode(F.translate(F.when(known, token), CP1251, BYTES), "ISO-8859-1").cast("string"))
    short = F.expr(f"map({', '.join(quoted(x) for kv in SHORT_TOKENS.items() for x in kv)})")
    return F.coalesce(F.element_at(short, token), F.when(suspicious(token) & known & (mojibake_score(again) < score), again), token)


def by_pattern(c: Column, pattern: str, f) -> Column:
    """c with f, a function or a lambda of SQL, applied to what matches the pattern."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    done = F.concat(each(found, f) if isinstance(f, str) else F.transform(found, f), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(c, pattern, -1), done, lambda g, w: F.concat(g, w)), "")


def by_token(c: Column, f) -> Column:
    """c with f applied to what stands between white space."""
    return by_pattern(c, r"\S+", f)


def mojibake_repair(c: Column) -> Column:
    plain = F.replace(c, F.lit("\0"), F.lit(""))
    return bound(plain, lambda x: F.when(F.regexp_like(x, F.lit(GUARD)), by_token(x, repaired_token)).otherwise(x))


LONG_RUN = "[А-Яа-яЁё]{14,}"
LONG_RUN_START = "(?=[Ё-ё])(?<![А-Яа-яЁё])[А-Яа-яЁё]{14}"
STRETCH = 512  # positions whose results are gathered before they are put with the others: arrays are copied as they grow


def _respacing(words: tuple[str, ...]) -> str:
    """A lambda of SQL: a run of letters as dictionary words, the fewest that reach its end, the shortest first among equals; as it is where none do.

    From the end on, ahead[k - 1] is how many words are needed k letters further on; no more is remembered than the longest word needs. steps has the
    first word's length for each letter. Time and memory grow with the run's length.
    """
    lengths, n = sorted({len(w) for w in words}), "size(letters)"
    stretches = f"sequence(0, CAST(floor(({n} - 1) / {STRETCH}) AS INT))"
    known = f"array_contains(array({', '.join(map(quoted, words))}), lower(array_join(slice(letters, i + 1, k), '')))"
    ways = f"transform(array({', '.join(map(str, lengths))}), k -> CASE WHEN get(a.ahead, k - 1) IS NOT NULL AND {known} THEN named_struct('n', get(a.ahead, k - 1) + 1, 'k', k) END)"
    step = f"""transform(array(array_min({ways})), b -> named_struct(
      'ahead', slice(concat(array(b.n), a.ahead), 1, {lengths[-1]}), 'out', concat(a.out, array(b.k))))[0]"""
    solved = f"""aggregate({stretches}, named_struct('ahead', array(0), 'out', CAST(array() AS ARRAY<ARRAY<INT>>)),
      (acc, j) -> transform(array(aggregate(sequence({n} - 1 - j * {STRETCH}, greatest({n} - (j + 1) * {STRETCH}, 0), -1),
        named_struct('ahead', acc.ahead, 'out', CAST(array() AS ARRAY<INT>)), (a, i) -> {step})), p -> named_struct('ahead', p.ahead, 'out', concat(acc.out, array(p.out))))[0],
      s -> reverse(flatten(s.out)))"""
    letter = """named_struct('left', CASE WHEN a.left = 0 THEN get(steps, i) ELSE a.left END - 1,
      'out', concat(a.out, CASE WHEN a.left = 0 AND i > 0 THEN ' ' ELSE '' END, get(letters, i)))"""
    told = f"""aggregate({stretches}, named_struct('left', 0, 'out', CAST(array() AS ARRAY<STRING>)),
      (acc, j) -> transform(array(aggregate(sequence(j * {STRETCH}, least((j + 1) * {STRETCH}, {n}) - 1),
        named_struct('left', acc.left, 'out', ''), (a, i) -> {letter})), p -> named_struct('left', p.left, 'out', concat(acc.out, array(p.out))))[0],
      s -> array_join(s.out, ''))"""
    # without a step for its first letter a run can't be taken apart
    whole = f"transform(array({solved}), steps -> CASE WHEN get(steps, 0) IS NOT NULL THEN {told} ELSE array_join(letters, '') END)[0]"
    return f"run -> transform(array(regexp_extract_all(run, '.', 0)), letters -> {whole})[0]"


RESPACED = _respacing(P.SEGMENT_WORDS)


def respace_words(c: Column) -> Column:
    """Cyrillic runs of 14 letters and more, taken apart by the dictionary."""
    return bound(c, lambda x: F.when(F.regexp_like(x, F.lit(LONG_RUN)), by_pattern(x, LONG_RUN, RESPACED)).otherwise(x))


def layout_repair(c: Column) -> Column:
    """Hyphens at line ends undone between words, and in every line runs of three and more single Cyrillic letters joined."""
    word = "0-9A-Za-zА-Яа-яЁё"
    c = F.regexp_replace(c, rf"([{word}])-\s*\n\s*(?=[{word}])", "$1")
    run = rf"(?<![{word}])[А-Яа-яЁё](?:[^\S\n]+[А-Яа-яЁё](?![{word}])){{2,}}+"
    runs = F.concat(F.transform(F.regexp_extract_all(c, F.lit(run), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", "")), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split(c, run, -1), runs, lambda g, w: F.concat(g, w)), "")
    return F.when(F.regexp_like(c, F.lit(run)), whole).otherwise(c)


def trim_noise_lines(c: Column) -> Column:
    """Lines from the first text-like one on (among the first six), of these the text-like ones and those with three letters or digits in a row."""
    lines = F.filter(F.transform(F.split(T.normalize_text(layout_repair(c)), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")

    def kept(ls: Column) -> Column:
        likely = F.transform(F.slice(ls, 1, 6), lambda x: T.likely_text(x))
        first = F.greatest(F.coalesce(F.array_position(likely, F.lit(True)), F.lit(0)), F.lit(1)).cast("int")
        useful = F.filter(F.slice(ls, first, F.greatest(F.size(ls), F.lit(1))), lambda x: T.likely_text(x) | F.regexp_like(x, F.lit(r"[\p{L}\p{N}]{3,}")))
        return T.normalize_text(F.array_join(useful, "\n"))

    return F.transform(F.array(lines), kept)[0]


def numeric_entities(c: Column) -> Column:
    """Decimal and hexadecimal entities as their characters; those of no character stay."""
    pattern = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def decoded(e: Column) -> Column:
        body = F.substring(e, F.lit(3), F.length(e) - 3)
        is_hex = F.lower(F.substring(body, 1, 1)) == "x"
        number = F.when(is_hex, F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).cast("long")
        fine = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        # four bytes of the code point, big end first
        return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, number).otherwise(32)), 8, "0")), "UTF-32")).otherwise(e)

    done = F.concat(F.transform(found, decoded), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split(c, pattern, -1), done, lambda g, w: F.concat(g, w)), "")
    return F.when(F.contains(c, F.lit("&#")), whole).otherwise(c)
