"""The shape of clauses: references, leads, headings, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import each, let, quoted, replaced
from .text import LETTER

NUMBER = r"\d+(?:\.\d+){0,5}"
LABEL = "(?:clause|section|article|пункт|раздел)"
# Units of money and shares, those in ASCII letters and the others.
UNITS, SIGNS = "percent|eur|usd", r"руб|рубл|₽|%|€|\$|тыс|млн"
UPPER = "A-ZА-ЯЁÀ-ÖØ-Þ"


def clause_ref(text: Column, index: Column) -> Column:
    """The number a clause begins with, or that of its label, else its place."""
    own = F.nullif(F.regexp_extract(text, rf"^\s*({NUMBER})[.)]?(?:\s|$)", 1), F.lit(""))
    labelled = F.nullif(F.regexp_extract(text, rf"(?iu)^\s*{LABEL}\s+({NUMBER})", 1), F.lit(""))
    return F.coalesce(own, labelled, (index + 1).cast("string"))


LEADS = (r"^\s*[\x{2022}*-]+\s*", r"(?iu)^\s*\(?[a-zа-яё]\)\s*", rf"(?iu)^\s*{LABEL}\s+{NUMBER}[.)]?\s*", rf"^\s*{NUMBER}[.)]?\s*")


def trim_lead_sql(text: str) -> str:
    return f"trim({replaced(text, *((p, '') for p in LEADS))})"


def trim_lead(text: Column) -> Column:
    for p in LEADS:
        text = F.regexp_replace(text, p, "")
    return F.trim(text)


def heading_like_sql(t: str) -> str:
    letters, upper = (f"regexp_count({t}, {quoted(f'[{x}]')})" for x in (LETTER, UPPER))
    return f"({t} = '' OR endswith({t}, ':') OR ({letters} > 0 AND {upper} > {letters} * 0.72D))"


def heading_like(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(f"[{LETTER}]"))
    upper = F.regexp_count(text, F.lit(f"[{UPPER}]"))
    return (text == "") | text.endswith(":") | ((letters > 0) & (upper > letters * F.lit(0.72)))


def numeric_signal(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?<![0-9A-Za-z_])\d+(?:[.,]\d+)?(?![0-9A-Za-z_])"))


def monetary_signal(text: Column) -> Column:
    """A number and a currency, a share or thousands. A sign or Cyrillic unit counts only where an ASCII word character follows, as its word boundary asks."""
    return F.regexp_like(text, F.lit(rf"(?iu)(?<![0-9A-Za-z_])\d[\d\s.,]*\s*(?:(?:{UNITS})(?![0-9A-Za-z_])|(?:{SIGNS})(?=[0-9A-Za-z_]))"))


def excerpt_focus(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 48, -1).when(n <= 180, 2).when(n <= 260, 1).otherwise(0)


def strip_trailing_marker_sql(text: str) -> str:
    bare = replaced("w", (r"[.!?]\d+(?:[.,]\d+){0,5}[.)]?\s*$", ""), (r"\s+\d+(?:[.,]\d+){0,5}[.)]?\s*$", ""), (r"\s+$", ""))
    labelled = rf"(?iu){LABEL}\s+{NUMBER}[.)]?\s*$"
    # without a digit at its end, or a dot or bracket behind one, a text has no number there
    kept = f"NOT regexp_like(w, {quoted(r'\d[.)]?\s*$')}) OR regexp_like(w, {quoted(labelled)})"
    return let("w", replaced(text, (r"\s+$", "")), f"CASE WHEN {kept} THEN w ELSE {bare} END")


def strip_trailing_marker(text: Column) -> Column:
    """The text without a loose number at its end; a labelled number stays."""
    return each(F.array(text), f"x -> {strip_trailing_marker_sql('x')}")[0]
