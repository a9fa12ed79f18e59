"""Documents to clauses, statements and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import shape
from ..functions.binding import bound
from ..sources import rules as R

BLANK = " \t\n\r\x0b\x0c"


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def with_text(requests: DataFrame) -> DataFrame:
    """requests with language resolved and an empty text replaced by the placeholder."""
    language = L.locale_precedence(F.col("language_raw"), F.col("locale_raw"))
    out = requests.withColumn("language", language)
    empty = F.coalesce(F.btrim("document_text", F.lit(BLANK)), F.lit("")) == ""
    return out.withColumn("document_text", F.when(empty, L.localize_text(L.text_map(R.PLACEHOLDER), F.col("language"))).otherwise(F.col("document_text")))


def clause_array(text: Column) -> Column:
    """The clauses of a text: blank lines separate, empty parts go."""
    return _trimmed(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n\n", -1))


def clauses_simple(docs: DataFrame, text: str = "document_text") -> DataFrame:
    """One row per clause; clause_index counts what is left after dropping empty parts."""
    parts = clause_array(F.col(text))
    out = docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("clause_index", "clause_text"))
    return out.withColumn("clause_id", F.concat(F.lit("clause-"), (F.col("clause_index") + 1).cast("string")))


def numbered_array(text: Column) -> Column:
    """The clauses of a text: blank lines separate, and so does a line that begins with a number or a bullet."""
    return _trimmed(F.split(text, r"(?=\n)(?:\n{2,}|(?=\n\s*(?:\d+(?:\.\d+){0,20}[.)]|[\x{2022}*-])))", -1))


def clauses_numbered(docs: DataFrame, text: str = "document_text") -> DataFrame:
    """Blank lines separate, and so does a line that begins with a number or a bullet."""
    parts = numbered_array(F.col(text))
    out = docs.select(*[c for c in docs.columns if c != text], F.posexplode(parts).alias("clause_index", "clause_text"))
    return out.withColumn("clause_ref", shape.clause_ref(F.col("clause_text"), F.col("clause_index")))


def pieces(docs: DataFrame, pattern: str, most: int = 240, text: str = "document_text") -> DataFrame:
    """(…, pos, piece): the text split by pattern, first of equal pieces (letters in either case), cut to most characters.

    The clauses of a text hold nothing that the text doesn't: splitting the text gives all.
    Pieces are cut within a row; the first of equal ones is found by one grouping, which deals the pieces out by their columns.
    """
    parts = _trimmed(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), pattern, -1))
    keyed = F.transform(parts, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    out = docs.select(*[c for c in docs.columns if c != text], F.explode(keyed).alias("p"))
    keep = [c for c in docs.columns if c != text]
    first = out.groupBy(*keep, F.col("p.k").alias("k")).agg(F.min(F.struct("p.i", "p.x")).alias("m"))
    return first.select(*keep, F.col("m.i").alias("pos"), F.substring("m.x", 1, most).alias("piece"))


def line_array(text: Column) -> Column:
    """Lines of a text, also split at ;, the first of those that are equal with letters in either case, cut to 240 characters."""
    parts = _trimmed(F.split(F.replace(text, F.lit("\r"), F.lit("")), r"[\n;]", -1))
    keyed = lambda ps: F.struct(ps.alias("x"), F.transform(ps, lambda x: F.lower(x)).alias("k"))
    return bound(bound(parts, keyed), lambda s: F.transform(
        F.array_distinct(s["k"]), lambda k: F.substring(F.element_at(s["x"], F.array_position(s["k"], k).cast("int")), 1, 240)))


def statements(docs: DataFrame) -> DataFrame:
    return pieces(docs, r"[\n.;]+")


def candidate_lines(docs: DataFrame) -> DataFrame:
    return pieces(docs, r"[\n;]")
