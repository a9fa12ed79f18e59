"""Clauses against dictionaries: containment joins, positions, and distances between markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let, quoted, told
from ..sources.shared import written
from .joins import MOST_SENT, fits


def contains_join(units: DataFrame, markers: DataFrame, text: str, marker: str, most: int = MOST_SENT) -> DataFrame:
    """units with each marker that their text contains. A marker table of at most `most` bytes is sent to the units; a larger one goes by trigrams."""
    if fits(markers, most):
        return units.join(F.broadcast(markers), F.contains(F.col(text), F.col(marker)))
    return contains_join_blocked(units, markers, text, marker, most)


def _grams(text: Column, n: int) -> Column:
    """All stretches of n characters, with the whole text as the only one where it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n)))


MOST_LISTED = 4096  # trigrams of markers that are written into the plan as a set


def _trigrams(text: Column) -> Column:
    """The trigrams of a text, in time that grows with it. Behind a character beyond 16 bits there is one more, the same wherever the character and the next two stand."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1))


def _with_trigrams(units: DataFrame, markers: DataFrame, text: str, marker: str) -> tuple[DataFrame, DataFrame]:
    """(units, known): units with a number _u, written, and their trigrams _tris; known are those of the markers.

    Where these can be listed, _tris holds only trigrams of markers, and is written as well.
    """
    known = markers.where(F.length(marker) >= 3).select(F.explode(_trigrams(F.col(marker))).alias("_tri")).distinct()
    listed = [r[0] for r in known.limit(MOST_LISTED + 1).collect()]
    own = units.withColumn("_u", F.monotonically_increasing_id())
    if len(listed) > MOST_LISTED:
        return written(own, "units").withColumn("_tris", F.array_distinct(_trigrams(F.col(text)))), known
    return written(own.withColumn("_tris", F.array_distinct(F.filter(_trigrams(F.col(text)), lambda g: g.isin(listed)))), "units"), known


def _rarest(keyed: DataFrame, known: DataFrame, markers: DataFrame, marker: str, most: int) -> DataFrame:
    of_marker = markers.where(F.length(marker) >= 3).withColumn("_tris", F.array_distinct(_trigrams(F.col(marker))))
    in_units = keyed.select(F.explode("_tris").alias("_tri")).join(known.hint("broadcast" if fits(known, most) else "merge"), "_tri")
    counts = written(in_units.groupBy("_tri").agg(F.count("*").alias("_units")), "trigrams")
    each = of_marker.select(marker, F.explode("_tris").alias("_tri")).distinct().join(counts.hint("merge"), "_tri", "left")
    best = each.groupBy(marker).agg(F.min(F.struct(F.coalesce("_units", F.lit(0)).alias("n"), "_tri")).alias("_b")).where("_b.n > 0")
    return markers.join(best.select(marker, F.col("_b._tri").alias("_tri")).hint("merge"), marker)


def rarest_trigrams(units: DataFrame, markers: DataFrame, text: str, marker: str, most: int = MOST_SENT) -> DataFrame:
    """markers (of three characters and more) with _tri, that trigram of theirs that fewest units contain; markers with one that no unit contains are left out.

    Only trigrams that occur in markers are counted, one row each after the partial count of a task.
    """
    return _rarest(*_with_trigrams(units, markers, text, marker), markers, marker, most)


def contains_join_blocked(units: DataFrame, markers: DataFrame, text: str, marker: str, most: int = MOST_SENT) -> DataFrame:
    """The same rows as contains_join, for dictionaries of thousands of markers.

    A unit meets a marker on the marker's rarest trigram, and is verified. Where the markers fit, they are sent to the units, so that no text is
    shuffled; else (unit, trigram) rows without text meet them, and only units with a candidate are dealt out once more for the check.
    Markers of one or two characters, if there are any, meet the units' single characters and pairs. An empty marker is in no text.
    The units are worked out once and written with the trigrams that markers have.
    """
    keyed, known = _with_trigrams(units, markers, text, marker)
    chosen = written(_rarest(keyed, known, markers, marker, most), "rarest")
    short = markers.where((F.length(marker) < 3) & (F.length(marker) > 0))
    if fits(chosen, most):
        met = keyed.withColumn("_tri", F.explode("_tris")).join(F.broadcast(chosen), "_tri")
        met = met.where(F.contains(F.col(text), F.col(marker))).drop("_tri", "_tris", "_u")
    else:
        pairs = keyed.select("_u", F.explode("_tris").alias("_tri")).join(chosen.hint("merge"), "_tri").drop("_tri")
        met = keyed.drop("_tris").join(pairs.hint("merge"), "_u").where(F.contains(F.col(text), F.col(marker))).drop("_u")
    if short.isEmpty():
        return met
    parts = lambda c: F.array_distinct(F.concat(_grams(c, 1), _grams(c, 2)))
    near = keyed.drop("_tris", "_u").withColumn("_part", F.explode(parts(F.col(text)))).where("_part <> ''")
    near = near.join(short.hint("broadcast" if fits(short, most) else "merge"), F.col("_part") == F.col(marker)).drop("_part")
    return met.unionByName(near)


def clause_rule_match(clauses: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """One row per rule and clause where any keyword is in the clause."""
    hits = contains_join(clauses.withColumn("_low", F.lower("clause_text")), keywords, "_low", "keyword")
    return hits.select(key, "clause_index", "clause_id", "rule_id", "rule_index", "severity").distinct()


def clause_dispute_match(clauses: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    long = markers.select("dispute_id", "dispute_index", "confidence", F.explode("markers").alias("marker"))
    hits = contains_join(clauses.withColumn("_low", F.lower("clause_text")), long, "_low", "marker")
    return hits.select(key, "clause_index", "clause_id", "dispute_id", "dispute_index", "confidence", F.substring("clause_text", 1, 300).alias("excerpt")).distinct()


def marker_hits(text: Column, markers: list[str]) -> Column:
    """How many listed markers the text contains; a marker counts once."""
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))


def hits_sql(text: str, markers: list[str] | tuple[str, ...]) -> str:
    """SQL: how many listed markers the text contains; a marker counts once."""
    return " + ".join(f"CAST(contains({text}, {quoted(m)}) AS INT)" for m in markers) or "0"


STRETCH = 512  # places that are added up before they are put with the others: arrays are copied as they grow


def _running(sizes: str) -> str:
    """SQL: the sums of all sizes before each: 0, then the first, then the first two; stretch by stretch, as an array is copied with every value it gets."""
    part = f"""aggregate(slice({sizes}, j * {STRETCH} + 1, {STRETCH}), named_struct('at', acc.at, 'out', CAST(array() AS ARRAY<INT>)),
      (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at))))"""
    sums = f"""aggregate(sequence(0, CAST(floor((size({sizes}) - 1) / {STRETCH}) AS INT)), named_struct('at', 0, 'out', CAST(array() AS ARRAY<ARRAY<INT>>)),
      (acc, j) -> {let('p', part, "named_struct('at', p.at, 'out', concat(acc.out, array(p.out)))")}, r -> flatten(r.out))"""
    return f"CASE WHEN size({sizes}) > 0 THEN {sums} ELSE CAST(array() AS ARRAY<INT>) END"


def occurrences_sql(text: str, marker: str) -> str:
    """SQL: start offsets (from 0) of the non-overlapping occurrences of a marker."""
    literal = f"concat({quoted(chr(92) + 'Q')}, replace({marker}, {quoted(r'\E')}, {quoted(r'\E\\E\Q')}), {quoted(r'\E')})"
    # an occurrence stands behind each gap but the last, and begins where the marker's length has not been added yet
    ends = f"transform(slice(g, 1, size(g) - 1), x -> length(x) + length({marker}))"
    return let("g", f"split({text}, {literal}, -1)", let("sizes", ends, f"zip_with({_running('sizes')}, sizes, (a, x) -> a + x - length({marker}))"))


def occurrences_of(text: Column, marker: Column) -> Column:
    """Start offsets (from 0) of the non-overlapping occurrences of a marker."""
    return told(occurrences_sql("s.text", "s.marker"), text=text, marker=marker)


def positions_sql(text: str, terms: str) -> str:
    """SQL: sorted start offsets (from 0) of all non-overlapping occurrences of all terms, an array."""
    return f"array_sort(flatten(transform(filter({terms}, t -> contains({text}, t)), t -> {occurrences_sql(text, 't')})))"


def marker_positions(text: Column, markers: list[str]) -> Column:
    """Sorted start offsets (from 0) of all non-overlapping occurrences of all markers."""
    return F.array_sort(F.concat(*[F.when(F.contains(text, F.lit(m)), occurrences_of(text, F.lit(m))).otherwise(F.array().cast("array<int>")) for m in markers]))


def reach_count_sql(a: str, b: str, back: str, on: str) -> str:
    """SQL: how many of a lie within [target - back, target + on] of some target of b: one merge of the points and the ends of these stretches.

    At equal places stretches begin (0) before points are met (1), and end (2) after.
    """
    at = lambda xs, by, kind: f"transform({xs}, x -> named_struct('at', x + {by}, 'kind', {kind}))"
    events = f"array_sort(concat({at(b, f'(-{back})', 0)}, {at(a, '0', 1)}, {at(b, on, 2)}))"
    met = f"""aggregate({events}, named_struct('open', 0, 'n', 0), (acc, e) -> named_struct(
      'open', acc.open + CASE e.kind WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END, 'n', acc.n + CASE WHEN e.kind = 1 AND acc.open > 0 THEN 1 ELSE 0 END), acc -> acc.n)"""
    return f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN 0 ELSE {met} END"


def reach_count(a: Column, b: Column, back: int | Column, on: int | Column) -> Column:
    """Positions of a that have one of b at most `on` before or `back` behind them."""
    number = lambda x: x if isinstance(x, Column) else F.lit(x)
    return told(reach_count_sql("s.a", "s.b", "s.back", "s.on"), a=a, b=b, back=number(back), on=number(on))


def near_any(a: Column, b: Column, within: int = 96) -> Column:
    """Some position of a is within so many characters of some position of b."""
    return near_count(a, b, within) > 0


def lead_any(a: Column, b: Column, within: int = 96) -> Column:
    """Some position of a is at or before some position of b, by at most so many characters."""
    return reach_count(a, b, within, 0) > 0


def near_count(a: Column, b: Column, within: int = 96) -> Column:
    """Positions of a that have one of b within so many characters."""
    return reach_count(a, b, within, within)
