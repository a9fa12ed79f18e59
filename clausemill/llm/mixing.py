"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Aside, Scratch

SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=(5, 2, 1), budget_ratio: float = 1.5, max_repeat: int = 2, max_sources: int = 1_000_000) -> DataFrame:
    """One row per source: (source, source_size, target); sizes has (source, part_size).

    Weights repeat over the sources in code point order, null last. A target stops at
    max_repeat times its source's size; the excess is reshared by weight until none is
    above. Sorted by cap per weight, the sources that stop are a prefix, so the water
    level is the first (budget - caps before) / (weights from here) that its own source
    can take. The windows run over one row per source, in one task: more than max_sources are an error.
    """
    every = W.orderBy("_ratio", "_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    later = W.orderBy("_ratio", "_rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    if sizes.select("source").distinct().count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    per = sizes.groupBy("source").agg(F.sum("part_size").cast("long").alias("source_size"))
    per = per.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ws = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumns({
        "_w": F.element_at(ws, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")),
        "_cap": F.col("source_size") * max_repeat,
        "_budget": F.sum("source_size").over(whole) * F.lit(float(budget_ratio)),
    }).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    per = per.withColumns({"_caps": F.sum("_cap").over(every) - F.col("_cap"), "_ws": F.sum("_w").over(later)})
    per = per.withColumn("_level", (F.col("_budget") - F.col("_caps")) / F.col("_ws"))
    open_at = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))
    per = per.withColumn("_level", F.min(open_at).over(whole)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def _queued(side: Aside, weights, budget_ratio: float, max_repeat: int, rows_per_bucket: int) -> DataFrame:
    """The rows of side with size, source_size, target, _sent (words its source sends before it, in one round) and finish."""
    scratch = Scratch(side.rows.sparkSession)
    rows = side.rows.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / rows_per_bucket, 16))) if rows > rows_per_bucket else 1
    text = F.coalesce(side["text"], F.lit(""))
    # the key covers the text, so that rows of one or no doc_id are apart
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(side["doc_id"].cast("string"), F.lit("null")), F.lit(":"), text))
    sized = side.rows.withColumns({
        "source": side["source"],
        "size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "_key": key,
    }).withColumn("_bucket", F.substring("_key", 1, digits))
    parts = scratch.write(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("part_size")), "parts")
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    targets = source_targets(parts, weights, budget_ratio, max_repeat)
    # a written table, so that its size estimate is true; null-safe keys for the null source
    offsets = scratch.write(
        offsets.alias("o").join(targets.alias("t").hint("merge"), F.col("o.source").eqNullSafe(F.col("t.source")))
        .select(F.col("o.source").alias("_source"), F.col("o._bucket").alias("_b"), "_offset", "source_size", "target"), "offsets")
    inside = W.partitionBy("source", "_bucket").orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    ran = sized.withColumn("_run", F.sum("size").over(inside))
    joined = ran.join(offsets.hint("merge"), ran["source"].eqNullSafe(offsets["_source"]) & (ran["_bucket"] == offsets["_b"]))
    joined = joined.withColumn("_sent", F.col("_offset") + F.col("_run") - F.col("size"))
    return joined.withColumn("finish", F.when(F.col("target") > 0, (F.col("_sent") + F.col("size")) / F.col("target")))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), budget_ratio: float = 1.5, max_repeat: int = 2, rows_per_bucket: int = 20000) -> DataFrame:
    """docs with size, source_size, target, taken and finish.

    Every source is a queue of its documents in hashed order, served max_repeat times
    over. A document's virtual finish time is the words its source has sent up to and
    with it, divided by the source's target; repeats finish a round (source_size / target) later. As the
    targets add up to the budget, the globally sorted queue of words reaches the budget at
    virtual time 1: copies that finish by then are taken whole, the one that a source is
    sending then is cut there, later ones aren't taken. So a source's taken words are its target, rounded down.

    taken counts repeats; finish is that of the document's first copy. Null text has
    size 0, is never taken, and finishes when its predecessor does; a null source is a
    source of its own; a null doc_id counts as the text "null"; repeated rows queue one after
    the other, and which of them is cut is open. Extra columns stay, but for those named like an
    added one, which gives the added one's values.

    Running sums never need a whole source in one task: sources are cut into buckets of
    the hashed order, bucket sums give each bucket its offset, and the window inside a
    bucket adds the rest.
    """
    side = Aside(docs)
    out = _queued(side, weights, budget_ratio, max_repeat, rows_per_bucket)

    def of_copy(r: int):
        lap = F.col("source_size") * r
        return (F.when(F.col("finish") + lap / F.col("target") <= 1, F.col("size"))
                .otherwise(F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("_sent") - lap))))

    taken = sum((of_copy(r) for r in range(max_repeat)), F.lit(0))
    out = out.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0).cast("long"))
    added = ("size", "source_size", "target", "taken", "finish")
    return out.select(*side.back(*added), *added)


def mixed_stream(docs: DataFrame, weights=(5, 2, 1), budget_ratio: float = 1.5, max_repeat: int = 2, rows_per_bucket: int = 20000) -> DataFrame:
    """The mix itself: a row per taken copy of a document, range-sorted by virtual finish time, with the columns of docs.

    Documents are taken whole: a copy goes in if its source has sent half of it by virtual time 1, where the budget
    is reached, so that a source's words miss its target by at most half a document. Texts without words are never sent.
    Nulls and repeated rows are as in mix_sources; all columns stay as they are, whatever their names.
    """
    side = Aside(docs)
    out = _queued(side, weights, budget_ratio, max_repeat, rows_per_bucket).where((F.col("size") > 0) & (F.col("target") > 0))
    rounds = F.sequence(F.lit(0), F.lit(max_repeat - 1))
    sent = F.filter(rounds, lambda r: F.col("_sent") + r * F.col("source_size") + F.col("size") / 2 <= F.col("target"))
    rows = out.withColumn("_copy", F.explode(sent))
    rows = rows.withColumn("_at", F.col("finish") + F.col("_copy") * F.col("source_size") / F.col("target"))
    return rows.repartitionByRange(F.col("_at")).sortWithinPartitions("_at").select(*side.back())
