"""Extendible hashing: shards by hash prefix, where only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Aside, Scratch, numbered

BITS = 60


def shard_documents(docs: DataFrame, byte_limit: int = 8 << 20, spare_bits: int = 4, step_bits: int = 18) -> DataFrame:
    """docs with n_bytes, shard_id, depth and shard_bytes.

    A row's hash covers all its columns. The directory starts as one bucket; a bucket of
    more than byte_limit bytes of text (UTF-8) and more than one row splits on the next
    hash bit, others stay. shard_id is "depth:prefix" (prefix in binary), and
    ":page" follows where rows repeat so often that hashing can't part them: such equal
    rows go to pages of at most the limit. A single text over the limit is a shard of its own.
    Null text has 0 bytes; an empty table gives no rows; extra columns are kept, but for those
    named like an added one, which gives the added one's values.

    The splits are decided on a histogram of hash prefixes, of a size that follows the
    number of shards: one grouping sums every prefix at every depth, and a bucket is the
    shallowest prefix that fits. Where a prefix as long as the histogram's still doesn't,
    only its rows go on, with more bits.
    """
    scratch = Scratch(docs.sparkSession)
    side = Aside(docs)
    keyed = side.rows.withColumns({
        "n_bytes": F.coalesce(F.octet_length(side["text"]), F.lit(0)).cast("long"),
        "_hash": F.shiftrightunsigned(F.xxhash64(*side.every()), 64 - BITS),
    })
    narrow = scratch.write(keyed.select("_hash", "n_bytes"), "hashes")
    total = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(step_bits, max(1, math.ceil(math.log2(max(1, total / byte_limit)))) + spare_bits)
    base, left, rest, done = 0, narrow, keyed, []
    while True:
        bits = min(bits, BITS - base)
        entry = F.shiftright("_hash", BITS - base - bits)
        directory = scratch.write(_directory(left.withColumn("_p", entry), base, bits, byte_limit), "directory")
        told = rest.withColumn("_p", entry).join(directory.hint("merge"), "_p").drop("_p")
        done.append(told.where(~F.col("_more")).drop("_more"))
        if directory.where("_more").isEmpty():
            break
        rest = told.where("_more").select(*keyed.columns)
        if base + bits == BITS:
            done.append(_pages(scratch.write(rest, "equal"), byte_limit, scratch))
            break
        left = scratch.write(left.withColumn("_p", entry).join(directory.where("_more").hint("merge"), "_p", "left_semi").drop("_p"), "left")
        base, bits = base + bits, step_bits
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    added = ("n_bytes", "shard_id", "depth", "shard_bytes")
    return out.select(*side.back(*added), *added)


def _directory(hashed: DataFrame, base: int, bits: int, byte_limit: int) -> DataFrame:
    """(_p, depth, shard_id, shard_bytes, _more) for each prefix _p of base + bits bits in use."""
    hist = hashed.groupBy("_p").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
    first = 0 if base == 0 else 1
    levels = hist.select("_p", "bytes", "rows", F.explode(F.sequence(F.lit(first), F.lit(bits))).alias("d"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(_p, {bits} - d)"))
    sums = levels.groupBy("d", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    fits = sums.where((F.col("b") <= byte_limit) | (F.col("r") == 1))
    best = levels.select("_p", "d", "prefix").join(fits.hint("merge"), ["d", "prefix"]).groupBy("_p").agg(F.min(F.struct("d", "prefix", "b")).alias("best"))
    told = hist.select("_p").join(best.hint("merge"), "_p", "left")
    depth = (F.col("best.d") + base).cast("int")
    shard = F.concat_ws(":", depth.cast("string"), F.when(depth == 0, "").otherwise(F.lpad(F.bin("best.prefix"), depth, "0")))
    return told.select("_p", depth.alias("depth"), shard.alias("shard_id"), F.col("best.b").alias("shard_bytes"), F.col("best").isNull().alias("_more"))


def _pages(rows: DataFrame, byte_limit: int, scratch: Scratch) -> DataFrame:
    """Equal rows (one hash each), dealt to pages that fit; a text over the limit has a page of its own."""
    per_page = F.greatest(F.lit(1), F.floor(F.lit(byte_limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    out = scratch.write(numbered(rows, "_hash", scratch).withColumn("_page", F.floor((F.col("_no") - 1) / per_page)).drop("_no"), "pages")
    sizes = out.groupBy("_hash", "_page").agg(F.sum("n_bytes").alias("shard_bytes"))
    shard = F.concat_ws(":", F.lit(str(BITS)), F.lpad(F.bin("_hash"), BITS, "0"), F.col("_page").cast("string"))
    # a page's rows are as many as fit the limit
    out = out.join(sizes.hint("merge"), ["_hash", "_page"])
    return out.select(*rows.columns, F.lit(BITS).alias("depth"), shard.alias("shard_id"), "shard_bytes")
