"""Line dedup with two Bloom filters: once-seen and twice-seen line hashes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import Aside, Scratch, ascii_lower, hot_keys, row_key, salted_join

BLANK = " \t\n\x0b\x0c\r"
SEGMENT_BITS = 19


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two Bloom positions for each 64-bit hash."""
    u = h.astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return (u & mask).astype(np.int64), ((u >> np.uint64(64 - bits)) & mask).astype(np.int64)


def twice_seen(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of Bloom positions that at least two rows of hashes (h long) set.

    Every task folds its rows into sorted position lists with a seen-again flag; lists
    meet by segment of the filter, where a once-seen and a twice-seen bitmap merge. The
    result has 2**bits bits whatever the input.
    """

    def fold(frames):
        seen: list[np.ndarray] = []
        for f in frames:
            seen.extend(_positions(f["h"].to_numpy(), bits))
        if not seen:
            return
        pos, n = np.unique(np.concatenate(seen), return_counts=True)
        packed = (pos & ((1 << SEGMENT_BITS) - 1)).astype(np.uint32) | ((n > 1).astype(np.uint32) << np.uint32(31))
        seg, at = np.unique(pos >> SEGMENT_BITS, return_index=True)
        ends = [*at[1:], len(pos)]
        yield pd.DataFrame({"segment": seg, "part": [packed[a:b].tobytes() for a, b in zip(at, ends, strict=True)]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once = np.zeros(1 << SEGMENT_BITS, bool)
        twice = np.zeros(1 << SEGMENT_BITS, bool)
        for part in pdf["part"]:
            x = np.frombuffer(part, np.uint32)
            pos = x & np.uint32((1 << 31) - 1)
            twice[pos[once[pos]]] = True
            twice[pos[x >> np.uint32(31) == 1]] = True
            once[pos] = True
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "twice": [np.packbits(twice).tobytes()]})

    parts = hashes.select("h").mapInPandas(fold, "segment long, part binary")
    merged = parts.groupBy("segment").applyInPandas(merge, "segment long, twice binary")
    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    width = 1 << (SEGMENT_BITS - 3)
    for r in merged.toLocalIterator():
        out[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["twice"], np.uint8)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits_per_line: int = 8, max_bits: int = 29) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    A text splits at newlines; null or empty text is one empty line. A line's key is the
    line without blanks at both ends and with A-Z lowered. A key of at least min_chars
    code points that at least min_docs documents hold stays only in the document with the
    largest doc_id among them (with every occurrence there). Documents are told apart by
    doc_id; a null id counts as smallest, and repeated rows of one id as one document.
    Extra columns stay, but for those named like an added one, which gives the added one's values.

    The filters have bits_per_line bits a line, at most 2**max_bits in all (a proven
    bound on what is broadcast); a fuller filter only passes more lines on to the exact
    check, which compares SHA-256 digests of whole keys.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    side = Aside(docs)
    row = row_key(side["doc_id"], side["text"])
    text = F.coalesce(side["text"], F.lit(""))
    key = F.btrim("line", F.lit(BLANK))
    # lower-casing makes a string per character: only for lines that need it
    key = F.when(F.regexp_like("line", F.lit("[A-Z]")), ascii_lower(key)).otherwise(key)
    lines = side.rows.select(side["doc_id"].alias("doc_id"), row.alias("_row"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.length("line") >= min_chars).withColumn("line", key).where(F.length("line") >= min_chars)
    lines = scratch.write(lines.select("doc_id", "_row", "line_no", F.unhex(F.sha2("line", 256)).alias("sha"), F.xxhash64("line").alias("h")), "lines")
    n = lines.count()
    bits = min(max_bits, max(SEGMENT_BITS, math.ceil(math.log2(max(1, n * bits_per_line)))))
    shared = spark.sparkContext.broadcast(twice_seen(lines, bits))

    @F.pandas_udf(BooleanType())
    def seen_again(h: pd.Series) -> pd.Series:
        bitmap = shared.value
        hit = np.ones(len(h), bool)
        for pos in _positions(h.to_numpy(), bits):
            hit &= (bitmap[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    suspects = scratch.write(lines.where(seen_again("h")).drop("h"), "suspects")
    scratch.drop(lines)
    held = suspects.select("sha", "doc_id").distinct().groupBy("sha").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    confirmed = scratch.write(held.where(F.col("n") >= min_docs), "confirmed")
    hot = hot_keys(confirmed, "sha", "n", suspects.count())
    drops = salted_join(suspects, confirmed.select("sha", "keeper"), "sha", hot, "_row").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = scratch.write(drops.groupBy("_row").agg(F.collect_set("line_no").alias("_drop")), "drops")
    scratch.drop(suspects, confirmed)
    out = side.rows.withColumn("_row", row).join(drops.hint("merge"), "_row", "left")
    split = F.split(text, "\n", -1)
    out = out.withColumn("n_lines", F.size(split).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("_drop"))
    # the one-element array binds the lines to a variable, so that they are split once
    rebuilt = F.transform(F.array(split), lambda all_lines: F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))[0]
    out = out.withColumns({
        "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("_drop").isNull(), text).otherwise(rebuilt),
    })
    added = ("n_lines", "n_dropped", "kept_text")
    return out.select(*side.back(*added), *added)
