"""Scratch tables, deterministic folds, text constants and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed character values of the text contracts: what separates words, and A-Z.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; made up only in local mode, when it is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="clausemill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


# While an intermediate table is written: its shuffle files go once it is there, and Arrow batches
# are bounded by bytes, so that a batch of very long texts isn't larger than others.
WRITE_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Intermediate tables, written once to the shared folder and read back.

    A written table cuts lineage, survives lost executors and has a true size
    estimate, unlike a cached or locally checkpointed one. What is not dropped before
    stays for results that are still to be read, and goes with the session, or by release().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/clausemill-{uuid.uuid4().hex}"
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, at: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with settings(self.spark, WRITE_SETTINGS):
            df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, fs = self._fs(t._scratch)
            fs.delete(path, True)

    def release(self) -> None:
        """Deletes all tables; results that read them must have been written by then."""
        path, fs = self._fs(self.root)
        fs.delete(path, True)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system: idle workers are kept and would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Aside:
    """A table under working names, so that no column of it clashes with those an operator makes.

    rows has the columns c0, c1, ...; back() are these under their own names, without those
    whose name, letters in either case, an added column takes: the added one wins.
    """

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.rows = table.toDF(*[f"c{i}" for i in range(len(self.names))])
        self._at = {n.lower(): f"c{i}" for i, n in enumerate(self.names)}

    def __getitem__(self, name: str) -> Column:
        return F.col(self._at[name.lower()])

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._at

    def back(self, *added: str) -> list[Column]:
        taken = {a.lower() for a in added}
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in taken]

    def every(self) -> list[Column]:
        """All columns in a form that can be hashed: those that hold maps, which can't, as JSON."""
        return [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in self.rows.dtypes]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % parts


def row_key(*cols) -> Column:
    """128 bits that tell rows apart by the given columns; equal rows have equal keys."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_SHARE = 64
ONE_TASK = 1 << 19  # edges, 8 MB
SALTS = 32


def hot_keys(counts: DataFrame, key: str, n: str, rows: int) -> list:
    """Keys that hold more than a HOT_SHARE-th of all rows: fewer than HOT_SHARE, whatever the input."""
    if rows < 8 * HOT_SHARE:
        return []
    return [r[0] for r in counts.where(F.col(n) > rows / HOT_SHARE).select(key).collect()]


def heavy_values(table: DataFrame, column: str) -> list[int]:
    """Values of a long column that may hold more than a HOT_SHARE-th of all rows, in one pass: fewer than 2 * HOT_SHARE, whatever the input."""
    rows, top = table.agg(F.count("*"), F.expr(f"approx_top_k({column}, {HOT_SHARE})")).first()
    return [t["item"] for t in top if t["count"] > rows / HOT_SHARE] if rows >= 8 * HOT_SHARE else []


def salted_join(large: DataFrame, small: DataFrame, key: str, hot: list, spread: str, how: str = "inner") -> DataFrame:
    """large joined to small, which has one row for each key; rows of hot keys are spread over SALTS tasks by their spread column."""
    if not hot:
        return large.join(small.hint("merge"), key, how)
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = large.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = small.withColumn("_salt", F.explode(F.when(is_hot, salts).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def numbered(rows: DataFrame, key: str, scratch: Scratch, parts: int = 256) -> DataFrame:
    """rows, a written table, with _no: 1, 2, ... among rows of one key, in any order. A key's rows are numbered in parts, so that none is too large for a task."""
    dealt = scratch.write(rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")), "dealt")
    sizes = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(key, "_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    own = F.row_number().over(W.partitionBy(key, "_part").orderBy(F.lit(0)))
    out = dealt.withColumn("_own", own).join(offsets.hint("merge"), [key, "_part"])
    return out.withColumn("_no", F.col("_offset") + F.col("_own")).drop("_part", "_offset", "_own")


def _forest(frames: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Edges (a, b) of a task as edges (u, v) from each node to the smallest one that edges at hand connect it to; handed on at `most` nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def out() -> pd.DataFrame:
        ends = [(x, find(x)) for x in parent]
        parent.clear()
        return pd.DataFrame([e for e in ends if e[0] != e[1]], columns=["u", "v"], dtype=np.int64)

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > most:
            yield out()
    yield out()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), longs: component is the smallest node reachable.

    Every task first reduces the edges it holds to a forest. Where ONE_TASK edges or fewer are all there is, one task
    holds them all, and its forest is the result. Else alternating large-star and small-star rounds
    follow until nothing changes; each round is two groupings by node, and writes its edges to the shared folder. Edge lists never
    meet in one group: a round sends every neighbour to the group's minimum, found beforehand
    by a partial aggregate and joined back. Hubs, of which there are few, are salted in that join.
    """
    und = edges.select("a", "b").where("a <> b").distinct()
    few = edges.count() <= ONE_TASK
    cur = scratch.write((und.coalesce(1) if few else und).mapInPandas(_forest, "u long, v long"), "cc")
    if few:
        return _labels(cur)

    def state() -> tuple:
        rows, mark, top = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.expr(f"approx_top_k(v, {HOT_SHARE})")).first()
        return (rows, mark), [t["item"] for t in top if t["count"] > rows / HOT_SHARE] if rows >= 8 * HOT_SHARE else []

    before, hubs = state()
    for _ in range(max_rounds):
        # large star: neighbours larger than u go to the minimum of u and its neighbours
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), low, "u", hubs, "v")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u (the larger end) and its smaller neighbours go to their minimum; few are smaller, as edges point to minima by now
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low.hint("merge"), "u")
        small = step.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.write(small, "cc")
        scratch.drop(cur)
        cur = nxt
        now, hubs = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return _labels(cur)


def _labels(stars: DataFrame) -> DataFrame:
    """(node, component) for the edges (u, v) from nodes to their components' smallest ones."""
    own = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
