"""Exact search for the largest inner products: vectors by nearest pivot and distance, sorted annuli, triangle-inequality bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, give_back, shuffle_partitions

EXACT = 2.0**53  # below it, sums of whole numbers in double precision are exact
LONGEST = (1 << 63) - 1
SLACK = 1e-6  # of the largest length; far more than distances err by
SAMPLE = 4096  # vectors that pivots are picked from

_ROW = "_row long, vec_id long, no_id boolean, v binary, asks boolean, pivot int, r double"
_BLOCK = "cell long, block long, pivot int, r_lo double, r_hi double, n int, rows binary, ids binary, no_id binary, v binary"
_FOUND = "q long, query_id long, q_pivot int, vec_id long, score long, other long"


def whole(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null if the vector is null, or one is null or not finite, then or before."""
    scaled = F.transform(embedding.cast("array<double>"), lambda x: F.when(F.abs(x * scale) < F.lit(float("inf")), _floor(x * scale)))
    return F.when(~F.exists(scaled, lambda x: x.isNull()), scaled)


def _floor(x: Column) -> Column:
    """Whole numbers as doubles: floor() gives a long, which has no room for large ones; those are whole as they are."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def _matrix(cells, dim: int) -> np.ndarray:
    """Vectors, packed or as lists, as rows of length dim; shorter ones go on with zeros."""
    out = np.zeros((len(cells), dim))
    for i, c in enumerate(cells):
        v = np.frombuffer(c) if isinstance(c, bytes | bytearray) else np.asarray(c, float)
        out[i, : len(v)] = v
    return out


class Pivots:
    """Picked vectors, and distances to them in a space with one more component.

    There a vector x of length |x| gets sqrt(m^2 - |x|^2), a query 0, m being the largest length: all vectors are as
    long as each other, so a query's distance falls as the inner product with it rises.
    """

    def __init__(self, points: np.ndarray, longest: float):
        self.points, self.longest = points, longest
        self.extra = self._extra(points)

    def _extra(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        with np.errstate(all="ignore"):
            own = np.zeros(len(x)) if query else self._extra(x)
            square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", self.points, self.points) - 2 * x @ self.points.T
            return np.sqrt(np.maximum(square + (own[:, None] - self.extra) ** 2, 0))

    def reach(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance from each query within which scores of `least` lie, slack included; infinite where least is."""
        with np.errstate(all="ignore"):
            square = np.einsum("ij,ij->i", x, x) + self.longest**2 - 2 * least
            return np.sqrt(np.maximum(square, 0)) + SLACK * (self.longest + np.sqrt(np.einsum("ij,ij->i", x, x)))


def pick(sample: np.ndarray, n: int, longest: float) -> Pivots:
    """The farthest vector from those picked before, until there are n or all have been picked."""
    picked = [0]
    near = Pivots(sample[:1], longest).distances(sample, False)[:, 0]
    while len(picked) < n and np.nanmax(near, initial=0) > 0:
        picked.append(int(np.nanargmax(near)))
        near = np.fmin(near, Pivots(sample[picked[-1:]], longest).distances(sample, False)[:, 0])
    return Pivots(sample[picked], longest)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact; beyond a long, the nearest one."""
    with np.errstate(all="ignore"):
        most = math.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)) * math.sqrt(np.einsum("ij,ij->i", y, y).max(initial=0))
    if most < EXACT:
        return (x @ y.T).astype(np.int64)
    ints = np.vectorize(int, otypes=[object])
    return np.clip(ints(x) @ ints(y).T, -LONGEST - 1, LONGEST).astype(np.int64) if x.size and y.size else np.zeros((len(x), len(y)), np.int64)


class Best:
    """The k best of each query so far, ties to the smaller vec_id (none last), then to the smaller row."""

    def __init__(self, n: int, k: int):
        self.k, self.at = k, [[] for _ in range(n)]

    def offer(self, who: np.ndarray, s: np.ndarray, ids: list, rows: np.ndarray, least: np.ndarray, own: np.ndarray) -> None:
        """s: scores of the queries `who` with the rows; least: the score each query needs, which rises as its list fills."""
        for i, w in enumerate(who):
            enough = s[i] >= least[w]
            if len(rows) > 8 * self.k:  # those below the k-th of this block, the query's own row among them, can't be in
                enough &= s[i] >= np.partition(s[i], len(rows) - self.k - 1)[len(rows) - self.k - 1]
            new = [(-int(s[i, j]), ids[j] is None, ids[j] or 0, int(rows[j])) for j in np.flatnonzero(enough & (rows != own[w]))]
            if new:
                self.at[w] = sorted(self.at[w] + new)[: self.k]
                if len(self.at[w]) == self.k:
                    least[w] = max(least[w], -self.at[w][-1][0])


def _ids(b) -> list:
    """vec_ids of a block; none where the flags say so."""
    return [None if no else int(i) for i, no in zip(np.frombuffer(b.ids, np.int64), np.frombuffer(b.no_id, bool), strict=True)]


def _placed(frames: Iterator[pd.DataFrame], pivots: Pivots, dim: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        x = _matrix(f["v"], dim)
        d = pivots.distances(x, False)
        with np.errstate(all="ignore"):
            f["pivot"] = np.where(np.isnan(d), np.inf, d).argmin(1).astype(np.int32)
        # lengths whose squares are too large for a number bound nothing: reach() is infinite then
        f["r"] = np.nan_to_num(d[np.arange(len(f)), f["pivot"]], posinf=np.inf)
        f["v"] = [row.tobytes() for row in x]
        yield f[["_row", "vec_id", "no_id", "v", "asks", "pivot", "r"]]


def _blocks(frames: Iterator[pd.DataFrame], dim: int, block_bytes: int, cell_bytes: int) -> Iterator[pd.DataFrame]:
    """Vectors sorted by pivot and distance as annuli of at most block_bytes, and cells of consecutive annuli of about cell_bytes."""
    from pyspark import TaskContext

    most, part = max(1, block_bytes // (8 * dim)), TaskContext.get().partitionId() << 32
    block, cell, in_cell, last = part, part, 0, None
    held: list[pd.DataFrame] = []

    def out(f: pd.DataFrame) -> pd.DataFrame:
        nonlocal block, cell, in_cell, last
        pivot = int(f["pivot"].iloc[0])
        if last is not None and (pivot != last or in_cell >= cell_bytes):
            cell, in_cell = cell + 1, 0
        block, in_cell, last = block + 1, in_cell + 8 * dim * len(f), pivot
        rows, ids, none = (f[c].to_numpy(kind).tobytes() for c, kind in (("_row", np.int64), ("vec_id", np.int64), ("no_id", bool)))
        return pd.DataFrame([[cell, block, pivot, float(f["r"].min()), float(f["r"].max()), len(f), rows, ids, none, b"".join(f["v"])]],
                            columns=["cell", "block", "pivot", "r_lo", "r_hi", "n", "rows", "ids", "no_id", "v"])

    for f in frames:
        for _, part_of in f.groupby("pivot", sort=False):
            if held and int(held[0]["pivot"].iloc[0]) != int(part_of["pivot"].iloc[0]):
                yield out(pd.concat(held))
                held = []
            held.append(part_of)
            while sum(map(len, held)) >= most:
                all_of = pd.concat(held)
                yield out(all_of.iloc[:most])
                held = [all_of.iloc[most:]] if len(all_of) > most else []
    if held:
        yield out(pd.concat(held))
    give_back()


def _found(best: Best, q: list, query_ids: list, q_pivots: list) -> pd.DataFrame:
    rows = [(q[i], query_ids[i], q_pivots[i], None if no else v, -s, row) for i, top in enumerate(best.at) for s, no, v, row in top]
    # ids may be null, and pandas' own columns of numbers with gaps would round large ones
    return pd.DataFrame({name: pd.array([row[i] for row in rows], "Int64") for i, name in enumerate(("q", "query_id", "q_pivot", "vec_id", "score", "other"))})


def _own_annulus(frames: Iterator[pd.DataFrame], every: int, k: int, dim: int) -> Iterator[pd.DataFrame]:
    """The best of each query among the annulus that it lies in itself."""
    for f in frames:
        for b in f.itertuples():
            x, ids, rows = np.frombuffer(b.v).reshape(b.n, dim), _ids(b), np.frombuffer(b.rows, np.int64)
            who = [i for i, v in enumerate(ids) if v is not None and v % every == 0]
            best, least = Best(len(who), k), np.full(len(who), -np.inf)
            best.offer(np.arange(len(who)), scores(x[who], x), ids, rows, least, rows[who])
            yield _found(best, rows[who].tolist(), [ids[i] for i in who], [b.pivot] * len(who))


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int = 64, block_bytes: int = 1 << 18,
                       cell_bytes: int = 1 << 23, slab_bytes: int = 1 << 23) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k other rows of the largest inner product.

    A component x counts as floor(scale * x), in double precision; scores are exact whole numbers (beyond a long, the nearest one),
    ties go to the smaller vec_id, null ids last. A vector takes no part if it is null or holds a null or non-finite component (of x or
    scale * x). A row is not compared with itself, but with others of its vec_id; repeated queries are answered each. Shorter vectors
    go on with zeros; empty ones score 0. Fewer than k others: all. An empty table gives no rows. Other columns are not looked at.

    Pivots are picked by farthest-first from a sample of SAMPLE vectors; every vector is indexed: range-sorted by nearest pivot,
    distance and row, so that neither a hot pivot nor a crowd of copies is one task's, and written as annuli of block_bytes in cells of cell_bytes. A query
    asks its own annulus first, then those of its pivot, then those of all others, nearest first; triangle-inequality
    bounds against its k-th best so far leave out pivots' stretches before anything is shuffled, and end the search of a cell.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), whole(F.col("embedding"), scale).alias("v"))
    rows = scratch.write(rows.where("v is not null"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    answer = "query_id long, rank int, vec_id long, score long"
    if n < 2:
        return spark.createDataFrame([], answer)
    dim, longest = max(dim, 1), math.sqrt(longest)
    few = max(1, min(pivots, n // 64, (8 << 20) // (8 * dim)))
    sample = rows.orderBy(F.xxhash64("_row")).limit(min(SAMPLE, max(few, (32 << 20) // (8 * dim)))).select("v").collect()
    points = pick(_matrix([r.v for r in sample], dim), few, longest)
    placed = rows.withColumn("asks", ~F.col("no_id") & (F.col("vec_id") % every == 0)).mapInPandas(lambda it: _placed(it, points, dim), _ROW)
    placed = scratch.write(placed, "placed")
    scratch.drop(rows)
    parts = max(shuffle_partitions(spark), math.ceil(n * dim * 8 / (64 << 20)))
    dealt = placed.drop("asks").repartitionByRange(parts, "pivot", "r", "_row").sortWithinPartitions("pivot", "r", "_row")
    index = scratch.write(dealt.mapInPandas(lambda it: _blocks(it, dim, block_bytes, cell_bytes), _BLOCK), "index")
    cells = scratch.write(index.groupBy("cell", "pivot").agg(F.min("r_lo").alias("r_lo"), F.max("r_hi").alias("r_hi"), F.count("*").alias("blocks")), "cells")
    found = scratch.write(index.mapInPandas(lambda it: _own_annulus(it, every, k, dim), _FOUND), "found")
    asked = placed.where("asks").select(F.col("_row").alias("q"), F.col("vec_id").alias("query_id"), F.col("pivot").alias("q_pivot"), "v")
    for own in (True, False):
        more = scratch.write(_round(asked, found, index, cells, points, dim, k, own, slab_bytes, scratch), "found")
        found = scratch.write(_best(found.unionByName(more), k).drop("place"), "best")
    return _best(found, k).select("query_id", F.col("place").alias("rank"), "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _slabs(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each pivot with so many queries the first of its slabs and their number: pivots share a slab of about `most` queries, or have several."""
    out, at, held = {}, 0, 0
    for pivot, n in sorted(counts.items()):
        if held and held + n > most:
            at, held = at + 1, 0
        k = -(-n // most)
        out[pivot] = (at, k)
        at, held = (at + k, 0) if k > 1 else (at, held + n)
    return out


def _round(asked: DataFrame, found: DataFrame, index: DataFrame, cells: DataFrame, points: Pivots, dim: int, k: int, own: bool, slab_bytes: int, scratch: Scratch) -> DataFrame:
    """What queries find in the cells of their own pivot, or of all others, that may hold scores as good as their k-th so far."""
    kth = found.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("q", "least")
    asks = asked.join(kth.hint("merge"), "q", "left")
    per = _slabs({r.q_pivot: r.n for r in asked.groupBy("q_pivot").agg(F.count("*").alias("n")).collect()}, max(1, slab_bytes // (8 * dim)))
    of = lambda i: F.create_map(*[F.lit(x) for p, at in per.items() for x in (p, at[i])])[F.col("q_pivot")]
    asks = asks.withColumn("slab", (of(0) + F.pmod(F.xxhash64("q"), of(1))).cast("long")) if per else asks.withColumn("slab", F.lit(0).cast("long"))

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with the distances from each pivot between which they have to look."""
        for f in frames:
            x = _matrix(f["v"], dim)
            least = f["least"].fillna(-np.inf).to_numpy(float)
            reach, d = points.reach(x, least)[:, None], points.distances(x, True)
            with np.errstate(all="ignore"):
                lo, hi = d - reach, d + reach
            # what isn't a number bounds nothing
            f["lo"], f["hi"] = list(np.where(np.isnan(lo), -np.inf, lo)), list(np.where(np.isnan(hi), np.inf, hi))
            yield f[["slab", "q", "query_id", "q_pivot", "v", "least", "lo", "hi"]]

    fields = "slab long, q long, query_id long, q_pivot int, v binary, least double, lo array<double>, hi array<double>"
    slab = scratch.write(asks.withColumn("least", F.col("least").cast("double")).mapInPandas(reached, fields), "slabs")
    spans = slab.select("slab", "q_pivot", F.posexplode(F.arrays_zip("lo", "hi")).alias("pivot", "span"))
    spans = spans.where((F.col("pivot") == F.col("q_pivot")) == F.lit(own)).groupBy("slab", "pivot").agg(F.min("span.lo").alias("lo"), F.max("span.hi").alias("hi"))
    # a slab meets cells, not each query each vector
    pairs = spans.hint("merge").join(cells, "pivot").where("not (r_hi < lo or r_lo > hi)").select("slab", "cell")
    pairs = scratch.write(pairs, "pairs")
    vectors = index.join(pairs.hint("merge"), "cell")
    queries = slab.select("slab", "q", "query_id", "q_pivot", "v", "least").join(pairs.hint("merge"), "slab")

    def search(asks: pd.DataFrame, annuli: pd.DataFrame) -> pd.DataFrame:
        """Annuli of a cell, expanded from the nearest on, until the bound of the next one is beyond every query's reach."""
        if not len(asks) or not len(annuli):
            return _found(Best(0, k), [], [], [])
        x, q = _matrix(asks["v"], dim), asks["q"].to_numpy(np.int64)
        least, pivot = asks["least"].fillna(-np.inf).to_numpy(float), int(annuli["pivot"].iloc[0])
        looks = (asks["q_pivot"].to_numpy() == pivot) == own
        d = Pivots(points.points[pivot : pivot + 1], points.longest).distances(x, True)[:, 0]
        bounds = np.stack([np.maximum(np.maximum(d - b.r_hi, b.r_lo - d), 0) for b in annuli.itertuples()])
        bounds = np.where(np.isnan(bounds), 0, bounds)
        best, blocks = Best(len(q), k), list(annuli.itertuples())
        for i in np.argsort(np.where(looks, bounds, np.inf).min(1), kind="stable"):
            reach = points.reach(x, least)
            if not (looks & ~(bounds.min(0) > reach)).any():
                break
            b = blocks[i]
            who = np.flatnonzero(looks & ~(bounds[i] > reach))
            bounds[i] = np.inf
            if len(who):
                y = np.frombuffer(b.v).reshape(b.n, dim)
                best.offer(who, scores(x[who], y), _ids(b), np.frombuffer(b.rows, np.int64), least, q)
        return _found(best, q.tolist(), asks["query_id"].tolist(), asks["q_pivot"].tolist())

    return queries.groupBy("slab", "cell").cogroup(vectors.groupBy("slab", "cell")).applyInPandas(search, _FOUND)
