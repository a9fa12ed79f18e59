"""Embedding near-dedup over hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, give_back, heavy_values, salted_join
from .shingles import distinct

DEGREE = 12
OWN = 3  # slots for the vector inserted before, the one after, and the list hung on the nearest
BATCH = 128
ENTRIES = 4  # vectors a beam takes along to the layer below
SLACK = 1e-5  # more than single precision errs by in a cosine
UPPER = 32  # beam of the layers above the lowest in a search


class Graph:
    """Unit vectors with neighbour lists for each layer; layer 0 holds all vectors.

    The first slots of every list link a vector with the one inserted before it in its layer, so that each
    layer is connected and a beam as wide as the shard sees all of it.
    """

    def __init__(self, unit: np.ndarray, links: list[np.ndarray], top: int):
        self.unit, self.links, self.top = unit, links, top

    @classmethod
    def build(cls, unit: np.ndarray, seed: int, beam: int = 48) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(rng.random(n)) / math.log(DEGREE)).astype(int), 4)
        levels[0] = levels.max()
        links = [np.full((n, (2 if l == 0 else 1) * DEGREE + OWN), -1, np.int32) for l in range(int(levels[0]) + 1)]
        g = cls(unit, links, 0)
        last = [-1] * len(links)
        at = 0
        while at < n:
            end = min(n, max(at + 1, min(at + BATCH, 2 * at)))
            new = np.arange(at, end)
            entry = np.zeros((len(new), 1), np.int64)
            for l in range(len(links) - 1, -1, -1):
                here = new[levels[new] >= l]
                if at:
                    ids, _ = g._beam(unit[new], entry, l, beam if l == 0 or len(here) else 1)
                    entry = ids[:, :ENTRIES]
                else:
                    ids = np.full((len(new), 1), -1)
                for v in here:
                    near = ids[v - at]
                    near = np.unique(np.concatenate([near[near >= 0], here[here < v]]))
                    near = near[levels[near] >= l]
                    if last[l] >= 0:
                        links[l][v, 0], links[l][last[l], 1] = last[l], v
                    last[l] = int(v)
                    if len(near):
                        g._connect(int(v), near, l)
            at = end
        return g

    def _connect(self, v: int, near: np.ndarray, layer: int) -> None:
        table = self.links[layer]
        most = table.shape[1] - OWN
        sims = self.unit[near] @ self.unit[v]
        near = near[np.argsort(-sims)][: 3 * most]
        among = self.unit[near] @ self.unit[near].T
        to_v = among_v = self.unit[near] @ self.unit[v]
        picked: list[int] = []
        # first those nearer to v than to any picked one, so that lists point in all directions
        for i in range(len(near)):
            if len(picked) >= most // 2:
                break
            if not picked or to_v[i] > among[i, picked].max():
                picked.append(i)
        picked += [i for i in range(len(near)) if i not in picked][: most - len(picked)]
        table[v, OWN : OWN + len(picked)] = near[picked]
        # a list hung on the nearest vector, so that each is reached from there however crowded lists are
        table[v, 2], table[near[0], 2] = table[near[0], 2], v
        for i in picked:
            u = near[i]
            row = table[u, OWN:]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = v
            else:
                s = self.unit[row] @ self.unit[u]
                worst = int(s.argmin())
                if s[worst] < among_v[i]:
                    row[worst] = v

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, width: int, found=None, least: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of many queries at once; found gets (query, vector) of all seen with similarity >= least."""
        n, rows = len(self.unit), np.arange(len(q))
        table = self.links[layer]
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        width = min(width, n)
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -np.inf, np.float32)
        open_ = np.zeros((len(q), width), bool)
        r, c = np.nonzero(entry[:, :width] >= 0)
        v = entry[r, c]
        ids[r, c], open_[r, c], seen[r, v] = v, True, True
        s = np.einsum("kd,kd->k", self.unit[v], q[r])
        sims[r, c] = s
        if found is not None:
            found.append((r[s >= least], v[s >= least]))
        step = 4 if width >= 8 else 1
        while open_.any():
            score = np.where(open_, sims, -np.inf)
            best = np.argpartition(-score, min(step, width) - 1, axis=1)[:, : min(step, width)]
            live = np.take_along_axis(open_, best, 1)
            np.put_along_axis(open_, best, False, 1)
            nb = table[np.take_along_axis(ids, best, 1)].astype(np.int64)
            nb = np.where(live[:, :, None], nb, -1).reshape(len(q), -1)
            nb.sort(axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[nb < 0] = n
            nb[seen[rows[:, None], nb]] = n
            seen[rows[:, None], nb] = True
            r, c = np.nonzero(nb < n)
            s = np.full(nb.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("kd,kd->k", self.unit[nb[r, c]], q[r])
            if found is not None:
                hit = s[r, c] >= least
                found.append((r[hit], nb[r, c][hit]))
            all_s, all_i = np.concatenate([sims, s], 1), np.concatenate([ids, nb], 1)
            all_o = np.concatenate([open_, s > -np.inf], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims, ids, open_ = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, all_o))
        order = np.argsort(-sims, axis=1)
        return np.where(np.take_along_axis(sims, order, 1) > -np.inf, np.take_along_axis(ids, order, 1), -1), np.take_along_axis(sims, order, 1)

    def near(self, q: np.ndarray, least: float, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of similarity >= least that a beam of this width comes across; own: where the queries are in the graph."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            if own is not None:
                entry = own[at : at + BATCH, None]
            else:
                entry = np.zeros((len(part), 1), np.int64)
                for l in range(len(self.links) - 1, 0, -1):
                    entry = self._beam(part, entry, l, UPPER)[0][:, :ENTRIES]
            found: list = []
            self._beam(part, entry, 0, width, found, least)
            out += [(r + at, v) for r, v in self._flood(part, found, least)]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _flood(self, q: np.ndarray, found: list, least: float, chunk: int = 1 << 15) -> list[tuple[np.ndarray, np.ndarray]]:
        """found, and all that links of found vectors lead to without leaving the range: a group larger than a beam comes whole."""
        table, n = self.links[0], len(self.unit)
        seen = np.zeros((len(q), n), bool)
        rows, vs = np.concatenate([r for r, _ in found]), np.concatenate([v for _, v in found])
        seen[rows, vs] = True
        out = [(rows, vs)]
        queue = [(rows, vs)]
        while queue:
            rows, vs = queue.pop()
            for at in range(0, len(rows), chunk):
                nb = table[vs[at : at + chunk]].astype(np.int64)
                r = np.repeat(rows[at : at + chunk], nb.shape[1])
                nb = nb.reshape(-1)
                new = nb >= 0
                new[new] = ~seen[r[new], nb[new]]
                key = distinct(r[new] * n + nb[new])
                r, nb = key // n, key % n
                seen[r, nb] = True
                hit = np.zeros(len(r), bool)
                for i in range(0, len(r), chunk):
                    hit[i : i + chunk] = np.einsum("kd,kd->k", self.unit[nb[i : i + chunk]], q[r[i : i + chunk]]) >= least
                if hit.any():
                    out.append((r[hit], nb[hit]))
                    queue.append((r[hit], nb[hit]))
        return out

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, *self.links)
        return f.getvalue()

    @classmethod
    def load(cls, unit: np.ndarray, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as z:
            return cls(unit, [z[k] for k in z.files], 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _scaled(raw: bytes, dim: int) -> np.ndarray:
    """Vectors with their largest component between 0.5 and 1: by powers of two, so that no cosine changes and no square leaves the range of doubles."""
    x = np.frombuffer(raw, np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _audited(g: Graph, q: np.ndarray, least: float, width: int, audit: int, recall: float, own: bool = False, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(query, vector, whole) of similarity >= least in parts, found by a beam widened until it finds `recall` of what brute force does.

    Blocks of queries dealt at random are compared with all vectors until `audit` groups of links are met: a query
    of k links counts 1/k, so that a crowd is about one group. Where the queries end first, or the links met are more than `most`,
    brute force goes on to the end. whole says that the part has all links of its queries, by brute force; such parts come first.
    own: the queries are the graph's vectors; a vector's link with itself is left out.
    """
    n = len(g.unit)
    order = np.random.default_rng(len(q)).permutation(len(q))
    done, met, held, true = 0, 0.0, 0, []
    while done < len(q) and (met < audit or held > most):
        some = order[done : done + BATCH]
        hit = q[some] @ g.unit.T >= least
        if own:
            hit[np.arange(len(some)), some] = False
        links = hit.sum(1)
        met += (1 / links[links > 0]).sum()
        a, v = np.nonzero(hit)
        yield some[a], v, True
        held += len(a)
        if held <= most:
            true.append((some[a], v))
        done += len(some)
    if done == len(q):
        return
    a, v = np.concatenate([x for x, _ in true]), np.concatenate([x for _, x in true])
    linked = distinct(a)
    while width < n:
        i, w = g.near(q[linked], least, width, linked if own else None)
        if np.isin(a * n + v, linked[i] * n + w).sum() >= recall * len(a):
            break
        width *= 2
    for at in range(done, len(q), BATCH):
        rest = order[at : at + BATCH]
        i, w = g.near(q[rest], least, width, rest if own else None)
        i = rest[i]
        yield (i[i != w], w[i != w], False) if own else (i, w, False)


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the nodes of each pair are connected: the smallest number of each component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _block_links(g: Graph, q: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, own: bool, threshold: float, how: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(others, root) for the vectors x of the graph and behind them, unless they are the same (own), the vectors y of the queries.

    others: how many vectors, copies counted (nx, ny), a vector links with here; root: the smallest vector that links here connect it to. No list of
    links is kept but of those that only a search found.
    """
    n, at_q = len(x), 0 if own else len(x)
    size = n + (0 if own else len(y))
    copies = nx if own else np.concatenate([nx, ny])
    root, there, back, whole = np.arange(size), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    lx, ly = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    pending: list[np.ndarray] = []

    def checked(a: np.ndarray, v: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 14):
            i, j = a[at : at + (1 << 14)], v[at : at + (1 << 14)]
            ok[at : at + (1 << 14)] = np.einsum("kd,kd->k", y[i], x[j]) / (ly[i] * lx[j]) >= threshold
        return ok

    for a, v, complete in _audited(g, q, *how, own):
        whole[a + at_q] |= complete
        ok = checked(a, v)
        a, v = a[ok] + at_q, v[ok]
        if own and not complete:
            # links of these with complete ones are known from there; each other is counted once, whichever end found it
            new = ~whole[v]
            pending.append(distinct(np.minimum(a, v)[new] * n + np.maximum(a, v)[new]))
        else:
            np.add.at(there, a, copies[v])
            np.add.at(back, v, copies[a])
            root = _hook(root, a, v)
    if not own:
        return there + back, root
    if pending:
        pairs = distinct(np.concatenate(pending))
        a, v = pairs // n, pairs % n
        np.add.at(there, a, copies[v])
        np.add.at(there, v, copies[a])
        root = _hook(root, a, v)
    return np.where(whole, there, there + back), root


def embedding_links(vectors: DataFrame, threshold: float = 0.98, shard_size: int = 16384, beam: int = 64, audit: int = 256, recall: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors of one label link when their cosine in double precision is at least threshold.
    Vectors that are null, zero, or hold null or non-finite components, and those without a label, link
    with nothing; nor do vectors of different length. Repeated rows are further vectors; one without a vec_id
    counts as a link, and is kept. Extra columns are not looked at, whatever their names.

    Equal vectors of a label are one entry of the index, with a count. A label's entries go to
    shards of about shard_size by hashed id, each with a graph of its own, and every shard
    is asked for the links of each shard of its label that doesn't come before it: a vector's
    searches grow with the number of shards, so these are as large as one task builds well. A
    beam widens, up to the whole shard, until it finds all links of queries that brute force has
    found to have some; where too few have any, or some have very many, brute force answers all queries. Links of
    vectors found within range are followed, whatever the beam's width; pairs found are
    checked in double precision. Of the links of two shards only each vector's number and the forest that connects
    them leave the task, so that a group of close vectors makes no row per pair.
    """
    scratch = Scratch(vectors.sparkSession)
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("ok", F.coalesce(fine & (largest > 0), F.lit(False)))
    key = F.struct(F.xxhash64("label", "embedding").alias("a"), F.xxhash64(F.lit(1), "label", "embedding").alias("b"))
    rows = rows.withColumn("key", F.when(F.col("ok"), key))
    reps = rows.where("ok").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    reps = reps.withColumns({"dim": F.size("embedding"), "h": F.xxhash64("key")})
    reps = scratch.write(reps.withColumn("grp", F.xxhash64("label", "dim")), "reps")
    # labels whose hashes meet share a number of shards, no more
    shards = scratch.write(reps.groupBy("grp").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards")), "shards")
    dealt = salted_join(reps, shards, "grp", heavy_values(reps, "grp"), "h").withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        g = Graph.build(_unit(_scaled(x.tobytes(), x.shape[1])), int(pdf["shard"].iloc[0]))
        first = pdf.iloc[0]
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "shards": [first["shards"]],
                             "ids": [pdf["h"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "vecs": [x.tobytes()], "graph": [g.dump()]})

    label_type = reps.schema["label"].dataType.simpleString()
    wanted = dealt.select(F.col("label"), "dim", "shard", "shards", "h", "copies", "embedding")
    graphs = wanted.groupBy("label", "dim", "shard").applyInPandas(build, f"label {label_type}, dim int, shard int, shards int, ids binary, copies binary, vecs binary, graph binary")
    graphs = scratch.write(graphs, "graphs")
    group = ["label", "dim"]
    asks = scratch.write(graphs.select(*group, "shard", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("asked")), "asks")
    index = graphs.select(*group, "shard", "ids", "copies", "vecs", "graph")
    queries = graphs.select(*group, F.col("shard").alias("asked"), F.col("ids").alias("q_ids"), F.col("copies").alias("q_copies"), F.col("vecs").alias("q_vecs"))
    work = asks.join(index.hint("merge"), [*group, "shard"]).join(queries.hint("merge"), [*group, "asked"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                own = r.shard == r.asked
                x, y = _scaled(r.vecs, r.dim), _scaled(r.q_vecs, r.dim)
                nx, ny = np.frombuffer(r.copies, np.int64), np.frombuffer(r.q_copies, np.int64)
                g, q = Graph.load(_unit(x), r.graph), _unit(y)
                others, root = _block_links(g, q, x, y, nx, ny, own, threshold, (threshold - SLACK, beam, audit, recall))
                ids = np.frombuffer(r.ids if own else r.ids + r.q_ids, np.int64)
                some = np.flatnonzero(others)
                yield pd.DataFrame({"h": ids[some], "others": others[some], "root": ids[root[some]]})
        give_back()

    parts = work.select("dim", "shard", "asked", "ids", "copies", "vecs", "graph", "q_ids", "q_copies", "q_vecs")
    links = scratch.write(parts.mapInPandas(search, "h long, others long, root long"), "links")
    scratch.drop(graphs, asks)
    labels = scratch.write(connected_components(links.select(F.col("h").alias("a"), F.col("root").alias("b")), scratch), "labels")
    counted = links.groupBy("h").agg(F.sum("others").alias("others"))
    told = reps.select("h", "rep", "copies", "key").join(counted.hint("merge"), "h", "left").join(labels.withColumnRenamed("node", "h").hint("merge"), "h", "left")
    told = scratch.write(told.select("key", "rep", F.coalesce("component", "h").alias("c"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n")), "told")
    least = scratch.write(told.groupBy("c").agg(F.min("rep").alias("component_id")), "least")
    told = salted_join(told, least, "c", heavy_values(told, "c"), "key").select("key", "n", "component_id")
    out = rows.select("vec_id", "key").join(told.hint("merge"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
