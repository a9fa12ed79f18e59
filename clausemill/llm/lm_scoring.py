"""Language-model scores by online logistic context mixing, and a unigram base score."""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context_mixing as cm
from .common import Scratch, give_back
from .shingles import distinct

END_TOKEN = b""
PARTS = 16
HEAD_BYTES = 64  # longer tokens are never sent to the executors
BLOCK_TEXTS = 1 << 16
BUCKET_BYTES = 16 << 20  # text for each bucket of contexts


def tokens(text: bytes | None) -> Counter:
    """Words of the text with A-Z lowered, and one end."""
    c = Counter((text or b"").lower().split())
    c[END_TOKEN] += 1
    return c


def token_counts(texts: DataFrame, flush: int = 1 << 17, flush_bytes: int = 16 << 20) -> DataFrame:
    """(token, c) over all rows of texts (text binary). Tasks hand on what they hold at flush tokens, or after flush_bytes of text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _unpacked.clear()  # tables of an earlier model that this worker may hold
        total: Counter = Counter()
        size = 0

        def out() -> pd.DataFrame:
            df = pd.DataFrame({"token": list(total), "n": list(total.values())})
            total.clear()
            return df

        for f in frames:
            for t in f["text"]:
                total.update((t or b"").lower().split())
                total[END_TOKEN] += 1
                size += len(t or b"")
                if len(total) > flush or size > flush_bytes:
                    yield out()
                    size = 0
        if total:
            yield out()
        give_back()

    return texts.mapInPandas(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def _packed(code: np.ndarray) -> bytes:
    """Sorted codes, byte by byte, compressed."""
    return zlib.compress(np.ascontiguousarray(code.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    six = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(6, -1)
    wide = np.zeros((six.shape[1], 8), np.uint8)
    wide[:, :6] = six.T
    return wide.view(np.int64).reshape(-1)


def _blob(rows: list[int], texts: list[bytes]) -> bytes:
    """A block of texts and their row numbers, compressed."""
    head = np.array([len(rows), *rows, *map(len, texts)], np.int64)
    return zlib.compress(head.tobytes() + b"".join(texts), 1)


def _unblob(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n + 1)
    ends = (8 * (2 * n + 1) + np.cumsum(head[n + 1 :])).tolist()
    return head[1 : n + 1], [raw[i:j] for i, j in zip([8 * (2 * n + 1), *ends], ends, strict=False)]


def _occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes, how often each occurs, and in which text each occurrence is, in that order. At most BLOCK_TEXTS texts."""
    code, lengths = cm.codes_of(texts)
    # a code has 48 bits: with the number of its text behind it, one sort does all
    both = (code.astype(np.uint64) << np.uint64(16)) | np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    both.sort()
    code, text = (both >> np.uint64(16)).astype(np.int64), (both & np.uint64(0xFFFF)).astype(np.int64)
    first = cm.starts_of(code)
    return code[first], np.diff(np.append(first, len(code))), text


def _dealt(code: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the codes by bucket, then code, and (bucket, from, to) in it; a bucket has all codes of a context of 3 bytes."""
    at = ((cm.kin(code) >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = cm.starts_of(at)
    return order, list(zip(at[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True))


def context_counts(texts: DataFrame, buckets: int, block_bytes: int = 3 << 20) -> DataFrame:
    """(bucket, codes, counts): how often each byte follows each 5-byte context, over all rows of texts.

    Tasks count blocks of block_bytes on their own; counts meet by bucket of the context's last 3 bytes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue: list[bytes] = []
        size = 0

        def out() -> pd.DataFrame:
            code, n, _ = _occurrences(queue)
            order, parts = _dealt(code, buckets)
            code, n = code[order], n[order].astype(np.uint32)
            return pd.DataFrame([(b, _packed(code[i:j]), n[i:j].tobytes()) for b, i, j in parts], columns=["bucket", "codes", "counts"])

        for f in frames:
            for t in f["text"]:
                queue.append(t or b"")
                size += len(queue[-1]) + 6
                if size > block_bytes or len(queue) == BLOCK_TEXTS:
                    yield out()
                    queue, size = [], 0
        if queue:
            yield out()
        give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]])
        code = np.concatenate([_unpack(x) for x in pdf["codes"]])
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = cm.starts_of(code)
        total = np.add.reduceat(n.astype(np.int64), first)
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "codes": [code[first].tobytes()], "counts": [total.tobytes()]})

    packed = texts.mapInPandas(run, "bucket int, codes binary, counts binary")
    return packed.groupBy("bucket").applyInPandas(merge, "bucket int, codes binary, counts binary")


def slot_tables(contexts: DataFrame) -> list[np.ndarray]:
    """Quantised counts of the contexts of 0 to 2 bytes: every one has a slot, and so what reaches the driver is fixed."""
    width = 1 << cm.RANGE_BITS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for codes, counts in zip(f["codes"], f["counts"], strict=True):
                every, each = np.frombuffer(codes, np.int64), np.frombuffer(counts, np.int64)
                for at, k in itertools.product(range(0, len(every), 1 << 18), range(cm.DENSE)):
                    code, n = every[at : at + (1 << 18)], each[at : at + (1 << 18)]
                    where = np.concatenate([cm.slots(code, node, k) * 2 + bit for node, bit in cm.bits_of(code)])
                    if cm.SLOT_BITS[k] <= 16:
                        total = np.bincount(where, np.tile(n, 8))
                        u = np.flatnonzero(total)
                        total = total[u]
                    else:
                        u, back = np.unique(where, return_inverse=True)
                        total = np.bincount(back, np.tile(n, 8))
                    held, first = np.unique(u >> (cm.RANGE_BITS + 1), return_index=True)
                    yield pd.DataFrame({"order": k, "range": held, "slots": [u[i:j].tobytes() for i, j in zip(first, [*first[1:], len(u)], strict=True)],
                                        "counts": [total[i:j].tobytes() for i, j in zip(first, [*first[1:], len(u)], strict=True)]})

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # lists come batch by batch: however many buckets there are, a task holds one range of cells
        both = np.zeros(2 * width)
        for pdf in batches:
            for s, c in zip(pdf["slots"], pdf["counts"], strict=True):
                at = np.frombuffer(s, np.int64) & (2 * width - 1)
                both[at] += np.frombuffer(c, np.float64)
        q = cm.quantised(both[0::2], both[1::2])
        yield pd.DataFrame({"order": [key[0]], "range": [key[1]], "cells": [q.tobytes()]})

    parts = contexts.mapInPandas(run, "order int, range long, slots binary, counts binary")
    merged = parts.groupBy("order", "range").applyInPandas(merge, "order int, range long, cells binary")
    tables = [np.zeros(max(width, 1 << b), np.uint16) for b in cm.SLOT_BITS]
    for r in merged.toLocalIterator():
        tables[r["order"]][r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["cells"], np.uint16)
    return [t[: 1 << b] for t, b in zip(tables, cm.SLOT_BITS, strict=True)]


_unpacked: dict[str, list[np.ndarray]] = {}


class SharedTables:
    """Slot tables on their way to the executors: sent once, compressed, unpacked once in each Python worker."""

    def __init__(self, texts: DataFrame, tables: list[np.ndarray]):
        self.name = uuid.uuid4().hex
        self.packed: Broadcast = texts.sparkSession.sparkContext.broadcast([zlib.compress(t.tobytes(), 1) for t in tables])

    def model(self, params: np.ndarray | None = None, refine: np.ndarray | None = None) -> cm.Model:
        if self.name not in _unpacked:
            _unpacked.clear()
            _unpacked[self.name] = [np.frombuffer(zlib.decompress(t), np.uint16) for t in self.packed.value]
        return cm.Model(_unpacked[self.name], cm.start_params() if params is None else params.copy(), refine)


def train(contexts: DataFrame) -> tuple[SharedTables, np.ndarray, np.ndarray]:
    """The model of all contexts: tables of the short ones, mixer parameters, refinement.

    Counts of all contexts are sums over the corpus; those of 3 bytes and more are read off the codes of
    their bucket. The mixer then learns online from every distinct (context, byte), weighed by its
    occurrences and with one occurrence left out of the counts; each bucket of contexts trains a
    mixer from the same start, and their average by occurrences is kept. The refinement
    counts outcomes of that mixer's predictions.
    """
    shared = SharedTables(contexts, slot_tables(contexts))

    def mixers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for bucket, codes, counts in zip(f["bucket"], f["codes"], f["counts"], strict=True):
                m = shared.model()
                n = np.frombuffer(counts, np.int64)
                cm.learn(m, np.frombuffer(codes, np.int64), n)
                yield pd.DataFrame({"part": [bucket % PARTS], "x": [(m.params * n.sum()).tobytes()], "mass": [float(n.sum())]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sum([np.frombuffer(v, np.float64) for v in pdf["x"]], 0)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "x": [x.tobytes()], "mass": [pdf["mass"].sum()]})

    # a mixer travels as one packed row; PARTS rows reach the driver
    schema = "part int, x binary, mass double"
    sums = contexts.mapInPandas(mixers, schema).groupBy("part").applyInPandas(summed, schema).orderBy("part")
    params, mass = np.zeros(cm.PARAMS), 0.0
    for r in sums.toLocalIterator():
        params += np.frombuffer(r["x"], np.float64)
        mass += r["mass"]
    params = np.round(params / mass, 9) if mass else cm.start_params()

    def outcomes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones, total = np.zeros(256 * cm.BINS), np.zeros(256 * cm.BINS)
        model = shared.model(params)
        for f in frames:
            for codes, counts in zip(f["codes"], f["counts"], strict=True):
                a, b = cm.refinement(model, np.frombuffer(codes, np.int64), np.frombuffer(counts, np.int64))
                ones += a
                total += b
        held = np.flatnonzero(total)
        yield pd.DataFrame({"i": held, "ones": ones[held], "total": total[held]})

    ones, total = np.zeros(256 * cm.BINS), np.zeros(256 * cm.BINS)
    for r in contexts.mapInPandas(outcomes, "i int, ones double, total double").groupBy("i").agg(F.sum("ones").alias("ones"), F.sum("total").alias("total")).toLocalIterator():
        ones[r["i"]], total[r["i"]] = r["ones"], r["total"]
    return shared, params, cm.refined(ones, total)


def code_costs(asked: DataFrame, contexts: DataFrame, shared: SharedTables, params: np.ndarray, refine: np.ndarray) -> DataFrame:
    """(block, bucket, costs) for rows of asked (block, bucket, codes): the model's costs, looked up among all contexts of the bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known, asks = pdf[pdf["counts"].notna()], pdf[pdf["counts"].isna()]
        codes = [_unpack(x) for x in asks["codes"]]
        held = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in known["codes"])])
        if not codes:
            return pd.DataFrame({"block": [], "bucket": [], "costs": []})
        code = distinct(np.concatenate([held, *codes]))
        count = np.zeros(len(code), np.int64)
        if len(held):
            count[np.searchsorted(code, held)] = np.concatenate([np.frombuffer(x, np.int64) for x in known["counts"]])
        cost = shared.model(params, refine).costs(code, count).astype(np.float32)
        return pd.DataFrame({"block": asks["block"], "bucket": asks["bucket"], "costs": [cost[np.searchsorted(code, c)].tobytes() for c in codes]})

    both = asked.withColumn("counts", F.lit(None).cast("binary")).unionByName(contexts.withColumn("block", F.lit(0).cast("long")))
    return both.groupBy("bucket").applyInPandas(run, "block long, bucket int, costs binary")


def block_scores(blocks: DataFrame, costs: DataFrame, buckets: int) -> DataFrame:
    """(row, score) for every text of blocks (block, blob)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, texts = _unblob(left["blob"].iloc[0])
        told = dict(zip(right["bucket"], right["costs"], strict=True))
        code, n, text = _occurrences(texts)
        order, parts = _dealt(code, buckets)
        cost = np.empty(len(code))
        cost[order] = np.concatenate([np.frombuffer(told[b], np.float32) for b, _, _ in parts])
        return pd.DataFrame({"row": rows, "score": np.bincount(text, np.repeat(cost, n), len(texts))})

    return blocks.groupBy("block").cogroup(costs.groupBy("block")).applyInPandas(run, "row long, score double")


def score_texts(docs: DataFrame, held_out: Column, head_size: int = 1 << 16, block_bytes: int = 3 << 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs.

    Everything is learnt from the texts of rows where held_out is false, and all whole texts are
    scored. score is the context mixing model's log10 probability of the text's UTF-8
    bytes and its end; bits_per_byte follows from it. base_score is a smoothed unigram
    score of words. Null text counts as empty: one token, the end. Repeated rows count and are scored
    again; columns other than doc_id, text and those of held_out aren't looked at. Without
    training texts counts are 0 and the smoothing alone defines the scores.

    The head_size commonest tokens of at most HEAD_BYTES bytes are sent to the executors; other tokens of each
    text join the count table, where none is common enough to crowd a task. The codes (context and byte)
    of each block of texts join the contexts by bucket, whose number follows the bytes of docs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    told = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    train_rows = told.where(~F.col("held_out")).select("text")
    counts = scratch.write(token_counts(train_rows), "tokens")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = {bytes(r["token"]): r["c"] for r in counts.where(F.length("token") <= HEAD_BYTES).orderBy(F.desc("c"), "token").limit(head_size).toLocalIterator()}
    whole = math.log10(n + 0.1 * (v + 1))
    size = told.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(size / bucket_bytes))
    contexts = scratch.write(context_counts(train_rows, buckets), "contexts")
    shared_tables, params, refine = train(contexts)
    shared = spark.sparkContext.broadcast({t: (c, math.log10(c + 0.1) - whole) for t, c in head.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for f in frames:
            rows, numbers, queue, size = [], [], [], 0
            for i, (at, t) in enumerate(zip(f["row"], f["text"], strict=True)):
                t = t or b""
                base, known, number = 0.0, 0, 0
                tail, tail_n = [], []
                for w, k in tokens(t).items():
                    number += k
                    if (hit := common.get(w)) is not None:
                        base += k * hit[1]
                        known += k
                    else:
                        tail.append(w)
                        tail_n.append(k)
                numbers.append(at)
                queue.append(t)
                size += len(t) + 6
                blob = None
                if size > block_bytes or len(queue) == BLOCK_TEXTS or i == len(f) - 1:
                    blob = _blob(numbers, queue)
                    numbers, queue, size = [], [], 0
                rows.append((blob, number, known, base, len(t), tail, tail_n))
            out = pd.DataFrame(rows, columns=["blob", "n_tokens", "head_known", "head_base", "n_bytes", "tail", "tail_n"])
            for c in ("row", "doc_id", "held_out"):
                out[c] = f[c]
            yield out

    # numbered as they are written, so that the numbers hold from then on
    parts = told.withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        run, "row long, blob binary, doc_id string, held_out boolean, n_tokens long, head_known long, head_base double, n_bytes long, tail array<binary>, tail_n array<long>")
    parts = scratch.write(parts, "parts")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, blob in zip(f["block"], f["blob"], strict=True):
                code = _occurrences(_unblob(blob)[1])[0]
                order, parts = _dealt(code, buckets)
                code = code[order]
                yield pd.DataFrame([(block, b, _packed(code[i:j])) for b, i, j in parts], columns=["block", "bucket", "codes"])
        give_back()

    # the last row of a block carries its texts
    blocks = parts.where(F.col("blob").isNotNull()).select(F.col("row").alias("block"), "blob")
    asked = blocks.mapInPandas(ask, "block long, bucket int, codes binary")
    scores = scratch.write(block_scores(blocks, code_costs(asked, contexts, shared_tables, params, refine), buckets), "scores")
    scratch.drop(contexts)
    tail = parts.select("row", F.explode(F.arrays_zip(F.col("tail").alias("token"), F.col("tail_n").alias("k"))).alias("x")).select("row", "x.token", "x.k")
    met = tail.join(counts.hint("merge"), "token", "left")
    cost = F.log10(F.coalesce("c", F.lit(0)) + 0.1) - F.lit(whole)
    sums = met.groupBy("row").agg(F.sum(F.col("k") * cost).alias("tail_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("tail_known"))
    out = parts.drop("tail", "tail_n", "blob").join(scores.hint("merge"), "row").join(sums.hint("merge"), "row", "left")
    return out.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score",
        (F.col("score") * -math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
