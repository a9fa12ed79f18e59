"""Benchmark decontamination by pigeonhole edit matching with Myers bit-parallel distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Aside, Scratch

SCHEMA = "doc_id long, item_id long, distance int, budget int, start long"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64())])


def normal(text: str | None) -> str:
    """Lower case, every run of white space one blank."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces (offset, text) of nearly equal length: an occurrence with budget edits leaves one whole."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[str, int], m: int, window: str, limit: int) -> tuple[int, int]:
    """Least edit distance of a pattern to any substring of window, and that substring's end; stops at 0."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = limit + 1, -1
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return best, end


class Matcher:
    """An automaton of the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        """items: (item_id, text in normal form)."""
        self.items, where = [], {}
        for item_id, t in items:
            budget = int(len(t) * error_rate)
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | (1 << i)
            for at, piece in pieces(t, budget):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, t, budget, masks))
        self.auto = ahocorasick.Automaton()
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        if where:
            self.auto.make_automaton()

    def match(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, start) for each item that occurs within its budget: its best place."""
        t = normal(text)
        if not t or not self.items:
            return []
        diagonals: dict[int, set[int]] = {}
        for end, (size, at) in self.auto.iter(t):
            start = end - size + 1
            for item, offset in at:
                diagonals.setdefault(item, set()).add(start - offset)
        found = []
        for item, starts in diagonals.items():
            item_id, pattern, budget, masks = self.items[item]
            m = len(pattern)
            best = None
            if any(t.startswith(pattern, s) for s in starts if s >= 0):
                best = (0, min(s for s in starts if s >= 0 and t.startswith(pattern, s)))
            else:
                spans: list[list[int]] = []
                for s in sorted(starts):
                    lo, hi = max(0, s - budget), s + m + budget
                    if spans and lo <= spans[-1][1] - m:
                        spans[-1][1] = hi
                    else:
                        spans.append([lo, hi])
                for lo, hi in spans:
                    d, end = myers(masks, m, t[lo:hi], budget)
                    if d <= budget and (best is None or d < best[0]):
                        best = (d, max(0, lo + end - m))
            if best:
                found.append((item_id, best[0], budget, best[1]))
        return found


def _item_blocks(benchmark: DataFrame, block_chars: int) -> DataFrame:
    """Benchmark items in normal form, packed by tasks to rows (ids, texts) of about block_chars characters; a longer item is a row of its own."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        texts: list[str] = []
        size = 0
        for f in frames:
            for item, text in zip(f["item_id"], f["text"], strict=True):
                t = normal(text)
                if not t:
                    continue
                if texts and size + len(t) > block_chars:
                    yield pd.DataFrame({"ids": [ids], "texts": [texts]})
                    ids, texts, size = [], [], 0
                ids.append(None if item == "" else int(item))
                texts.append(t)
                size += len(t)
        if texts:
            yield pd.DataFrame({"ids": [ids], "texts": [texts]})

    rows = benchmark.where(F.length("text") > 0).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return rows.coalesce(max(1, math.ceil(chars / block_chars))).mapInPandas(pack, "ids array<long>, texts array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block_chars: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, distance, budget, start): items that occur in a document's whole text.

    Both sides are lowered, with runs of white space as one blank; start is a place in
    that form. An item may differ by error_rate of its length in edits, rounded down. By pigeonhole
    an occurrence within the budget keeps one of budget + 1 pieces whole: an automaton finds the
    pieces, Myers' algorithm checks the windows around them, and the best place counts.

    Null, empty and blank texts and items match nothing; repeated rows give repeated results; a null
    doc_id or item_id stays null; other columns of both tables aren't looked at.
    Tasks write the benchmark as blocks of about block_chars characters. The driver holds one block at a time, whatever
    the benchmark's size; each is broadcast, read against all documents, its results written, and released.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    narrow = docs.select(F.col("doc_id").cast("long"), "text")

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def match(batches):
            matcher = Matcher(shared.value, error_rate)
            for b in batches:
                texts = b.column(1)
                rows = [(d, *hit) for i, d in enumerate(b.column(0).to_pylist()) for hit in matcher.match(texts[i].as_py())]
                yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in rows], ARROW)

        found = scratch.write(narrow.mapInArrow(match, SCHEMA), "leaks")
        shared.destroy()
        return found

    out = None
    for r in scratch.write(_item_blocks(benchmark, block_chars), "items").toLocalIterator():
        part = scan(list(zip(r["ids"], r["texts"], strict=True)))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those in which find_leaks finds an item.

    Rows are judged by their own text, told apart by a hash of all columns: a null or repeated doc_id
    doesn't matter, equal rows share their fate. All columns stay as they are, whatever their names.
    """
    side = Aside(docs)
    row = F.xxhash64(*side.every())
    leaks = find_leaks(side.rows.select(row.alias("doc_id"), side["text"].alias("text")), benchmark, **how)
    leaks = leaks.select(F.col("doc_id").alias("_row")).distinct()
    return side.rows.withColumn("_row", row).join(leaks.hint("merge"), "_row", "left_anti").select(*side.back())
