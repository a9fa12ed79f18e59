"""Repair of damaged text by its distinct parts: each is put right once for all texts that hold it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import repair as R
from ..sources.shared import written
from .joins import MOST_SENT, fits


def by_distinct(docs: DataFrame, text: str, found: Callable[[Column], Column], repaired: Callable[[DataFrame], DataFrame], put: Callable[[Column, Column], Column], most: int = MOST_SENT) -> DataFrame:
    """docs with text repaired: found(text) lists the parts that may need it, repaired(parts) gives (part, fixed), put(text, fixes) applies a map of both.

    Only parts are shuffled to find the distinct ones; what doesn't change goes. Texts meet their fixes by the digest of the whole text: the
    table of fixes is sent to the texts if it fits, else only texts that have some are dealt to it, and one that fills much of the table is split by AQE.
    Texts without such parts, nulls among them, are handed on as they are.
    """
    # texts are needed two or three times: what makes them is done once
    docs = written(docs, "texts")
    parts = docs.select(F.md5(F.encode(text, "utf-8")).alias("_text"), F.array_distinct(found(F.col(text))).alias("_parts")).where(F.size("_parts") > 0)
    pairs = written(parts.groupBy("_text").agg(F.first("_parts").alias("_parts")).select("_text", F.explode("_parts").alias("part")), "parts")
    fixes = written(repaired(pairs.select("part").distinct()).where("fixed <> part"), "fixes")
    of_text = pairs.join(fixes.hint("broadcast" if fits(fixes, most) else "merge"), "part")
    of_text = written(of_text.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("part", "fixed"))).alias("_fixes")), "of-text")
    keyed = docs.withColumn("_text", F.md5(F.encode(text, "utf-8")))
    done = lambda rows: rows.withColumn(text, F.when(F.col("_fixes").isNotNull(), put(F.col(text), F.col("_fixes"))).otherwise(F.col(text))).select(*docs.columns)
    if fits(of_text, most):
        return done(keyed.join(of_text.hint("broadcast"), "_text", "left"))
    has = F.size(F.coalesce(found(F.col(text)), F.array())) > 0
    return docs.where(~has).unionByName(done(keyed.where(has).join(of_text.hint("merge"), "_text", "left")))


def mojibake_repaired(docs: DataFrame, text: str, most: int = MOST_SENT) -> DataFrame:
    """docs with the same text as functions.repair.mojibake_repair gives, each distinct suspicious token decoded once."""
    plain = docs.withColumn(text, F.replace(text, F.lit("\0"), F.lit("")))
    found = lambda c: F.when(F.regexp_like(c, F.lit(R.GUARD)), F.filter(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), R.suspicious))
    repaired = lambda parts: parts.select("part", R.repaired_token(F.col("part")).alias("fixed"))
    put = lambda c, fixes: R.by_token(c, lambda t: F.coalesce(F.element_at(fixes, t), t))
    return by_distinct(plain, text, found, repaired, put, most)


END = ""


def prefix_tree(words) -> dict:
    """Words by their letters, one dictionary for each; END marks where a word ends."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[END] = {}
    return root


def segmented(run: str, tree: dict) -> str:
    """A run as the fewest words of the tree that reach its end, the shortest first among equals; as it is where none do, or one does.

    From the end on: counts[i] words are needed from i, the first of steps[i] letters. A position looks at no more letters than the tree has there.
    """
    low, n = run.lower(), len(run)
    if len(low) != n:
        return run
    counts: list = [None] * n + [0]
    steps = [0] * n
    for i in range(n - 1, -1, -1):
        node, best = tree, None
        for j in range(i, n):
            node = node.get(low[j])
            if node is None:
                break
            if END in node and counts[j + 1] is not None and (best is None or counts[j + 1] + 1 < best):
                best, steps[i] = counts[j + 1] + 1, j + 1 - i
        counts[i] = best
    if not counts[0] or counts[0] < 2:
        return run
    out, i = [], 0
    while i < n:
        out.append(run[i : i + steps[i]])
        i += steps[i]
    return " ".join(out)


def respaced(docs: DataFrame, text: str, words: list[str] | DataFrame, most: int = MOST_SENT) -> DataFrame:
    """docs with long Cyrillic runs taken apart by the dictionary, each distinct run once.

    words: a list, or a table whose column word is read; a dictionary of more than `most` bytes is an error, as every task holds it as a
    prefix tree. What a run costs depends on its length and the longest word, not on how many words there are.
    """
    if isinstance(words, DataFrame):
        if not fits(words.select("word"), most):
            raise ValueError(f"the dictionary takes more than {most} bytes")
        words = [r.word for r in words.select("word").where("word <> ''").collect()]
    words = sorted({w.lower() for w in words if w})

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = prefix_tree(words)
        for f in frames:
            yield pd.DataFrame({"part": f["part"], "fixed": [segmented(p, tree) for p in f["part"]]})

    found = lambda c: F.regexp_extract_all(c, F.lit(R.LONG_RUN), F.lit(0))
    put = lambda c, fixes: R.by_pattern(c, R.LONG_RUN, lambda r: F.coalesce(F.element_at(fixes, r), r))
    return by_distinct(docs, text, found, lambda parts: parts.mapInPandas(solved, "part string, fixed string"), put, most)
