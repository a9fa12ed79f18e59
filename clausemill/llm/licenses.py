"""License scans by diagonal voting over rolling word k-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Aside, Scratch, give_back, row_key
from .shingles import mix, word_hashes

K = 3

# The contract's phrases and labels, found word for word.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further templates: public license wording, found in part.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "apache-2-text": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2-text": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "all-rights-reserved": "all rights reserved",
}

_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def gram_hashes(text: bytes | None) -> tuple[int, np.ndarray]:
    """How many words (of letters, digits and all that isn't ASCII, A-Z lowered) a text has, and a 64-bit hash of its K words from each on."""
    w = word_hashes(text.translate(_WORDS)) if text else np.zeros(0, np.uint64)
    n = len(w) - K + 1
    if n <= 0:
        return len(w), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = h * _STEP + w[j : n + j]
    return len(w), mix(h).view(np.int64)


MOST_ROWS = 1 << 19  # grams handed on at once


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text a row with its number of words (pos -1, no gram), and one for each of its grams."""
    names = ["_row", "n_words", "pos", "gram"]

    def out(rows: pa.Array, which: list[int], counts: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(h) + 1 for h in held]
        n = sum(sizes)
        heads = np.cumsum([0, *sizes[:-1]])
        pos = np.arange(n) - np.repeat(heads, sizes) - 1
        is_head = np.zeros(n, bool)
        is_head[heads] = True
        gram = np.zeros(n, np.int64)
        gram[~is_head] = np.concatenate(held)
        words = np.repeat(np.array(counts), sizes)
        return pa.RecordBatch.from_arrays([rows.take(pa.array(np.repeat(np.array(which), sizes))), pa.array(words, pa.int64()), pa.array(pos, pa.int64()), pa.array(gram, mask=is_head)], names=names)

    for b in batches:
        rows, texts = b.column("_row"), b.column("_text")
        which, counts, held, size = [], [], [], 0
        for i, t in enumerate(texts):
            n, h = gram_hashes(t.as_py())
            for at in range(0, max(len(h), 1), MOST_ROWS):
                if at:  # a very long text goes on without a second row for itself
                    part = h[at : at + MOST_ROWS]
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array([i] * len(part))), pa.array([n] * len(part), pa.int64()), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=names)
            which.append(i)
            counts.append(n)
            held.append(h[:MOST_ROWS])
            size += len(held[-1]) + 1
            if size >= MOST_ROWS:
                yield out(rows, which, counts, held)
                which, counts, held, size = [], [], [], 0
        if which:
            yield out(rows, which, counts, held)
        give_back()


def _template_rows(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    rows = []
    for exact, group in ((True, phrases), (False, templates)):
        for no, (text, label) in enumerate(group.items() if exact else [(t, n) for n, t in group.items()]):
            w = text.split()
            name = f"{'p' if exact else 't'}{no}"
            rows += [(name, label, exact, len(w) - K + 1, i, int(h)) for i, h in enumerate(gram_hashes(text.encode())[1])]
    return rows


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, least_share: float = 0.6, slack: int = 3) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score.

    The hashes of all rolling K-word grams of every whole text are joined by Spark to the templates' positions; a hit votes for the diagonal
    "place in the text minus place in the template". A phrase is found where a diagonal has
    all its grams, as 64-bit hashes. For longer
    templates, diagonals of one document within slack words of each other merge to a span,
    and the span counts if its distinct template grams cover least_share of the template.
    score is the best cover (1 where a phrase is found, 0 where nothing is).

    Null and empty texts have no words; repeated rows give the same again; of templates with equal cover all
    labels come. Extra columns stay, but for those named like an added one, which gives the added one's values.
    Templates are a fixed list of a few hundred grams and are broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = _template_rows(phrases, templates)
    template = spark.createDataFrame(rows, "template string, label string, exact boolean, n_grams int, at int, gram long")
    side = Aside(docs)
    row = row_key(*side.every())
    told = side.rows.withColumn("_row", row)
    grams = told.select("_row", side["text"].cast("binary").alias("_text")).mapInArrow(_grams, "_row struct<a:long,b:long>, n_words long, pos long, gram long")
    # only hits are written, and a row for each text
    hits = scratch.write(grams.join(F.broadcast(template), "gram", "left").where("pos = -1 OR template IS NOT NULL"), "hits")
    seen = hits.where("pos = -1").select("_row", "n_words").dropDuplicates(["_row"])
    # repeated rows have voted more than once
    votes = hits.where("pos >= 0").drop("n_words", "gram").distinct().withColumn("diagonal", F.col("pos") - F.col("at"))
    diagonals = votes.groupBy("_row", "template", "label", "exact", "n_grams", "diagonal").agg(
        F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats"))
    place = diagonals.where(F.col("exact") & (F.col("n") == F.col("n_grams")))
    base = place.groupBy("_row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("_base"))
    near = W.partitionBy("_row", "template").orderBy("diagonal", "first")
    spans = diagonals.where(~F.col("exact")).withColumn("_new", (F.col("diagonal") - F.lag("diagonal").over(near) > slack).cast("int"))
    spans = spans.withColumn("_span", F.sum(F.coalesce("_new", F.lit(0))).over(near))
    spans = spans.groupBy("_row", "template", "label", "n_grams", "_span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"))
    spans = spans.withColumn("share", F.col("covered") / F.col("n_grams")).where(F.col("share") >= least_share)
    more = spans.groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("share").alias("_share"))
    none = F.array().cast("array<string>")
    found = seen.select("_row", "n_words").join(base.hint("merge"), "_row", "left").join(more.hint("merge"), "_row", "left")
    out = told.join(found.hint("merge"), "_row")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        *side.back("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined(F.coalesce("_base", none)).alias("base_labels"),
        joined(F.concat(F.coalesce("_base", none), F.coalesce("_more", none))).alias("labels"),
        F.when(F.col("n_base").isNotNull(), 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
