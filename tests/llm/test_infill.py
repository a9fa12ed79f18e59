"""Fill-in-the-middle forms against cuts by plain string handling."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm.infill import WaveletMatrix, classes, fill_in_middle, restored

TEXTS = [None, "", " ", "\n", "\n\n a", "a", "ab", "é", "日本語 テキスト\n二行目", "<P> is a tag", "a <S", "<<<M", "ends <", "😀😀 x\n", "  two  words \n", "tab\tand\x0bmore\x1c\x85"]


def texts():
    rng = random.Random(3)
    out = list(TEXTS)
    for _ in range(150):
        out.append("".join(rng.choice("ab é日😀\n\t  <>PSM") for _ in range(rng.randint(0, 60))))
    out += ["long " * 300000, "x" * 1500000, "日\n" * 200000]
    return list(enumerate(out)) + [(3, "same row"), (3, "same row"), (None, "no id given")]


def plain_cut(text, unit, k):
    """Where k units end: the code point at which the next one starts."""
    if k == 0:
        return 0
    if unit == "char":
        return k
    if unit == "word":
        at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        return at[k] if k < len(at) else len(text)
    at = [m.end() for m in re.finditer("\n", text)]
    return at[k - 1] if k <= len(at) else len(text)


def plain_form(doc_id, text, unit):
    text = text or ""
    n = len(text) if unit == "char" else len(re.findall(r"[^\x20\x09-\x0D]+", text)) if unit == "word" else text.count("\n") + 1 if text else 0
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m = plain_cut(text, unit, a), plain_cut(text, unit, b)
    pre, mid, suf = text[:p], text[p:m], text[m:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_forms(spark, unit):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("clash"), "N_UNITS": F.lit(1), "extra": F.create_map(F.lit("k"), "doc_id")})
    out = fill_in_middle(docs.repartition(5), unit)
    assert out.columns == ["doc_id", "extra", "n_units", "form", "prefix_units", "middle_units", "fim_text"]
    back = out.withColumn("back", restored(F.col("form"), F.col("fim_text"))).collect()
    got = sorted((repr((r.doc_id, r.n_units, r.form, r.prefix_units, r.middle_units, r.fim_text, r.back)) for r in back))
    want = sorted(repr((i, *plain_form(i, t, unit), t or "")) for i, t in rows)
    assert got == want
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 5, n).astype(np.uint8)
        matrix, at = WaveletMatrix(values), np.arange(n + 1)
        for c in range(5):
            assert matrix.rank(c, at).tolist() == [int((values[:i] == c).sum()) for i in at]


def test_classes_do_not_run_into_the_next_text():
    data = np.frombuffer("ab".encode() + "c é".encode(), np.uint8)
    assert classes(data, np.array([0, 2])).tolist() == [3, 4, 3, 2, 3, 0]
