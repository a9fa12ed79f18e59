"""Excerpts of a text and its clauses: cut by stretches, each distinct one once, numbered within a contract."""

import random

import pytest
from pyspark.sql import functions as F

from clausemill.functions import deep as D
from clausemill.functions import text as X
from clausemill.operators import deep as O
from clausemill.operators import joins, segmentation

SCHEMA = "contract_id long, role string, document_text string"
BITS = ["Buyer", "Buyer shall", "shall", "shall:", "may: ", "ABC ", "GENERAL TERMS", "A", "b", "clause", "clause ", "section 3", "Section 3.2 ", "пункт", "Раздел 4", "Исполнитель обязан", "pay", " ", " ", "\n", "\n", "\n\n", "\n\n",
        "\n1. ", "\n\n2. ", "\n3.4) ", "\n\n5 ", "\n6 ", "1", "2.", "3.4", "3.4.", "7.8Buyer", ".", ". ", ":", ";", "! ", "?", "•", "- ", "\n- ", "*", ")", "(a) ", "(", ",", "\n• "]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def lists(spark, texts, made):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", made(F.col("t")).alias("v")).orderBy("i").collect()]


def test_stretches_are_cut_as_in_the_whole(spark):
    texts = list(dict.fromkeys(lists(spark, odd_texts(6000, 11), X.normalize_twice)))
    parts = lists(spark, texts, D.stretches)
    assert sum(len(p) > 1 for p in parts) > 1000
    places = [i for i, p in enumerate(parts) for _ in p]
    for made in (D.broken, segmentation.numbered_array):
        got = [[] for _ in texts]
        for i, v in zip(places, lists(spark, [x for p in parts for x in p], made), strict=True):
            got[i] += v
        assert got == lists(spark, texts, made)


def test_a_text_is_clean_if_its_stretches_are(spark):
    bits = [*BITS, "-", "‐", "‑", "\x1e", "\t", "\xad", "\x07", "\x0b", "é", "Р°", "Ђ", "\n\n\n", "\n12) ", "x\n7) ", " a b ", "договорпоставкитовара", "±", "\x7f", "\r"]
    rng = random.Random(8)
    texts = [*("".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(6000)), "-\n1. x", "‐\n\n1. x", "a\n12. x", "a\n1. x", ".\n\n\n1 x", "", "\n1. x"]
    want, parts = lists(spark, texts, X.unclean), lists(spark, texts, D.stretches)
    assert 0.2 < sum(want) / len(want) < 0.95 and sum(len(p) > 1 for p in parts) > 500
    told = iter(lists(spark, [x for p in parts for x in p], X.unclean))
    assert [any([next(told) for _ in p]) for p in parts] == want


def test_twice_normalized(spark):
    texts = [*odd_texts(400, 5), "a‐\n b c d e", "Р°Р±РІ x", "договорпоставкитовара\n\n\n\nx", " x\ty \n", "", None]
    assert lists(spark, texts, X.normalize_twice) == lists(spark, lists(spark, texts, X.normalize_text), X.normalize_text)


def plain_lines(spark, texts):
    """Of each text the excerpts of its fragments and those of its clauses, the first of those with equal search forms."""
    whole = lists(spark, texts, X.normalize_twice)
    clauses = lists(spark, whole, segmentation.numbered_array)
    out = []
    sources = [[t or "", *(c or [])] for t, c in zip(whole, clauses, strict=True)]
    clean = iter(lists(spark, [c for s in sources for c in s[1:]], X.normalize_text))
    sources = [[s[0], *(next(clean) for _ in s[1:])] for s in sources]
    pieces = iter(lists(spark, [x for s in sources for x in s], D.broken))
    pieces = [[f for _ in s for f in next(pieces)] for s in sources]
    lines = lists(spark, [f for p in pieces for f in p], D.excerpt)
    both = iter(zip(lines, lists(spark, lines, X.search_text), strict=True))
    for p in pieces:
        first = {}
        for line, key in (next(both) for _ in p):
            if line:
                first.setdefault(key, line)
        out.append(list(first.values()))
    return out


@pytest.mark.parametrize(("most", "clean"), [(joins.MOST_SENT, False), (0, False), (0, True)])
def test_excerpts_of_text_and_clauses(spark, monkeypatch, most, clean):
    for f in (joins.put_back, joins.fits):
        monkeypatch.setattr(f, "__defaults__", (most,))
    texts = [*odd_texts(300, 3), "1. Buyer pays.\n\n2. buyer  PAYS.\n\n3. Seller waits; Buyer pays.", "; • ;", "", None, "x\n\n1. x\n2) y"] * 2
    if clean:
        texts = [*dict.fromkeys(t for t in lists(spark, texts, X.normalize_twice) if t), "x - y\n\n1. z"]
        texts = [t for t, u in zip(texts, lists(spark, texts, X.unclean), strict=True) if not u]
        assert len(texts) > 200
    df = spark.createDataFrame([(i, "buyer", t) for i, t in enumerate(texts)], SCHEMA)
    got = {}
    for r in O.candidate_excerpts(df).orderBy("contract_id", "n").collect():
        got.setdefault(r.contract_id, []).append((r.n, r.line))
    assert got == {i: list(enumerate(x, 1)) for i, x in enumerate(plain_lines(spark, texts)) if x}


def test_clauses_add_what_reads_otherwise(spark):
    """Before a capital a number parts the text; the clause that it ends keeps it."""
    df = spark.createDataFrame([(1, "buyer", "Delivery follows clause 5\n\nBuyer waits"), (2, None, ";")], SCHEMA)
    got = [(r.contract_id, r.n, r.line) for r in O.candidate_excerpts(df).orderBy("contract_id", "n").collect()]
    assert got == [(1, 1, "Delivery follows"), (1, 2, "Buyer waits"), (1, 3, "Delivery follows clause 5")]


def test_stretches_are_worked_out_once(spark):
    """Texts put together from few clauses take as much work as these; no text is dealt out by contract."""
    clauses = ["Buyer shall pay. Seller waits", "Seller waits", "No line:", "GOODS"]
    df = spark.createDataFrame([(i, "buyer", "\n\n".join(f"{n}. {clauses[(i * n) % 4]}" for n in range(1, 6))) for i in range(200)], SCHEMA)
    rows, units = O.stretch_rows(df)
    assert rows.count() == 1000 and units.count() <= 20
    lines = O.candidate_lines(units)
    assert lines.count() <= 30 and lines.select("same").distinct().count() == 2
    plan = O.candidate_excerpts(df)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression"):]
    assert "line#" not in dealt.split("Join")[0] and "stretch#" not in dealt.split("Join")[0]
