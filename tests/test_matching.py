"""Containment joins, distances of markers and places in a queue against plain versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clausemill.operators import matching as M
from clausemill.operators import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(rng, n=300):
    letters = "abcdeéд "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)] + ["", None, "ab", "a", "aaaaaaaa"]
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(2000)} | {"zzz", "abczzz"})
    return texts, words


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_blocked_join_gives_the_same_rows(spark, most):
    texts, words = corpus(random.Random(1))
    units = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    marks = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, no int")
    got = sorted((r.id, r.no) for r in M.contains_join_blocked(units, marks, "t", "w", most).collect())
    want = sorted((i, no) for i, t in enumerate(texts) for no, w in enumerate(words) if t and w in t)
    assert got == want
    assert sorted((r.id, r.no) for r in M.contains_join(units, marks, "t", "w", most).collect()) == want


def test_ten_thousand_keywords_shuffle_no_text(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(10_500)})[:10_000]
    texts = [" ".join(rng.sample(words, 5)) for _ in range(200)]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    marks = spark.createDataFrame([(w,) for w in words], "w string")
    out = M.contains_join_blocked(units, marks, "t", "w")
    assert "Exchange hashpartitioning" not in plan(out) and "Exchange range" not in plan(out)
    assert sorted((r.id, r.w) for r in out.collect()) == sorted((i, w) for i, t in enumerate(texts) for w in words if w in t)
    rare = M.rarest_trigrams(units, marks, "t", "w")
    assert rare.where(~F.contains("w", F.col("_tri"))).count() == 0 and rare.count() < len(words)


def test_distances(spark):
    rng = random.Random(3)
    rows = [([], []), ([1], []), ([], [1]), ([5], [5]), ([0, 200], [100])]
    rows += [(sorted(rng.choices(range(600), k=rng.randint(0, 9))), sorted(rng.choices(range(600), k=rng.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", M.near_any(a, b, 24).alias("any"), M.lead_any(a, b, 24).alias("lead"), M.near_count(a, b, 24).alias("n")).collect():
        near = [x for x in r.a if any(abs(x - y) <= 24 for y in r.b)]
        assert (r.any, r.n, r.lead) == (bool(near), len(near), any(0 <= y - x <= 24 for x in r.a for y in r.b))


def test_positions(spark):
    texts = ["", "shall", "a shall, shallshall a.b axb \\E", "été shall 日本 shall", "x" * 3000 + "shall"]
    marks = ["shall", "a.b", "a", "\\E"]

    def plain(t):
        out = []
        for m in marks:
            at = t.find(m)
            while at >= 0:
                out.append(at)
                at = t.find(m, at + len(m))
        return sorted(out)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.p for r in df.select("t", M.marker_positions(F.col("t"), marks).alias("p")).collect()} == {t: plain(t) for t in texts}


def test_many_positions_end(spark):
    began = time.time()
    text = "shall days " * 100_000
    df = spark.createDataFrame([(text,)], "t string").select(M.marker_positions(F.col("t"), ["shall"]).alias("a"), M.marker_positions(F.col("t"), ["days"]).alias("b"))
    assert df.select(M.near_count(F.col("a"), F.col("b"), 24), M.lead_any(F.col("a"), F.col("b"), 3)).first() == (100_000, False)
    assert time.time() - began < 60


def test_places_without_one_task(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, p int, t int").repartition(5)
    out = tables.ranked_by_ranges(df, ["p", "t"], ["id"])
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    assert [r.id for r in out.orderBy("place").collect()] == [r[0] for r in order]
    assert [r.place for r in out.orderBy("place").select("place").collect()] == list(range(1, 3001))


@pytest.mark.parametrize("listed", [M.MOST_LISTED, 3])
@pytest.mark.parametrize("most", [1 << 24, 0])
def test_blocked_join_works_units_out_once(spark, monkeypatch, listed, most):
    monkeypatch.setattr(M, "MOST_LISTED", listed)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(t):
        seen.add(1)
        return t

    texts = ["the lease ends", "a😀bc😀d lease", "x" * 40_000 + "lease\n\nlea", "", "ab", None, "😀bc", "?bc"]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2).withColumn("t", told.asNondeterministic()("t"))
    words = ["lease", "😀bc😀", "😀bc", "bc😀d", "e\n\nl", "zzz", "the lease ends!"]
    marks = spark.createDataFrame([(w,) for w in words], "w string")
    out = M.contains_join_blocked(units, marks, "t", "w", most)
    assert "_tri" not in out.columns and "_u" not in out.columns and "_tris" not in out.columns
    assert sorted((r.id, r.w) for r in out.collect()) == sorted((i, w) for i, t in enumerate(texts) for w in words if t and w in t)
    assert seen.value == len(texts)
