"""Repair by distinct parts against repair row by row, and runs of any length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clausemill.functions import repair as R
from clausemill.operators import repair as O
from clausemill.sources.deep_pack import SEGMENT_WORDS


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def wrong(text):
    return "".join(bytes([b]).decode("cp1251") if b != 0x98 else "\x98" for b in text.encode())


MIXED = ["договор", "Срок", "и", "в", "цена", "Россия", "РОССИЯ", "СССР", "plain", "é", "Ðž", "рис", "№5"]


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "Р", "РІ", "Р С", "a\0b", "\n РІ\tРё ", wrong("срок поставки и цена"), wrong(wrong("договор"))]
    for _ in range(150):
        out.append(" ".join(wrong(w) if rng.random() < 0.5 else w for w in rng.choices(MIXED, k=rng.randint(1, 12))))
    return out + out[:20]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_tokens_once_or_in_every_row(spark, most):
    df = spark.createDataFrame([(i, t, {"k": i}) for i, t in enumerate(texts())], "id long, t string, extra map<string,int>").repartition(3)
    got = {r.id: r.t for r in O.mojibake_repaired(df, "t", most).collect()}
    want = {r.id: r.t for r in df.select("id", R.mojibake_repair(F.col("t")).alias("t")).collect()}
    assert got == want
    assert O.mojibake_repaired(df, "t", most).columns == ["id", "t", "extra"]


def test_short_and_long_tokens(spark):
    assert one(spark, R.mojibake_repair, wrong("в доме и саду")) == "в доме и саду"
    assert one(spark, R.mojibake_repair, "СССР и Россия") == "СССР и Россия"
    assert R.SHORT_TOKENS["Р"] == "И" and R.SHORT_TOKENS["Р°"] == "а"


def test_guard_misses_no_suspicious_token(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("РСÐaвx°") for _ in range(rng.randint(1, 12))),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string").where(R.suspicious(F.col("t")))
    assert df.count() > 500
    assert df.where(~F.regexp_like("t", F.lit(R.GUARD))).count() == 0


def fewest(run, words):
    """All segmentations of a short run by plain recursion: the fewest words, then the least text."""
    if not run:
        return (0, "")
    best = None
    for k in range(1, len(run) + 1):
        if run[:k].lower() in words and (rest := fewest(run[k:], words)):
            way = (rest[0] + 1, run[:k] + (" " + rest[1] if rest[1] else ""))
            best = min(best, way) if best else way
    return best


def test_runs_against_all_segmentations(spark):
    rng = random.Random(3)
    runs = []
    for _ in range(60):
        parts = rng.choices([*SEGMENT_WORDS, "ъъ"], k=rng.randint(1, 5))
        runs.append("".join(p.capitalize() if rng.random() < 0.3 else p for p in parts))
    df = spark.createDataFrame([(i, f"А. {r}; {r}") for i, r in enumerate(runs)], "id long, t string")
    words = set(SEGMENT_WORDS)

    def put(r):
        best = fewest(r, words) if len(r) >= 14 else None
        return best[1] if best and best[0] > 1 else r

    want = {i: f"А. {put(r)}; {put(r)}" for i, r in enumerate(runs)}
    assert {r.id: r.t for r in df.select("id", R.respace_words(F.col("t")).alias("t")).collect()} == want
    assert {r.id: r.t for r in O.respaced(df, "t", list(SEGMENT_WORDS)).collect()} == want
    assert {r.id: r.t for r in O.respaced(df, "t", spark.createDataFrame([(w,) for w in SEGMENT_WORDS], "word string"), 1 << 20).collect()} == want


def test_large_dictionary(spark):
    rng = random.Random(4)
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    words = sorted({"".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(50_000)})
    some = [rng.sample(words, 4) for _ in range(40)]
    df = spark.createDataFrame([(i, "".join(s)) for i, s in enumerate(some)], "id long, t string")
    got = {r.id: r.t for r in O.respaced(df, "t", words).collect()}
    known = set(words)
    assert all(t.replace(" ", "") == "".join(some[i]) and all(w in known for w in t.split()) and len(t.split()) <= 4 for i, t in got.items())
    tree, few = O.prefix_tree(words), O.prefix_tree(words[::50])

    def took(t):
        began = time.perf_counter()
        for s in some * 20:
            O.segmented("".join(s), t)
        return time.perf_counter() - began

    took(tree)
    assert took(tree) < 20 * took(few) + 0.5
    with pytest.raises(ValueError, match="dictionary"):
        O.respaced(df, "t", spark.createDataFrame([("слово",)], "word string"), 3)


def test_runs_of_any_length_end(spark):
    began = time.time()
    known = "договорпоставка" * 2000
    assert one(spark, R.respace_words, known) == " ".join(["договор", "поставка"] * 2000)
    assert one(spark, R.respace_words, "ъ" * 200_000) == "ъ" * 200_000
    assert time.time() - began < 60
    tree = O.prefix_tree(SEGMENT_WORDS)
    assert O.segmented("договорпоставка" * 70_000, tree).count(" ") == 139_999
