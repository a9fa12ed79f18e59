"""What is worked out once for each distinct text, and what clean texts are spared."""

import random

import pytest
from pyspark.sql import functions as F

from clausemill.functions import repair
from clausemill.functions import text as X
from clausemill.operators import deep as O
from clausemill.operators import joins, segmentation
from clausemill.operators.report import best_type

SCHEMA = "contract_id long, role string, document_text string"


def test_clauses_are_worked_out_once(spark):
    text = "1. Buyer shall pay 5 EUR. Seller waits.\n\nNo number here\n\n2. Buyer shall pay"
    docs = spark.createDataFrame([(i, "buyer" if i % 2 else None, text) for i in range(40)] + [(90, "buyer", "No number here"), (91, "buyer", None)], SCHEMA)
    places, frags = O.clause_units(docs)
    assert (places.count(), frags.select("contract_id", *O.UNIT).distinct().count()) == (121, 6)
    rows = {(r.contract_id, r.clause_index, r.fragment_index): (r.fragment, r.clause_ref) for r in O.fragment_table(docs).collect()}
    assert len(rows) == 40 * 7 + 1
    assert rows[(7, 1, 0)] == ("No number here", "2") and rows[(90, 0, 0)] == ("No number here", "1") and rows[(8, 0, 3)] == ("Seller waits.", "1")


@pytest.mark.parametrize("most", [joins.MOST_SENT, 0])
def test_put_back_nulls_and_copies(spark, most):
    rows = spark.createDataFrame([(i, k) for i in range(9) for k in ("a", "b", None)], "i int, k string")
    told = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("c", 4)], "k string, v int")
    got = sorted((r.i, r.v) for r in joins.put_back(rows, told, ["k"], most).collect())
    assert got == sorted((i, v) for i in range(9) for v in (1, 2, 3))


def _odd_texts(n):
    rng = random.Random(3)
    bits = ["a", "B", "ж", "Р", "С°", "Ð", " ", "  ", "\t", "\n", "\n\n\n", "-", "‐", "\xa0", "\xad", "\r", "©", "■", "\x07", "​", "1", "12", ".", "word", "ab\ncd", "- ", "договорпоставкитовара", "a b c d", "\0", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(n)] + ["plain text", "", None]


def test_clean_texts_are_those_that_stay(spark):
    df = spark.createDataFrame([(t,) for t in _odd_texts(3000)], "t string")
    wrong = df.where(~X.normalize_text(F.col("t")).eqNullSafe(X.normalize_all(F.col("t"))))
    assert wrong.collect() == []


def test_changes_are_looked_for_only_where_they_may_begin(spark):
    places, (signs, broken, run) = X._changes()
    assert all(p.startswith("(?=") for p in (places, signs, broken, run))
    white = rf"\A[ \t\n]|[ \t](?:[ \t\n]|\z)|\n(?:[ \t]|\z|\n\n|(?<=[0-9{X.LETTER}]\n)[0-9{X.LOWER}][0-9{X.LETTER}])|-[ \t\n]|\s[{X.LETTER}]\s+[{X.LETTER}]\s|[\x00-\x08\x0B-\x1F\x7F]"
    plain = {places: white, signs: f"[{X.CONTROL[1:-1]}{X.GLYPHS[1:-1]}±©ª\\x{{A0}}\\x{{AD}}](?<=[^\\x00-\\x7E])", broken: rf"[\x{{2010}}\x{{2011}}][ \t\n]|{repair.GUARD}", run: repair.LONG_RUN}
    more = [" ab", " a b c", "x a\n\nb y", "x- y", "x -", "x y ", "ёжикидоговорпоставки Ђдоговорпоставкит", "а Р° б", "a\x1fb", "\U0001f600 \x85", "x‐\ny", "﻿x", "\xffÿ"]
    df = spark.createDataFrame([(t,) for t in _odd_texts(2000) + more], "t string")
    for p, q in plain.items():
        assert df.where(~F.regexp_like("t", F.lit(p)).eqNullSafe(F.regexp_like("t", F.lit(q)))).collect() == []


def test_numbered_lines_part_clauses(spark):
    text = "1. a\n2) b\nc\n  3.1. d\n\n\n• e\n-f\n\ng\n\n 4. h\n"
    rows = segmentation.clauses_numbered(spark.createDataFrame([(text,)], "document_text string")).collect()
    assert [r.clause_text for r in rows] == ["1. a", "2) b\nc", "3.1. d", "• e", "-f", "g", "4. h"]


def _odd_lines(n):
    rng = random.Random(5)
    bits = ["a", "Bc", "жЁ", "é", "«", "#", "@", "_", "~", "€", "\x7f", "Ђ", "■", "¿", "😀", " ", "  ", "\n", "12", "aaaaaa", "-----", "\x0b"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["ab#cd@", "ab#c@d~", "", None]


def test_counts_and_readable_lines(spark):
    df = spark.createDataFrame([(t,) for t in _odd_lines(1500)], "t string")
    t = F.col("t")
    for p in (f"[{X.LETTER}]", X.ODD, r"\s", r"\p{L}", X.SPACE, X.C1):
        assert df.where(~X._count(t, p).eqNullSafe(F.regexp_count(t, F.lit(p)))).collect() == []
    assert df.where(~X.collapse_ws(t).eqNullSafe(F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" ")))).collect() == []
    assert df.where(F.regexp_like(t, F.lit(X.ODD)) & ~F.regexp_like(t, F.lit(f"(?=[{X.ODD_FIRST}]){X.ODD}"))).collect() == []

    def plain(x):
        odd = F.regexp_count(x, F.lit(X.ODD)) <= F.greatest(F.lit(2), F.floor(F.regexp_count(x, F.lit(f"[0-9{X.LETTER}]")) * 0.18))
        return (F.regexp_count(x, F.lit(f"[{X.LETTER}]")) >= 4) & odd & (X.repeated_noise(x) < F.length(F.regexp_replace(x, r"\s+", "")) * 0.2)

    want = F.array_join(F.filter(F.transform(F.split(X.normalize_text(t), "\n", -1), lambda x: F.trim(x)), plain), "\n")
    assert df.where(~want.eqNullSafe(X.readable_lines(t))).collect() == []
    # what is counted is not listed first
    assert "regexp_count" not in df.select(X._count(t, X.ODD))._jdf.queryExecution().analyzed().toString()


def test_contract_type_heads(spark):
    df = spark.createDataFrame([(t,) for t in [*_odd_texts(600), *_odd_lines(300), "plain " * 9]], "t string")
    for most in (5, 4000):
        want = X.search_text(F.substring(X.normalize_text(F.col("t")), 1, most))
        assert df.where(~want.eqNullSafe(X.search_head(F.col("t"), most))).collect() == []
    kinds = spark.createDataFrame([("a lease and a loan",), ("loan",), ("x",), ("",), (None,), ("lease",)], "t string")
    best = best_type(F.col("t"), {"rent": ["lease"], "loan": ["loan", "credit"]})
    assert [r.b for r in kinds.select(best.alias("b")).collect()] == ["rent", "loan", "unknown", "unknown", "unknown", "rent"]
    # the detectors are scored once
    assert kinds.select(best.alias("b"))._jdf.queryExecution().analyzed().toString().count("array_max") == 1


def test_long_expressions_take_few_calls(spark, monkeypatch):
    """An expression of Columns takes a call to the JVM for each of its parts, wherever it is used; those that stand many times are SQL."""
    from py4j.clientserver import ClientServerConnection

    from clausemill.functions import deep as D
    from clausemill.sources.packs import STARTER

    calls, send = [0], ClientServerConnection.send_command
    monkeypatch.setattr(ClientServerConnection, "send_command", lambda *a, **k: (calls.__setitem__(0, calls[0] + 1), send(*a, **k))[1])

    def taken(made):
        before = calls[0]
        made()
        return calls[0] - before

    t, roles = F.col("t"), F.col("roles")
    assert taken(lambda: X.normalize_text(t)) < 2000 and taken(lambda: D.excerpt(t)) < 200 and taken(lambda: D.summary_item(t)) < 2500
    assert taken(lambda: D.role_action_lead(t, roles)) < 300 and taken(lambda: D.benefits(t, t, roles, roles)) < 2500
    frags = spark.createDataFrame([], f"{SCHEMA}, fragment string, norm string, clause_norm string, excerpt string, clause_ref string, roles array<string>")
    assert taken(lambda: O.risk_matches(O.with_signals(frags, STARTER), STARTER)) < 7000
