"""Text repair, excerpts, previews and duties by cases and plain versions; streams; long texts."""

import pytest
from pyspark.sql import functions as F

from clausemill.functions import deep as D
from clausemill.functions import repair
from clausemill.functions import shape as S
from clausemill.functions import text as X
from clausemill.operators import deep as O
from clausemill.operators import matching as M
from clausemill.sources import tables as T
from clausemill.streaming import scan


def values(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_long_letter_runs_do_not_recurse(spark):
    long = "a " * 1_000_000 + "word"
    joined = "a" * 1_000_000 + " word"
    assert values(spark, X.join_spaced_letters, [long, "a b c d word", "x a b c", "a b c d", None]) == [joined, "abcd word", "xabc", "abcd", None]
    assert values(spark, X.search_text, [long])[0] == joined
    assert len(values(spark, X.report_points, ["1" + ".1" * 20_000 + ". x"])[0]) == 2


def test_numbers_of_any_length_split_clauses(spark):
    from clausemill.operators.segmentation import clauses_numbered

    df = spark.createDataFrame([("intro\n1" + ".2" * 20_000 + ") x\n3.4 y\n- z",)], "document_text string")
    assert [r.clause_text[:5] for r in clauses_numbered(df).orderBy("clause_index").collect()][-2:] == ["3.4 y", "- z"]


def test_mojibake(spark):
    right = ["Договор поставки, срок 5 дней", "Исполнитель обязан", "plain text", "Сторона", ""]
    wrong = [t.encode("utf-8").decode("cp1251", "surrogateescape").replace("\udc98", "\x98") for t in right]
    assert values(spark, repair.mojibake_repair, wrong) == right
    assert values(spark, repair.mojibake_repair, ["РАСПРС", "РС"]) == ["РАСПРС", "РС"]  # neither valid UTF-8 nor long enough


def test_entities(spark):
    cases = {"&#1055;&#x43f;&#65;": "ПпA", "&amp;#65; &lt;b&gt; &quot;&apos;": "&#65; <b> \"'", "&#x1F600;": "😀", "&#0; &#xD800; &#9999999;": "&#0; &#xD800; &#9999999;", "no & entity": "no & entity"}
    assert values(spark, X.xml_entities, list(cases)) == list(cases.values())


def test_folding(spark):
    assert values(spark, X.fold_diacritics, ["éèÀüñ", "ёйЁЙ", "šČžő", "é й", "ß æ"]) == ["eeAun", "еиЕИ", "sCzo", "e и", "ß æ"]


def test_respacing(spark):
    cases = {"срокпоставкитовара": "срок поставки товара", "неизвестныйнабор": "неизвестныйнабор", "договор": "договор", "ДоговорПоставкиТовара!": "Договор Поставки Товара!"}
    assert values(spark, repair.respace_words, list(cases)) == list(cases.values())


def test_layout(spark):
    cases = {"дого-\n вор": "договор", "д о г о в о р 5": "договор 5", "a b c d": "a b c d", "- д о м\nв": "- дом\nв"}
    assert values(spark, repair.layout_repair, list(cases)) == list(cases.values())
    noisy = "## %% @@\n~~\nThis line reads like a sentence of a text.\n@@ ^^\nok 123\n--"
    assert values(spark, repair.trim_noise_lines, [noisy, "", None]) == ["This line reads like a sentence of a text.\nok 123", "", None]


def test_money(spark):
    want = {"5 percent": True, "5 EUR.": True, "100 руб.": False, "100 рубx": True, "5%a": True, "5 %": False, "no": False, "12 млн1": True}
    assert values(spark, S.monetary_signal, list(want)) == list(want.values())


def plain_excerpt(text, most):
    """For texts without leads, numbers and headings."""
    if len(text) <= most:
        return text
    cut = text[:most].strip()
    end = max(cut.rfind(c) for c in (". ", "! ", "? "))
    if end >= 60:
        return cut[: end + 1]
    return cut if cut[-1] in ".!?" else cut.rstrip() + "..."


def test_excerpts_are_cut(spark):
    texts = ["word " * 100, "A sentence of some length that goes on until here is its end. " * 6, "Short one. " + "word " * 90, "x" * 300, "Ends here on time, at the place where the cut is made by chance. " + "y" * 200]
    got = values(spark, lambda c: D.excerpt(c, 220), texts)
    assert got == [plain_excerpt(t.strip() if len(t.strip()) <= 220 else t, 220) for t in texts]
    assert values(spark, D.excerpt, ["GENERAL PROVISIONS", "Heading:", "1.2 Buyer pays.3.4 Seller waits.", "Buyer pays. 2"]) == ["", "", "Buyer pays.", "Buyer pays."]


def test_previews(spark):
    df = spark.createDataFrame([(["a  b", "a b", "x. " * 100, "word" * 80, "one two " * 40, "z"],)], "t array<string>")
    got = df.select(D.preview_items(F.col("t"), 9).alias("v")).first().v
    assert got == ["a b", ("x. " * 73).strip(), ("word" * 80)[:217] + "...", ("one two " * 40)[:218].rsplit(" ", 1)[0].strip() + "...", "z"]


def test_summary_items(spark):
    cases = {"pay 1.2,3 by then": "pay 1.2.3 by then", "Buyer pays: 4.": "", "Deliver goods in time": "Deliver goods in time"}
    assert values(spark, D.summary_item, list(cases)) == list(cases.values())


def test_positions(spark):
    df = spark.createDataFrame([("aXbX.XX",), ("",)], "t string")
    got = [r.v for r in df.select(D.positions(F.col("t"), F.array(F.lit("X"), F.lit("b"), F.lit("."))).alias("v")).collect()]
    assert got == [[1, 2, 3, 4, 5, 6], []]


def test_duties_follow_a_lead(spark):
    text = "1. Buyer shall:\na) pay the invoice;\nb) report losses.\n\n2. Seller shall deliver; buyer keeps papers.\n\n3. An example: buyer shall wait."
    df = spark.createDataFrame([(1, "buyer", text), (2, "tenant", text)], "contract_id long, role string, document_text string")
    got = {r.contract_id: r for r in O.deep_report(df).collect()}
    assert got[1].duties == ["pay the invoice", "report losses."] and got[1].role_found
    assert got[2].duties == [] and not got[2].role_found and [x.rule_id for x in got[2].risks] == ["role-missing", "low-signal"]


def test_reports_of_nothing(spark):
    schema = "contract_id long, role string, document_text string"
    assert O.deep_report(spark.createDataFrame([], schema)).collect() == []
    row = O.deep_report(spark.createDataFrame([(1, "buyer", None), (2, None, "")], schema)).orderBy("contract_id").collect()
    assert [r.contract_id for r in row] == [1, 2] and all(not r.role_found and r.duties == [] for r in row)


def test_length_gate(spark):
    from clausemill.functions import lookups as L

    df = spark.createDataFrame([(1,)], "i int").select(*[L.length_error(F.repeat(F.lit("x"), n), F.lit("y")).alias(f"n{n}") for n in (500_000, 500_001)])
    assert df.first().asDict() == {"n500000": None, "n500001": "text_too_long"}


def test_last_silent_jobs_come_out(spark, tmp_path):
    """The last jobs of the log are silent at its end: a closing step finds them, and a second run goes on from the first."""
    at = str(tmp_path / "events")
    rows = [(1, "2024-01-01 00:00:00", 1, "view"), (2, "2024-01-01 00:01:00", 1, "purchase"), (3, "2024-01-01 00:00:30", 2, "click"), (4, "2024-01-01 05:00:00", 3, "view")]
    df = spark.createDataFrame([(i, t, u, e, 0.0, "{}") for i, t, u, e in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(at)
    states = {"view": "queued", "click": "preprocessing", "purchase": "report_ready"}
    for _ in range(2):
        got = scan.timeouts_so_far(spark, at, states, "test", now="2024-01-01 06:00:00")
        assert sorted((r.job_id, r.status) for r in got.collect()) == [(2, "preprocessing"), (3, "queued")]


@pytest.mark.parametrize("name", ["deep_contracts", "contracts"])
def test_corpora(spark, name):
    df = getattr(T, name)(spark, "/root/testdata/sf0.001")
    assert df.count() > 100 and df.select("contract_id").distinct().count() == df.count()


def test_marker_hits(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert df.select(M.marker_hits(F.col("t"), ["a", "b", "x", "a"]).alias("n")).first().n == 3


def test_capitals_in_a_row_end(spark):
    import time

    began = time.time()
    text = "A" * 200_000 + "Buyer shall pay. GENERAL TERMS Buyer shall pay"
    got = spark.createDataFrame([(text,)], "t string").select(D.fragments(F.col("t"))).first()[0]
    assert got == ["A" * 200_000, "Buyer shall pay.", "GENERAL TERMS", "Buyer shall pay"]
    assert time.time() - began < 60
