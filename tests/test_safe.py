"""Requests with faults: one report each, the error named."""

import base64
import random

from pyspark.sql import functions as F

from clausemill.functions import payload
from clausemill.operators import safe

SCHEMA = "contract_id long, document_text string, document_base64 string, mime_type string, language_raw string, locale_raw string"


def pack(b):
    return base64.b64encode(b).decode()


def test_decoded_like_the_standard_library(spark):
    rng = random.Random(8)
    texts = ["", "a", "ab", "abc", "é", "日本 😀", "x" * 100000] + ["".join(rng.choice("abé日😀\n") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    rows = [(pack(t.encode()), t, None, None) for t in texts] + [(" " + pack(t.encode()).rstrip("=") + "\n", t, None, None) for t in texts]
    broken = [b"\xff\xfe" + "é!".encode(), b"ab\xc3(", b"\xe2\x82", b"\xf0\x9f\x98ok", b"\x80" * 5]
    rows += [(pack(b), b.decode("utf-8", errors="ignore"), None, "invalid_utf8") for b in broken]
    rows += [(p, None, "invalid_base64", None) for p in ("%abc", "ab cd", "a", "abcde", "====", "ab=cd", "日本")]
    df = spark.createDataFrame(rows, "p string, text string, error string, warning string").select("*", payload.decoded(F.col("p")).alias("g"))
    for r in df.collect():
        assert (r.g.text, r.g.error, r.g.warning) == (r.text, r.error, r.warning), r.p


def test_one_report_each(spark):
    rows = [
        (1, "A penalty applies.\n\nAll is confidential.", None, "text/plain", "en", None), (2, None, None, None, None, None), (3, None, "%%%", None, "fr", None),
        (4, None, pack(b"\xffpenalty"), "application/pdf", "it", None), (5, " \n ", None, "text/plain", "en", "xx"), (6, "\r\r", None, None, "en", None),
        (7, "long " * 200, None, None, "en", None), (8, None, "A" * 2000, "application/msword", "en", None), (9, "penalty " + "x" * 400000, None, None, "en", None), (1, "A penalty applies.", None, None, "ru", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("state", F.lit("clash"))
    got = safe.safe_report(df, "contract_id", 500_000, 1_000).orderBy("contract_id", "summary").collect()
    assert [(r.contract_id, r.state, r.error, list(r.warnings), [x.group_id for x in r.risks]) for r in got if r.contract_id > 1] == [
        (2, "fallback", "missing_payload", [], ["analysis-safe-mode"]), (3, "fallback", "invalid_base64", [], ["analysis-safe-mode"]), (4, "analyzed", None, ["invalid_utf8", "limited_pdf_text"], ["penalty"]),
        (5, "analyzed", None, ["empty_text"], ["none"]), (6, "analyzed", None, ["empty_text"], ["none"]), (7, "analyzed", None, [], ["none"]),
        (8, "fallback", "payload_too_long", ["legacy_document"], ["analysis-safe-mode"]), (9, "analyzed", None, [], ["penalty"])]
    assert [[(x.group_id, x.severity, x.clause_ref) for x in r.risks] for r in got if r.contract_id == 1] == [[("penalty", "high", "clause-1"), ("secrecy", "medium", "clause-2")], [("penalty", "high", "clause-1")]]
    assert all(r.summary and all(x.title and x.description and x.recommendation for x in r.risks) for r in got)


def test_no_requests(spark):
    assert safe.safe_report(spark.createDataFrame([], SCHEMA), "contract_id").count() == 0


def test_nothing_is_shuffled(spark):
    plan = safe.safe_report(spark.createDataFrame([], SCHEMA), "contract_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
