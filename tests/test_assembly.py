import datetime
import hashlib

from pyspark.sql import functions as F

from clausemill.functions import shape, text
from clausemill.operators import report, tables
from clausemill.plans import request_queries
from clausemill.streaming import scan


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_scores_and_choices(spark):
    assert one(spark, text.char_class_score, "ab 1\x01") == 1.4
    assert one(spark, text.char_class_score, "") == 0
    assert one(spark, text.char_class_score, None) is None
    assert one(spark, lambda c: text.structured_or_flat(c, F.lit("0123456789")), "012345") == "012345"
    assert one(spark, lambda c: text.structured_or_flat(c, F.lit("0123456789")), "01234") == "0123456789"
    assert one(spark, lambda c: text.structured_or_flat(c, F.lit("")), "") == ""
    assert one(spark, text.report_points, "1. Pay now. - Ship it; Pay now. Done") == ["Pay now.", "Ship it", "Done"]


def test_trailing_markers(spark):
    assert one(spark, shape.strip_trailing_marker, "The buyer pays. 4.2.") == "The buyer pays."
    assert one(spark, shape.strip_trailing_marker, "as told in section 4.2") == "as told in section 4.2"
    assert one(spark, shape.strip_trailing_marker, "ends here.3") == "ends here"


def test_remote_states(spark):
    local = spark.createDataFrame([(i, "queued") for i in range(6)], "job_id long, status string")
    remote = spark.createDataFrame([(0, "queued", False), (1, "processing", False), (2, "failed", False), (3, "completed", True), (4, "completed", False)], "job_id long, remote_status string, has_result boolean")
    got = {r.job_id: r.status for r in tables.remote_sync(local, remote).collect()}
    assert got == {0: "queued", 1: "analyzing", 2: "failed", 3: "report_ready", 4: "failed", 5: "queued"}


def test_final_order_puts_role_missing_first(spark):
    found = spark.createDataFrame([(1, 0, "a", 0, "medium"), (1, 1, "a", 0, "medium"), (1, 2, "b", 1, "critical"), (1, 0, "c", 2, "low")], "d long, clause_index int, rule_id string, rule_index int, severity string")
    risks = report.final_risk_order(found, "d")
    clauses = spark.createDataFrame([(1, "The seller ships.", "buyer")], "d long, clause_text string, role string")
    got = report.with_role_missing(risks, clauses, "d").orderBy("n").collect()
    assert [(r.n, r.rule_id, r.severity, r.occurrences) for r in got] == [(0, "role_missing", "medium", 1), (1, "a", "high", 2), (2, "b", "high", 1), (3, "c", "low", 1)]


def test_job_timeouts(spark, tmp_path):
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, 0, m, s)
    rows = [(1, at(0), 7, "view", 0.0, ""), (2, at(1), 7, "click", 0.0, ""), (3, at(0), 8, "view", 0.0, ""), (4, at(0, 30), 8, "purchase", 0.0, ""), (5, at(59), 9, "view", 0.0, "")]
    spark.createDataFrame(rows, scan.EVENTS).write.parquet(str(tmp_path / "events"))
    states = {"view": "queued", "click": "preprocessing", "purchase": "report_ready"}
    out = scan.run_available(scan.job_timeouts(scan.job_stream(spark, str(tmp_path / "events"), states)), "test", str(tmp_path))
    # job 8 ended in time; job 9's silence is not over at the watermark
    assert [(r.job_id, r.since, r.status) for r in out.collect()] == [(7, at(1), "preprocessing")]
