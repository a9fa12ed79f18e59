"""Layouts: plans without exchanges, folders that are left out, and files that stay as they are."""

from pathlib import Path

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.operators import tables as D
from clausemill.sources import layout as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nested_reports_without_an_exchange(spark):
    contracts = L.bucketed(spark.createDataFrame([(i, f"u{i}") for i in range(20)], "contract_id long, owner string"), "c", "contract_id", 4)
    risks = L.bucketed(spark.createDataFrame([(i % 7, i, f"r{i}") for i in range(40)] + [(99, 1, "orphan"), (None, 2, "none")], "contract_id long, id long, label string"), "r", "contract_id", 4)
    jobs = L.bucketed(spark.createDataFrame([(3, 9, None), (3, 8, "x")], "contract_id long, id long, label string"), "j", "contract_id", 4)
    out = D.report_fetch(contracts, {"risks": (risks, ["id", "label"]), "jobs": (jobs, ["id", "label"])}, "contract_id")
    assert "Exchange" not in plan(out)
    got = {r.contract_id: ([x.id for x in r.risks], [tuple(x) for x in r.jobs]) for r in out.collect()}
    assert len(got) == 20 and got[0] == ([0, 7, 14, 21, 28, 35], []) and got[3][1] == [(8, "x"), (9, None)] and got[19] == ([], [])


def test_access_patterns_prune_and_do_not_exchange(spark):
    rows = [(i, i % 5, ["new", "done"][i % 2], i * 3 % 17) for i in range(100)]
    c = L.bucketed(spark.createDataFrame(rows, "contract_id long, user_id long, status string, at int"), "c", "user_id", 4, by="status", order=("at",))
    newest = c.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("at"), "contract_id"))).where("n = 1")
    assert "Exchange" not in plan(newest) and newest.count() == 5
    assert "Exchange" not in plan(c.groupBy("user_id").count())
    done = c.where("status = 'done'")
    assert "PartitionFilters: [isnotnull(status" in plan(done) and done.count() == 50
    assert {Path(f).parent.name for f in done.inputFiles()} == {"status=done"}
    j = L.bucketed(spark.createDataFrame(rows, "job_id long, contract_id long, status string, at int"), "j", "contract_id", 4)
    latest = j.groupBy("contract_id").agg(F.max_by("job_id", F.struct("at", "job_id")).alias("job_id"))
    assert "Exchange" not in plan(latest) and latest.count() == 5


def test_upsert_writes_touched_parts_only(spark, tmp_path):
    at, schema = str(tmp_path / "t"), "k long, v string"
    L.write_parts(spark.createDataFrame([(i, f"old {i}") for i in range(200)] + [(None, "no key")], schema), at, ["k"], 16)
    files = lambda: {p.relative_to(at) for p in Path(at).rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(5, "new 5"), (5, "new 5b"), (1000, "added"), (None, None)], schema)
    touched = L.upsert_parts(spark, at, new, ["k"], 16)
    assert 0 < len(touched) <= 3
    kept = {f for f in before if int(f.parts[0].split("=")[1]) not in touched}
    assert len(kept) > 0 and kept <= files() and all(int(f.parts[0].split("=")[1]) in touched for f in files() - before)
    got = {r.k: r.v for r in spark.read.parquet(at).collect()}
    assert got == {**{i: f"old {i}" for i in range(200)}, 5: "new 5b", 1000: "added", None: None}
    assert spark.read.parquet(at).count() == 202
    after = files()
    assert L.upsert_parts(spark, at, new.limit(0), ["k"], 16) == [] and files() == after
