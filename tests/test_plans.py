"""Modules of queries: names that a query looks up when it runs."""

import ast
from pathlib import Path

import pytest

from clausemill.operators import tables

PLANS = sorted((Path(__file__).resolve().parents[1] / "clausemill" / "plans").glob("*.py"))


@pytest.mark.parametrize("path", PLANS, ids=lambda p: p.stem)
def test_constants_are_given_once(path):
    names = [t.id for s in ast.parse(path.read_text()).body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name) and t.id.isupper()]
    assert len(names) == len(set(names))


def test_duplicates_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows = spark.range(950).selectExpr("CASE WHEN id % 50 = 0 THEN NULL WHEN id < 40 THEN 'same' ELSE 'k' || id END AS k", "id % 1 AS one")
    found = tables.duplicates(rows, ["k", "one"])
    assert sorted(((r.k or ""), r.n) for r in found.collect()) == [("", 19), ("same", 39)]
    assert ", 10), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert tables.duplicates(rows.where("false"), ["k"]).collect() == []
