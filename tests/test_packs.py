"""Packs as tables: the starter's scores are those of its expressions, and a pack from JSON changes results."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from clausemill.operators import deep, joins, scoring
from clausemill.sources import deep_pack as P
from clausemill.sources import packs


def candidates(spark, rules, n=400):
    rng = random.Random(7)
    names = list(P.SIGNALS)
    few = lambda: rng.choice([0, 0, 0, 1, 1, 2, 3])
    rows = [(rng.choice(rules), *[{m: few() for m in names} for _ in "hc"], few(), few(), *[rng.random() < 0.5 for _ in range(5)], rng.randint(-5, 15)) for _ in range(n)]
    one = "struct<" + ", ".join(f"{m}: int" for m in names) + ">"
    return spark.createDataFrame(rows, f"rule_id string, h {one}, ch {one}, f_role int, c_role int, f_subject boolean, c_subject boolean, num boolean, mon boolean, norm_mon boolean, total int")


@pytest.mark.parametrize("kind", ["rules", "disputes"])
def test_tables_say_what_the_expressions_say(spark, kind):
    stated = {r[0]: r[-2:] for r in (P.RULES if kind == "rules" else P.DISPUTES)}
    rows = candidates(spark, list(stated))

    def case(part, hits, side):
        names = {n: f"{hits}.{n}" for n in P.SIGNALS} | {"role": f"{side}_role", "subject": f"{side}_subject"}
        put = lambda e: re.sub(r"[a-z_]+", lambda m: names.get(m[0], m[0]), e)
        return F.expr("CASE rule_id " + " ".join(f"WHEN '{r}' THEN {put(e[part])}" for r, e in stated.items()) + " END")

    got = scoring.passing(scoring.context_scores(rows, packs.STARTER, kind), packs.STARTER, kind)
    got = got.withColumns({"f": case(0, "h", "f"), "c": case(0, "ch", "c"), "p": F.coalesce(case(1, "h", "f"), F.lit(False))})
    assert got.where("f <> f_score OR c <> c_score OR p <> passed").count() == 0
    assert got.select("passed").distinct().count() == 2


def test_pack_from_json(spark, tmp_path):
    (tmp_path / "same.json").write_text(packs.STARTER.as_json())
    assert packs.read_pack(spark, f"{tmp_path}/same.json") == packs.STARTER
    own = {
        "signals": dict(packs.STARTER.signals, shouting=["loud", "it's \\ loud"]),
        "rules": [{"rule_id": "noise", "severity": "low", "keywords": ["noise"], "weights": [{"feature": "shouting", "weight": 5, "cap": 1}, {"feature": "one", "weight": -3, "when": [{"feature": "shouting", "at_most": 0}]}],
                   "thresholds": [[{"feature": "total", "at_least": 9}]]}],
    }
    (tmp_path / "own.json").write_text(json.dumps(own))
    pack = packs.read_pack(spark, f"{tmp_path}/own.json")
    docs = spark.createDataFrame([(1, "buyer", "1. The buyer makes loud noise, it's \\ loud."), (2, "buyer", "1. The buyer makes noise.")], "contract_id long, role string, document_text string")
    signals = deep.with_signals(deep.fragment_table(docs), pack)
    got = deep.reranked(deep.risk_candidates(signals, pack), "rules", pack).orderBy("contract_id").collect()
    assert [(r.contract_id, r.rule_id, r.f_score, r.passed) for r in got] == [(1, "noise", 5, True), (2, "noise", -3, False)]


@pytest.mark.parametrize("change, wrong", [
    ({"rules": [{"rule_id": "a", "severity": "low", "keywords": ["x"], "weights": [{"feature": "nothing", "weight": 1}]}]}, "feature 'nothing'"),
    ({"rules": [{"rule_id": "a", "severity": "bad", "keywords": ["x"]}]}, "severity 'bad'"),
    ({"rules": [{"rule_id": "a", "severity": "low", "keywords": []}]}, "keywords"),
    ({"rules": [{"rule_id": "a", "severity": "low", "keywords": ["x"]}] * 2}, "no name of its own"),
    ({"signals": {"role_action": []}, "rules": []}, "no phrases"),
])
def test_broken_packs_are_named(change, wrong):
    with pytest.raises(ValueError, match=wrong):
        packs.from_json(json.dumps({"signals": {"role_action": ["shall"]}, "rules": [], "disputes": [], **change}))


def test_sides_are_measured(spark):
    left, side = spark.range(10), spark.range(5).withColumn("x", F.lit("word"))
    plan = lambda most: joins.sized_join(left, side, "id", "left", most)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1 << 20) and "SortMergeJoin" in plan(10)
    assert joins.fits(side.limit(0), 0)
