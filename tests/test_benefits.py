"""Whose benefit a match is, against a plain loop, and plans that don't grow with the number of questions asked."""

import random

from pyspark.sql import functions as F

from clausemill.functions import deep as D
from clausemill.operators import deep as O
from clausemill.sources import deep_pack as P

BITS = ["buyer", "seller", "supplier", "is liable", "indemnif", "compensates", "pays a penalty", "shall pay a penalty", "recovers", "is entitled to a penalty", "is entitled", "may", "damages", "losses",
        "not recoverable", "liability is excluded", "no penalty is due", "x" * 30, "y" * 45, "покупатель", ""]


def _places(text, words):
    out = []
    for w in words:
        at = text.find(w)
        while at >= 0:
            out.append(at)
            at = text.find(w, at + len(w))
    return out


def _told(rule, t, roles, others):
    near = lambda a, b, n: any(abs(p - q) <= n for p in _places(t, a) for q in _places(t, b))
    leads = lambda a, b, n: any(0 <= q - p <= n for p in _places(t, a) for q in _places(t, b))
    has = lambda words: any(w in t for w in words)
    named = has(roles)
    if rule == "unilateral":
        return False, named and leads(roles, P.BENEFIT[rule], 72)
    if rule not in ("liability", "penalties"):
        return False, False
    pays, good, void = P.BURDEN[rule], P.BENEFIT[rule], rule == "liability" and has(P.RECOVERY_EXCLUDED)
    own = leads(roles, pays, 112) or (void and near(roles, P.RECOVERY_SUBJECT, 88))
    theirs = leads(others, pays, 112) or (void and near(others, P.RECOVERY_SUBJECT, 88))
    burden = bool(roles) and has(others) and not own and not near(others, good, 96) and theirs
    return burden, burden or (has(P.GENERIC_BENEFIT[rule]) and not has(others)) or (named and near(roles, good, 96))


def test_benefits_are_those_of_a_plain_loop(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["liability", "penalties", "unilateral", "acceptance"]), " ".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))),
             rng.choice([["buyer"], ["seller", "supplier"], []]), rng.choice([["seller"], ["buyer", "supplier"], []])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "rule string, t string, roles array<string>, others array<string>")
    got = df.select(D.benefits(*map(F.col, ("rule", "t", "roles", "others"))).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in got] == [_told(*r) for r in rows]
    assert len({tuple(r) for r in got}) == 3


def test_a_role_that_is_null_is_nobodys_benefit(spark):
    df = spark.createDataFrame([("acceptance", "x"), ("liability", "seller is liable"), ("unilateral", "may")], "rule string, t string")
    none = F.lit(None).cast("array<string>")
    got = df.select(D.benefits(F.col("rule"), F.col("t"), none, none).alias("b")).select("b.*").collect()
    assert [r.beneficial for r in got] == [False, None, None]


def test_plans_stay_small(spark):
    docs = spark.createDataFrame([(1, "buyer", "1. Seller is liable for all losses in full.")], "contract_id long, role string, document_text string")
    rows = O.reranked(O.risk_candidates(O.with_signals(O.clause_units(docs)[1])), "rules")
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_report_parts_are_those_of_the_whole(spark):
    docs = spark.createDataFrame([(1, "buyer", "1. Seller is liable for all losses in full.\n\n2. Buyer shall pay 5 EUR. Buyer shall:\na) answer;"), (2, "buyer", "x"), (3, None, None)],
                                 "contract_id long, role string, document_text string")
    part, whole = O.deep_report(docs, parts=("risks",)), O.deep_report(docs)
    assert part.columns == ["contract_id", "role_found", "risks"] and whole.columns == [*part.columns, "disputes", "duties"]
    assert sorted(part.collect()) == sorted(whole.select(*part.columns).collect())
    # one row per clause says whether it names the role
    assert O.role_named(O.clause_units(docs)[1]).count() == 3
