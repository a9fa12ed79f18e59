"""Scores and thresholds of candidates from tables of weights and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..sources.packs import Pack
from .joins import sized_join


def _met(features: Column, c: Column) -> Column:
    """A condition's feature lies within its bounds; an open bound is null."""
    value = F.get(features, c["at"])
    return F.coalesce(value >= c["at_least"], F.lit(True)) & F.coalesce(value <= c["at_most"], F.lit(True))


def score(features: Column, terms: Column) -> Column:
    """The sum of weight times value, which a cap bounds, over the terms whose conditions are met."""
    value = lambda t: F.least(F.get(features, t["at"]), t["cap"])  # noqa: E731  least() leaves out a cap that is null
    return F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(F.forall(t["when"], lambda c: _met(features, c)), t["weight"] * value(t)).otherwise(0))


def feature_row(pack: Pack, hits: str, side: str) -> Column:
    """A candidate's features in the pack's order, from its struct of signals and the columns of the side (f, c)."""
    named = {"one": F.lit(1), "role": F.col(f"{side}_role"), "subject": F.col(f"{side}_subject"), "num": F.col("num"), "mon": F.col("mon"), "norm_mon": F.col("norm_mon")}
    return F.array(*[F.coalesce((named[n] if n in named else F.col(f"{hits}.{n}")).cast("int"), F.lit(0)) for n in pack.features() if n != "total"])


def context_scores(rows: DataFrame, pack: Pack, kind: str) -> DataFrame:
    """rows with f_score and c_score, the scores of the fragment and of its clause, by joining each rule's weights.

    A rule's terms are one row of a table that is joined by rule; they are summed within the candidate's row, so that nothing but that join's
    table is sent around, and not that either where it is large. A rule without terms scores 0.
    """
    weights = pack.weights(rows.sparkSession, kind).groupBy("rule_id").agg(F.collect_list(F.struct("at", "weight", "cap", "when")).alias("_terms"))
    rows = sized_join(rows, weights, "rule_id", "left")
    told = lambda h, side: F.coalesce(bound(feature_row(pack, h, side), lambda f: score(f, F.col("_terms"))), F.lit(0))
    return rows.withColumns({"f_score": told("h", "f"), "c_score": told("ch", "c")}).drop("_terms")


def passing(rows: DataFrame, pack: Pack, kind: str) -> DataFrame:
    """rows (with total) with passed: of each clause of the rule's thresholds one condition is met. A rule without thresholds passes."""
    each = pack.thresholds(rows.sparkSession, kind).groupBy("rule_id", "clause").agg(F.collect_list(F.struct("at", "at_least", "at_most")).alias("any_of"))
    rules = each.groupBy("rule_id").agg(F.collect_list("any_of").alias("_clauses"))
    rows = sized_join(rows, rules, "rule_id", "left")
    features = F.concat(feature_row(pack, "h", "f"), F.array("total"))
    met = bound(features, lambda f: F.forall("_clauses", lambda any_of: F.exists(any_of, lambda c: _met(f, c))))
    return rows.withColumn("passed", F.coalesce(met, F.lit(True))).drop("_clauses")
