"""Clauses against rules, markers and roles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import matching as M
from ..operators import report as P
from ..sources import rules as R
from ..sources import tables as T
from .registry import query
from .text_queries import CLAUSES_CTE, LINES_CTE, clauses

MATCH_CTE = f"""{CLAUSES_CTE}, matched AS MATERIALIZED (
  SELECT DISTINCT c.contract_id, c.clause_index, k.rule_id, k.rule_index, k.severity FROM clauses c JOIN {R.KEYWORDS_SQL} ON contains(lower(c.clause_text), k.keyword)
), disputed AS MATERIALIZED (
  SELECT DISTINCT c.contract_id, c.clause_index, m.dispute_id, m.dispute_index, m.confidence, substr(c.clause_text, 1, 300) AS excerpt
  FROM clauses c JOIN {R.MARKERS_SQL} ON contains(lower(c.clause_text), m.marker)
)"""


def matched(spark, sf):
    return M.clause_rule_match(clauses(spark, sf), R.keywords(spark), "contract_id")


def disputed(spark, sf):
    return M.clause_dispute_match(clauses(spark, sf), R.dispute_markers(spark), "contract_id")


@query(f"WITH {MATCH_CTE} SELECT contract_id, clause_index, rule_id, severity FROM matched")
def q_clause_rule_match(spark, sf):
    return matched(spark, sf).select("contract_id", "clause_index", "rule_id", "severity")


@query(f"WITH {MATCH_CTE} SELECT contract_id, clause_index, rule_id, severity FROM matched")
def q_clause_rule_match_blocked(spark, sf):
    """The same rows by way of trigrams, for large dictionaries."""
    units = clauses(spark, sf).select("contract_id", "clause_index", F.lower("clause_text").alias("low"))
    hits = M.contains_join_blocked(units, R.keywords(spark), "low", "keyword")
    return hits.select("contract_id", "clause_index", "rule_id", "severity").distinct()


@query(f"WITH {MATCH_CTE} SELECT contract_id, clause_index, dispute_id, confidence::DOUBLE AS confidence, excerpt FROM disputed")
def q_clause_dispute_match(spark, sf):
    return disputed(spark, sf).select("contract_id", "clause_index", "dispute_id", "confidence", "excerpt")


@query("SELECT doc_id, (contains(text, 'the')::INT + contains(text, 'der')::INT + contains(text, 'que')::INT)::INT AS hits FROM documents")
def q_marker_hits(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", M.marker_hits(F.col("text"), ["the", "der", "que"]).alias("hits"))


def _pos_sql(c: str, marker: str) -> str:
    n = len(marker)
    parts = f"string_split({c}, '{marker}')"
    return f"list_transform(range(1, len({parts})), lambda i: (list_sum(list_transform(list_slice({parts}, 1, i), lambda x: length(x))) + (i - 1) * {n})::INT)"


_POS = f"contract_id, clause_index, {_pos_sql('lower(clause_text)', 'shall')} AS a, list_sort(list_concat({_pos_sql('lower(clause_text)', 'days')}, {_pos_sql('lower(clause_text)', 'buyer')})) AS b"


def _positions(spark, sf):
    low = F.lower("clause_text")
    return clauses(spark, sf).select("contract_id", "clause_index", M.marker_positions(low, ["shall"]).alias("a"), M.marker_positions(low, ["days", "buyer"]).alias("b"))


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, array_to_string(b, ',') AS positions FROM (SELECT {_POS} FROM clauses)")
def q_marker_positions(spark, sf):
    return _positions(spark, sf).select("contract_id", "clause_index", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("positions"))


_EXISTS = "len(list_filter(a, lambda x: len(list_filter(b, lambda y: {})) > 0))"


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, {_EXISTS.format('abs(x - y) <= 24')} > 0 AS near FROM (SELECT {_POS} FROM clauses)")
def q_near_any(spark, sf):
    return _positions(spark, sf).select("contract_id", "clause_index", M.near_any(F.col("a"), F.col("b"), 24).alias("near"))


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, {_EXISTS.format('x <= y AND y - x <= 24')} > 0 AS lead FROM (SELECT {_POS} FROM clauses)")
def q_lead_any(spark, sf):
    return _positions(spark, sf).select("contract_id", "clause_index", M.lead_any(F.col("a"), F.col("b"), 24).alias("lead"))


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, {_EXISTS.format('abs(x - y) <= 24')}::INT AS n FROM (SELECT {_POS} FROM clauses)")
def q_near_count(spark, sf):
    return _positions(spark, sf).select("contract_id", "clause_index", M.near_count(F.col("a"), F.col("b"), 24).alias("n"))


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, clause_index, contains(lower(clause_text), lower(trim(role))) AS mentioned FROM clauses")
def q_role_mention(spark, sf):
    return clauses(spark, sf).select("contract_id", "clause_index", F.contains(F.lower("clause_text"), F.lower(F.trim("role"))).alias("mentioned"))


@query(f"WITH {CLAUSES_CTE} SELECT contract_id, bool_or(contains(lower(clause_text), lower(role))) AS found FROM clauses GROUP BY contract_id")
def q_clause_role_found(spark, sf):
    return clauses(spark, sf).groupBy("contract_id").agg(F.bool_or(F.contains(F.lower("clause_text"), F.lower("role"))).alias("found"))


@query(f"WITH {MATCH_CTE} SELECT contract_id, rule_id, count(*)::BIGINT AS occurrences, array_to_string(list(clause_index + 1 ORDER BY clause_index), ', ') AS refs FROM matched GROUP BY contract_id, rule_id")
def q_clause_occurrence_rollup(spark, sf):
    return P.occurrences(matched(spark, sf), "contract_id").select("contract_id", "rule_id", "occurrences", "refs")


@query(f"""WITH {MATCH_CTE}, o AS (SELECT contract_id, rule_id, severity, count(*) AS n FROM matched GROUP BY ALL)
  SELECT contract_id, rule_id, CASE WHEN n >= 2 AND severity = 'low' THEN 'medium' WHEN n >= 2 AND severity = 'medium' THEN 'high' ELSE severity END AS severity FROM o""")
def q_elevate_severity(spark, sf):
    rolled = P.occurrences(matched(spark, sf), "contract_id")
    return rolled.select("contract_id", "rule_id", P.elevate_severity(F.col("severity"), F.col("occurrences")).alias("severity"))


@query(f"WITH {MATCH_CTE} SELECT contract_id, rule_id, min(clause_index)::INT AS first_clause FROM matched GROUP BY contract_id, rule_id")
def q_clause_risk_group(spark, sf):
    return matched(spark, sf).groupBy("contract_id", "rule_id").agg(F.min("clause_index").alias("first_clause"))


@query(f"WITH {MATCH_CTE} SELECT count(*)::BIGINT AS pairs, count(DISTINCT (contract_id, rule_id))::BIGINT AS groups FROM matched")
def q_pair_dedupe(spark, sf):
    groups = matched(spark, sf).groupBy("contract_id", "rule_id").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("pairs"), F.count("*").alias("groups"))


@query(f"""WITH {MATCH_CTE}, c AS (SELECT contract_id, language, count(*) AS n FROM clauses GROUP BY ALL), r AS (SELECT contract_id, count(*) AS n FROM matched GROUP BY 1)
  SELECT c.contract_id, c.n::BIGINT AS clauses, greatest(coalesce(r.n, 0), 1)::BIGINT AS risks, {R.brief_sql('clauses')} || c.n || {R.brief_sql('risks')} || greatest(coalesce(r.n, 0), 1) || '.' AS overview
  FROM c LEFT JOIN r ON r.contract_id = c.contract_id""")
def q_overview_counts(spark, sf):
    c = clauses(spark, sf).groupBy("contract_id", "language").agg(F.count("*").alias("clauses"))
    r = matched(spark, sf).groupBy("contract_id").agg(F.count("*").alias("r"))
    rows = c.join(r.hint("merge"), "contract_id", "left").select("contract_id", "language", "clauses", F.greatest(F.coalesce("r", F.lit(0)), F.lit(1)).cast("long").alias("risks"))
    words = lambda part: L.said(R.BRIEF, F.lit(part), F.col("language"))
    return rows.select("contract_id", "clauses", "risks", F.concat(words("clauses"), "clauses", words("risks"), "risks", F.lit(".")).alias("overview"))


@query(f"""WITH {LINES_CTE} SELECT contract_id, pos, (3 * (contains(lower(piece), 'shall')::INT + contains(lower(piece), 'must')::INT + contains(lower(piece), 'days')::INT) + 2 * contains(lower(piece), lower(role))::INT)::INT AS score FROM lines""")
def q_line_score(spark, sf):
    low = F.lower("piece")
    score = M.marker_hits(low, ["shall", "must", "days"]) * 3 + F.contains(low, F.lower("role")).cast("int") * 2
    return P.lines(spark, sf).select("contract_id", "pos", score.alias("score"))


@query(f"""WITH {LINES_CTE}, s AS (SELECT contract_id, pos, piece, 3 * (contains(lower(piece), 'shall')::INT + contains(lower(piece), 'must')::INT + contains(lower(piece), 'days')::INT) + 2 * contains(lower(piece), lower(role))::INT AS score FROM lines),
  r AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY score DESC, length(piece), pos) AS n FROM s WHERE score > 0)
  SELECT contract_id, n::INT AS n, piece, score::INT AS score FROM r WHERE n <= 2""")
def q_scored_topk(spark, sf):
    low = F.lower("piece")
    score = M.marker_hits(low, ["shall", "must", "days"]) * 3 + F.contains(low, F.lower("role")).cast("int") * 2
    ranked = P.lines(spark, sf).withColumn("score", score).where("score > 0")
    n = F.row_number().over(W.partitionBy("contract_id").orderBy(F.desc("score"), F.length("piece"), "pos"))
    return ranked.withColumn("n", n).where("n <= 2").select("contract_id", "n", "piece", "score")
