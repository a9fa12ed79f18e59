"""Ranked risks, fallbacks, summaries and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as P
from ..operators import segmentation
from ..sources import rules as R
from ..sources import tables as T
from .match_queries import MATCH_CTE, disputed, matched
from .registry import query
from .request_queries import TEXTS_CTE, case_sql
from .text_queries import CLAUSES_CTE, LINES_CTE, STATEMENTS_CTE, clauses

RANKED = f"""SELECT m.contract_id, 'risk-' || row_number() OVER (PARTITION BY m.contract_id ORDER BY r.rank DESC, m.clause_index, m.rule_index) AS risk_id,
  'clause-' || (m.clause_index + 1) AS clause_id, m.rule_id, m.severity FROM matched m JOIN {R.RANK_SQL} ON r.severity = m.severity"""
RISKS = f"""SELECT f.contract_id, coalesce(k.risk_id, 'risk-1') AS risk_id, k.clause_id, k.rule_id, coalesce(k.severity, 'low') AS severity, ti.words AS title, mi.words AS mitigation
  FROM filled f LEFT JOIN ({RANKED}) k ON k.contract_id = f.contract_id JOIN {R.words_sql(R.RULE_TITLE)} AS ti(rule, lang, words) ON ti.rule = coalesce(k.rule_id, 'none') AND ti.lang = f.language
    JOIN {R.words_sql(R.MITIGATION)} AS mi(rule, lang, words) ON mi.rule = coalesce(k.rule_id, 'none') AND mi.lang = f.language"""
DISPUTES = """SELECT contract_id, 'clause-' || (clause_index + 1) AS clause_id, dispute_id, confidence::DOUBLE AS confidence, excerpt FROM disputed
  UNION ALL SELECT contract_id, 'clause-1', NULL, 0.35::DOUBLE, substr(clause_text, 1, 300) FROM clauses c WHERE clause_index = 0 AND NOT EXISTS (SELECT 1 FROM disputed d WHERE d.contract_id = c.contract_id)"""


@query(f"WITH {MATCH_CTE} {RANKED}")
def q_rank_risks(spark, sf):
    return P.rank_risks(matched(spark, sf), "contract_id").select("contract_id", "risk_id", "clause_id", "rule_id", "severity")


@query(f"WITH {MATCH_CTE} {RISKS}")
def q_fallback_risk(spark, sf):
    return P.with_fallback_risk(segmentation.with_text(T.contracts(spark, sf)), P.rank_risks(matched(spark, sf), "contract_id"), "contract_id")


@query(f"WITH {MATCH_CTE} {DISPUTES}")
def q_fallback_dispute(spark, sf):
    return P.with_fallback_dispute(clauses(spark, sf), disputed(spark, sf), "contract_id")


TIERED = f"""{LINES_CTE}, hit AS MATERIALIZED (
  SELECT DISTINCT l.contract_id, s.section, l.pos, l.piece,
    contains(lower(l.piece), lower(l.role)) OR (s.section NOT IN ('must_do', 'deadlines') AND coalesce(contains(lower(l.piece), lower(l.counterparty_role)), false)) AS named
  FROM lines l JOIN {R.SECTIONS_SQL} ON contains(lower(l.piece), s.marker)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY contract_id, section ORDER BY CASE WHEN named THEN 0 ELSE 1 END, pos) AS n FROM hit
), sections AS MATERIALIZED (
  SELECT c.contract_id, s.section, coalesce(array_to_string(x.items, '|'), 'none: ' || s.section) AS items
  FROM contracts c CROSS JOIN (SELECT DISTINCT section FROM {R.SECTIONS_SQL}) s
  LEFT JOIN (SELECT contract_id, section, list(piece ORDER BY n) AS items FROM ranked WHERE n <= 5 GROUP BY 1, 2) x ON x.contract_id = c.contract_id AND x.section = s.section
)"""


@query(f"WITH {TIERED} SELECT contract_id, section, n::INT AS n, piece FROM ranked WHERE n <= 5 AND section = 'must_do'")
def q_two_tier_topk(spark, sf):
    marks = R.section_markers(spark).where("section = 'must_do'")
    return P.two_tier_topk(P.lines(spark, sf), marks, "contract_id", F.array("role")).select("contract_id", "section", "n", "piece")


@query(f"WITH {TIERED} SELECT contract_id, section, items FROM sections")
def q_role_summary(spark, sf):
    return P.role_summary(spark, sf).select("contract_id", "section", F.array_join("items", "|").alias("items"))


@query(f"WITH {TIERED} SELECT contract_id, section, items FROM sections WHERE items LIKE 'none: %'")
def q_section_fallback(spark, sf):
    return P.role_summary(spark, sf).select("contract_id", "section", F.array_join("items", "|").alias("items")).where("items like 'none: %'")


@query(f"WITH {TIERED} SELECT contract_id, section, unnest(string_split(items, '|')) AS action FROM sections WHERE section <> 'penalties'")
def q_obligation_fanout(spark, sf):
    return P.role_summary(spark, sf).where("section <> 'penalties'").select("contract_id", "section", F.explode("items").alias("action"))


@query(f"WITH {TIERED}, a AS (SELECT DISTINCT contract_id, unnest(string_split(items, '|')) AS action FROM sections WHERE section <> 'should_review') SELECT contract_id, count(*)::BIGINT AS actions FROM a GROUP BY 1")
def q_obligation_union(spark, sf):
    items = P.role_summary(spark, sf).where("section <> 'should_review'").groupBy("contract_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("items")))).alias("actions"))
    return items.select("contract_id", F.col("actions").cast("long").alias("actions"))


@query(f"""WITH {STATEMENTS_CTE}, hit AS (SELECT DISTINCT l.contract_id, s.section, l.pos, l.piece FROM stmts l JOIN {R.SECTIONS_SQL} ON contains(lower(l.piece), s.marker) WHERE contains(lower(l.piece), lower(l.role))),
  r AS (SELECT *, row_number() OVER (PARTITION BY contract_id, section ORDER BY pos) AS n FROM hit) SELECT contract_id, section, n::INT AS n, piece FROM r WHERE n <= 2""")
def q_actor_topk(spark, sf):
    docs = segmentation.with_text(T.contracts(spark, sf)).select("contract_id", "role", "document_text")
    return P.actor_topk(segmentation.statements(docs), R.section_markers(spark), "contract_id", "role").select("contract_id", "section", "n", "piece")


@query(f"""WITH {MATCH_CTE}, risks AS ({RISKS}), disputes AS ({DISPUTES})
  SELECT c.contract_id, c.language, (SELECT count(*) FROM clauses x WHERE x.contract_id = c.contract_id)::BIGINT AS clauses,
    array_to_string((SELECT list(risk_id || ':' || severity ORDER BY risk_id) FROM risks x WHERE x.contract_id = c.contract_id), ',') AS risks,
    (SELECT count(*) FROM disputes x WHERE x.contract_id = c.contract_id)::BIGINT AS disputes FROM filled c""")
def q_analysis_digest(spark, sf):
    out = P.analysis_output(spark, sf)
    risks = F.array_join(F.transform("risks", lambda r: F.concat_ws(":", r["risk_id"], r["severity"])), ",")
    return out.select("contract_id", "language", "clauses", risks.alias("risks"), F.size("disputes").cast("long").alias("disputes"))


# a contract's text is never empty once it has its placeholder: without a mode of its type it is read locally
_MODE = f"coalesce({case_sql(R.MIME_MODES, 'lower(trim(c.mime_type))')}, 'local_first')"


@query(f"""WITH {MATCH_CTE}{TIERED[len(TEXTS_CTE):]}, risks AS ({RISKS}), disputes AS ({DISPUTES}),
  n AS (SELECT contract_id, count(*) AS n FROM clauses GROUP BY 1),
  r AS (SELECT contract_id, string_agg(concat_ws(':', risk_id, severity, clause_id, rule_id), ',' ORDER BY risk_id) AS risks FROM risks GROUP BY 1),
  d AS (SELECT contract_id, string_agg(concat_ws(':', clause_id, dispute_id, confidence::VARCHAR), ',' ORDER BY clause_id, dispute_id) AS disputes FROM disputes GROUP BY 1),
  s AS (SELECT contract_id, string_agg(section || '=' || items, chr(10) ORDER BY section) AS role_summary FROM sections GROUP BY 1)
  SELECT c.contract_id, c.language, c.role, {_MODE} AS mode, n.n::BIGINT AS clauses, r.risks, d.disputes, s.role_summary
  FROM filled c JOIN n ON n.contract_id = c.contract_id JOIN r ON r.contract_id = c.contract_id JOIN d ON d.contract_id = c.contract_id JOIN s ON s.contract_id = c.contract_id""")
def q_analysis_output(spark, sf):
    """The nested rows of all contracts, each part as text."""
    out = P.analysis_output(spark, sf)
    listed = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    sections = F.transform(F.array_sort(F.map_entries("role_summary")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], "|")))
    return out.select(
        "contract_id", "language", "role", "execution_plan.mode", "clauses", listed("risks", lambda r: F.concat_ws(":", r["risk_id"], r["severity"], r["clause_id"], r["rule_id"])),
        listed("disputes", lambda d: F.concat_ws(":", d["clause_id"], d["dispute_id"], d["confidence"].cast("string"))), F.array_join(sections, "\n").alias("role_summary"))


@query(f"WITH {CLAUSES_CTE}, n AS (SELECT contract_id, count(*) AS n FROM clauses GROUP BY 1) SELECT c.contract_id, 'Contract was split into ' || n.n || ' clauses for ' || c.role || '.' AS brief FROM filled c JOIN n ON n.contract_id = c.contract_id")
def q_brief_intro(spark, sf):
    n = clauses(spark, sf).groupBy("contract_id", "role").agg(F.count("*").alias("n"))
    return n.select("contract_id", F.concat(F.lit("Contract was split into "), F.col("n").cast("string"), F.lit(" clauses for "), "role", F.lit(".")).alias("brief"))


@query("SELECT o_orderkey AS contract_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS n FROM orders")
def q_history_order(spark, sf):
    from pyspark.sql import Window as W

    newest = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("contract_id"), F.row_number().over(newest).alias("n"))
