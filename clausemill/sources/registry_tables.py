"""The registry's tables (users, contracts, jobs, risks, logs, catalogs), derived from the given tables by SQL that both engines run.

They grow with customers, orders, line items and events, and hold faults on purpose: orphans, doubles, values out of range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

SQL = {
    "users": """SELECT c_custkey AS user_id, 'u' || CAST(c_custkey - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END AS VARCHAR(20)) || '@mail.test' AS email,
      CASE WHEN c_custkey % 31 = 0 THEN 'English' WHEN c_custkey % 4 = 0 THEN 'en' ELSE 'ru' END AS locale FROM customer""",
    "role_profiles": """SELECT c_custkey * 2 AS profile_id, CASE WHEN c_custkey % 301 = 7 THEN -1 ELSE c_custkey END AS user_id, 'buyer' AS role, CASE WHEN c_custkey % 41 = 0 THEN 'other' ELSE 'party' END AS role_kind, c_custkey % 3 = 0 AS is_default FROM customer
      UNION ALL SELECT c_custkey * 2 + 1, c_custkey, CASE WHEN c_custkey % 60 = 1 THEN 'buyer' ELSE 'seller' END, 'party', c_custkey % 6 = 0 FROM customer""",
    "contracts": """SELECT o_orderkey AS contract_id, CASE WHEN o_orderkey % 499 = 5 THEN -1 ELSE o_custkey END AS user_id, o_custkey * 2 AS profile_id,
      CASE WHEN o_orderkey % 113 = 0 THEN 'not a digest' ELSE md5(CAST(o_custkey AS VARCHAR(20))) || md5(CAST(o_orderdate AS VARCHAR(30))) END AS file_sha256, 'key/' || CAST(o_orderkey - CASE WHEN o_orderkey % 400 = 399 THEN 1 ELSE 0 END AS VARCHAR(20)) AS storage_key,
      CASE WHEN o_orderkey % 300 = 1 THEN 0 ELSE o_orderkey * 7 % 1000 + 1 END AS size_bytes, CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'F' THEN 'report_ready' ELSE 'analyzing' END AS status,
      CASE WHEN o_orderkey % 70 = 0 THEN 'xx' WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'ru' END AS language_code, CASE WHEN o_orderkey % 3 = 0 THEN 'ru' ELSE 'en' END AS locale, o_orderdate AS uploaded_at,
      CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate END AS deleted_at FROM orders""",
    "analysis_jobs": """SELECT l_orderkey * 10 + l_linenumber AS job_id, CASE WHEN l_partkey % 700 = 3 THEN -l_orderkey - 1 ELSE l_orderkey END AS contract_id, l_suppkey AS requested_by,
      CASE l_returnflag WHEN 'A' THEN 'queued' WHEN 'N' THEN 'running' ELSE CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'failed' END END AS status, l_linenumber + CASE WHEN l_partkey % 53 = 0 THEN 9 ELSE 0 END AS priority,
      CAST(l_orderkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(20)) AS idempotency_key, CASE WHEN l_suppkey % 40 = 0 THEN 'xx' ELSE 'en' END AS language_code, l_shipdate AS created_at FROM lineitem""",
    "risk_items": """SELECT l_orderkey * 10 + l_linenumber AS risk_id, l_orderkey * 10 + l_linenumber AS job_id, l_orderkey AS contract_id, CASE WHEN l_partkey % 101 = 0 THEN 'severe' WHEN l_returnflag = 'A' THEN 'low' WHEN l_returnflag = 'N' THEN 'medium' ELSE 'high' END AS severity,
      l_quantity * 2.2 AS score, l_discount * 11 AS confidence, CASE l_linenumber % 3 WHEN 0 THEN 'payment' WHEN 1 THEN 'liability' ELSE 'term' END AS category, CASE l_suppkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS role_impact FROM lineitem WHERE l_quantity > 20""",
    "disputed_clauses": """SELECT l_orderkey * 10 + l_linenumber AS dispute_id, l_orderkey * 10 + l_linenumber + CASE WHEN l_partkey % 90 = 0 THEN 9 ELSE 0 END AS job_id, l_orderkey AS contract_id, l_tax * 13 AS confidence, CASE WHEN l_partkey % 77 = 0 THEN '' ELSE 'clause' END AS clause_text FROM lineitem WHERE l_tax > 0.04""",
    "summaries": """SELECT o_orderkey AS summary_id, o_orderkey * 10 + 1 + CASE WHEN o_orderkey % 200 = 199 THEN -10 ELSE 0 END AS job_id, o_orderkey AS contract_id, CASE WHEN o_orderkey % 33 = 0 THEN '' ELSE 'brief' END AS brief, CASE WHEN o_orderkey % 80 = 0 THEN '{}' ELSE '[]' END AS key_terms FROM orders""",
    "audit_logs": """SELECT event_id, user_id, user_id * 3 AS contract_id, user_id * 30 + 1 AS job_id, event_type, ts AS created_at, CASE WHEN event_id % 90 = 0 THEN '[]' ELSE props END AS event_payload FROM events""",
    "language_catalog": """SELECT CAST(floor(c_custkey / 5) AS BIGINT) AS scope, CASE c_custkey % 5 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' WHEN 2 THEN 'it' WHEN 3 THEN 'fr' ELSE 'de' END AS code, c_acctbal > 2000 AS is_active, c_custkey % 7 = 0 AS is_default FROM customer""",
    "app_config": """SELECT CAST(floor(c_custkey / 4) AS BIGINT) AS scope, CASE c_custkey % 4 WHEN 0 THEN 'jobs.min_priority' WHEN 1 THEN 'jobs.max_priority' WHEN 2 THEN 'quality.target' ELSE CASE WHEN c_custkey % 12 = 3 THEN 'Odd Key' ELSE 'language.default' END END AS config_key,
      CASE WHEN c_custkey % 4 = 3 THEN 'string' ELSE 'integer' END AS value_type, CASE WHEN c_custkey % 4 = 3 THEN '"' || CASE WHEN c_custkey % 8 = 3 THEN 'en' ELSE 'it' END || '"' WHEN c_custkey % 44 = 0 THEN '"many"' ELSE CAST(c_custkey % 11 AS VARCHAR(5)) END AS value_json, c_custkey AS updated_by FROM customer""",
}
SOURCES = ("customer", "orders", "lineitem", "events")


def cte(*names: str) -> str:
    """The tables as common table expressions of DuckDB; a name that is taken gets an r_ before it."""
    return ", ".join(f"r_{n} AS ({SQL[n]})" for n in names)


def registry_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    used = [s for s in SOURCES if f"FROM {s}" in sql]
    for s in used:
        sql = sql.replace(f"FROM {s}", "FROM {" + s + "}").replace("'{}'", "'{{}}'")
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in used})
