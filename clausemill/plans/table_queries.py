"""Job logs and the tables that reports live in: constraints, references, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as D
from ..sources import rules as R
from ..sources import tables as T
from ..sources.layout import upsert_parts, write_parts
from ..sources.shared import new_folder
from .registry import query
from .request_queries import lang_sql

LOG = T.JOB_LOG_CTE
LATEST = f"WITH {LOG}, last AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM job_log GROUP BY job_id)"


@query(f"""WITH {LOG}, s AS (SELECT event_id, job_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM job_log)
  SELECT s.event_id, s.before AS from_status, s.status AS to_status FROM s LEFT JOIN {R.TRANSITION_SQL} ON t.from_status = s.before AND t.to_status = s.status
  WHERE s.before IS NOT NULL AND t.to_status IS NULL""")
def q_transition_check(spark, sf):
    return D.illegal_transitions(T.job_log(spark, sf), R.TRANSITIONS)


@query(f"{LATEST} SELECT l.job_id, l.status, coalesce(array_to_string(list(t.to_status ORDER BY t.to_status) FILTER (WHERE t.to_status IS NOT NULL), ','), '') AS next FROM last l LEFT JOIN {R.TRANSITION_SQL} ON t.from_status = l.status GROUP BY 1, 2")
def q_allowed_next(spark, sf):
    allowed = F.create_map(*[x for k, v in R.TRANSITIONS.items() for x in (F.lit(k), F.lit(",".join(sorted(v))))])
    return D.current_status(T.job_log(spark, sf)).select("job_id", "status", F.coalesce(allowed[F.col("status")], F.lit("")).alias("next"))


@query(f"{LATEST} SELECT job_id, status FROM last")
def q_current_status(spark, sf):
    return D.current_status(T.job_log(spark, sf)).select("job_id", "status")


@query(f"{LATEST} SELECT job_id, status FROM last WHERE status IN ('queued', 'preprocessing', 'analyzing') AND ts < TIMESTAMP '2024-03-01' - INTERVAL 120 SECOND")
def q_stuck_jobs(spark, sf):
    return D.stuck_jobs(T.job_log(spark, sf), "2024-03-01 00:00:00").select("job_id", "status")


@query("SELECT sha256(text) AS sha, count(*)::BIGINT AS n, min(doc_id)::BIGINT AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_same_file(spark, sf):
    hashed = T.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return hashed.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"WITH {T.CONTRACTS_CTE} SELECT contract_id, {lang_sql('language_raw')} AS language FROM contracts WHERE language_raw IS DISTINCT FROM {lang_sql('language_raw')}")
def q_backfill_diff(spark, sf):
    from ..functions.lookups import normalize_language

    fixed = T.contracts(spark, sf).withColumn("language", normalize_language(F.col("language_raw")))
    return fixed.where(~F.col("language_raw").eqNullSafe(F.col("language"))).select("contract_id", "language")


@query(f"WITH {T.CONTRACTS_CTE} SELECT role, round(avg(CASE WHEN lower(trim(language_raw)) IS DISTINCT FROM {lang_sql('language_raw')} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share FROM contracts GROUP BY role")
def q_fallback_share(spark, sf):
    from ..functions.lookups import normalize_language

    fell = (~F.lower(F.trim("language_raw")).eqNullSafe(normalize_language(F.col("language_raw")))).cast("int")
    return T.contracts(spark, sf).groupBy("role").agg(F.round(F.avg(fell), 6).alias("share"))


@query("""SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value FROM (SELECT c_custkey AS key, c_name AS value FROM customer) o
  FULL JOIN (SELECT c_custkey + 100 AS key, 'new ' || c_name AS value FROM customer) n ON n.key = o.key""")
def q_upsert(spark, sf):
    old = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    new = old.select((F.col("key") + 100).alias("key"), F.concat(F.lit("new "), F.col("value")).alias("value"))
    at = f"{new_folder(spark, 'customers')}/table"
    write_parts(old, at, ["key"], 64)
    upsert_parts(spark, at, new, ["key"], 64)
    return spark.read.schema(old.schema).parquet(at).select("key", "value")
