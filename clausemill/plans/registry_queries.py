"""Remote states, job times, typed configuration, rule packs, and the validation of all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import normalize_language
from ..operators import tables as D
from ..sources import rules as R
from ..sources import tables as T
from .registry import query
from .request_queries import lang_sql
from .table_queries import LATEST, LOG


@query(f"""{LATEST}, r AS (SELECT l.*, ['queued', 'processing', 'completed', 'failed'][job_id % 4 + 1] AS seen, job_id % 8 = 2 AS has_result FROM last l)
  SELECT job_id, CASE WHEN seen = 'processing' THEN 'analyzing' WHEN seen = 'failed' THEN 'failed' WHEN seen = 'completed' AND has_result THEN 'report_ready'
    WHEN seen = 'completed' THEN 'failed' ELSE status END AS status FROM r""")
def q_remote_sync(spark, sf):
    local = D.current_status(T.job_log(spark, sf))
    states = F.array(*[F.lit(s) for s in ("queued", "processing", "completed", "failed")])
    remote = local.select("job_id", F.get(states, (F.col("job_id") % 4).cast("int")).alias("remote_status"), (F.col("job_id") % 8 == 2).alias("has_result"))
    return D.remote_sync(local, remote)


@query(f"""WITH {LOG}, t AS (SELECT job_id, min(ts) FILTER (WHERE status = 'uploaded') AS created, min(ts) FILTER (WHERE status = 'preprocessing') AS started, min(ts) FILTER (WHERE status = 'report_ready') AS finished FROM job_log GROUP BY 1)
  SELECT count(*) FILTER (WHERE started < created) AS started_early, count(*) FILTER (WHERE finished < started) AS finished_early, count(*) FILTER (WHERE finished IS NOT NULL AND started IS NULL) AS never_started FROM t""")
def q_check_job_times(spark, sf):
    return D.violations(D.job_times(T.job_log(spark, sf)), {
        "started_early": F.col("started") >= F.col("created"), "finished_early": F.col("finished") >= F.col("started"),
        "never_started": F.col("finished").isNull() | F.col("started").isNotNull()})


@query(f"WITH {T.CONTRACTS_CTE} SELECT contract_id, {lang_sql('language_raw')} AS language, CASE WHEN language_raw IS DISTINCT FROM {lang_sql('language_raw')} THEN '2024-03-01 00:00:00' ELSE strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM contracts")
def q_touch_updated_at(spark, sf):
    fixed = normalize_language(F.col("language_raw"))
    was = F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss")
    touched = F.when(~F.col("language_raw").eqNullSafe(fixed), "2024-03-01 00:00:00").otherwise(was)
    return T.contracts(spark, sf).select("contract_id", fixed.alias("language"), touched.alias("updated_at"))
