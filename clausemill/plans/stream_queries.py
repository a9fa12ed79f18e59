"""Streams over the documents and the job log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import rules as R
from ..sources import tables as T
from ..sources.shared import new_folder
from ..streaming import scan as S
from .registry import query

MARKERS = ["license", "rights", "released under", "the", "der", "que"]
# a pattern, as a stream's path is a folder or a pattern, and a table here may be one file
DOCUMENTS, EVENTS = "documents.parque[t]", "events.parque[t]"
STATES = {"signup": "uploaded", "view": "queued", "click": "preprocessing", "purchase": "report_ready", "error": "failed"}


@query(f"SELECT d.doc_id, m.marker FROM documents d JOIN {R.values([(m,) for m in MARKERS])} AS m(marker) ON contains(lower(d.text), m.marker)")
def q_stream_scan(spark, sf):
    rules = f"{new_folder(spark, 'stream-rules')}/table"
    spark.createDataFrame([(m,) for m in MARKERS], "marker string").write.parquet(rules)
    return S.stream_scan(spark, f"{sf}/{DOCUMENTS}", rules, "scan").select("doc_id", "marker")


# Sessions of a job end after 120 seconds of silence; a job is timed out where a session ends in a pending state.
@query(f"""WITH {T.JOB_LOG_CTE}, g AS (SELECT job_id, ts, status, CASE WHEN ts - lag(ts) OVER w < INTERVAL 120 SECOND THEN 0 ELSE 1 END AS fresh FROM job_log WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), e AS (SELECT job_id, n, max(ts) AS since, arg_max(status, (ts, status)) AS status FROM s GROUP BY 1, 2)
  SELECT job_id, epoch_us(since) AS since, status FROM e WHERE status IN ('queued', 'preprocessing', 'analyzing') AND since + INTERVAL 120 SECOND <= (SELECT max(ts) FROM job_log)""")
def q_stream_job_timeout(spark, sf):
    out = S.timeouts_so_far(spark, f"{sf}/{EVENTS}", STATES, "timeouts")
    return out.select("job_id", F.unix_micros("since").alias("since"), "status")
