"""Documents and job events as streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import contains_join
from ..sources import tables as T
from ..sources.shared import shared_folder

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


PENDING = ("queued", "preprocessing", "analyzing")


def _place(spark: SparkSession, name: str, source: str) -> str:
    """A query's folder in the shared one, under its name and its input: a run after a loss, or after more input has come, goes on from there."""
    return f"{shared_folder(spark)}/stream-{name}-{hashlib.sha256(source.encode()).hexdigest()[:16]}"


def run_available(stream: DataFrame, name: str, source: str) -> DataFrame:
    """Runs a stream over all that is there now, and returns what it has written so far."""
    spark = stream.sparkSession
    at = _place(spark, name, source)
    run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(T.DOCUMENTS).parquet(path)


SCANNED = "doc_id LONG, marker STRING, batch LONG"


def stream_scan(spark: SparkSession, documents: str, rules: str, name: str) -> DataFrame:
    """(doc_id, marker, batch) for each marker of the rule table that a document contains, letters in either case, of all that is there now and was before.

    The rule table (marker) is read anew for every batch: documents that come after it has changed are matched with what it holds then, earlier results
    stay. A batch writes its rows to a folder of its own, which it replaces: a batch that is run once more after a loss gives them once.
    """
    at = _place(spark, name, documents)

    def one(docs: DataFrame, batch: int) -> None:
        session = docs.sparkSession
        wanted = session.read.parquet(rules).select(F.lower("marker").alias("marker")).where("marker <> ''").distinct()
        found = contains_join(docs.select("doc_id", F.lower("text").alias("_low")), wanted, "_low", "marker").select("doc_id", "marker")
        found.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    run = document_stream(spark, documents).writeStream.foreachBatch(one).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(SCANNED).parquet(f"{at}/out")


def job_stream(spark: SparkSession, path: str, states: dict[str, str]) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    rows = spark.readStream.schema(EVENTS).parquet(path)
    return rows.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), pairs[F.col("event_type")].alias("status"))


def job_timeouts(log: DataFrame, seconds: int = 120, late: int = 600) -> DataFrame:
    """(job_id, since, status): jobs silent for so many seconds after a pending state. Events that come more than `late` seconds behind are dropped."""
    quiet = log.withWatermark("ts", f"{late} seconds").groupBy("job_id", F.session_window("ts", f"{seconds} seconds").alias("s"))
    last = quiet.agg(F.max(F.struct("ts", "status")).alias("last"))
    return last.where(F.col("last.status").isin(*PENDING)).select("job_id", F.col("last.ts").alias("since"), F.col("last.status").alias("status"))


def timeouts_so_far(spark: SparkSession, path: str, states: dict[str, str], name: str, now: str | None = None, seconds: int = 120, late: int = 600) -> DataFrame:
    """What the stream of time-outs has found, and the sessions it still holds that have been silent for so many seconds by now (the log's last event where that isn't given).

    No later event moves the watermark past these. They are read from the stream's state, a row for each open session: the log itself isn't
    read again, and the next run goes on as if nothing had been asked.
    """
    found = run_available(job_timeouts(job_stream(spark, path, states), seconds, late), name, path)
    state = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_place(spark, name, path)}/state/state")
    if not state.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(state):
        return found  # no event has come yet
    held = spark.read.format("statestore").load(f"{_place(spark, name, path)}/state").where("value is not null")
    open_ = held.select(F.col("value.job_id").alias("job_id"), F.col("value.max.ts").alias("since"), F.col("value.max.status").alias("status"))
    # the last event's own session is among the open ones
    end = F.lit(now).cast("timestamp") if now else F.lit(open_.agg(F.max("since")).first()[0]).cast("timestamp")
    closing = open_.where(F.col("status").isin(*PENDING) & (F.col("since") + F.expr(f"INTERVAL {seconds} SECONDS") <= end))
    return found.unionByName(closing).distinct()
