"""Streams: rules that change between runs, batches that are run again, sessions that are still open."""

import datetime as dt
import shutil

from clausemill.sources import tables as T
from clausemill.streaming import scan as S

STATES = {"a": "queued", "b": "report_ready", "c": "analyzing"}
T0 = dt.datetime(2024, 1, 1)


def put_docs(spark, at, rows):
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], T.DOCUMENTS).coalesce(1).write.mode("append").parquet(at)


def put_rules(spark, at, markers):
    spark.createDataFrame([(m,) for m in markers], "marker string").write.mode("overwrite").parquet(at)


def test_changed_rules_take_effect_on_the_next_run(spark, tmp_path):
    docs, rules = str(tmp_path / "docs"), str(tmp_path / "rules")
    put_docs(spark, docs, [(1, "A Penalty and a fee"), (2, None), (3, "")])
    put_rules(spark, rules, ["penalty", "PENALTY", "", "none"])
    got = lambda: sorted((r.doc_id, r.marker) for r in S.stream_scan(spark, docs, rules, "changed").collect())
    assert got() == [(1, "penalty")]
    put_rules(spark, rules, ["fee"])
    assert got() == [(1, "penalty")]
    put_docs(spark, docs, [(4, "Penalty: no FEE")])
    assert got() == [(1, "penalty"), (4, "fee")]


def test_a_batch_run_again_gives_its_rows_once(spark, tmp_path):
    docs, rules = str(tmp_path / "docs"), str(tmp_path / "rules")
    put_docs(spark, docs, [(1, "a penalty")])
    put_rules(spark, rules, ["penalty"])
    S.stream_scan(spark, docs, rules, "again")
    # the batch's rows were written, but its end was lost
    at = S._place(spark, "again", docs).removeprefix("file:")
    shutil.rmtree(f"{at}/state/commits")
    assert [(r.doc_id, r.marker) for r in S.stream_scan(spark, docs, rules, "again").collect()] == [(1, "penalty")]


def put_events(spark, at, rows):
    spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), job, kind, None, None) for i, (job, s, kind) in enumerate(rows)], S.EVENTS).coalesce(1).write.mode("append").parquet(at)


def plain_timeouts(rows, now, seconds=120):
    out = set()
    for job in {r[0] for r in rows}:
        mine = sorted((s, STATES[k]) for j, s, k in rows if j == job)
        for n, (s, state) in enumerate(mine):
            ends = n + 1 == len(mine) or mine[n + 1][0] - s >= seconds
            if ends and state in S.PENDING and s + seconds <= now:
                out.add((job, s, state))
    return out


def test_time_outs_from_the_log_and_from_open_sessions(spark, tmp_path):
    at = str(tmp_path / "events")
    first = [(1, 0, "a"), (1, 60, "c"), (2, 10, "b"), (3, 500, "a"), (1, 900, "a"), (4, 1000, "c"), (5, 1100, "b")]
    more = [(6, 1150, "a"), (4, 1090, "a"), (1, 5000, "a"), (2, 5200, "b")]
    found = lambda now=None: {(r.job_id, int((r.since - T0).total_seconds()), r.status) for r in S.timeouts_so_far(spark, at, STATES, "open", now).collect()}
    put_events(spark, at, first)
    assert found() == plain_timeouts(first, 1100)
    # asked again, nothing has changed; nothing was taken from the stream
    assert found() == plain_timeouts(first, 1100)
    put_events(spark, at, more)
    assert found() == plain_timeouts(first + more, 5200)
    assert found("2024-01-01 06:00:00") == plain_timeouts(first + more, 6 * 3600)
