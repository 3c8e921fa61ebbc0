"""Summaries on hand-made rows: days across a change of the clocks, targets, ties of gaps, due rows and failing tasks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestream.operators import ops, summaries
from lodestream.plans import registry

T = dt.datetime(2026, 3, 8)


def test_today_is_the_local_day_where_the_clocks_change(spark):
    # 8 March 2026 has 23 hours in New York: 05:00 to 04:00 of the next day in UTC
    hours = [4.9, 5.0, 27.9, 28.0]
    e = spark.createDataFrame([(i, T + dt.timedelta(hours=h), "error" if i % 2 else None, "s") for i, h in enumerate(hours)], "event_id int, ts timestamp, level string, source string")
    r = spark.createDataFrame([(i, i % 2, T + dt.timedelta(hours=h), "failed" if i == 1 else "success", None) for i, h in enumerate(hours)], "run_id int, task_id int, started timestamp, status string, cost decimal(12,8)")
    got = summaries.today(e, r, day="2026-03-08", zone="America/New_York").first()
    assert (got["n_events"], got["levels"], got["newest_event"], got["n_runs"], got["n_tasks"], got["statuses"], got["failed_share"], got["spent"]) == (2, "error=1,none=1", 2, 2, 2, "failed=1,success=1", 0.5, 0)
    none = summaries.today(e, r, day="2026-05-01", zone="America/New_York").first()
    assert (none["n_events"], none["levels"], none["newest_event"], none["failed_share"]) == (0, "", None, None)


def test_totals_are_filled_only_where_both_parts_are_known(spark):
    rows = [("a", "success", 1, 2, None, 10), ("a", "failed", None, 5, None, None), ("a", "running", 1, 1, 50, 30), ("b", "success", None, None, None, None)]
    u = spark.createDataFrame(rows, "k string, status string, tokens_in long, tokens_out long, total_tokens long, latency_ms long").withColumn("cost", F.lit(None).cast("decimal(12,8)"))
    got = {r["k"]: r for r in summaries.usage_totals(u, "k").collect()}
    assert (got["a"]["requests"], got["a"]["succeeded"], got["a"]["failed"], got["a"]["total_tokens"], got["a"]["mean_latency_ms"], got["a"]["longest_ms"]) == (3, 1, 1, 53, 20.0, 30)
    assert got["b"]["total_tokens"] is None and got["b"]["mean_latency_ms"] is None and got["b"]["cost"] is None


def test_a_source_that_works_can_be_under_its_target(spark):
    rows = [("a", "success", 3, 1, 1, None), ("a", "success", 2, 2, 2, "slow"), ("b", "success", 9, 1, 3, None), ("c", "success", 9, 1, 4, "x"), ("c", "auth_blocked", 0, 2, 5, None), ("d", "success", None, 1, 6, None)]
    a = spark.createDataFrame(rows, "source string, status string, kept long, at int, id int, error string")
    got = {r["source"]: (r["status"], r["last_error"]) for r in summaries.source_status(a, {"auth_blocked": 4}, least=6).collect()}
    assert got == {"a": ("under_target", "slow"), "b": ("success", None), "c": ("auth_blocked", "x"), "d": ("under_target", None)}


def test_worst_gaps(spark):
    j = spark.createDataFrame([("s", " ", None, "u"), ("s", "c", None, None), ("t", "c", "l", "u")], "source string, company string, location string, url string")
    got = {r["source"]: (r["n"], r["missing_company"], r["worst"]) for r in summaries.completeness(j, ("company", "location", "url")).collect()}
    assert got == {"s": (2, 1, "location missing in 2/2; company missing in 1/2"), "t": (1, 0, "")}


def test_due_rows(spark):
    tasks = [(1, "queued", None, T), (2, "queued", T, T), (3, "queued", T + dt.timedelta(seconds=1), T), (4, "running", None, T - dt.timedelta(hours=2)), (5, "running", None, T - dt.timedelta(hours=1)), (6, "failed", None, T), (7, "running", None, None)]
    schedules = [(1, True, None), (2, True, T + dt.timedelta(seconds=1)), (3, False, None), (4, None, None), (5, True, T)]
    got = summaries.due(spark.createDataFrame(tasks, "task_id long, status string, next_run_at timestamp, updated timestamp"), spark.createDataFrame(schedules, "schedule_id long, enabled boolean, next_run_at timestamp"), now=F.lit(T), stale_hours=1)
    assert sorted(map(tuple, got.collect())) == [("schedule", 1, "due"), ("schedule", 5, "due"), ("task", 1, "due"), ("task", 2, "due"), ("task", 4, "stale")]


def test_failing_tasks_and_their_alerts(spark):
    rows = [(1, 1, "failed", "a"), (1, 2, "failed", "a"), (2, 1, "success", "b"), (2, 2, "failed", "b"), (2, 3, "failed", "b"), (3, 1, "failed", "a"), (3, 2, "failed", "a"), (3, 3, "success", "a"), (4, 1, "failed", "a")]
    r = spark.createDataFrame([(t, 10 * t + n, T + dt.timedelta(hours=n), s, k) for t, n, s, k in rows], "task_id long, run_id long, started timestamp, status string, task_type string")
    got = {x["event_id"]: (x["level"], x["message"]) for x in summaries.failing_tasks(r).collect()}
    assert got == {12: ("error", "task 1 failed 2 times"), 23: ("warning", "task 2 failed 2 times")}
    alert = ops.compress_alerts(ops.event_signals(summaries.failing_tasks(r)), now=F.lit(T)).collect()
    assert [(a["signature"], a["n"], a["severity"], a["category"], a["next_action"]) for a in alert] == [("task-failure:task_failed", 2, "error", "actionNeeded", "inspect_runs")]


def test_profile_tokens(spark):
    rows = spark.createDataFrame([("The Kiln-Keeper, 2026 of kiln", "and ÉTÉ ab"), (None, None)], "a string, b string")
    got = [r["t"] for r in rows.select(summaries.profile_tokens(F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == [["kiln", "keeper", "été"], []]
    o = rows.select(summaries.skill_overlap(summaries.profile_tokens(F.col("a"), F.col("b")), ("the Kiln", "été")).alias("o")).collect()
    assert [tuple(r["o"]) for r in o] == [(2, 3, 0.6667), (0, 0, 0.0)]


def test_task_filters(spark):
    t = spark.createDataFrame([("jobs_rank", "Failed"), ("deals", "failed"), (None, "queued")], "task_type string, status string")
    assert summaries.matching_tasks(t, kind="JOBS", statuses=("failed",)).count() == 1
    assert summaries.matching_tasks(t, kind=" ").count() == 3 and summaries.matching_tasks(t, statuses=("queued",)).count() == 1


def test_no_two_queries_share_a_name():
    from importlib import reload

    from lodestream.plans import report_queries

    report_queries.QUERIES["jobs_pipeline"] = None
    try:
        with pytest.raises(ValueError, match="jobs_pipeline"):
            reload(registry)
    finally:
        del report_queries.QUERIES["jobs_pipeline"]
        reload(registry)
