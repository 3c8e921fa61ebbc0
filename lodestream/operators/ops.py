"""Operations analytics over runs, tasks, events, usage, heartbeats and artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def in_window(rows: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows of the half-open window; on a table partitioned by date the other dates aren't read."""
    return rows.filter((F.col(at) >= F.lit(start).cast(rows.schema[at].dataType)) & (F.col(at) < F.lit(end).cast(rows.schema[at].dataType)))


def newest(rows: DataFrame, at: str, key: str, n: int, *, most: int = 500) -> DataFrame:
    """The newest n rows, n held between 1 and most."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(max(1, min(n, most)))


def latest_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns; a maximum, begun on the map side, so a hot key doesn't gather."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def usage_summary(usage: DataFrame, *by: str) -> DataFrame:
    """requests, succeeded, failed, total and average value; sums stay null on no rows."""
    return usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("average"),
    )


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("cost").alias("cost"))


def daily_flags(events: DataFrame, *, zone: str = "UTC", spike: float = 1.5) -> DataFrame:
    """Counts by level and operational day, with flags against the day before: no success, a spike of errors, a spike of cost.

    events(ts, level, value). One row per day, so the window over all days is over a few thousand rows at most.
    """
    daily = events.groupBy(dates.operational_day(F.col("ts"), zone).alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), F.round(F.sum("value"), 2).alias("cost"),
    )
    w = Window.orderBy("day")
    prior = {c: F.lag(c).over(w) for c in ("errors", "cost")}
    out = daily.withColumns({"errors_before": prior["errors"], "cost_before": prior["cost"]})
    no_success = F.col("events") == F.col("errors")
    failure_spike = F.coalesce(F.col("errors") > spike * F.col("errors_before"), F.lit(False))
    cost_spike = F.coalesce(F.col("cost") > spike * F.col("cost_before"), F.lit(False))
    return out.select(
        "day", "events", "errors", "warnings", "cost", no_success.alias("no_success"), failure_spike.alias("failure_spike"), cost_spike.alias("cost_spike"),
        F.when(no_success | failure_spike, "error").when(cost_spike, "warning").otherwise("info").alias("severity"),
    )


def budget_ledger(runs: DataFrame, *, budget: float) -> DataFrame:
    """Spend so far and what remains of a day's budget, run by run; runs without a start don't count."""
    day = F.to_date("started")
    w = Window.partitionBy("day").orderBy("started", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    out = runs.filter(F.col("started").isNotNull()).withColumn("day", day)
    spent = F.sum(F.coalesce("cost", F.lit(0).cast("decimal(12,8)"))).over(w)
    return out.select("run_id", "day", spent.alias("spent"), (F.lit(budget).cast("decimal(12,8)") - spent).alias("remaining"), (spent <= F.lit(budget).cast("decimal(12,8)")).alias("allowed"))


def failure_mode(runs: DataFrame, *, most: int = 3) -> DataFrame:
    """Each failed run with its attempt number in its task, permanent from the most-th on."""
    attempt = F.row_number().over(Window.partitionBy("task_id").orderBy("started", "run_id"))
    return runs.withColumn("attempt", attempt).filter("status = 'failed'").select("run_id", "task_id", "attempt", F.when(F.col("attempt") >= most, "permanent").otherwise("retryable").alias("failure_mode"))


def attempts_left(tasks: DataFrame, runs: DataFrame, *, most: int) -> DataFrame:
    """Tasks with fewer runs than most. Runs are counted before the join."""
    used = runs.groupBy("task_id").agg(F.count(F.lit(1)).alias("used"))
    return tasks.join(used, "task_id", "left").withColumn("used", F.coalesce("used", F.lit(0))).filter(F.col("used") < most)


def since_last(runs: DataFrame, now: Column) -> DataFrame:
    """Per task type: the last start, the hours since, and the gap before it."""
    w = Window.partitionBy("task_type").orderBy("started", "run_id")
    per_day = runs.groupBy("task_type", "started").agg(F.max("run_id").alias("run_id"))
    gaps = per_day.withColumn("gap_days", F.datediff("started", F.lag("started").over(w)))
    last = latest_per_key(gaps, ["task_type"], "started", "run_id")
    return last.select("task_type", "started", "gap_days", F.floor((F.unix_seconds(now) - F.unix_seconds(F.col("started").cast("timestamp"))) / 3600).alias("hours_since"))


# Fixed values of the alert feed: what words in a message mean.
URGENT = ("failed_permanent", "blocked_budget", "task_failed", "auth_rejected", "unauthorized", "rate_limited")
SYSTEM = ("watchdog", "stale", "heartbeat", "cpu", "memory", "disk", "health", "not_ready")
WORKFLOW = ("planner", "task_", "template", "workflow", "deals", "jobs", "resume", "digest", "notify")
SEVERITIES, CATEGORIES = {"error": 300, "warning": 200, "info": 100}, {"actionNeeded": 100, "workflow": 60, "system": 50, "informational": 20}


def has_any(x: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(t) for t in terms])


def signature_text(x: Column) -> Column:
    """Lower case, hex ids and numbers as #, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"\b[0-9a-f]{8,}\b", "#"), r"\d+", "#"), r"\s+", " "))


def event_signals(events: DataFrame) -> DataFrame:
    """events(event_id, ts, event_type, level, source, message) with severity, category, family, signature and next action."""
    t = F.lower(F.concat_ws(" ", "event_type", "message"))
    severity = F.when(F.col("level") == "error", "error").when(has_any(t, ("failed_permanent", "blocked_budget", "critical")), "error").when(F.col("level") == "warning", "warning").when(has_any(t, ("failed", "stale", "watchdog", "not_ready")), "warning").otherwise("info")
    notify_failed = has_any(t, ("notify", "notification")) & has_any(t, ("fail", "error", "rejected", "not_sent", "delivery"))
    family = (
        F.when(notify_failed, "notify-failure").when(t.contains("watchdog"), "watchdog").when(t.contains("stale") & has_any(t, ("agent", "heartbeat")), "stale-agent").when(t.contains("stale"), "stale")
        .when(t.contains("planner") & t.contains("tick"), "planner-tick").when(t.contains("planner") & t.contains("cycle"), "planner-cycle").when(has_any(t, ("task_failed", "failed_permanent")), "task-failure").when(t.contains("budget"), "budget").otherwise("generic")
    )
    out = events.withColumns({"severity": severity, "family": family})
    category = F.when(has_any(t, URGENT) | (F.col("severity") == "error"), "actionNeeded").when(has_any(t, SYSTEM), "system").when(has_any(t, WORKFLOW) | F.col("source").isin("scheduler", "worker", "planner", "notify_v1"), "workflow").otherwise("informational")
    agent = F.regexp_extract(F.lower("message"), r"\b(agent|worker|scheduler)\s*[:=]?\s*([a-z0-9_.-]+)", 2)
    agent = signature_text(F.coalesce(F.nullif(agent, F.lit("")), F.nullif(F.col("source"), F.lit("")), F.lit("unknown")))
    reason = F.trim(F.regexp_replace(signature_text(F.col("message")), r"\b(watchdog|agent|heartbeat)\b", ""))
    signature = (
        F.when(F.col("family") == "watchdog", F.concat(F.lit("watchdog:"), agent, F.lit(":"), F.coalesce(F.nullif(reason, F.lit("")), "event_type"))).when(F.col("family") == "stale-agent", F.concat(F.lit("stale-agent:"), agent)).when(F.col("family") == "notify-failure", F.lit("notify-failure:unknown_channel"))
        .when(F.col("family").isin("planner-tick", "planner-cycle", "budget"), F.col("family")).when(F.col("family") == "task-failure", F.concat(F.lit("task-failure:"), signature_text(F.col("event_type")))).otherwise(F.concat_ws("|", "event_type", "source", signature_text(F.col("message"))))
    )
    action = (
        F.when(t.contains("budget"), "adjust_budget").when(F.col("family") == "notify-failure", "check_channel").when(t.contains("failed"), "inspect_runs").when(has_any(t, ("watchdog", "stale", "heartbeat")), "check_heartbeats").when(has_any(t, ("planner", "approval")), "check_planner").when(has_any(t, ("auth", "api key")), "check_key").when(t.contains("template"), "fix_template")
    )
    return out.withColumns({"category": category, "signature": signature, "next_action": action})


def compress_alerts(signals: DataFrame, *, now: Column) -> DataFrame:
    """One row per signature: count, latest event, largest severity, most pressing category, priority. Planner ticks stay only when they repeat or need action."""
    weight = lambda c, of: reduce(lambda a, kv: a.when(c == kv[0], kv[1]), list(of.items())[1:], F.when(c == next(iter(of)), next(iter(of.values())))).otherwise(0)
    # the latest of the group that names an action
    with_action = F.max_by("next_action", F.when(F.col("next_action").isNotNull(), F.struct("ts", "event_id")))
    g = signals.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("event_id", "family", "source", "message"), F.struct("ts", "event_id")).alias("l"), F.max("ts").alias("latest"), F.max(weight(F.col("severity"), SEVERITIES)).alias("s"), F.max(weight(F.col("category"), CATEGORIES)).alias("c"), with_action.alias("next_action"))
    back = lambda c, of: reduce(lambda a, kv: a.when(c == kv[1], kv[0]), of.items(), F)
    age = F.unix_seconds(now) - F.unix_seconds(F.col("latest").cast("timestamp"))
    fresh = F.when(age <= 900, 25).when(age <= 3600, 10).otherwise(0)
    repeat = F.when(F.col("n") > 1, F.least(F.col("n") * 5, F.lit(40))).otherwise(0)
    out = g.select("signature", "n", F.col("l.event_id").alias("event_id"), F.col("l.family").alias("family"), "latest", back(F.col("s"), SEVERITIES).alias("severity"), back(F.col("c"), CATEGORIES).alias("category"), "next_action", (F.col("s") + F.col("c") + fresh + repeat).cast("long").alias("priority"))
    return out.filter(~F.col("family").isin("planner-tick", "planner-cycle") | (F.col("n") > 2) | (F.col("category") == "actionNeeded"))


def top_per_category(alerts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first alerts of each category by priority; caps names how many."""
    n = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("priority"), F.desc("latest"), "signature"))
    cap = reduce(lambda a, kv: a.when(F.col("category") == kv[0], kv[1]), caps.items(), F).otherwise(0)
    return alerts.withColumn("position", n).filter(F.col("position") <= cap)


def agent_status(beats: DataFrame, tracked: DataFrame, *, now: Column, stale_after: int) -> DataFrame:
    """Tracked agents as active, stale or missing, and untracked stale ones as historical."""
    last = beats.groupBy("agent").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("beats"))
    age = F.unix_seconds(now) - F.unix_seconds(F.col("last_seen").cast("timestamp"))
    known = tracked.select("agent").join(last, "agent", "left").withColumn("status", F.when(F.col("last_seen").isNull(), "missing").when(age > stale_after, "stale").otherwise("active"))
    others = last.join(tracked.select("agent"), "agent", "left_anti").filter(age > stale_after).withColumn("status", F.lit("historical"))
    return known.unionByName(others)


def retained(beats: DataFrame, *, cutoff: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a retention run leaves: rows from the cutoff on, and those of agents on the keep list."""
    return beats.filter((F.col("ts") >= cutoff) | F.col("agent").isin(*keep))


def early_stop(attempts: DataFrame, *, empty: int = 3, least: int | None = None) -> DataFrame:
    """Search attempts (source, query_index, new_rows) that are run before a source stops: after `empty` attempts in a row without a new row, or once `least` rows are there."""
    w = Window.partitionBy("source").orderBy("query_index").rowsBetween(Window.unboundedPreceding, 0)
    runs = attempts.withColumn("streak_id", F.sum((F.col("new_rows") > 0).cast("int")).over(w))
    streak = F.sum((F.col("new_rows") == 0).cast("int")).over(Window.partitionBy("source", "streak_id").orderBy("query_index").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumns({"streak": streak, "so_far": F.sum("new_rows").over(w)})
    stops = (F.col("streak") >= empty) | (F.col("so_far") >= least if least is not None else F.lit(False))
    before = Window.partitionBy("source").orderBy("query_index").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("stop", stops).withColumn("executed", ~F.coalesce(F.max(F.col("stop").cast("int")).over(before) > 0, F.lit(False))).drop("streak_id")


def waterfall(rows: DataFrame) -> DataFrame:
    """Per source and in total: discovered, kept, distinct, collapsed. rows(source, kept, key). A key counts once in its source, and once in the total."""
    per = rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"))
    of = lambda frame: frame.agg(F.sum("n").alias("discovered"), F.sum("kept").alias("kept"), F.count_if(F.col("kept") > 0).alias("distinct_rows"))
    every = per.groupBy("key").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    total = of(every.groupBy(F.lit("all sources").alias("source")))
    return of(per.groupBy("source")).unionByName(total).withColumn("collapsed", F.col("kept") - F.col("distinct_rows"))


def worst_status(attempts: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Per source: its worst status by priority, the last error, and how many attempts there were; summaries.source_status also holds the source against its target."""
    weight = reduce(lambda a, kv: a.when(F.col("status") == kv[0], kv[1]), priority.items(), F).otherwise(0)
    return attempts.groupBy("source").agg(F.max_by("status", F.struct(weight, F.col("status"))).alias("status"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "id"))).alias("last_error"), F.count(F.lit(1)).alias("attempts"))


def score_audit(expected: DataFrame, captured: DataFrame) -> DataFrame:
    """Captured score rows (id, score) against the expected ids: ok, unknown, duplicate, missing or out of range, one row per id."""
    c = captured.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    j = expected.select("id", F.lit(True).alias("wanted")).join(c, "id", "full_outer")
    verdict = F.when(F.col("wanted").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when((F.col("low") < 0) | (F.col("high") > 100) | F.col("low").isNull(), "out_of_range").otherwise("ok")
    return j.select("id", verdict.alias("verdict"))


def contract_violations(rows: DataFrame, required: tuple[str, ...], enums: dict[str, tuple[str, ...]], numeric: tuple[str, ...]) -> DataFrame:
    """rows with violations: what each row breaks, by column."""
    checks = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"{c}:required") for c in required]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), f"{c}:enum") for c, v in enums.items()]
    checks += [F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull(), f"{c}:numeric") for c in numeric]
    return rows.withColumn("violations", F.array_join(F.array_compact(F.array(*checks)), ","))


def planner_decision() -> Column:
    """health, then budget, failure spike, backlog, due: the first that applies to a row of state."""
    return F.when(~F.col("healthy"), "hold_unhealthy").when(F.col("remaining") <= 0, "hold_budget").when(F.col("failure_rate") > 0.5, "hold_failures").when(F.col("backlog") > 100, "hold_backlog").when(F.col("due"), "execute").otherwise("wait")
