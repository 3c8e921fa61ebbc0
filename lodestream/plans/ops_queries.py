"""Queries over runs, tasks, events and heartbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import ops
from ..sources import sinks
from . import inputs

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = inputs.with_views(sql)
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


@query("daily_flags", """WITH d AS (SELECT ts::DATE AS day, count(*) AS events, count_if(level = 'error') AS errors, count_if(level = 'warning') AS warnings, round(sum(value), 2) AS cost FROM events_ GROUP BY 1),
l AS (SELECT *, lag(errors) OVER (ORDER BY day) AS e0, lag(cost) OVER (ORDER BY day) AS c0 FROM d), f AS (SELECT *, events = errors AS no_success, coalesce(errors > 1.5 * e0, false) AS failure_spike, coalesce(cost > 1.5 * c0, false) AS cost_spike FROM l)
SELECT day, events, errors, warnings, cost, no_success, failure_spike, cost_spike, CASE WHEN no_success OR failure_spike THEN 'error' WHEN cost_spike THEN 'warning' ELSE 'info' END AS severity FROM f""")
def daily_flags(spark, sf_dir):
    return ops.daily_flags(inputs.events(spark, sf_dir))


@query("operational_day", "SELECT day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT ts, (ts - INTERVAL 5 HOUR)::DATE AS day FROM events_) GROUP BY day")
def operational_day(spark, sf_dir):
    # New York keeps winter time through the table's January
    e = inputs.events(spark, sf_dir).select("ts", dates.operational_day(F.col("ts").cast("timestamp"), "America/New_York").alias("day"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("events_in_window", "SELECT event_id, ts, level FROM events_ WHERE ts >= '2024-01-10' AND ts < '2024-01-12'")
def events_in_window(spark, sf_dir):
    return ops.in_window(inputs.events(spark, sf_dir), "ts", "2024-01-10", "2024-01-12").select("event_id", "ts", "level")


@query("recent_events", "SELECT event_id, ts, level FROM events_ ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    return ops.newest(inputs.events(spark, sf_dir), "ts", "event_id", 50).select("event_id", "ts", "level")


@query("notable_events", "SELECT event_id, ts, level FROM (SELECT * FROM events_ ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE level IN ('warning', 'error') ORDER BY ts DESC, event_id DESC LIMIT 6")
def notable_events(spark, sf_dir):
    # the limits' order matters: six of the newest 500
    last = ops.newest(inputs.events(spark, sf_dir), "ts", "event_id", 500).select("event_id", "ts", "level")
    return ops.newest(last.filter(F.col("level").isin("warning", "error")), "ts", "event_id", 6)


USAGE = "(SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, value, event_type AS model FROM events_)"


def usage(spark, sf_dir):
    return inputs.events(spark, sf_dir).select(F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), "value", F.col("event_type").alias("model"))


_U = "count(*) AS requests, count_if(status = 'succeeded') AS succeeded, count_if(status = 'failed') AS failed, round(sum(value), 4) AS total, round(avg(value), 4) AS average"


@query("usage_summary", f"SELECT {_U} FROM {USAGE}")
def usage_summary(spark, sf_dir):
    return ops.usage_summary(usage(spark, sf_dir))


@query("usage_by_model", f"SELECT model, {_U} FROM {USAGE} GROUP BY model")
def usage_by_model(spark, sf_dir):
    return ops.usage_summary(usage(spark, sf_dir), "model")


_R = "count(*) AS total, count_if(status = 'success') AS completed, count_if(status = 'failed') AS failed, sum(cost)::DECIMAL(22, 8) AS cost"


@query("run_summary", f"SELECT {_R} FROM runs")
def run_summary(spark, sf_dir):
    return ops.run_summary(inputs.runs(spark, sf_dir))


@query("runs_by_type", f"SELECT task_type, {_R} FROM runs GROUP BY task_type")
def runs_by_type(spark, sf_dir):
    return ops.run_summary(inputs.runs(spark, sf_dir), "task_type")


@query("active_tasks", "SELECT c_name AS task, count(*) AS n, max(started) AS latest FROM runs JOIN customer ON task_id = c_custkey GROUP BY c_name ORDER BY n DESC, task LIMIT 5")
def active_tasks(spark, sf_dir):
    tasks = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("task"))
    return inputs.runs(spark, sf_dir).join(tasks, "task_id").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("started").alias("latest")).orderBy(F.desc("n"), "task").limit(5)


@query("budget_ledger", "SELECT run_id, day, spent, 0.5::DECIMAL(12,8) - spent AS remaining, spent <= 0.5 AS allowed FROM (SELECT run_id, started::DATE AS day, sum(cost) OVER (PARTITION BY started::DATE ORDER BY started, run_id ROWS UNBOUNDED PRECEDING) AS spent FROM runs WHERE started IS NOT NULL)")
def budget_ledger(spark, sf_dir):
    return ops.budget_ledger(inputs.runs(spark, sf_dir), budget=0.5)


@query("failure_mode", "SELECT run_id, task_id, attempt::INTEGER AS attempt, CASE WHEN attempt >= 3 THEN 'permanent' ELSE 'retryable' END AS failure_mode FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY started, run_id) AS attempt FROM runs) WHERE status = 'failed'")
def failure_mode(spark, sf_dir):
    return ops.failure_mode(inputs.runs(spark, sf_dir))


@query("failure_diagnostics", r"""SELECT run_id, CASE WHEN starts_with(error, 'QUEUE') THEN 'queue_enqueue_failure' WHEN starts_with(error, 'APIConn') THEN 'upstream_connection_failure' WHEN starts_with(error, 'VALID') THEN 'validation_failure' WHEN starts_with(error, 'NON_') THEN 'non_retryable_failure' WHEN error LIKE '%budget%' THEN 'budget_blocked' ELSE 'task_execution_failure' END AS category,
 CASE WHEN starts_with(error, 'QUEUE') THEN 'scheduler' WHEN error LIKE '%budget%' THEN 'api' ELSE 'worker' END AS source, CASE WHEN starts_with(error, 'QUEUE') THEN 'QUEUE_ENQUEUE_ERROR' WHEN error LIKE '%budget%' THEN NULL ELSE split_part(error, ':', 1) END AS error_type FROM runs WHERE error IS NOT NULL""")
def failure_diagnostics(spark, sf_dir):
    d = inputs.runs(spark, sf_dir).withColumn("d", text.failure_diagnostics(F.col("error"))).filter("d is not null")
    return d.select("run_id", "d.category", "d.source", "d.error_type")


@query("retry_delays", "SELECT run_id, least(30.0 * pow(2.0, run_id % 9), 900.0) AS delay FROM runs")
def retry_delays(spark, sf_dir):
    return inputs.runs(spark, sf_dir).select("run_id", text.retry_delay(F.col("run_id") % 9 + 1).alias("delay"))


@query("latest_run_per_task", "SELECT task_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY started DESC, run_id DESC) AS n FROM runs) WHERE n = 1")
def latest_run_per_task(spark, sf_dir):
    return ops.latest_per_key(inputs.runs(spark, sf_dir), ["task_id"], "started", "run_id").select("task_id", "run_id", "status")


@query("attempts_left", "SELECT c_custkey AS task_id, coalesce(n, 0) AS used FROM customer LEFT JOIN (SELECT task_id, count(*) AS n FROM runs GROUP BY 1) ON c_custkey = task_id WHERE coalesce(n, 0) < 8")
def attempts_left(spark, sf_dir):
    tasks = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("task_id"))
    return ops.attempts_left(tasks, inputs.runs(spark, sf_dir), most=8)


@query("since_last_run", "WITH d AS (SELECT task_type, started, max(run_id) AS r FROM runs GROUP BY 1, 2), g AS (SELECT *, (started::DATE - lag(started::DATE) OVER (PARTITION BY task_type ORDER BY started))::INTEGER AS gap_days, row_number() OVER (PARTITION BY task_type ORDER BY started DESC) AS n FROM d) SELECT task_type, started, gap_days, floor((epoch(TIMESTAMP '2024-01-31') - epoch(started::TIMESTAMP)) / 3600)::BIGINT AS hours_since FROM g WHERE n = 1")
def since_last_run(spark, sf_dir):
    return ops.since_last(inputs.runs(spark, sf_dir), now())


@query("tasks_without_runs", "SELECT c_custkey AS task_id FROM customer WHERE c_custkey NOT IN (SELECT task_id FROM runs)")
def tasks_without_runs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("task_id")).join(inputs.runs(spark, sf_dir).select("task_id"), "task_id", "left_anti")


@query("tasks_with_failures", "SELECT c_custkey AS task_id FROM customer WHERE c_custkey IN (SELECT task_id FROM runs WHERE status = 'failed')")
def tasks_with_failures(spark, sf_dir):
    failed = inputs.runs(spark, sf_dir).filter("status = 'failed'").select("task_id")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("task_id")).join(failed, "task_id", "left_semi")


@query("planner_sums", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT) AS k_sum FROM events_ GROUP BY event_type")
def planner_sums(spark, sf_dir):
    return inputs.events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k_sum"))


SIGNALS = r"""(SELECT *, CASE WHEN contains(t, 'failed_permanent') OR contains(t, 'blocked_budget') OR contains(t, 'task_failed') OR severity = 'error' THEN 'actionNeeded' WHEN regexp_matches(t, 'watchdog|stale|heartbeat|cpu|memory|disk|health|not_ready') THEN 'system' ELSE 'workflow' END AS category FROM (SELECT *,
 CASE WHEN level = 'error' OR regexp_matches(t, 'failed_permanent|blocked_budget|critical') THEN 'error' WHEN level = 'warning' OR regexp_matches(t, 'failed|stale|watchdog|not_ready') THEN 'warning' ELSE 'info' END AS severity,
 CASE WHEN regexp_matches(t, 'notify|notification') AND regexp_matches(t, 'fail|error|rejected|not_sent|delivery') THEN 'notify-failure' WHEN contains(t, 'watchdog') THEN 'watchdog' WHEN contains(t, 'planner') AND contains(t, 'tick') THEN 'planner-tick' WHEN contains(t, 'task_failed') THEN 'task-failure' WHEN contains(t, 'budget') THEN 'budget' ELSE 'generic' END AS family
FROM (SELECT *, lower(event_type || ' ' || message) AS t FROM events_)))"""
SIGNED = rf"""(SELECT *, CASE family WHEN 'watchdog' THEN 'watchdog:#:' || trim(regexp_replace(sig, '\b(watchdog|agent|heartbeat)\b', '', 'g')) WHEN 'notify-failure' THEN 'notify-failure:unknown_channel' WHEN 'planner-tick' THEN family WHEN 'budget' THEN family WHEN 'task-failure' THEN 'task-failure:' || event_type ELSE event_type || '|' || source || '|' || sig END AS signature
FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '\b[0-9a-f]{{8,}}\b', '#', 'g'), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS sig FROM {SIGNALS}))"""


@query("event_signals", f"SELECT event_id, severity, category, family, signature FROM {SIGNED}")
def event_signals(spark, sf_dir):
    return ops.event_signals(inputs.events(spark, sf_dir)).select("event_id", "severity", "category", "family", "signature")


@query("alert_feed", f"""SELECT signature, n, event_id, family, severity, category, (s + c + CASE WHEN n > 1 THEN least(n * 5, 40) ELSE 0 END + CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(latest)) <= 900 THEN 25 WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(latest)) <= 3600 THEN 10 ELSE 0 END)::BIGINT AS priority FROM (
 SELECT signature, count(*) AS n, arg_max(event_id, struct_pack(ts, event_id)) AS event_id, arg_max(family, struct_pack(ts, event_id)) AS family, max(ts) AS latest, CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END AS severity, CASE WHEN bool_or(category = 'actionNeeded') THEN 'actionNeeded' WHEN bool_or(category = 'workflow') THEN 'workflow' ELSE 'system' END AS category,
 max(CASE severity WHEN 'error' THEN 300 WHEN 'warning' THEN 200 ELSE 100 END) AS s, max(CASE category WHEN 'actionNeeded' THEN 100 WHEN 'workflow' THEN 60 WHEN 'system' THEN 50 ELSE 20 END) AS c FROM {SIGNED} GROUP BY signature)
WHERE family <> 'planner-tick' OR n > 2 OR category = 'actionNeeded'""")
def alert_feed(spark, sf_dir):
    return ops.compress_alerts(ops.event_signals(inputs.events(spark, sf_dir)), now=now()).select("signature", "n", "event_id", "family", "severity", "category", "priority")


ACTIONS = "CASE WHEN contains(t, 'budget') THEN 'adjust_budget' WHEN family = 'notify-failure' THEN 'check_channel' WHEN contains(t, 'failed') THEN 'inspect_runs' WHEN regexp_matches(t, 'watchdog|stale|heartbeat') THEN 'check_heartbeats' WHEN regexp_matches(t, 'planner|approval') THEN 'check_planner' WHEN regexp_matches(t, 'auth|api key') THEN 'check_key' WHEN contains(t, 'template') THEN 'fix_template' END"


@query("alert_top", f"""SELECT category, position, signature, priority, next_action FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, latest DESC, signature) AS position FROM (
 SELECT signature, latest, category, action AS next_action, (s + c + CASE WHEN n > 1 THEN least(n * 5, 40) ELSE 0 END + CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(latest)) <= 900 THEN 25 WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(latest)) <= 3600 THEN 10 ELSE 0 END)::BIGINT AS priority FROM (
 SELECT signature, count(*) AS n, arg_max(family, struct_pack(ts, event_id)) AS family, max(ts) AS latest, CASE max(CASE category WHEN 'actionNeeded' THEN 4 WHEN 'workflow' THEN 3 WHEN 'system' THEN 2 ELSE 1 END) WHEN 4 THEN 'actionNeeded' WHEN 3 THEN 'workflow' WHEN 2 THEN 'system' ELSE 'informational' END AS category, arg_max(act, struct_pack(ts, event_id)) FILTER (act IS NOT NULL) AS action,
 max(CASE severity WHEN 'error' THEN 300 WHEN 'warning' THEN 200 ELSE 100 END) AS s, max(CASE category WHEN 'actionNeeded' THEN 100 WHEN 'workflow' THEN 60 WHEN 'system' THEN 50 ELSE 20 END) AS c FROM (SELECT *, {ACTIONS} AS act FROM {SIGNED}) GROUP BY signature)
 WHERE family <> 'planner-tick' OR n > 2 OR category = 'actionNeeded')) WHERE position <= CASE category WHEN 'actionNeeded' THEN 10 ELSE 12 END""")
def alert_top(spark, sf_dir):
    feed = ops.compress_alerts(ops.event_signals(inputs.events(spark, sf_dir)), now=now())
    return ops.top_per_category(feed, {"actionNeeded": 10, "workflow": 12, "system": 12, "informational": 12}).select("category", "position", "signature", "priority", "next_action")


def beats(spark, sf_dir):
    return inputs.events(spark, sf_dir).select(F.col("user_id").alias("agent"), "ts", F.col("event_id").alias("id"))


@query("agent_status", f"""WITH l AS (SELECT user_id AS agent, max(ts) AS last_seen, count(*) AS beats, epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts))) AS age FROM events_ GROUP BY 1), t AS (SELECT s_suppkey AS agent FROM supplier)
SELECT t.agent, last_seen, beats, CASE WHEN last_seen IS NULL THEN 'missing' WHEN age > 86400 THEN 'stale' ELSE 'active' END AS status FROM t LEFT JOIN l USING (agent) UNION ALL SELECT agent, last_seen, beats, 'historical' FROM l WHERE agent NOT IN (SELECT agent FROM t) AND age > 86400""")
def agent_status(spark, sf_dir):
    tracked = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("agent"))
    return ops.agent_status(beats(spark, sf_dir), tracked, now=now(), stale_after=86400)


@query("retained_beats", "SELECT user_id AS agent, ts, event_id AS id FROM events_ WHERE ts >= '2024-01-20' OR user_id IN (1, 2)")
def retained_beats(spark, sf_dir):
    return ops.retained(beats(spark, sf_dir), cutoff=F.lit("2024-01-20").cast("timestamp_ntz"), keep=(1, 2))


ATTEMPTS = "(SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS query_index, (o_orderkey % 3)::BIGINT * (o_orderkey % 2)::BIGINT AS new_rows FROM orders)"


@query("early_stop", f"""WITH a AS {ATTEMPTS}, b AS (SELECT *, sum((new_rows > 0)::INT) OVER w AS g, sum(new_rows) OVER w AS so_far FROM a WINDOW w AS (PARTITION BY source ORDER BY query_index ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum((new_rows = 0)::INT) OVER (PARTITION BY source, g ORDER BY query_index ROWS UNBOUNDED PRECEDING) >= 3 OR so_far >= 6 AS stop FROM b)
SELECT source, query_index::INTEGER AS query_index, new_rows, NOT coalesce(bool_or(stop) OVER (PARTITION BY source ORDER BY query_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS executed FROM c""")
def early_stop(spark, sf_dir):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    attempts = o.select(F.col("o_custkey").alias("source"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("query_index"), ((F.col("o_orderkey") % 3) * (F.col("o_orderkey") % 2)).cast("long").alias("new_rows"))
    return ops.early_stop(attempts, empty=3, least=6).select("source", "query_index", "new_rows", "executed")


@query("collection_waterfall", """WITH d AS (SELECT source, lang AS src2, md5(coalesce(text, '')) AS k, n_chars > 800 AS kept FROM documents), p AS (SELECT source, k, count(*) AS n, count_if(kept) AS kept FROM d GROUP BY 1, 2), e AS (SELECT k, count(*) AS n, count_if(kept) AS kept FROM d GROUP BY 1)
SELECT source, sum(n)::BIGINT AS discovered, sum(kept)::BIGINT AS kept, count_if(kept > 0) AS distinct_rows, (sum(kept) - count_if(kept > 0))::BIGINT AS collapsed FROM p GROUP BY source UNION ALL SELECT 'all sources', sum(n)::BIGINT, sum(kept)::BIGINT, count_if(kept > 0), (sum(kept) - count_if(kept > 0))::BIGINT FROM e""")
def collection_waterfall(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ops.waterfall(d.select("source", (F.col("n_chars") > 800).alias("kept"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key")))


@query("worst_status", "SELECT task_type AS source, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' ELSE 'success' END AS status, arg_max(error, struct_pack(started, run_id)) FILTER (error IS NOT NULL) AS last_error, count(*) AS attempts FROM runs GROUP BY 1")
def worst_status(spark, sf_dir):
    a = inputs.runs(spark, sf_dir).select(F.col("task_type").alias("source"), "status", "error", F.col("started").alias("at"), F.col("run_id").alias("id"))
    return ops.worst_status(a, {"failed": 3, "running": 2, "success": 1})


@query("contract_audit", "SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'name:required' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment:enum' END) AS violations FROM customer")
def contract_audit(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    return ops.contract_violations(c, ("name",), {"segment": ("BUILDING", "MACHINERY")}, ("id",)).select("id", "violations")


@query("token_costs", "SELECT run_id, ((run_id % 4000)::DECIMAL(18,0) * 2.5::DECIMAL(12,6) + (run_id % 900)::DECIMAL(18,0) * 10::DECIMAL(12,6))::DECIMAL(38,12) / 1000000 AS exact FROM runs")
def token_costs(spark, sf_dir):
    n = F.col("run_id")
    cost = text.token_cost((n % 4000), (n % 900), F.lit("2.5"), F.lit("10"))
    return inputs.runs(spark, sf_dir).select("run_id", cost.cast("double").alias("exact"))


@query("heartbeat_upsert", "SELECT agent, last_seen FROM (SELECT user_id AS agent, max(ts) AS last_seen FROM events_ GROUP BY 1)")
def heartbeat_upsert(spark, sf_dir):
    e = beats(spark, sf_dir)
    last = lambda x: x.groupBy("agent").agg(F.max("ts").alias("last_seen"))
    return sinks.upsert(last(e.filter("ts < '2024-01-15'")), last(e.filter("ts >= '2024-01-15'")), "agent")


@query("metric_gauges", "SELECT 'errors' AS name, count_if(level = 'error') AS value FROM events_ UNION ALL SELECT 'events', count(*) FROM events_")
def metric_gauges(spark, sf_dir):
    return sinks.exposition(inputs.events(spark, sf_dir).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count(F.lit(1)).alias("events")))


@query("planner_decisions", "SELECT task_type, CASE WHEN f / n > 0.5 THEN 'hold_failures' WHEN r > 100 THEN 'hold_backlog' WHEN r > 0 THEN 'execute' ELSE 'wait' END AS decision FROM (SELECT task_type, count(*)::DOUBLE AS n, count_if(status = 'failed') AS f, count_if(status = 'running') AS r FROM runs GROUP BY 1)")
def planner_decisions(spark, sf_dir):
    s = inputs.runs(spark, sf_dir).groupBy("task_type").agg((F.count_if(F.col("status") == "failed") / F.count(F.lit(1))).alias("failure_rate"), F.count_if(F.col("status") == "running").alias("backlog"))
    return s.withColumns({"healthy": F.lit(True), "remaining": F.lit(1.0), "due": F.col("backlog") > 0}).select("task_type", ops.planner_decision().alias("decision"))
