"""Queries for summaries, due rows, failing tasks and profile overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ops, query_plans, summaries
from . import inputs
from . import listing_queries as q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = inputs.with_views(sql)
        return f

    return add


USAGE = "SELECT run_id, task_id, task_type, status, CASE WHEN run_id % 5 <> 0 THEN run_id % 1000 END AS tokens_in, run_id % 77 AS tokens_out, CASE WHEN run_id % 3 = 0 THEN run_id % 2000 END AS total_tokens, cost, CASE WHEN run_id % 4 <> 0 THEN run_id % 9000 END AS latency_ms FROM {runs}"
_TOTALS = "count(*) AS requests, count_if(status = 'success') AS succeeded, count_if(status = 'failed') AS failed, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(coalesce(total_tokens, tokens_in + tokens_out))::BIGINT AS total_tokens, sum(cost)::DECIMAL(22,8) AS cost, round(avg(latency_ms), 2) AS mean_latency_ms, max(latency_ms) AS longest_ms"


def usage(spark, sf_dir):
    return spark.sql(USAGE, runs=inputs.runs(spark, sf_dir))


@query("usage_totals", f"SELECT task_type, {_TOTALS} FROM ({USAGE.format(runs='runs')}) GROUP BY task_type")
def usage_totals(spark, sf_dir):
    return summaries.usage_totals(usage(spark, sf_dir), "task_type")


@query("task_usage", f"SELECT task_id, {_TOTALS} FROM ({USAGE.format(runs='runs')}) GROUP BY task_id")
def task_usage(spark, sf_dir):
    return summaries.usage_totals(usage(spark, sf_dir), "task_id")


#: Runs of the year in which events happen, so that one day has both.
SHIFTED = "SELECT * REPLACE (TIMESTAMP '2024-01-01' + to_seconds(run_id * 97 % 2592000) AS started) FROM runs"
_MAP = lambda c, frame: f"coalesce((SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce({c}, 'none') AS k, count(*) AS n FROM {frame} GROUP BY 1)), '')"


@query("today_facts", f"""WITH e AS (SELECT * FROM events_ WHERE ts >= TIMESTAMP '2024-01-15 05:00:00' AND ts < TIMESTAMP '2024-01-16 05:00:00'), r AS (SELECT * FROM ({SHIFTED}) WHERE started >= TIMESTAMP '2024-01-15 05:00:00' AND started < TIMESTAMP '2024-01-16 05:00:00')
SELECT '2024-01-15' AS day, {_MAP('level', 'e')} AS levels, {_MAP('source', 'e')} AS sources, {_MAP('status', 'r')} AS statuses, (SELECT count(*) FROM e) AS n_events, (SELECT arg_max(event_id, struct_pack(ts, event_id)) FROM e) AS newest_event, count(*) AS n_runs, count(DISTINCT task_id) AS n_tasks, coalesce(sum(cost), 0)::DECIMAL(22,8) AS spent, round(avg((status = 'failed')::INT), 4) AS failed_share FROM r""")
def today_facts(spark, sf_dir):
    runs = inputs.runs(spark, sf_dir).withColumn("started", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("run_id") * 97 % 2592000))
    return summaries.today(inputs.events(spark, sf_dir), runs, day="2024-01-15", zone="America/New_York")


PRIORITY = {"empty_success": 1, "upstream_failure": 2, "layout_mismatch": 3, "auth_blocked": 4}
ATTEMPTS = "SELECT event_id AS id, ts AS at, source || CAST(user_id % 20 AS VARCHAR(9)) AS source, CASE WHEN user_id % 20 < 14 OR event_id % 9 > 3 THEN 'success' WHEN event_id % 9 = 0 THEN 'empty_success' WHEN event_id % 9 = 1 THEN 'upstream_failure' WHEN event_id % 9 = 2 THEN 'layout_mismatch' ELSE 'auth_blocked' END AS status, event_id % 4 AS kept, CASE WHEN event_id % 7 = 0 THEN message END AS error FROM {events}"


@query("source_states", f"""WITH a AS ({ATTEMPTS.format(events='events_').replace('AS at,', 'AS seen,')}), g AS (SELECT source, arg_max(status, struct_pack(w := CASE status WHEN 'empty_success' THEN 1 WHEN 'upstream_failure' THEN 2 WHEN 'layout_mismatch' THEN 3 WHEN 'auth_blocked' THEN 4 ELSE 0 END, s := status)) AS worst, sum(kept)::BIGINT AS kept, arg_max(error, struct_pack(seen, id)) FILTER (error IS NOT NULL) AS last_error, count(*) AS attempts FROM a GROUP BY source)
SELECT source, CASE WHEN worst = 'success' AND kept < 150 THEN 'under_target' ELSE worst END AS status, kept, last_error, attempts FROM g""")
def source_states(spark, sf_dir):
    return summaries.source_status(spark.sql(ATTEMPTS, events=inputs.events(spark, sf_dir)), PRIORITY, least=150)


_FIELDS = ("company", "location", "url", "posted_text", "salary_text")
_WORST = ", ".join(f"struct_pack(n := -missing_{f}, i := {i}, f := '{f}')" for i, f in enumerate(_FIELDS))


@query("listing_gaps", f"SELECT *, array_to_string(list_transform(list_sort(list_filter([{_WORST}], lambda x: x.n < 0))[1:2], lambda x: x.f || ' missing in ' || -x.n || '/' || n), '; ') AS worst FROM (SELECT source, count(*) AS n, {', '.join(f'count_if({q.sq(f)} IS NULL) AS missing_{f}' for f in _FIELDS)} FROM jobs GROUP BY source)")
def listing_gaps(spark, sf_dir):
    return summaries.completeness(inputs.jobs(spark, sf_dir), _FIELDS)


@query("normalisation_rates", q.chained(q.NORMAL) + "SELECT r.source, raw, coalesce(kept, 0) AS kept, round(100.0 * coalesce(kept, 0) / raw, 1) AS kept_pct, CASE WHEN kept > 0 THEN round(100.0 * c / kept, 1) END AS company_missing_pct, CASE WHEN kept > 0 THEN round(100.0 * l / kept, 1) END AS location_missing_pct, CASE WHEN kept > 0 THEN round(100.0 * p / kept, 1) END AS posted_at_missing_pct FROM (SELECT source, count(*) AS raw FROM jobs GROUP BY 1) r LEFT JOIN (SELECT source, count(*) AS kept, count_if(company IS NULL) AS c, count_if(location IS NULL) AS l, count_if(posted_at IS NULL) AS p FROM normal WHERE job_id % 5 <> 0 GROUP BY 1) n USING (source)")
def normalisation_rates(spark, sf_dir):
    """Rows whose id five divides have lost their title before."""
    normal = q.normalized(spark, sf_dir).filter("job_id % 5 <> 0")
    return summaries.normalisation_rates(inputs.jobs(spark, sf_dir), normal, ("company", "location", "posted_at"))


@query("tasks_by_status", "SELECT run_id, task_type, status FROM runs WHERE contains(lower(task_type), 'urgent') AND status IN ('failed', 'running')")
def tasks_by_status(spark, sf_dir):
    return summaries.matching_tasks(inputs.runs(spark, sf_dir), kind=" URGENT ", statuses=("Failed", "running")).select("run_id", "task_type", "status")


TASKS = "SELECT run_id AS task_id, CASE run_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE status END AS status, CASE WHEN run_id % 3 <> 0 THEN CAST(started AS TIMESTAMP) END AS next_run_at, CAST(started AS TIMESTAMP) AS updated FROM {runs}"
SCHEDULES = "SELECT task_id AS schedule_id, CASE task_id % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled, CASE WHEN task_id % 7 <> 0 THEN CAST(max(started) AS TIMESTAMP) END AS next_run_at FROM {runs} GROUP BY task_id"


@query("due_work", f"SELECT 'task' AS kind, task_id AS id, CASE WHEN status = 'queued' AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '1997-01-01') THEN 'due' ELSE 'stale' END AS reason FROM ({TASKS.format(runs='runs')}) WHERE (status = 'queued' AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '1997-01-01')) OR (status = 'running' AND epoch(TIMESTAMP '1997-01-01') - epoch(updated) > 36 * 3600) UNION ALL SELECT 'schedule', schedule_id, 'due' FROM ({SCHEDULES.format(runs='runs')}) WHERE enabled AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '1997-01-01')")
def due_work(spark, sf_dir):
    runs = inputs.runs(spark, sf_dir)
    return summaries.due(spark.sql(TASKS, runs=runs), spark.sql(SCHEDULES, runs=runs), now=F.lit("1997-01-01").cast("timestamp"), stale_hours=36)


@query("failing_tasks", """WITH g AS (SELECT task_id, arg_max(status, struct_pack(started, run_id)) AS last, max(started) AS ts, arg_max(run_id, struct_pack(started, run_id)) AS event_id, count_if(status = 'failed') AS failures, count_if(status = 'success') AS successes, arg_max(task_type, struct_pack(started, run_id)) AS task_type FROM runs GROUP BY task_id)
SELECT event_id, ts::TIMESTAMP AS ts, 'task_failed' AS event_type, CASE WHEN successes = 0 THEN 'error' ELSE 'warning' END AS level, 'task:' || task_type AS source, 'task ' || task_id || ' failed ' || failures || ' times' AS message FROM g WHERE last = 'failed' AND failures >= 2""")
def failing_tasks(spark, sf_dir):
    return summaries.failing_tasks(inputs.runs(spark, sf_dir))


@query("failing_task_alerts", """WITH g AS (SELECT task_id, arg_max(status, struct_pack(started, run_id)) AS last, max(started)::TIMESTAMP AS ts, arg_max(run_id, struct_pack(started, run_id)) AS event_id, count_if(status = 'failed') AS failures, count_if(status = 'success') AS successes FROM runs GROUP BY task_id), f AS (SELECT * FROM g WHERE last = 'failed' AND failures >= 2)
SELECT 'task-failure:task_failed' AS signature, count(*) AS n, arg_max(event_id, struct_pack(ts, event_id)) AS event_id, CASE WHEN bool_or(successes = 0) THEN 'error' ELSE 'warning' END AS severity, 'actionNeeded' AS category, 'inspect_runs' AS next_action FROM f HAVING count(*) > 0""")
def failing_task_alerts(spark, sf_dir):
    """Failing tasks in the alert feed: one signature, by the rules for events."""
    signals = ops.event_signals(summaries.failing_tasks(inputs.runs(spark, sf_dir)))
    return ops.compress_alerts(signals, now=F.lit("1998-08-02").cast("timestamp")).select("signature", "n", "event_id", "severity", "category", "next_action")


_TOKENS = f"list_filter(list_distinct(string_split({q.canon_u("concat_ws(' ', title, description)")}, ' ')), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN {summaries.PROFILE_STOPWORDS})"


@query("skill_overlap", f"SELECT job_id, len(list_intersect(t, ['intern', 'tion', 'ing', 'senior', 'lead', 'der']))::INTEGER AS shared, len(t)::INTEGER AS of, round(least(len(list_intersect(t, ['intern', 'tion', 'ing', 'senior', 'lead', 'der'])) / greatest(least(len(t), 12), 1)::DOUBLE, 1.0), 4) AS share FROM (SELECT job_id, {_TOKENS} AS t FROM jobs)")
def skill_overlap(spark, sf_dir):
    tokens = summaries.profile_tokens(F.col("title"), F.col("description"))
    return inputs.jobs(spark, sf_dir).select("job_id", summaries.skill_overlap(tokens, ("Intern tion ing", "the senior lead", "and der")).alias("o")).select("job_id", "o.*")


REQUESTS = """SELECT job_id AS request_id, CASE job_id % 5 WHEN 0 THEN title WHEN 1 THEN ' ' WHEN 2 THEN 'remote  kiln lead' ELSE NULL END AS explicit, split(CASE job_id % 4 WHEN 0 THEN 'Software Engineer;' || title WHEN 1 THEN 'senior data engineer;Kiln Keeper;kiln  keeper' WHEN 2 THEN 'Remote Machine Learning Engineer;software engineer; ' ELSE title END, ';') AS titles,
 split(CASE job_id % 3 WHEN 0 THEN 'Oslo;Remote;oslo' WHEN 1 THEN coalesce(location, 'Bergen') ELSE 'anywhere;Work from home' END, ';') AS locations, split(CASE job_id % 6 WHEN 0 THEN 'backend;API' WHEN 1 THEN 'Full-Stack;x;platform' ELSE '' END, ';') AS keywords, split(CASE job_id % 7 WHEN 0 THEN 'entry' WHEN 1 THEN 'mid;senior' WHEN 2 THEN 'lead;entry;entry' ELSE '' END, ';') AS levels,
 job_id % 2 = 0 AS remote, CAST(job_id % 25 AS INT) AS most, CAST(1 + job_id % 6 AS INT) AS per_pair, job_id % 8 <> 0 AS expand FROM {jobs}"""
_SQ = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_CLEAN = lambda x: f"list_filter(list_transform({x}, lambda v: {_SQ('v')}), lambda v: v <> '')"
_ONCE = lambda x: f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda y: lower(y)), lower(v)) = i)"
_FAR = lambda x: f"regexp_matches({x}, '{query_plans.REMOTE}')"
_PUT = lambda what, where: f"CASE WHEN {_FAR(where)} AND {_FAR(what)} THEN {what} ELSE {what} || ' ' || {where} END"
_LEVEL = "CASE lv " + " ".join(f"WHEN '{k}' THEN [" + ", ".join("'" + t.replace("{}", "' || seed || '") + "'" for t in names) + "]" for k, names in query_plans.LEVELS.items()) + " ELSE [] END"
_SYNONYM = "flatten([" + ", ".join(f"CASE WHEN regexp_matches(seed, '{p}') THEN {list(names)} ELSE [] END" for p, names in query_plans.SYNONYMS) + "])"
_ROLE = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in query_plans.ROLES.items()) + " END"


@query("search_plans", rf"""WITH q0 AS ({REQUESTS.format(jobs='jobs')}), q1 AS (SELECT request_id, {_SQ("coalesce(explicit, '')")} AS explicit, {_CLEAN('titles')} AS tc, {_CLEAN('locations')} AS lc, keywords, levels, remote, greatest(1, least(most, 20)) AS most, per_pair, expand FROM q0),
 q2 AS (SELECT * EXCLUDE (tc, lc), {_ONCE('tc')} AS titles, {_ONCE('lc')} AS ls FROM q1), q3 AS (SELECT *, CASE WHEN remote AND len(list_filter(ls, lambda x: {_FAR('x')})) = 0 THEN list_append(ls, 'Remote') ELSE ls END AS places FROM q2),
 p AS (SELECT * EXCLUDE (ls, places), generate_subscripts(places, 1) AS lp, unnest(places) AS location FROM q3), pn AS (SELECT *, CASE WHEN {_FAR('location')} THEN {list(query_plans.REMOTE_NAMES)} ELSE [location] END AS names FROM p),
 t AS (SELECT * EXCLUDE (titles), generate_subscripts(titles, 1) AS tp, unnest(titles) AS seed FROM pn), s AS (SELECT *, {q.canon('seed')} AS cs FROM t),
 raw AS (SELECT *, {_CLEAN(f"list_filter(flatten(list_transform(levels, lambda lv: {_LEVEL})), lambda v: {q.canon('v')} <> cs)")} AS a0, {_SYNONYM} AS b0, list_transform(list_filter(list_transform(keywords, lambda k: {q.canon('k')}), lambda k: k <> '' AND NOT contains(cs, k) AND {_ROLE} IS NOT NULL), lambda k: {_ROLE} || ' ' || seed) AS c0 FROM s),
 o AS (SELECT *, {_ONCE('a0')} AS a, {_ONCE('b0')} AS b, {_ONCE('c0')} AS c FROM raw),
 ev AS (SELECT *, list_concat([struct_pack(title := seed, kind := 'base_title')], CASE WHEN expand THEN flatten(list_transform(range(1, greatest(len(a), len(b), len(c)) + 1), lambda i: list_filter([struct_pack(title := a[i], kind := 'seniority'), struct_pack(title := b[i], kind := 'title_synonym'), struct_pack(title := c[i], kind := 'role_specialization')], lambda x: x.title IS NOT NULL))) ELSE [] END) AS e FROM o),
 v AS (SELECT * EXCLUDE (e), list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y.title)), lower(x.title)) = i)[1:per_pair] AS vs FROM ev), f AS (SELECT *, generate_subscripts(vs, 1) AS vp, unnest(vs) AS x FROM v), g AS (SELECT *, generate_subscripts(names, 1) AS np, unnest(names) AS name FROM v WHERE expand),
 every AS (SELECT request_id, most, location, 0 AS stage, lp, 0 AS tp, 0 AS vp, {_PUT('explicit', 'names[1]')} AS query, explicit AS title_seed, 'explicit_query' AS expansion_type FROM pn WHERE explicit <> '' UNION ALL SELECT request_id, most, location, 1, lp, tp, vp, {_PUT('x.title', 'names[1]')}, seed, x.kind FROM f UNION ALL SELECT request_id, most, location, 2, lp, tp, np, {_PUT('vs[1].title', 'name')}, seed, vs[1].kind || '_location_synonym' FROM g WHERE np > 1),
 once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, lower(query) ORDER BY stage, lp, tp, vp) AS n FROM every) WHERE n = 1), numbered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY stage, lp, tp, vp) AS query_index FROM once)
 SELECT request_id, query_index, query, location, title_seed, expansion_type FROM numbered WHERE query_index <= most""")
def search_plans(spark, sf_dir):
    return query_plans.plan_queries(spark.sql(REQUESTS, jobs=inputs.jobs(spark, sf_dir)))
