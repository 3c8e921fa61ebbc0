"""Queries over whole pipelines: from raw rows through stage artifacts to digests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests, jobs_pipeline
from ..operators.listings import ShortlistPolicy
from ..sources import artifacts, sinks
from . import inputs
from . import listing_queries as q

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The second run is a day later.
LATER = "2026-03-21 12:00:00"
POLICY = ShortlistPolicy(most=6, least_score=15.0, per_source=3)
NOTIFIED = 3


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = inputs.with_views(sql)
        return f

    return add


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(digest rows, shortlist rows) of a second run, which starts from what the first ranked, and knows what the first showed."""
    root = sinks.shared_path(spark, "jobs-pipeline")
    raw = inputs.jobs(spark, sf_dir).withColumn("pipeline", F.col("job_id") % 20)
    first = jobs_pipeline.Run("first", q.now(), q.REQUEST, POLICY, ("the", "and", "with"))
    jobs_pipeline.run_stages(spark, root, first, raw=raw)
    top = artifacts.read_artifact(spark, root, jobs_pipeline.TOP, task_id="jobs:shortlist", run_id="first")
    history = top.filter("pick is not null").groupBy("job_key").agg(F.max(q.now()).alias("last_shortlisted"), F.max(F.when(F.col("pick") <= NOTIFIED, q.now())).alias("last_notified"))
    second = jobs_pipeline.Run("second", F.lit(LATER).cast("timestamp"), q.REQUEST, POLICY, history=history)
    rows = jobs_pipeline.run_stages(spark, root, second, first="shortlist", upstream="first")
    return rows, artifacts.read_artifact(spark, root, jobs_pipeline.TOP, task_id="jobs:shortlist", run_id="second")


def short(x: str, n: int) -> str:
    t = f"coalesce({q.sq(x)}, '')"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n - 1})) || '…' END"


_KNOWN = lambda x, unknown: f"CASE WHEN {q.canon(x)} IN {unknown} THEN '' ELSE {x} END"
_DAYS = f"greatest((epoch(TIMESTAMP '{LATER}') - epoch(posted_at)) / 86400.0::DOUBLE, 0.0)"
_POSTED = f"""CASE WHEN posted_at IS NOT NULL THEN 'Posted ' || CASE WHEN {_DAYS} < 1 THEN 'today' WHEN {_DAYS} < 14.5 THEN round_even({_DAYS}, 0)::BIGINT || 'd ago' WHEN year(posted_at) = 2026 THEN strftime(posted_at, '%b %d') ELSE strftime(posted_at, '%b %d, %Y') END
 WHEN said = '' THEN '' WHEN starts_with(lower(said), 'posted ') THEN said ELSE 'Posted ' || said END"""
STEPS = [
    q.NORMAL, "collected AS (SELECT job_id, job_id % 20 AS pipeline FROM (SELECT job_id, row_number() OVER (PARTITION BY job_id % 20, lower(trim(coalesce(source, ''))), trim(coalesce(url, '')), lower(trim(coalesce(title, ''))) ORDER BY job_id) AS n FROM jobs) WHERE n = 1)",
    "n_collected AS (SELECT pipeline, count(*) AS collected FROM collected GROUP BY pipeline)", "own AS (SELECT normal.*, pipeline FROM normal JOIN collected USING (job_id))", q.merged_groups("own", "pipeline, job_key", "merged"),
    "n_deduped AS (SELECT pipeline, count(*) AS deduped FROM merged GROUP BY pipeline)", q.MATCHED.replace("FROM normal", "FROM merged"), q.SCORED.replace("__OVERLAP__", q._OVERLAP), q.RANKED.replace("job_id % 20 AS pipeline, ", "").replace("job_id % 20", "pipeline"), q.RANKS,
    "pooled AS MATERIALIZED (SELECT pipeline, job_id, rank, source, company, title, adjusted, coalesce(exp(-age_days / 21.0::DOUBLE), 0.35::DOUBLE) AS freshness, job_key AS group_id, false AS in_cooldown, 0.0::DOUBLE AS repeat_factor FROM ranked)", q.picked("s1", "pooled", POLICY),
    f"history AS (SELECT group_id, bool_or(pick <= {NOTIFIED}) AS notified FROM s1 JOIN pooled USING (pipeline, job_id) WHERE pick IS NOT NULL GROUP BY group_id)",
    "later AS MATERIALIZED (SELECT p.* EXCLUDE (in_cooldown, repeat_factor), coalesce(notified, false) AS in_cooldown, CASE WHEN notified IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS repeat_factor FROM pooled p LEFT JOIN history USING (group_id))", q.picked("s2", "later", POLICY),
    "best AS (SELECT ranked.*, pick FROM s2 JOIN ranked USING (pipeline, job_id) WHERE pick IS NOT NULL)",
    f"cut AS (SELECT pipeline, pick AS rank, job_id, job_key, {short('title', 120)} AS title, {short('company', 120)} AS c, {short('location', 120)} AS l, {short('salary_text', 120)} AS s, {short('source', 80)} AS src, CASE WHEN regexp_matches(url, '^https?://') THEN {short('url', 260)} ELSE '' END AS link, posted_at, {short('posted_raw', 48)} AS said, contains(lower(coalesce(location, '')), 'remote') OR coalesce(mode = 'remote', false) AS remote, quality FROM best)",
    f"""texts AS (SELECT pipeline, rank, job_id, job_key, title, {_KNOWN('c', tuple(q.text.UNKNOWN_COMPANIES))} AS company, {_KNOWN('l', digests.UNKNOWN_PLACES)} AS location, coalesce(nullif(s, ''), 'Not listed') AS salary, upper(src[1]) || src[2:] AS source, link, {_POSTED} AS posted, remote, quality FROM cut)""",
    """lines AS (SELECT *, 'Matches core title and profile preferences.' AS reason, coalesce(nullif(concat_ws(' ', CASE WHEN company = '' THEN 'Company not listed.' END, CASE WHEN location = '' THEN 'Location details are limited.' END, CASE WHEN link = '' THEN 'Direct application link is limited.' END, CASE WHEN posted = '' THEN 'Posted date is unavailable.' END), ''), 'Needs deeper role-level validation before applying.') AS tradeoffs,
 quality < 40 AND company = '' AND link = '' AND posted = '' AS thin, CASE WHEN company <> '' THEN title || ' at ' || company ELSE title END AS heading FROM texts)""",
]


@query("jobs_pipeline", "WITH RECURSIVE " + ", ".join(STEPS) + " SELECT * FROM lines")
def jobs_pipeline_(spark, sf_dir):
    return two_runs(spark, sf_dir)[0]


@query("jobs_pipeline_reasons", "WITH RECURSIVE " + ", ".join(STEPS) + " SELECT pipeline, reason, count(*) AS n FROM s2 WHERE reason IS NOT NULL GROUP BY ALL")
def jobs_pipeline_reasons(spark, sf_dir):
    return two_runs(spark, sf_dir)[1].filter("reason is not null").groupBy("pipeline", "reason").agg(F.count(F.lit(1)).alias("n"))


_JOBS = ", ".join(("rank", "title", "company", "location", "salary", "source", "link", "posted", "remote", "reason", "tradeoffs", "thin", "heading"))
_BLOCK = "array_to_string(list_filter(['### ' || j.rank || '. ' || j.heading, '- Source: ' || coalesce(nullif(j.source, ''), 'Unknown source'), CASE WHEN j.link <> '' THEN '- Link: ' || j.link END, CASE WHEN j.posted <> '' THEN '- ' || j.posted END, CASE WHEN j.location <> '' THEN '- Location: ' || j.location END, '- Salary: ' || j.salary, '- Why selected: ' || j.reason, '- Watchouts: ' || j.tradeoffs], lambda x: x IS NOT NULL), chr(10))"
REPORTS = [
    *STEPS, f"jl AS (SELECT pipeline, list(struct_pack({_JOBS}) ORDER BY rank) AS jobs FROM lines GROUP BY pipeline)", "rc AS (SELECT pipeline, collected, deduped, coalesce(len(jobs), 0)::INTEGER AS shortlisted, coalesce(jobs, []) AS jobs FROM (SELECT DISTINCT pipeline FROM ranked) JOIN n_collected USING (pipeline) JOIN n_deduped USING (pipeline) LEFT JOIN jl USING (pipeline))",
    "ls AS (SELECT *, list_transform(jobs, lambda j: lower(j.source)) AS ss, list_transform(jobs, lambda j: lower(j.title)) AS ts, list_filter(jobs, lambda j: NOT j.thin) AS strong FROM rc)",
    "tops AS (SELECT *, list_max(list_transform(list_filter(ss, lambda s, i: list_position(ss, s) = i), lambda s: struct_pack(n := len(list_filter(ss, lambda x: x = s)), i := -list_position(ss, s), s := s))) AS top, list_slice(list_transform(list_filter(jobs, lambda j, i: list_position(ts, lower(j.title)) = i), lambda j: j.title), 1, 4) AS role_list, list_slice(CASE WHEN len(strong) > 0 THEN strong ELSE jobs END, 1, 3) AS shown FROM ls)",
    """said AS (SELECT *, 'Reviewed ' || collected || ' collected jobs, ' || deduped || ' after dedupe, and shortlisted ' || shortlisted || ' for action.' AS summary, CASE WHEN shortlisted > 0 THEN [top.n || '/' || shortlisted || ' top roles are from ' || top.s || '.', len(list_filter(jobs, lambda j: j.remote)) || '/' || shortlisted || ' roles appear remote-friendly.', len(list_filter(jobs, lambda j: j.salary <> 'Not listed')) || '/' || shortlisted || ' roles include salary signal.'] ELSE ['No shortlist entries were available in this run.'] END AS pl,
 list_filter(list_transform(jobs, lambda j: j.link), lambda x: x <> '') AS links FROM tops)""",
    f"""report AS (SELECT pipeline, collected, deduped, shortlisted, summary, array_to_string(pl, ' ') AS patterns, array_to_string(role_list, ', ') AS roles, {short("concat_ws(' ', " + short('summary', 220) + ", 'Shortlisted ' || shortlisted || ' from ' || collected || ' collected / ' || deduped || ' deduped.', CASE WHEN len(shown) > 0 THEN 'Top picks: ' || array_to_string(list_transform(shown, lambda j: j.heading), '; ') || '.' END)", 500)} AS excerpt,
 '# Jobs Digest' || chr(10) || chr(10) || '## Executive Summary' || chr(10) || summary || chr(10) || chr(10) || '- Collected: ' || collected || chr(10) || '- After dedupe: ' || deduped || chr(10) || '- Shortlisted: ' || shortlisted || chr(10) || '- Strongest patterns: ' || array_to_string(pl, '; ') || CASE WHEN len(role_list) > 0 THEN chr(10) || '- Best-fit roles: ' || array_to_string(role_list, ', ') ELSE '' END || chr(10) || chr(10) || '## Top Jobs' || chr(10)
 || CASE WHEN shortlisted > 0 THEN array_to_string(list_transform(jobs, lambda j: {_BLOCK}), chr(10) || chr(10)) ELSE 'No shortlisted jobs were available.' END AS markdown, shortlisted > 0 AS should_notify, links FROM said)""",
]
_KEY = "'jobs-digest:20260321-12:' || substr(sha256(array_to_string(list_slice(list_filter(links, lambda x, i: list_position(links, x) = i), 1, 5), '|')), 1, 16)"


@query("jobs_digests", "WITH RECURSIVE " + ", ".join(REPORTS) + f" SELECT r.* EXCLUDE (links), {_KEY} AS dedupe_key FROM report r WHERE should_notify AND {_KEY} NOT IN (SELECT {_KEY} FROM report WHERE pipeline % 4 = 0)")
def jobs_digests(spark, sf_dir):
    """Reports that go out: those of pipelines whose number four divides were sent in this hour; other messages have expired."""
    rows, top = two_runs(spark, sf_dir)
    counts = top.groupBy("pipeline").agg(F.max("collected").alias("collected"), F.max("deduped").alias("deduped"))
    reports, later = sinks.stage(digests.digest_reports(rows, counts), "reports"), F.lit(datetime.fromisoformat(LATER))
    expires = later + F.when(F.col("pipeline") % 4 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval -1 hour"))
    sent = digests.unsent(reports, spark.createDataFrame([], "dedupe_key string, expires_at timestamp"), now=later).filter("pipeline % 4 < 2").select("dedupe_key", expires.alias("expires_at"))
    return digests.unsent(reports, sent, now=later).drop("links")
