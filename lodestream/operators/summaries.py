"""Summaries over runs, events, sources and listings, and what is due or failing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

#: Words that say nothing of a profile.
PROFILE_STOPWORDS = ("the", "and", "for", "with", "that", "this", "from", "you", "your", "our", "are", "will", "have")


def usage_totals(usage: DataFrame, *by: str) -> DataFrame:
    """usage(status, tokens_in, tokens_out, total_tokens, cost, latency_ms): requests, tokens, cost and latency. A row's total is the sum of its parts where it isn't given and both are known; sums of nothing stay null."""
    total = F.coalesce("total_tokens", F.col("tokens_in") + F.col("tokens_out"))
    return usage.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(total).alias("total_tokens"),
        F.sum("cost").alias("cost"), F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"), F.max("latency_ms").alias("longest_ms"),
    )


def as_text_map(counts: DataFrame, key: str, name: str) -> DataFrame:
    """One row: the counts of a column's values as a sorted map, k=n, ...; values are few."""
    per = counts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(key), F.lit("none")), "n"))))
    return per.agg(entries.alias("m")).select(F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(name))


def today(events: DataFrame, runs: DataFrame, *, day: str, zone: str) -> DataFrame:
    """One row of a local day: events by level, the newest of them and their sources; runs by status, tasks, spend, and the share of runs that failed.

    The day's bounds in UTC are constants, so a table partitioned by time is read for these hours alone. Each fact is summed up by itself, and rows of one are joined.
    """
    bounds = dates.day_bounds(F.lit(day).cast("date"), zone)
    inside = lambda c: (F.col(c).cast("timestamp") >= bounds["start"]) & (F.col(c).cast("timestamp") < bounds["end"])
    e, r = events.filter(inside("ts")), runs.filter(inside("started"))
    facts = [
        as_text_map(e, "level", "levels"), as_text_map(e, "source", "sources"), as_text_map(r, "status", "statuses"), e.agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event_id", F.struct("ts", "event_id")).alias("newest_event")),
        r.agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("task_id").alias("n_tasks"), F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(12,8)")).cast("decimal(22,8)").alias("spent"), F.round(F.avg((F.col("status") == "failed").cast("double")), 4).alias("failed_share")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), facts).withColumn("day", F.lit(day))


def source_status(attempts: DataFrame, priority: dict[str, int], *, least: int) -> DataFrame:
    """Per source of attempts(source, status, kept, at, id, error): its worst status, where the worst is success the rows it kept against its target, the last error and how many attempts there were."""
    weight = reduce(lambda a, kv: a.when(F.col("status") == kv[0], kv[1]), priority.items(), F).otherwise(0)
    g = attempts.groupBy("source").agg(F.max_by("status", F.struct(weight, "status")).alias("worst"), F.sum("kept").alias("kept"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "id"))).alias("last_error"), F.count(F.lit(1)).alias("attempts"))
    status = F.when((F.col("worst") == "success") & (F.coalesce("kept", F.lit(0)) < least), "under_target").otherwise(F.col("worst"))
    return g.select("source", status.alias("status"), "kept", "last_error", "attempts")


def completeness(jobs: DataFrame, fields: tuple[str, ...], *, by: str = "source") -> DataFrame:
    """Per group: rows, for each field how many lack it, and the two fields that most lack, as a text; ties go to the field named first, fields that nobody lacks aren't named."""
    lacks = {f: F.count_if(text.as_text(F.col(f).cast("string")).isNull()) for f in fields}
    g = jobs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"missing_{f}") for f, c in lacks.items()])
    ranked = F.sort_array(F.filter(F.array(*[F.struct((-F.col(f"missing_{f}")).alias("n"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(fields)]), lambda x: x["n"] < 0))
    worst = F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: F.concat(x["f"], F.lit(" missing in "), (-x["n"]).cast("string"), F.lit("/"), F.col("n").cast("string"))), "; ")
    return g.withColumn("worst", worst)


def normalisation_rates(raw: DataFrame, normal: DataFrame, fields: tuple[str, ...], *, by: str = "source") -> DataFrame:
    """Per group: raw and kept rows, the share that was kept, and in percent how many of the kept rows lack each field. Both sides are summed up before they meet."""
    r = raw.groupBy(by).agg(F.count(F.lit(1)).alias("raw"))
    k = normal.groupBy(by).agg(F.count(F.lit(1)).alias("kept"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    share = lambda a, b: F.round(100.0 * a / b, 1)
    j = r.join(k, by, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return j.select(by, "raw", "kept", share(F.col("kept"), F.col("raw")).alias("kept_pct"), *[F.when(F.col("kept") > 0, share(F.col(f), F.col("kept"))).alias(f"{f}_missing_pct") for f in fields])


def matching_tasks(tasks: DataFrame, *, kind: str | None = None, statuses: tuple[str, ...] = ()) -> DataFrame:
    """tasks(task_type, status) whose type holds kind, in whatever case, and whose status is one of statuses; either may be left out."""
    out = tasks.filter(F.contains(F.lower("task_type"), F.lit(kind.strip().lower()))) if kind and kind.strip() else tasks
    return out.filter(F.lower("status").isin(*[s.lower() for s in statuses])) if statuses else out


def due(tasks: DataFrame, schedules: DataFrame, *, now: Column, stale_hours: float) -> DataFrame:
    """(kind, id, reason): tasks(task_id, status, next_run_at, updated) that are queued and due, or running for too long, and schedules(schedule_id, enabled, next_run_at) that are enabled and due; a schedule without a time is due at once."""
    late = F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)
    old = F.unix_seconds(now) - F.unix_seconds("updated") > stale_hours * 3600
    t = tasks.withColumn("reason", F.when((F.col("status") == "queued") & late, "due").when((F.col("status") == "running") & old, "stale"))
    s = schedules.filter(F.coalesce("enabled", F.lit(False)) & late)
    return t.filter("reason is not null").select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), "reason").unionByName(s.select(F.lit("schedule").alias("kind"), F.col("schedule_id").alias("id"), F.lit("due").alias("reason")))


def failing_tasks(runs: DataFrame, *, least: int = 2) -> DataFrame:
    """Tasks whose newest run failed, with least failures or more, in the shape of the alert feed's events: one each, at the newest failure, an error where nothing ever succeeded."""
    g = runs.groupBy("task_id").agg(F.max_by("status", F.struct("started", "run_id")).alias("last"), F.max("started").alias("ts"), F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"), F.count_if(F.col("status") == "failed").alias("failures"), F.count_if(F.col("status") == "success").alias("successes"), F.max_by("task_type", F.struct("started", "run_id")).alias("task_type"))
    bad = g.filter((F.col("last") == "failed") & (F.col("failures") >= least))
    said = F.concat(F.lit("task "), F.col("task_id").cast("string"), F.lit(" failed "), F.col("failures").cast("string"), F.lit(" times"))
    return bad.select(F.col("run_id").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("task_failed").alias("event_type"), F.when(F.col("successes") == 0, "error").otherwise("warning").alias("level"), F.concat(F.lit("task:"), F.col("task_type")).alias("source"), said.alias("message"))


def profile_tokens(*parts: Column) -> Column:
    """The distinct words of three letters or more of a text, without numbers and words that say nothing."""
    words = F.array_distinct(text.words(text.canon_unicode(F.concat_ws(" ", *parts))))
    return F.filter(words, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*PROFILE_STOPWORDS))


def skill_overlap(tokens: Column, profile: tuple[str, ...]) -> Column:
    """struct(shared, of, share): how many of a listing's tokens an applicant's profile has, of at most twelve."""
    wanted = sorted({w for p in profile for w in p.lower().split()} - set(PROFILE_STOPWORDS))
    return text.let(tokens, lambda t: F.struct(F.size(F.array_intersect(t, F.array(*map(F.lit, wanted)).cast("array<string>"))).alias("shared"), F.size(t).alias("of"), F.round(F.least(F.size(F.array_intersect(t, F.array(*map(F.lit, wanted)).cast("array<string>"))) / F.greatest(F.least(F.size(t), F.lit(12)), F.lit(1)), F.lit(1.0)), 4).alias("share")))
