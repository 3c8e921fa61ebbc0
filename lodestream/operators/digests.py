"""Digests of a pipeline's picks: rows with their texts, a report per pipeline, and the decision to send it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

# The wording of digests.
NO_TITLE, NO_SALARY = "Unknown role", "Not listed"
FITS = "Matches core title and profile preferences."
MISSING = {"company": "Company not listed.", "location": "Location details are limited.", "link": "Direct application link is limited.", "posted": "Posted date is unavailable."}
NO_GAPS = "Needs deeper role-level validation before applying."
UNKNOWN_PLACES = ("not listed", "unknown", "unspecified")
NO_JOBS = "No shortlisted jobs were available."
#: How many of a report's rows its message names, and how many titles count as roles.
SHOWN, ROLES = 3, 4


def posted_text(posted: Column, raw: Column, now: Column) -> Column:
    """Posted today, so many days ago up to two weeks, or the date; the raw text where no time is known, empty without both."""
    days = F.greatest((F.unix_seconds(now) - F.unix_seconds(posted)) / 86400.0, F.lit(0.0))
    date = F.when(F.year(posted) == F.year(now), F.date_format(posted, "MMM dd")).otherwise(F.date_format(posted, "MMM dd, yyyy"))
    said = text.short_text(raw, 48)
    known = F.when(days < 1.0, F.lit("today")).when(days < 14.5, F.concat(F.bround(days, 0).cast("long").cast("string"), F.lit("d ago"))).otherwise(date)
    return F.when(posted.isNotNull(), F.concat(F.lit("Posted "), known)).when(said == "", "").when(F.lower(said).startswith("posted "), said).otherwise(F.concat(F.lit("Posted "), said))


def digest_jobs(picks: DataFrame, *, now: Column) -> DataFrame:
    """picks(pipeline, pick, and a listing's columns) as digest rows: rank, texts cut to their lengths, link, what is missing, and whether the row is too thin to be shown in front."""
    c = F.col
    known = lambda x, unknown: F.when(text.canon_ascii(x).isin(*unknown), "").otherwise(x)
    web = F.when(text.as_text(c("url")).rlike("^https?://"), text.short_text(c("url"), 260))
    source = text.short_text(c("source"), 80)
    rows = picks.select(
        "pipeline", c("pick").alias("rank"), "job_id", "job_key", F.coalesce(F.nullif(text.short_text(c("title"), 120), F.lit("")), F.lit(NO_TITLE)).alias("title"), known(text.short_text(c("company"), 120), text.UNKNOWN_COMPANIES).alias("company"),
        known(text.short_text(c("location"), 120), UNKNOWN_PLACES).alias("location"), F.coalesce(F.nullif(text.short_text(c("salary_text"), 120), F.lit("")), F.lit(NO_SALARY)).alias("salary"), F.concat(F.upper(F.substring(source, 1, 1)), F.substring(source, 2, 80)).alias("source"),
        F.coalesce(web, F.lit("")).alias("link"), posted_text(c("posted_at"), c("posted_raw"), now).alias("posted"), (F.lower(F.coalesce("location", F.lit(""))).contains("remote") | F.coalesce(c("mode") == "remote", F.lit(False))).alias("remote"), "quality",
    )
    gaps = F.concat_ws(" ", *[F.when(c(k) == "", said) for k, said in MISSING.items()])
    thin = (F.coalesce("quality", F.lit(0.0)) < 40.0) & reduce(lambda a, b: a & b, [c(k) == "" for k in ("company", "link", "posted")])
    return rows.withColumns({"reason": F.lit(FITS), "tradeoffs": F.when(gaps != "", gaps).otherwise(NO_GAPS), "thin": thin, "heading": F.when(c("company") != "", F.concat("title", F.lit(" at "), "company")).otherwise(c("title"))})


def digest_reports(rows: DataFrame, counts: DataFrame, *, notify_on_empty: bool = False) -> DataFrame:
    """One row per pipeline of counts(pipeline, collected, deduped): numbers, patterns, roles, the excerpt, the whole report in Markdown, and should_notify.

    A pipeline's rows are its picks, as many as the shortlist's policy allows, so gathering them is bounded.
    """
    c = F.col
    jobs = rows.groupBy("pipeline").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "company", "location", "salary", "source", "link", "posted", "remote", "reason", "tradeoffs", "thin", "heading"))).alias("jobs"))
    none = F.array().cast(jobs.schema["jobs"].dataType)
    r = counts.join(jobs, "pipeline", "left").withColumn("jobs", F.coalesce("jobs", none)).withColumn("shortlisted", F.size("jobs"))
    text_of = lambda x: x.cast("string")
    n = text_of(c("shortlisted"))
    sources = F.transform("jobs", lambda j: F.lower(j["source"]))
    # the most frequent source, of equal ones the first
    top = F.array_max(F.transform(F.array_distinct(sources), lambda s, i: F.struct(F.size(F.filter(sources, lambda x: x == s)).alias("n"), (-i).alias("i"), s.alias("s"))))
    lower_titles = F.transform("jobs", lambda j: F.lower(j["title"]))
    roles = F.filter("jobs", lambda j, i: F.array_position(lower_titles, F.lower(j["title"])) == i + 1)
    counted = lambda p: text_of(F.size(F.filter("jobs", p)))
    r = r.withColumns({
        "summary": F.concat(F.lit("Reviewed "), text_of(c("collected")), F.lit(" collected jobs, "), text_of(c("deduped")), F.lit(" after dedupe, and shortlisted "), n, F.lit(" for action.")),
        "patterns": F.when(c("shortlisted") > 0, F.array(F.concat(text_of(top["n"]), F.lit("/"), n, F.lit(" top roles are from "), top["s"], F.lit(".")), F.concat(counted(lambda j: j["remote"]), F.lit("/"), n, F.lit(" roles appear remote-friendly.")), F.concat(counted(lambda j: j["salary"] != NO_SALARY), F.lit("/"), n, F.lit(" roles include salary signal."))))
        .otherwise(F.array(F.lit("No shortlist entries were available in this run."))),
        "roles": F.slice(F.transform(roles, lambda j: j["title"]), 1, ROLES), "shown": F.slice(F.when(F.exists("jobs", lambda j: ~j["thin"]), F.filter("jobs", lambda j: ~j["thin"])).otherwise(c("jobs")), 1, SHOWN),
    })
    line = F.concat(F.lit("Shortlisted "), n, F.lit(" from "), text_of(c("collected")), F.lit(" collected / "), text_of(c("deduped")), F.lit(" deduped."))
    picks = F.when(F.size("shown") > 0, F.concat(F.lit("Top picks: "), F.array_join(F.transform("shown", lambda j: j["heading"]), "; "), F.lit(".")))
    head = F.array(F.lit("# Jobs Digest"), F.lit(""), F.lit("## Executive Summary"), c("summary"), F.lit(""), F.concat(F.lit("- Collected: "), text_of(c("collected"))), F.concat(F.lit("- After dedupe: "), text_of(c("deduped"))), F.concat(F.lit("- Shortlisted: "), n), F.concat(F.lit("- Strongest patterns: "), F.array_join("patterns", "; ")))
    fit = F.when(F.size("roles") > 0, F.array(F.concat(F.lit("- Best-fit roles: "), F.array_join("roles", ", "))))
    optional = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x))
    block = lambda j: F.array_compact(F.array(
        F.concat(F.lit("### "), text_of(j["rank"]), F.lit(". "), j["heading"]), F.concat(F.lit("- Source: "), F.coalesce(F.nullif(j["source"], F.lit("")), F.lit("Unknown source"))), optional("- Link: ", j["link"]), optional("- ", j["posted"]), optional("- Location: ", j["location"]),
        F.concat(F.lit("- Salary: "), j["salary"]), F.concat(F.lit("- Why selected: "), j["reason"]), F.concat(F.lit("- Watchouts: "), j["tradeoffs"]),
    ))
    body = F.when(c("shortlisted") > 0, F.array_join(F.transform("jobs", lambda j: F.array_join(block(j), "\n")), "\n\n")).otherwise(NO_JOBS)
    lines = F.concat(head, F.coalesce(fit, F.array().cast("array<string>")), F.array(F.lit(""), F.lit("## Top Jobs"), body))
    links = F.filter(F.transform("jobs", lambda j: j["link"]), lambda x: x != "")
    return r.select(
        "pipeline", "collected", "deduped", "shortlisted", "summary", F.array_join("patterns", " ").alias("patterns"), F.array_join("roles", ", ").alias("roles"), text.short_text(F.concat_ws(" ", text.short_text(c("summary"), 220), line, picks), 500).alias("excerpt"),
        F.array_join(lines, "\n").alias("markdown"), ((c("shortlisted") > 0) | F.lit(notify_on_empty)).alias("should_notify"), links.alias("links"),
    )


def unsent(reports: DataFrame, sent: DataFrame, *, now: Column, most: int = 5) -> DataFrame:
    """Reports that should go out and haven't in this hour: dedupe_key holds the hour and the first links; sent(dedupe_key, expires_at)."""
    keyed = reports.filter("should_notify").withColumn("dedupe_key", urls.digest_key("jobs-digest", now, F.col("links"), most))
    return keyed.join(sent.filter(F.col("expires_at") > now).select("dedupe_key").distinct(), "dedupe_key", "left_anti")
