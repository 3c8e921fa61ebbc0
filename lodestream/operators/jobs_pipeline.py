"""The listings pipeline: collect, normalise, rank, shortlist and digest, each stage reading its predecessor's artifact and leaving its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..sources.artifacts import Contract, read_artifact, write_artifact
from . import deals, digests, listings

RAW = Contract("jobs_raw", 1, "pipeline long, job_id long, source string, title string, company string, location string, salary_text string, posted_text string, work_mode_text string, experience_text string, url string, description string")
NORMALIZED = Contract("jobs_normalized", 1, "pipeline long, job_id long, job_key string, title string, company string, location_key string, quality double, members long, collected long")
SCORED = Contract("jobs_scored", 1, "pipeline long, job_id long, job_key string, rank int, adjusted double, overall double, tier string, collected long, deduped long")
TOP = Contract("jobs_top", 1, "pipeline long, job_id long, job_key string, pick long, effective double, reason string, collected long, deduped long")
DIGEST = Contract("jobs_digest", 2, "pipeline long, rank long, job_id long, title string, company string, salary string, link string, tradeoffs string")


@dataclass(frozen=True)
class Run:
    """Parameters of a run. history(job_key, last_shortlisted, last_notified): what earlier runs showed, None if nothing; ranked: rows that are ranked in each pipeline, None for all."""

    run_id: str
    now: Column
    request: listings.Request
    policy: listings.ShortlistPolicy
    profile: tuple[str, ...] = ()
    history: DataFrame | None = None
    cooldown_days: int = 3
    ranked: int | None = 200
    task: str = "jobs"


def collect(raw: DataFrame, run: Run) -> DataFrame:
    """Raw rows, each listing of a pipeline once, as first seen."""
    wanted = [c.split(" ")[0] for c in RAW.columns.split(", ")]
    return deals.first_seen(raw.select(*wanted), [F.col("pipeline"), *deals.natural_key()], [F.col("job_id")])


def normalize(raw: DataFrame, run: Run) -> DataFrame:
    """Enriched rows, one per duplicate group of a pipeline, with how many rows the pipeline has collected."""
    n = raw.groupBy("pipeline").agg(F.count(F.lit(1)).alias("collected"))
    rows = listings.normalize(raw, scraped_at=run.now, keep=("pipeline",))
    return listings.duplicate_groups(rows, by=("pipeline", "job_key")).join(n, "pipeline")


def rank(groups: DataFrame, run: Run) -> DataFrame:
    """Scores, penalties and ranks; of each pipeline the best rows by score and quality, as many as the run ranks."""
    n = groups.groupBy("pipeline").agg(F.count(F.lit(1)).alias("deduped"))
    scored = listings.fallback_scores(groups, run.request, run.profile)
    if run.ranked is not None:
        scored = listings.top_ranked(scored, run.ranked, F.desc(F.col("overall") - F.col("penalty")), F.desc("quality"), F.asc("job_id"))
    return listings.diversity(scored).join(n, "pipeline")


def shortlist(scored: DataFrame, run: Run) -> DataFrame:
    """Every ranked row with its pick, or why it has none. Rows shown lately are held back, those shortlisted before lose points by how long that is ago."""
    rows = scored.withColumns({"freshness": dates.freshness(F.col("age_days")), "group_id": F.col("job_key")})
    if run.history is None:
        rows = rows.withColumns({"in_cooldown": F.lit(False), "repeat_factor": F.lit(0.0)})
    else:
        rows = rows.join(run.history.select("job_key", "last_shortlisted", "last_notified"), "job_key", "left")
        since = (F.unix_seconds(run.now) - F.unix_seconds("last_notified")) / 86400.0
        before = F.when(F.col("last_shortlisted").isNotNull(), dates.history_factor(F.col("last_shortlisted"), run.now)).when(F.col("last_notified").isNotNull(), dates.history_factor(F.col("last_notified"), run.now) * 0.5)
        rows = rows.withColumns({"in_cooldown": F.coalesce(since < run.cooldown_days, F.lit(False)), "repeat_factor": F.coalesce(before, F.lit(0.0))})
    picks = listings.shortlist(rows, run.policy)
    return picks.join(scored, ["pipeline", "job_id"])


def digest(top: DataFrame, run: Run) -> DataFrame:
    return digests.digest_jobs(top.filter("pick is not null"), now=run.now)


#: name, the contract it reads, what it does, the contract it writes.
STAGES: tuple[tuple[str, Contract | None, Callable[[DataFrame, Run], DataFrame], Contract], ...] = (
    ("collect", None, collect, RAW), ("normalize", RAW, normalize, NORMALIZED), ("rank", NORMALIZED, rank, SCORED), ("shortlist", SCORED, shortlist, TOP), ("digest", TOP, digest, DIGEST),
)


def run_stages(spark: SparkSession, root: str, run: Run, *, raw: DataFrame | None = None, first: str = "collect", upstream: str | None = None) -> DataFrame:
    """Runs the stages from `first` on and returns the digest's rows.

    The first stage reads the artifact of its predecessor in the run named upstream (by default this run): so a run goes on where it died, or a later one starts from what an earlier
    one has ranked. Only collect takes raw rows instead. Each stage is a task of its own, named by the run's task and the stage.
    """
    names = [s[0] for s in STAGES]
    at = names.index(first)
    if at == 0 and raw is None:
        raise ValueError("collect needs raw rows")
    for i, (name, takes, work, leaves) in enumerate(STAGES[at:], at):
        given = raw if takes is None else read_artifact(spark, root, takes, task_id=f"{run.task}:{names[i - 1]}", run_id=(upstream or run.run_id) if i == at else run.run_id)
        write_artifact(work(given, run), root, leaves, task_id=f"{run.task}:{name}", run_id=run.run_id)
    return read_artifact(spark, root, DIGEST, task_id=f"{run.task}:digest", run_id=run.run_id)
