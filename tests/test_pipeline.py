"""Stage artifacts and their contracts, the listings pipeline run in parts, the shortlist against a plain greedy loop, and merged duplicate groups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import digests, jobs_pipeline, listings
from lodestream.operators.listings import Request, ShortlistPolicy
from lodestream.sources import artifacts
from lodestream.sources.artifacts import Contract, ContractError

THINGS = Contract("things", 1, "k long, v string")
NOW = dt.datetime(2026, 3, 20, 12)


def things(spark, *rows):
    return spark.createDataFrame(rows, "k long, v string, extra int")


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_the_newest_artifact_of_a_task_and_run_is_read(spark, tmp_path):
    root, put = str(tmp_path), lambda v, task, run, at: artifacts.write_artifact(things(spark, (1, v, 0)), str(tmp_path), THINGS, task_id=task, run_id=run, at=dt.datetime(2026, 3, at))
    with pytest.raises(LookupError):
        artifacts.read_artifact(spark, root, THINGS, task_id="a", run_id="r1")
    put("late", "a", "r1", 9), put("early", "a", "r1", 3), put("other run", "a", "r2", 20), put("other task", "b", "r1", 20)
    got = artifacts.read_artifact(spark, root, THINGS, task_id="a", run_id="r1")
    assert values(got) == ["late"] and got.columns == ["k", "v", "extra"]
    assert values(artifacts.read_artifact(spark, root, THINGS, task_id="a", run_id="r2")) == ["other run"]
    with pytest.raises(LookupError):
        artifacts.read_artifact(spark, root, THINGS, task_id="b", run_id="r2")


def test_a_read_scans_its_own_partition(spark, tmp_path):
    root = str(tmp_path)
    for run in ("r1", "r2"):
        artifacts.write_artifact(things(spark, (1, run, 0)), root, THINGS, task_id="a", run_id=run)
    got = artifacts.read_artifact(spark, root, THINGS, task_id="a", run_id="r2")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "run_id#" in plan.split("PartitionFilters")[1]
    assert len(got.inputFiles()) == 2 and len(got.select(F.input_file_name()).distinct().collect()) == 1


def test_contracts(spark, tmp_path):
    root = str(tmp_path)
    artifacts.write_artifact(things(spark, (1, "x", 0)), root, THINGS, task_id="a", run_id="r")
    for other in (Contract("others", 1, "k long"), Contract("things", 2, "k long")):
        with pytest.raises(ContractError, match="expected .* got things.v1"):
            artifacts.read_artifact(spark, root, other, task_id="a", run_id="r")
    with pytest.raises(ContractError, match="k string"):
        artifacts.read_artifact(spark, root, Contract("things", 1, "k string"), task_id="a", run_id="r")
    with pytest.raises(ContractError, match="w int"):
        artifacts.write_artifact(things(spark), root, Contract("things", 1, "w int"), task_id="a", run_id="r")
    artifacts.write_artifact(things(spark), root, THINGS, task_id="empty", run_id="r")
    assert artifacts.read_artifact(spark, root, THINGS, task_id="empty", run_id="r").collect() == []


def test_partition_columns_of_the_rows_give_way(spark, tmp_path):
    rows = things(spark, (1, "x", 0)).withColumns({"run_id": F.lit("mine"), "artifact_id": F.lit(3)})
    artifacts.write_artifact(rows, str(tmp_path), THINGS, task_id="a", run_id="r")
    assert artifacts.read_artifact(spark, str(tmp_path), THINGS, task_id="a", run_id="r").columns == ["k", "v", "extra"]


RAW = [
    (1, 1, "Alpha", "Kiln Lead", "Halden Works", "Remote", "$100k - $120k", "2 days ago", "remote", None, "https://a.example.com/jobs/view/1", "kiln work"),
    (1, 2, "alpha", "kiln lead ", "Halden Works", "Remote", None, None, "remote", None, "https://a.example.com/jobs/view/1", "the same row again"),
    (1, 3, "beta", "Kiln Lead", "Halden Works Inc", "Remote", None, None, "remote", None, None, "found elsewhere"),
    (1, 4, "beta", "Turbine Lead", None, None, None, None, None, None, None, None),
    (2, 5, "beta", "Kiln Lead", "Halden Works", "Remote", "$90k - $95k", "today", None, "Principal", "https://b.example.com/search?q=x", "x"),
]


def raw(spark):
    return spark.createDataFrame(RAW, jobs_pipeline.RAW.columns)


def a_run(run_id="one", now=NOW, **over):
    return jobs_pipeline.Run(run_id, F.lit(now), Request(titles=("Lead",)), ShortlistPolicy(least_score=0.0), **over)


def test_pipeline_from_rows_to_digest(spark, tmp_path):
    root = str(tmp_path)
    rows = {(r["pipeline"], r["rank"]): r for r in jobs_pipeline.run_stages(spark, root, a_run(), raw=raw(spark)).collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 1)}
    assert rows[1, 1]["heading"] == "Kiln Lead at Halden Works" and rows[1, 1]["posted"] == "Posted 2d ago" and rows[1, 1]["salary"] == "$100,000 - $120,000"
    assert rows[1, 2]["tradeoffs"] == "Company not listed. Location details are limited. Direct application link is limited. Posted date is unavailable." and rows[1, 2]["thin"]
    groups = artifacts.read_artifact(spark, root, jobs_pipeline.NORMALIZED, task_id="jobs:normalize", run_id="one")
    assert sorted((r["pipeline"], r["members"], r["collected"]) for r in groups.collect()) == [(1, 1, 3), (1, 2, 3), (2, 1, 1)]


def test_a_run_goes_on_from_its_predecessor_s_table(spark, tmp_path):
    root = str(tmp_path)
    whole = sorted(map(str, jobs_pipeline.run_stages(spark, root, a_run(), raw=raw(spark)).collect()))
    for first in ("normalize", "shortlist", "digest"):
        again = jobs_pipeline.run_stages(spark, root, a_run(), first=first)
        assert sorted(map(str, again.collect())) == whole
    with pytest.raises(LookupError):
        jobs_pipeline.run_stages(spark, root, a_run("two"), first="rank")
    assert sorted(map(str, jobs_pipeline.run_stages(spark, root, a_run("two"), first="rank", upstream="one").collect())) == whole
    with pytest.raises(ValueError, match="raw"):
        jobs_pipeline.run_stages(spark, root, a_run())


def test_what_was_shown_lately_is_held_back(spark, tmp_path):
    root = str(tmp_path)
    jobs_pipeline.run_stages(spark, root, a_run(), raw=raw(spark))
    keys = {r["title"]: r["job_key"] for r in artifacts.read_artifact(spark, root, jobs_pipeline.SCORED, task_id="jobs:rank", run_id="one").filter("pipeline = 1").collect()}
    history = spark.createDataFrame([(keys["Kiln Lead"], NOW, NOW - dt.timedelta(days=1)), (keys["Turbine Lead"], NOW - dt.timedelta(days=10), NOW - dt.timedelta(days=9))], "job_key string, last_shortlisted timestamp, last_notified timestamp")
    top = {r["title"]: r for r in jobs_pipeline.shortlist(artifacts.read_artifact(spark, root, jobs_pipeline.SCORED, task_id="jobs:rank", run_id="one").filter("pipeline = 1"), a_run(history=history)).collect()}
    assert top["Kiln Lead"]["reason"] == "notification_cooldown"
    plain = {r["title"]: r for r in artifacts.read_artifact(spark, root, jobs_pipeline.TOP, task_id="jobs:shortlist", run_id="one").filter("pipeline = 1").collect()}
    # first of its source and company now: only the repeat costs, 6 points times .65 after ten days
    base = plain["Turbine Lead"]["adjusted"] + 0.35 * 4.0
    assert top["Turbine Lead"]["pick"] == 1 and top["Turbine Lead"]["effective"] == pytest.approx(base - 3.9, abs=1e-3)


def test_reports_of_nothing_and_what_was_sent(spark, tmp_path):
    rows = jobs_pipeline.run_stages(spark, str(tmp_path), a_run(), raw=raw(spark))
    counts = spark.createDataFrame([(1, 3, 2), (2, 1, 1), (3, 9, 8)], "pipeline long, collected long, deduped long")
    reports = digests.digest_reports(rows, counts)
    got = {r["pipeline"]: r for r in reports.collect()}
    assert not got[3]["should_notify"] and got[3]["markdown"].endswith("## Top Jobs\nNo shortlisted jobs were available.") and got[3]["patterns"] == "No shortlist entries were available in this run."
    assert got[1]["patterns"] == "1/2 top roles are from alpha. 1/2 roles appear remote-friendly. 1/2 roles include salary signal."
    assert got[1]["excerpt"] == "Reviewed 3 collected jobs, 2 after dedupe, and shortlisted 2 for action. Shortlisted 2 from 3 collected / 2 deduped. Top picks: Kiln Lead at Halden Works."
    assert digests.digest_reports(rows, counts, notify_on_empty=True).filter("should_notify").count() == 3
    now = F.lit(NOW)
    fresh = digests.unsent(reports, spark.createDataFrame([], "dedupe_key string, expires_at timestamp"), now=now)
    keys = {r["pipeline"]: r["dedupe_key"] for r in fresh.collect()}
    assert set(keys) == {1, 2} and all(k.startswith("jobs-digest:20260320-12:") for k in keys.values())
    sent = spark.createDataFrame([(keys[1], NOW + dt.timedelta(hours=1)), (keys[2], NOW - dt.timedelta(hours=1)), (keys[1], NOW - dt.timedelta(hours=5))], "dedupe_key string, expires_at timestamp")
    assert [r["pipeline"] for r in digests.unsent(reports, sent, now=now).collect()] == [2]
    assert digests.unsent(reports, sent, now=F.lit(NOW + dt.timedelta(hours=2))).count() == 2


def greedy(rows, p):
    """The shortlist of one pipeline, one row at a time."""

    def words(x):
        return set("".join(c if c.isalnum() else " " for c in (x or "").lower()).split())

    def near(r, picked):
        same = [len(a & b) / len(a | b) for q in picked if (q["company"] or "") == (r["company"] or "") and ((a := words(q["title"])) | (b := words(r["title"])))]
        return max([s for s in same if s >= p.similar], default=None)

    def why(r, picked):
        count = lambda c: sum((q[c] or ("unknown" if c == "source" else "")) == (r[c] or ("unknown" if c == "source" else "")) for q in picked)
        if r["adjusted"] < p.least_score:
            return "below_min_score"
        if r["in_cooldown"]:
            return "notification_cooldown"
        if not p.resurface and r["resurfaced"]:
            return "resurface_disabled"
        if count("source") >= p.per_source:
            return "per_source_cap"
        if count("company") >= p.per_company:
            return "per_company_cap"
        return "duplicate_group_repeat" if r["group_id"] and any(q["group_id"] == r["group_id"] for q in picked) else None

    def worth(r, picked):
        count = lambda c: sum((q[c] or ("unknown" if c == "source" else "")) == (r[c] or ("unknown" if c == "source" else "")) for q in picked)
        n = near(r, picked)
        return r["adjusted"] + r["freshness"] * p.freshness_bonus - count("source") * p.source_weight - count("company") * p.company_weight - r["repeat_factor"] * p.repeat_penalty - (10.0 + n * 10.0 if n is not None else 0.0)

    left, picked, out = sorted((r for r in rows if p.pool is None or r["rank"] <= p.pool), key=lambda r: r["rank"]), [], {}
    while len(picked) < p.most and (may := [r for r in left if not why(r, picked)]):
        best = max(may, key=lambda r: (worth(r, picked), -r["rank"]))
        out[best["job_id"]] = (len(picked) + 1, round(worth(best, picked), 4), None)
        picked.append(best)
        left.remove(best)
    for r in left:
        out[r["job_id"]] = (None, None, why(r, picked) or ("near_duplicate_company_title" if near(r, picked) is not None else "max_items"))
    return out


@pytest.mark.parametrize("policy", [ShortlistPolicy(), ShortlistPolicy(most=25, per_source=9, per_company=7, similar=0.5, resurface=False, pool=None), ShortlistPolicy(most=3, least_score=80.0, pool=20)])
def test_shortlist_against_a_greedy_loop(spark, policy):
    rng = random.Random(policy.most)
    rows = []
    for p, n in ((1, 60), (2, 25), (3, 1), (4, 40)):
        for i in range(n):
            rows.append(dict(pipeline=p, job_id=100 * p + i, rank=i + 1, source=rng.choice(["a", "b", "c", None]), company=rng.choice(["x", "y", "", None, "z"]), title=" ".join(rng.sample(["lead", "Kiln", "senior", "data", "é"], rng.randrange(4))) or None,
                             adjusted=float(rng.choice([20, 40, 60, 90])) if p != 4 else 10.0, freshness=rng.choice([0.25, 0.5]), group_id=rng.choice([None, "", "g1", "g2", "g3", f"h{i}"]), in_cooldown=rng.random() < 0.1, repeat_factor=rng.choice([0.0, 1.0]), resurfaced=rng.choice([True, False, False])))
    kinds = "pipeline long, job_id long, rank int, source string, company string, title string, adjusted double, freshness double, group_id string, in_cooldown boolean, repeat_factor double, resurfaced boolean"
    got = {(r["pipeline"], r["job_id"]): (r["pick"], r["effective"], r["reason"]) for r in listings.shortlist(spark.createDataFrame(rows, kinds).repartition(5), policy).collect()}
    want = {(p, j): v for p in (1, 2, 3, 4) for j, v in greedy([r for r in rows if r["pipeline"] == p], policy).items()}
    assert got == want


def test_shortlist_of_nothing(spark):
    assert listings.shortlist(spark.createDataFrame([], "pipeline long, job_id long, rank int, source string, company string, title string, adjusted double, freshness double, group_id string, in_cooldown boolean, repeat_factor double"), ShortlistPolicy()).collect() == []


def test_the_best_member_is_completed_from_the_others(spark):
    rows = [
        {"job_id": 3, "job_key": "k", "title": "Kiln Lead", "quality": 80.0, "url": "https://a.example.com/jobs/view/1", "source": "b", "salary_min": 90.0, "description": " "},
        {"job_id": 1, "job_key": "k", "title": "kiln lead", "quality": 20.0, "company": "Second", "source": "a", "description": "short"},
        {"job_id": 2, "job_key": "k", "title": "kiln", "quality": 30.0, "company": "Third", "location": "Austin, TX", "mode": "onsite", "source": "a", "salary_min": 70.0, "salary_max": 80.0, "description": "longer one", "posted_at": NOW, "posted_raw": "today", "age_days": 0, "recency_quality": "relative_normalized"},
        {"job_id": 4, "job_key": "k", "title": "kiln", "quality": 30.0, "source": "c", "description": "as long on", "level": "senior"},
    ]
    kinds = "job_id long, job_key string, source string, description string, title string, company string, location string, salary_min double, salary_max double, currency string, mode string, level string, url string, posted_raw string, posted_at timestamp, age_days long, url_kind string, salary_text string, company_key string, title_key string, location_key string, location_quality string, recency_quality string, quality double"
    r = listings.duplicate_groups(spark.createDataFrame(rows, kinds)).first()
    assert (r["job_id"], r["title"], r["company"], r["location"], r["mode"], r["level"], r["description"]) == (3, "Kiln Lead", "Second", "Austin, TX", "onsite", "senior", "longer one")
    assert (r["posted_at"], r["posted_raw"], r["recency_quality"], r["salary_min"], r["salary_max"], r["salary_text"]) == (NOW, "today", "relative_normalized", 70.0, 80.0, "$70 - $80")
    assert (r["members"], r["sources"], r["url_kind"], r["location_quality"], r["quality"]) == (4, "a,b,c", "direct", "structured", 2 + 25 + 12 + 18 + 15 + 10 + 8 + 6 + 4)
