"""Hand-made rows for listings, and plain Python versions of the sequential operators."""

import datetime as dt
import itertools
import random

import duckdb
import pytest
from oracle import of_spark
from oracle import rows as of_rows
from pyspark.sql import functions as F

from lodestream.functions import dates, text, urls
from lodestream.operators import listings
from lodestream.operators.listings import Request, ShortlistPolicy
from lodestream.plans import registry

COLUMNS = "job_id long, source string, title string, company string, location string, salary_text string, posted_text string, work_mode_text string, experience_text string, url string, description string"
NOW = "2026-03-20 10:30:00"


def raw(spark, *rows):
    base = dict.fromkeys([c.split()[0] for c in COLUMNS.split(", ")])
    return spark.createDataFrame([tuple({**base, "job_id": i, "source": "a", **r}.values()) for i, r in enumerate(rows)], COLUMNS)


def normal(spark, *rows):
    return listings.normalize(raw(spark, *rows), scraped_at=F.lit(NOW).cast("timestamp"))


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_two_spellings_fall_into_one_group(spark):
    jobs = normal(spark,
                  {"title": "JR TURBINE DEV", "company": "HALDEN WORKS, LLC", "location": "Los Angeles, CA", "source": "beta", "salary_text": "$90k - $110k"},
                  {"title": "Junior Turbine Developer", "company": "Halden Works Llc", "location": "los angeles", "source": "gamma", "salary_text": "$85,000 to $105,000"},
                  {"title": "Kiln Keeper", "company": "Halden Works Llc", "location": "Remote"})
    groups = {r["members"]: r for r in listings.duplicate_groups(jobs).collect()}
    assert sorted(groups) == [1, 2]
    assert groups[2]["sources"] == "beta,gamma" and groups[2]["salary_min"] == 85000 and groups[2]["salary_max"] == 110000
    assert groups[2]["level"] == "entry" and groups[2]["location"] == "Los Angeles, CA"


def test_fields_of_a_sparse_row(spark):
    r = normal(spark, {"title": "engineer", "company": "Unknown company", "location": "new york city", "posted_text": "2 days ago", "salary_text": "From $150k a year"}).first()
    assert r["company"] is None and r["location"] == "New York, NY" and r["salary_text"] == "$150,000"
    assert (r["salary_min"], r["age_days"]) == (150000, 2)
    assert r["posted_at"] == dt.datetime(2026, 3, 18, 10, 30)


def test_empty_input_keeps_the_shape(spark):
    jobs = normal(spark).filter("false")
    assert listings.duplicate_groups(jobs).collect() == [] and "quality" in jobs.columns


@pytest.mark.parametrize("value, want", [("30+ days ago", 30), ("via dice", None), ("yesterday", 1), ("an hour ago", 0), ("2 weeks ago", 14), ("1 month ago", 30), (None, None)])
def test_posted_texts(spark, value, want):
    now = F.lit(NOW).cast("timestamp")
    got = one(spark, lambda x: F.when(dates.posted_at(x, now).isNotNull(), dates.age_days(F.lit(None).cast("long"), dates.posted_at(x, now), now)), value)
    assert got == want


@pytest.mark.parametrize("value, want", [("$80k - $100k", (80000, 100000, "USD")), ("100,000 to 90,000", (90000, 100000, None)), ("$85,000 / yr", (85000, 85000, "USD")), ("up to 90k", (None, 90000, None)), ("competitive", None), (None, None)])
def test_salaries(spark, value, want):
    got = one(spark, text.salary_parse, value)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("base, href, want", [
    ("https://a.b/c/d?x=1", "e", "https://a.b/c/e"), ("https://a.b/c/d", "/e", "https://a.b/e"), ("https://a.b/c", "//z/y", "https://z/y"), ("https://a.b", "q", "https://a.b/q"), ("https://a.b/c", "mailto:x", "mailto:x"), ("https://a.b/c", "?p=2", "https://a.b/c?p=2"),
])
def test_absolute_urls(spark, base, href, want):
    assert one(spark, lambda x: urls.absolute_url(F.lit(base), x), href) == want


def test_normal_url_drops_tracking(spark):
    assert one(spark, urls.normal_url, "HTTPS://A.example.com/x/?utm_source=1&b=2&a=1&fbclid=9#f") == "https://a.example.com/x?a=1&b=2"
    assert one(spark, urls.normal_url, None) is None


def test_title_pairs_equal_all_pairs(spark):
    titles = ["machine learning engineer", "machine learning platform engineer", "data engineer", "data platform engineer", "platform engineer", "engineer"]
    groups = spark.createDataFrame([(i, "b", t) for i, t in enumerate(titles)], "id long, bucket string, title_key string")
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(titles), 2):
        x, y = set(a.split()), set(b.split())
        if len(x & y) / len(x | y) >= 0.5:
            want[i, j] = round(len(x & y) / len(x | y), 4)
    assert {(r["left_id"], r["right_id"]): r["similarity"] for r in listings.title_pairs(groups, low=0.5, high=0.7).collect()} == want


def test_leaders_are_first_come(spark):
    titles = ["a b c d", "a b c", "a b", "x y", "a b c d e"]
    rows = [(i, i, "k", t) for i, t in enumerate(titles)]
    leaders, want = [], {}
    for i, _, _, t in rows:
        sets = set(t.split())
        hit = next((j for j, s in leaders if len(s & sets) / len(s | sets) >= 0.7), i)
        want[i] = hit
        if hit == i:
            leaders.append((i, sets))
    got = listings.leader_clusters(spark.createDataFrame(rows, "id long, ord long, bucket string, title_key string"), threshold=0.7)
    assert {r["id"]: r["leader"] for r in got.collect()} == want


def test_leaders_of_a_hot_bucket_gather_nowhere(spark):
    rng = random.Random(8)
    rows = [(i, o, f"k{i % 2}", " ".join(rng.sample("abcdefgh", rng.randrange(0, 5)))) for i, o in enumerate(rng.sample(range(150), 150))]
    want, leaders = {}, []
    for i, o, k, t in sorted(rows, key=lambda r: r[1]):
        x = set(t.split())
        want[i] = next((j for j, b, y in leaders if b == k and x and len(x & y) / len(x | y) >= 0.5), i)
        if want[i] == i:
            leaders.append((i, k, x))
    got = listings.leader_clusters(spark.createDataFrame(rows, "id long, ord long, bucket string, title_key string"), threshold=0.5)
    assert {r["id"]: r["leader"] for r in got.collect()} == want
    assert "InPandas" not in got._jdf.queryExecution().toString() and "collect_list" not in got._jdf.queryExecution().toString()


def test_members_are_rows(spark):
    jobs = normal(spark, *[{"title": f"Engineer {i % 2}", "company": "C Ltd", "location": "Remote"} for i in range(9)])
    groups = {r["job_key"]: r["members"] for r in listings.duplicate_groups(jobs).collect()}
    rows = [(r["job_key"], r["job_id"]) for r in listings.duplicate_members(jobs).collect()]
    assert "member_ids" not in listings.duplicate_groups(jobs).columns and len(set(rows)) == 9
    assert groups == {k: sum(x == k for x, _ in rows) for k in groups}


def test_filter_on_salary_and_place(spark):
    jobs = normal(spark, {"title": "Engineer", "location": "austin, tx", "salary_text": "$80k - $90k"}, {"title": "Engineer", "location": "austin, tx", "salary_text": "$200k - $220k"}, {"title": "Engineer", "location": "boston, ma"}, {"title": "Cook", "location": "austin, tx"})
    r = Request(titles=("engineer",), keywords=("x",), locations=("austin tx",), salary_min=100000.0)
    assert [x["job_id"] for x in jobs.withColumn("ok", listings.job_filter(r)).filter("ok").collect()] == [1]


@pytest.mark.parametrize("asked, want", [
    ({}, {0, 1, 2, 3, 4, 5}), ({"clearance": True}, {1, 2, 3, 4}), ({"clearance": False}, {0, 5}), ({"clearances": ("Public_Trust",)}, {0, 3, 5}), ({"clearances": ("secret",)}, {0, 1, 2, 5}),
    ({"clearances": ("secret",), "require": frozenset({"clearance"})}, {1, 2}), ({"clearances": ("top_secret", "public_trust"), "clearance": True}, {1, 3}), ({"clearances": ("secret",), "clearance": False}, {0, 5}),
])
def test_filter_on_clearances(spark, asked, want):
    said = (None, "a Secret Clearance, Top SECRET at best", "holds a secret clearance and public trust", "public trust", "active security clearance", "no clearance; topsecret, secretly")
    jobs = normal(spark, *[{"title": "Engineer", "location": "austin, tx", "description": d} for d in said])
    assert {x["job_id"] for x in jobs.filter(listings.job_filter(Request(titles=("engineer",), keywords=("x",), **asked))).collect()} == want


def test_job_filter_drops_clearances_that_the_applicant_lacks(spark, tmp_path):
    said = ("", "top secret", "Secret Clearance", "public trust", "security clearance", "secret trust")
    rows = [(72 * i + 51, f"Kiln oven {said[i % 6]} end", "en", "Src", 50) for i in range(24)]  # leads in Austin
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    names, got = of_spark(registry.QUERIES["job_filter"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.SQL["job_filter"])
    assert got == of_rows(want.columns, want.fetchall())
    assert {(r[names.index("job_id")] - 51) // 72 % 6 for r in got} == {0, 3, 5}


def test_requests_name_clearances():
    r = lambda **given: listings.resolve_request(given).request
    assert [r(clearance_required=x).clearance for x in ("Required", True, "none", False, "maybe", None, 1)] == [True, True, False, False, None, None, None]
    q = r(required_clearances=["Secret", " "], require_clearance_match=True)
    assert q.clearances == ("Secret",) and q.require == {"clearance"} and r().require == frozenset() and r().clearances == ()


def plain_diversity(rows):
    """(adjusted score, penalties) of one pipeline's rows, by a loop over all of them."""
    out, seen = {}, {c: {} for c in ("company", "title", "source")}
    for r in sorted(rows, key=lambda r: (-r["overall"], -r["resume_match"], -r["title_match"], r["job_id"])):
        before = {c: seen[c].get(r[c], 0) for c in seen}
        for c in seen:
            seen[c][r[c]] = before[c] + 1
        share = sum(x["source"] == r["source"] for x in rows) / len(rows)
        off = (min(before["company"] * 6.0, 18.0), min(before["title"] * 3.0, 9.0), 2.5 if share > 0.5 and before["source"] else 0.0)
        adjusted = max(0.0, min(100.0, r["overall"] - sum(off) - min(r["penalty"] * 0.6, 7.0) + (1.0 - share) * 2.0))
        out[r["job_id"]] = adjusted, off
    return out


def test_diversity_of_pipelines_of_any_length(spark):
    rng = random.Random(3)
    rows = [
        {"pipeline": p, "job_id": 10_000 * p + i, "source": "hot" if p == 1 or rng.random() < 0.3 else f"s{rng.randrange(4)}", "company": rng.choice(["hot", "hot", "hot", f"c{rng.randrange(60)}"]), "title": rng.choice(["lead", f"t {rng.randrange(200)}"]),
         "overall": rng.randrange(0, 400) / 4, "resume_match": rng.randrange(0, 8) * 1.0, "title_match": rng.randrange(0, 3) * 1.0, "penalty": rng.randrange(0, 10) * 1.0}
        for p, n in ((1, 700), (2, 430), (3, 1)) for i in range(n)
    ]
    want = {k: v for p in (1, 2, 3) for k, v in plain_diversity([r for r in rows if r["pipeline"] == p]).items()}
    got = {r["job_id"]: r for r in listings.diversity(spark.createDataFrame(rows).repartition(7)).collect()}
    assert set(got) == set(want)
    assert {k: (r["company_penalty"], r["title_penalty"], r["source_penalty"]) for k, r in got.items()} == {k: off for k, (_, off) in want.items()}
    assert all(abs(r["adjusted"] - want[k][0]) <= 0.00501 for k, r in got.items())
    for p, n in ((1, 700), (2, 430), (3, 1)):
        ordered = sorted((r for r in got.values() if r["pipeline"] == p), key=lambda r: (-r["adjusted"], -r["overall"], -r["resume_match"], r["job_id"]))
        assert [r["rank"] for r in ordered] == list(range(1, n + 1))


def test_rank_listings_ranks_every_row_of_a_pipeline(spark, tmp_path):
    rows = [(20 * i, f"Word{i % 9} other{i % 13} lead text number {i}", "en", f"Src{i % 3}", 40 + i) for i in range(230)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    names, got = of_spark(registry.QUERIES["rank_listings"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.SQL["rank_listings"])
    assert got == of_rows(want.columns, want.fetchall())
    assert sorted(r[names.index("rank")] for r in got) == list(range(1, 231))


def shortlist_row(i, **over):
    base = dict(pipeline=1, job_id=i, rank=i, source=f"s{i}", company=f"c{i}", title=f"title {i}", adjusted=90.0 - i, freshness=0.5, group_id=f"g{i}", in_cooldown=False, repeat_factor=0.0)
    return {**base, **over}


def test_shortlist_caps_and_reasons(spark):
    rows = [shortlist_row(1), shortlist_row(2, company="c1", title="other"), shortlist_row(3, company="c1", title="third one"), shortlist_row(4, group_id="g1"), shortlist_row(5, in_cooldown=True), shortlist_row(6, adjusted=10.0)]
    got = {r["job_id"]: (r["pick"], r["reason"]) for r in listings.shortlist(spark.createDataFrame(rows), ShortlistPolicy(most=5)).collect()}
    assert got[1] == (1, None) and got[2][0] == 2
    assert {i: got[i][1] for i in (3, 4, 5, 6)} == {3: "per_company_cap", 4: "duplicate_group_repeat", 5: "notification_cooldown", 6: "below_min_score"}


def test_fail_soft_uses_the_floor(spark):
    rows = [shortlist_row(i, adjusted=30.0 - i) for i in range(1, 6)]
    got = listings.shortlist_fail_soft(spark.createDataFrame(rows), ShortlistPolicy(), floor=20.0, at_least=3).collect()
    assert sum(r["pick"] is not None for r in got) == 3 and {r["selection_basis"] for r in got} == {"fail_soft"}


def test_partition_count_does_not_matter(spark):
    jobs = normal(spark, *[{"title": f"Engineer {i % 5}", "company": f"C{i % 3} Ltd", "location": "Remote"} for i in range(40)])
    a, b = (sorted(map(str, listings.duplicate_groups(j).collect())) for j in (jobs.repartition(1), jobs.repartition(8)))
    assert a == b


def test_requests_are_completed_and_clamped():
    r = listings.resolve_request(None)
    assert (r.query, r.mode, r.request.locations, r.limits.queries, r.limits.per_source, r.limits.seconds) == ("software engineer", "precision_match", ("United States",), 8, 250, None)
    r = listings.resolve_request({"desired_title": " Data  Engineer ", "titles": ["data engineer", "Developer"]})
    assert r.mode == "broad_discovery" and r.request.titles == ("Data Engineer", "Developer") and r.limits.queries == 14 and r.limits.expand
    r = listings.resolve_request({
        "titles": ["lead"], "keywords": ["kiln", "Kiln"], "desired_title_keywords": ["clay"], "excluded_keywords": "night", "work_mode_preference": ["On-Site", "orbit"], "experience_level": "new grad", "experience_levels": ["Senior"],
        "minimum_salary": "$90,000", "max_jobs_per_source": 99_999, "max_pages_per_source": -3, "collection_time_cap_seconds": "7200", "minimum_raw_jobs_total": 0, "search_mode": "Precision Match", "prefer_recent": "yes", "stop_when_minimum_reached": "no",
    })
    q, n = r.request, r.limits
    assert q.keywords == ("kiln", "clay") and q.excluded == ("night",) and q.work_modes == ("onsite",) and q.experience == ("entry", "senior") and q.salary_min == 90000 and q.prefer_recent
    assert (n.per_source, n.pages, n.seconds, n.least_raw, n.stop_at_least, n.queries, n.expand, r.mode) == (1000, 1, 3600, 0, False, 8, False, "precision_match")


def test_entry_and_recent_filters(spark):
    rows = spark.createDataFrame([(1, "Kiln Keeper", "entry", 3), (2, "Sr Kiln Keeper", None, 14), (3, "Keeper", "senior", 15), (4, "Keeper", None, None)], "id int, title string, level string, age_days int")
    entry, recent = Request(experience=("entry",)), Request(prefer_recent=True)
    assert {r["id"] for r in rows.filter(listings.experience_filter(entry)).collect()} == {1, 4}
    assert {r["id"] for r in rows.filter(listings.recency_filter(recent)).collect()} == {1, 2}
    assert rows.filter(listings.experience_filter(recent)).count() == 4 and rows.filter(listings.recency_filter(entry)).count() == 4


def test_manual_rows_skip_what_is_no_object(spark):
    rows = spark.createDataFrame([(1, '{"manual_jobs": [{"title": "a", "url": "http://u/"}, 5, null, {"title": "b", "url": "http://v/", "source_url": "http://w/"}]}'), (2, '{"manual_jobs": "none"}'), (3, "not json"), (4, None)], "request_id int, payload string")
    got = sorted((r["request_id"], r["title"], r["source_url"], r["source"]) for r in listings.manual_rows(rows).collect() if r["title"])
    assert got == [(1, "a", "http://u/", "manual"), (1, "b", "http://w/", "manual")]


@pytest.mark.parametrize("base, href, want", [("http://h/a/b/c", "../d", "http://h/a/d"), ("http://h/a/b/c", "./", "http://h/a/b/"), ("http://h/a", "/x/../../y?z=..", "http://h/y?z=.."), ("http://h/a/", "..", "http://h/")])
def test_dot_segments_are_resolved(spark, base, href, want):
    assert one(spark, lambda x: urls.absolute_url(F.lit(base), x), href) == want
