"""Listings: normalisation, duplicate groups, filters, signals, ranking and the shortlist."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from math import comb
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..sources.sinks import drop, read_snapshot, stage, staged, write_snapshot

TITLE_FAMILIES = {"engineer": ("engineer", "software engineer", "developer"), "data": ("data", "data scientist", "data engineer", "machine learning"), "lead": ("lead", "manager")}


@dataclass(frozen=True)
class Request:
    """A search request: parameters of a run, not data. Empty tuples and None mean no preference."""

    titles: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    work_modes: tuple[str, ...] = ()
    experience: tuple[str, ...] = ()
    salary_min: float | None = None
    salary_max: float | None = None
    require: frozenset[str] = field(default_factory=frozenset)  # of keyword, salary, experience, work_mode, clearance
    prefer_recent: bool = False
    clearance: bool | None = None  # only listings that ask for a security clearance, or only those that don't
    clearances: tuple[str, ...] = ()  # kinds, or parts of their names, that a listing may ask for

    @property
    def families(self) -> list[str]:
        spaced = [f" {t.lower()} " for t in self.titles]
        return [k for k, names in TITLE_FAMILIES.items() if any(f" {n} " in t for n in names for t in spaced)]

    @property
    def broad(self) -> bool:
        """Only generic titles and nothing more specific."""
        generic = bool(self.titles) and all(any(f" {n} " in f" {t.lower()} " for names in TITLE_FAMILIES.values() for n in names) for t in self.titles)
        return generic and not (self.keywords or self.work_modes or self.experience or self.salary_min or self.salary_max)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def has_phrase(canonical: Column, phrase: str) -> Column:
    """Whole-word containment in a canonical text."""
    return F.concat(F.lit(" "), canonical, F.lit(" ")).contains(f" {phrase.lower()} ")


def normalize(raw: DataFrame, *, scraped_at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Enriched listings: names in order, salary, work mode, experience, dates, keys and quality, and the columns to keep as they are. Rows without a title are dropped."""
    raw = raw.withColumns({"title": text.as_text(F.col("title")), "_salary": text.salary_parse(F.col("salary_text")), "posted_text": text.as_text(F.col("posted_text"))})
    salary = F.col("_salary")
    base = raw.filter(F.col("title").isNotNull()).select(
        *keep, "job_id", "source", "description", text.title_case(F.col("title")).alias("title"), text.company_name(F.col("company")).alias("company"), text.location_name(F.col("location")).alias("location"),
        salary["min"].alias("salary_min"), salary["max"].alias("salary_max"), F.when(salary.isNotNull(), F.coalesce(salary["currency"], F.lit("USD"))).alias("currency"), text.as_text(F.col("salary_text")).alias("salary_raw"),
        text.work_mode(F.col("work_mode_text")).alias("mode"), text.experience(F.col("experience_text")).alias("level"), text.as_text(F.col("url")).alias("url"), F.col("posted_text").alias("posted_raw"),
        dates.posted_at(F.col("posted_text"), scraped_at).alias("posted_at"), F.try_to_timestamp(F.col("posted_text")).isNull().alias("relative"),
    )
    mode = F.coalesce("mode", text.infer_work_mode(F.col("title"), F.col("location"), F.col("description")))
    level = F.coalesce("level", text.infer_experience(F.col("title"), F.col("description")))
    out = base.withColumns({"mode": mode, "level": level, "age_days": dates.age_days(F.lit(None).cast("long"), F.col("posted_at"), scraped_at), "url_kind": urls.url_kind(F.col("url"))})
    out = out.withColumns({
        "salary_text": F.when(F.col("currency").isNotNull(), text.salary_format(F.col("salary_min"), F.col("salary_max"), F.col("currency"))).otherwise(F.col("salary_raw")),
        "company_key": text.company_key(F.col("company")), "title_key": text.title_key(F.col("title")), "location_key": text.location_key(F.col("location"), F.col("mode")),
        "recency_quality": dates.recency_quality(F.col("posted_at"), F.col("relative"), F.col("age_days")),
    })
    out = out.withColumn("location_quality", text.quality_of_key(F.col("location"), F.col("mode"), F.col("location_key")))
    return out.withColumns({"job_key": urls.job_key(F.col("company_key"), F.col("title_key"), F.col("location_key"), F.col("url"), F.col("job_id")), "quality": quality(out)}).drop("relative", "salary_raw")


def quality(jobs: DataFrame) -> Column:
    """0 to 100: how much of a listing is there."""
    add = lambda condition, points: F.when(condition, points).otherwise(0.0)
    c = {k: F.col(k) for k in jobs.columns}
    place = F.when(c["location_quality"] == "structured", 12.0).when(c["location_quality"] == "mode_only", 8.0).when(c["location_quality"] == "broad", 5.0).when(c["location"].isNotNull(), 3.0).otherwise(0.0)
    recency = F.when(c["recency_quality"].isin("timestamp", "relative_normalized"), 15.0).when(c["recency_quality"] == "age_only", 11.0).otherwise(0.0)
    return (
        add(c["title"].isNotNull(), 2.0) + add(c["company"].isNotNull(), 25.0) + place + F.when(c["url_kind"] == "missing", 0.0).when(c["url_kind"] == "direct", 18.0).otherwise(8.0) + recency
        + add(c["mode"].isNotNull(), 10.0) + add(c["salary_text"].isNotNull(), 8.0) + add(c["description"].rlike(r"\S"), 6.0) + add(c["level"].isNotNull(), 4.0)
    )


def quality_penalty() -> Column:
    """Up to 15 points off for what a normalised listing lacks."""
    off = lambda condition, points: F.when(condition, points).otherwise(0.0)
    link = F.when(F.col("url_kind") == "missing", 2.5).when(F.col("url_kind") != "direct", 0.75).otherwise(0.0)
    total = (100.0 - F.col("quality")) * 0.06 + off(F.col("company").isNull(), 3.0) + link + off(F.col("posted_at").isNull(), 1.5) + off(F.col("location_quality").isin("missing", "weak"), 1.0) + off(F.col("mode").isNull(), 0.75)
    return F.round(text.bounded(total, 0.0, 15.0), 2)


#: Fields that a group's best member takes from the first other member that has them.
FILLED = ("company", "location", "mode", "level", "url")
#: Fields of a date, which go together.
DATED = ("posted_at", "posted_raw", "age_days", "recency_quality")


def duplicate_groups(jobs: DataFrame, *, by: tuple[str, ...] = ("job_key",)) -> DataFrame:
    """One row per key of normalised listings: the best member, completed from the others; with the number of members and their sources.

    The best has the highest quality, then most fields, most pay, and the least job_id. Each field that it lacks comes from the member with the least job_id that has it; the description, if it
    has none, is the longest (ties: least job_id). Salaries are the widest, put right if turned round, and their text is made anew where the best has none. Kind of address, place
    and quality are judged again. All of it is one aggregation of maxima and minima whose order skips members without the field, begun on the map
    side, so no group gathers; the members are rows of duplicate_members.
    """
    has = lambda c: F.col(c).isNotNull() if c == "posted_at" else F.trim(c) != ""
    filled = sum(F.col(c).isNotNull().cast("int") for c in ("company", "location", "mode", "salary_text", "url", "description", "posted_at", "level"))
    rank = F.struct("quality", filled.alias("filled"), F.coalesce("salary_max", "salary_min", F.lit(0.0)).alias("pay"), (-F.col("job_id")).alias("first"))
    first = lambda value, c: F.min_by(value, F.when(has(c), F.col("job_id")))
    g = jobs.groupBy(*by).agg(
        F.max_by(F.struct("job_id", "source", "title", "title_key", "company_key", "currency", "salary_text", "description", *FILLED, *DATED), rank).alias("b"), *[first(F.col(c), c).alias(f"f_{c}") for c in FILLED], first(F.struct(*DATED), "posted_at").alias("f_dated"),
        F.max_by("description", F.when(has("description"), F.struct(F.length(F.trim("description")), -F.col("job_id")))).alias("f_description"), F.min("salary_min").alias("low"), F.max("salary_max").alias("high"),
        F.count(F.lit(1)).alias("members"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    )
    own = lambda c: F.when(F.trim(F.col("b")[c]) != "", F.col("b")[c])
    out = g.select(
        *by, *[F.col("b")[c].alias(c) for c in ("job_id", "source", "title", "title_key", "company_key", "currency")], *[F.coalesce(own(c), f"f_{c}").alias(c) for c in FILLED],
        *[F.when(F.col("b.posted_at").isNotNull() | F.col("f_dated").isNull(), F.col("b")[c]).otherwise(F.col("f_dated")[c]).alias(c) for c in DATED], F.coalesce(own("description"), "f_description", "b.description").alias("description"),
        F.when(F.col("high") < F.col("low"), F.col("high")).otherwise(F.col("low")).alias("salary_min"), F.when(F.col("high") < F.col("low"), F.col("low")).otherwise(F.col("high")).alias("salary_max"), own("salary_text").alias("salary_text"), "members", "sources",
    )
    paid = F.coalesce("salary_max", "salary_min").isNotNull()
    out = out.withColumns({
        "salary_text": F.coalesce("salary_text", F.when(paid, text.salary_format(F.col("salary_min"), F.col("salary_max"), F.coalesce("currency", F.lit("USD"))))), "url_kind": urls.url_kind(F.col("url")), "location_key": text.location_key(F.col("location"), F.col("mode")),
    })
    out = out.withColumn("location_quality", text.quality_of_key(F.col("location"), F.col("mode"), F.col("location_key")))
    return out.withColumn("quality", quality(out))


def duplicate_members(jobs: DataFrame) -> DataFrame:
    """(job_key, job_id, source, url): a row for each member of each group, so that no group gathers in a row."""
    return jobs.select("job_key", "job_id", "source", "url")


def title_pairs(groups: DataFrame, *, low: float = 0.68, high: float = 0.84, longer: int = 0) -> DataFrame:
    """Pairs of titles with a token similarity of low or more inside a (company, location) bucket, and whether they merge.

    groups(id, bucket, title_key). Blocked by a prefix: of tokens in order of rarity, two sets that similar share one of the first
    n - ceil(low * n) + 1, so hot buckets don't meet in full. longer: only pairs in which a title has more tokens than that.
    """
    t = groups.select("id", "bucket", F.array_distinct(text.words(F.col("title_key"))).alias("t")).filter(F.size("t") > 0)
    df = t.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = t.select("id", "bucket", F.size("t").alias("n"), F.explode("t").alias("w")).join(df, "w")
    order = Window.partitionBy("id").orderBy("df", "w")
    first = ranked.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= F.col("n") - F.ceil(low * F.col("n")) + 1).select("id", "bucket", "n", "w")
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.id") < F.col("y.id")) & (F.greatest("x.n", "y.n") > longer)
    near = first.alias("x").join(first.alias("y"), meet).select(F.col("x.id").alias("left_id"), F.col("y.id").alias("right_id")).distinct()
    sets = lambda side: t.select(F.col("id").alias(f"{side}_id"), F.col("t").alias(f"{side}_t"))
    both = near.join(sets("left"), "left_id").join(sets("right"), "right_id")
    jaccard = F.size(F.array_intersect("left_t", "right_t")) / F.size(F.array_union("left_t", "right_t"))
    return both.select("left_id", "right_id", F.round(jaccard, 4).alias("similarity"), (jaccard >= high).alias("merge")).filter(F.col("similarity") >= low)


#: Titles of at most so many tokens meet by the token sets they share; pairs with a longer one are joined.
MOST_TOKENS = 8
SIZES = range(1, MOST_TOKENS + 1)


def least_shared(n: int, m: int, similar) -> int | None:
    """The least number of tokens that sets of n and m share where similar(similarity)."""
    return next((k for k in range(1, min(n, m) + 1) if similar(k / (n + m - k))), None)


def rounded_from(low: float):
    """A test of a similarity that is low or more once rounded as title_pairs rounds it."""
    return lambda x: float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) >= low


def token_subsets(titles: DataFrame, rules: list[tuple]) -> DataFrame:
    """(at, n, j, *columns of the rule, hub) of titles(at, bucket, t): a title's sets of j of its n tokens that another title of the bucket has, too, numbered as hubs.

    rules(n, j, ...): the sizes to make. So rows grow with the titles, not with their pairs.
    """
    spark = titles.sparkSession
    # all subsets: each token joins those made of the tokens before it
    grown = lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.struct((s["j"] + 1).alias("j"), F.concat(s["key"], F.lit(" "), w).alias("key"))))
    made = F.aggregate(F.array_sort("t"), F.array(F.struct(F.lit(0).alias("j"), F.lit("").alias("key"))), grown)
    names = list(rules[0]._fields)
    kinds = {int: "int", tuple: "array<bigint>"}
    wanted = spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in r) for r in rules], ", ".join(f"{k} {kinds[type(v)]}" for k, v in zip(names, rules[0])))
    short = titles.filter((F.size("t") <= MOST_TOKENS) & F.col("bucket").isNotNull())
    rows = short.select("at", "bucket", F.size("t").alias("n"), F.explode(made).alias("s")).select("at", "bucket", "n", "s.j", "s.key").join(F.broadcast(wanted), ["n", "j"])
    shared = rows.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    hubs = stage(shared.select("bucket", "key", F.monotonically_increasing_id().alias("hub")), "hubs")
    return stage(rows.join(hubs, ["bucket", "key"]).select("at", *names, "hub"), "subsets")


def by_size(value: Column, agg, name: str) -> list[Column]:
    """value summed up for the hub's members of each size."""
    return [agg(F.when(F.col("n") == m, value)).alias(f"{name}{m}") for m in SIZES]


class LinkRule(NamedTuple):
    n: int
    j: int
    meets: int  # bits of the sizes m with which j shared tokens are just enough
    low: tuple  # for each m: how often a common subset of j tokens counts, so that each link counts once
    high: tuple


class MeetRule(NamedTuple):
    n: int
    j: int
    meets: int


def meeting_sizes(n: int, j: int, similar) -> int:
    return sum(1 << m for m in SIZES if least_shared(n, m, similar) == j)


def link_rules(low: float, high: float) -> list[LinkRule]:
    """Sets that share k or more tokens are counted by their common subsets of j >= k tokens: the sum of (-1)^(j-k) C(j-1, k-1) over them is 1 for each."""

    def times(n: int, j: int, similar) -> tuple:
        k = {m: least_shared(n, m, similar) for m in SIZES}
        return tuple((-1) ** (j - k[m]) * comb(j - 1, k[m] - 1) if k[m] and j >= k[m] else 0 for m in SIZES)

    near, merges = rounded_from(low), lambda x: x >= high
    rows = [LinkRule(n, j, meeting_sizes(n, j, near), times(n, j, near), times(n, j, lambda x: near(x) and merges(x))) for n in SIZES for j in range(1, n + 1)]
    return [r for r in rows if any(r.low)]


def numbered_titles(groups: DataFrame, *order: str) -> DataFrame:
    """(at, id, bucket, title_key, t): groups with their tokens, and numbers that go up in the given order."""
    t = F.array_distinct(text.words(F.col("title_key")))
    return stage(groups.orderBy(*order).select(F.monotonically_increasing_id().alias("at"), "id", "bucket", "title_key", F.when(F.size(t) > 0, t).otherwise(F.array().cast("array<string>")).alias("t")), "titles")


def long_pairs(titles: DataFrame, *, low: float, high: float) -> DataFrame | None:
    """Similar pairs in which a title has more than MOST_TOKENS tokens, both ways round: (at, other, similarity, merge). None where there is no such title."""
    if titles.filter(F.size("t") > MOST_TOKENS).isEmpty():
        return None
    pairs = stage(title_pairs(titles.select(F.col("at").alias("id"), "bucket", "title_key"), low=low, high=high, longer=MOST_TOKENS), "pairs")
    way = lambda a, b: pairs.select(F.col(a).alias("at"), F.col(b).alias("other"), "similarity", "merge")
    return way("left_id", "right_id").unionByName(way("right_id", "left_id"))


def title_links(groups: DataFrame, *, low: float = 0.68, high: float = 0.84) -> DataFrame:
    """(id, component, links, merges, nearest): each title's class among those that title_pairs links, directly or through others.

    component is the least id of the class; links and merges are the numbers of titles of the bucket that are similar by low and by high, nearest the highest similarity, if there is a link.
    Links are counted and classes made by the token subsets that titles share, so no pair is written and work grows with the titles; only pairs with a title of more than MOST_TOKENS tokens are joined.
    groups(id, bucket, title_key), each id once.
    """
    from ..llm.components import components

    titles = numbered_titles(groups, "id")
    subs = token_subsets(titles.select("at", "bucket", "t"), link_rules(low, high))
    hubs = subs.groupBy("hub").agg(*by_size(F.lit(1), F.count, "c"), *by_size(F.col("at"), F.min, "a"))
    rows = subs.join(hubs, "hub")
    # the title itself isn't counted
    others = {m: F.col(f"c{m}") - (F.col("n") == m).cast("long") for m in SIZES}
    total = lambda rule: reduce(lambda a, b: a + b, [F.col(rule)[m - 1] * others[m] for m in SIZES])
    similarity = F.greatest(*[F.when(others[m] > 0, F.round(F.col("j") / (F.col("n") + m - F.col("j")), 4)) for m in SIZES])
    counted = rows.select("at", total("low").alias("links"), total("high").alias("merges"), similarity.alias("nearest"))
    met = F.array_compact(F.array(*[F.when(F.col("meets").bitwiseAND(1 << m) != 0, F.col(f"a{m}")) for m in SIZES]))
    edges = rows.select("at", F.explode(met).alias("other")).filter("at <> other")
    pairs = long_pairs(titles, low=low, high=high)
    if pairs is not None:
        counted = counted.unionByName(pairs.select("at", F.lit(1).cast("long").alias("links"), F.col("merge").cast("long").alias("merges"), F.col("similarity").alias("nearest")))
        edges = edges.unionByName(pairs.select("at", "other"))
    per_title = counted.groupBy("at").agg(F.sum("links").alias("links"), F.sum("merges").alias("merges"), F.max("nearest").alias("nearest"))
    classes = components(edges.select(F.col("at").alias("src"), F.col("other").alias("dst"))).select(F.col("node").alias("at"), F.col("component").alias("first"))
    first = titles.select(F.col("at").alias("first"), F.col("id").alias("component"))
    out = titles.select("at", "id").join(per_title, "at", "left").join(classes, "at", "left").withColumn("first", F.coalesce("first", "at")).join(first, "first")
    zero = F.lit(0).cast("long")
    return out.select("id", "component", F.coalesce("links", zero).alias("links"), F.coalesce("merges", zero).alias("merges"), F.when(F.col("links") > 0, F.col("nearest")).alias("nearest"))


def leader_clusters(groups: DataFrame, *, threshold: float = 0.84) -> DataFrame:
    """(id, leader): in each bucket, in order of ord (ties: id), a row joins the first leader whose title is similar enough, or leads itself.

    Decided in rounds, each written down: a row leads once all its earlier similar rows follow, and follows once one of them leads. Similar rows meet by the token subsets they share (hubs), of which only the
    first undecided row of each size is asked for: no pair is made, no bucket gathers in a task, and a round's work grows with the undecided rows. There are as many rounds as the longest chain of such
    decisions, few where the order has nothing to do with the titles. Pairs with a title of more than MOST_TOKENS tokens are joined. groups(id, ord, bucket, title_key), each id once.
    """
    near = rounded_from(threshold)
    rules = [MeetRule(n, j, b) for n in SIZES for j in range(1, n + 1) if (b := meeting_sizes(n, j, near))]
    titles = numbered_titles(groups, "ord", "id")
    members = token_subsets(titles.select("at", "bucket", "t"), rules).select("at", "n", "meets", "hub")
    pairs = long_pairs(titles, low=threshold, high=threshold)
    if pairs is not None:
        # a pair is a hub of its own, below 0; its rows are of one size, which meets itself
        ends = pairs.filter("at < other").select("at", "other", (-1 - F.monotonically_increasing_id()).alias("hub"))
        ends = ends.select(F.explode(F.array("at", "other")).alias("at"), F.lit(1).alias("n"), F.lit(1 << 1).alias("meets"), "hub")
        members = stage(members.unionByName(ends), "subsets")
    meets = lambda m: F.col("meets").bitwiseAND(1 << m) != 0

    def first_met(rows: DataFrame, asked: DataFrame) -> DataFrame:
        """(at, first): the first of rows that each of asked meets, itself included."""
        least = rows.groupBy("hub").agg(*by_size(F.col("at"), F.min, "a"))
        return asked.join(least, "hub").groupBy("at").agg(F.min(F.least(*[F.when(meets(m), F.col(f"a{m}")) for m in SIZES])).alias("first"))

    undecided, path, leaders = members, None, []
    while not undecided.isEmpty():
        new = stage(first_met(undecided, undecided).filter("first is null or first >= at").select("at"), "leaders")
        leaders.append(new)
        led = undecided.join(new, "at", "left_semi").groupBy("hub").agg(F.bit_or(F.expr("shiftleft(1, n)")).alias("led"))
        follow = undecided.join(led, "hub").filter(F.col("meets").bitwiseAND(F.col("led")) != 0).select("at")
        undecided, after = staged(undecided.join(follow.unionByName(new).distinct(), "at", "left_anti"), "undecided")
        if path:
            drop(groups.sparkSession, path)
        path = after
    if not leaders:
        return titles.select("id", F.col("id").alias("leader"))
    first = first_met(members.join(reduce(DataFrame.unionByName, leaders), "at", "left_semi"), members)
    names = titles.select(F.col("at").alias("first"), F.col("id").alias("leader"))
    return titles.select("at", "id").join(first, "at", "left").withColumn("first", F.coalesce("first", "at")).join(names, "first").select("id", "leader")


def location_match(request: Request) -> Column:
    """struct(score, reason, is_match) of a normalised listing's place and work mode against the request's."""
    result = lambda score, reason, ok: F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"), F.lit(ok).alias("is_match"))
    key, mode, modes = F.col("location_key"), F.col("mode"), list(request.work_modes)
    if not request.locations and not modes:
        return result(72.0, "no_location_preference", True)
    wrong = F.coalesce(~mode.isin(*modes), F.lit(True)) if modes else F.lit(False)
    out = F.when(wrong & mode.isNull(), result(14.0, "work_mode_unknown", False)).when(wrong, result(8.0, "remote_hybrid_mismatch", False))
    if not request.locations:
        return out.otherwise(result(92.0, "work_mode_match", True))
    tokens = text.words(key)

    def near(wanted: str) -> Column:
        w = F.array(*[F.lit(t) for t in sorted(set(wanted.split()))])
        return key.contains(wanted) | F.lit(wanted).contains(key) | (F.size(F.array_intersect(tokens, w)) >= F.greatest(F.lit(1), F.least(F.size(F.array_distinct(tokens)), F.size(w)) - 1))

    return (
        out.when(F.col("location_quality").isin("missing", "weak") | (key == "unspecified"), result(6.0, "location_unknown", False))
        .when(key.isin(*request.locations), result(100.0, "exact_location_match", True))
        .when(any_of([near(x) for x in request.locations]), result(84.0, "near_location_match", True))
        .when((mode == "remote") & F.lit("remote" in modes), result(76.0, "remote_match_outside_target_geo", True))
        .otherwise(result(10.0, "location_mismatch", False))
    )


def clearance_fits(kind: Column, request: Request) -> Column:
    """Whether the kind of clearance that a listing asks for, null if none, is one that the request takes."""
    fits = F.lit(True) if request.clearance is None else kind.isNotNull() if request.clearance else kind.isNull()
    if request.clearances:
        fits &= F.coalesce(any_of([kind.contains(c.lower()) for c in request.clearances]), F.lit("clearance" not in request.require))
    return fits


def job_filter(request: Request) -> Column:
    """Whether a normalised listing passes; what it lacks only counts against it where the request says so."""
    hay = F.lower(F.concat_ws(" ", "title", "location", "description"))
    contains = lambda x, terms: any_of([x.contains(t.lower()) for t in terms])
    ok = [~contains(F.lower("title"), request.excluded)]
    if request.titles and not request.broad:
        ok.append(contains(F.lower("title"), request.titles))
    if request.keywords and "keyword" in request.require:
        ok.append(contains(hay, request.keywords))
    place = location_match(request)
    ok.append(~place["reason"].isin("location_unknown", "location_mismatch"))
    if "work_mode" in request.require:
        ok.append(~place["reason"].isin("remote_hybrid_mismatch", "work_mode_unknown"))
    unpaid = F.lit("salary" not in request.require) | F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    if request.salary_min is not None:
        ok += [unpaid, F.coalesce(F.col("salary_max") >= request.salary_min, F.lit(True))]
    if request.salary_max is not None:
        ok += [unpaid, F.coalesce(F.col("salary_min") <= request.salary_max, F.lit(True))]
    if request.experience:
        ok.append(F.coalesce(F.col("level").isin(*request.experience), F.lit("experience" not in request.require)))
    if request.clearance is not None or request.clearances:
        ok.append(text.let(text.infer_clearance(F.col("title"), F.col("description")), lambda kind: clearance_fits(kind, request)))
    return reduce(lambda a, b: a & b, ok)


def signals(request: Request, *, canonical: bool = False) -> Column:
    """struct of a listing's deterministic signals and their sum. canonical: the description's canonical text is there as description_c."""
    title = text.canon_unicode(F.col("title"))
    hay = F.concat_ws(" ", title, F.col("description_c") if canonical else text.canon_unicode(F.col("description")), text.canon_unicode(F.col("location")))
    count = lambda x, phrases: sum([has_phrase(x, p).cast("int") for p in phrases], F.lit(0))
    families = sum([any_of([has_phrase(title, n) for n in TITLE_FAMILIES[k]]).cast("int") for k in request.families], F.lit(0))
    pay = F.greatest(F.coalesce("salary_min", F.lit(0.0)), F.coalesce("salary_max", F.lit(0.0)))
    part = {
        "title": F.least(families * 0.62 + count(title, request.titles) * 0.28, F.lit(1.7)), "keyword": F.least(count(hay, request.keywords) * 0.14, F.lit(0.42)), "salary": F.least(pay / 260000.0, F.lit(0.55)),
        "work_mode": location_match(request)["score"] / 100.0 * 0.24, "experience": F.when(F.col("level").isin("entry", "internship"), 0.18).when(F.col("level") == "mid", 0.1).when(F.col("level") == "senior", 0.05).otherwise(0.0),
        "metadata": F.col("quality") / 100.0 * 0.28, "link": F.when(F.col("url_kind") == "direct", 0.12).when(F.col("url_kind") != "missing", 0.05).otherwise(0.0), "broad": F.when(F.lit(request.broad) & (families > 0), 0.18).otherwise(0.0),
    }
    return F.struct(families.alias("families"), *[F.round(v, 4).alias(k) for k, v in part.items()], F.round(reduce(lambda a, b: a + b, part.values()), 4).alias("total"))


def recency(request: Request) -> Column:
    """struct(score, missing_penalty, old_penalty, stale) by age."""
    age = F.col("age_days").cast("double")
    row = lambda score, missing, old, stale: F.struct(F.round(text.bounded(score, 0.0, 100.0), 2).alias("score"), F.lit(missing).alias("missing_penalty"), F.round(old, 2).alias("old_penalty"), F.lit(stale).alias("stale"))
    zero = F.lit(0.0)
    out = F.when(age.isNull(), row(zero, 28.0 if request.prefer_recent else 20.0, zero, False))
    if request.prefer_recent:
        out = out.when(age > 30, row(zero, 0.0, F.lit(48.0), True)).when(age > 14, row(55.0 - (age - 14) * 3.0, 0.0, F.least(18.0 + (age - 14) * 1.5, F.lit(40.0)), False))
    return out.otherwise(row(100.0 - age * 5.0, 0.0, zero, False))


WEIGHTS = {"resume_match": 0.30, "title_match": 0.20, "salary_score": 0.12, "location_score": 0.13, "seniority": 0.12, "recency_score": 0.13}


def fallback_scores(jobs: DataFrame, request: Request, profile: tuple[str, ...] = ()) -> DataFrame:
    """Normalised listings with six sub-scores and the overall score, from signals alone. profile: the tokens of an applicant's text, a parameter."""
    s, r, place = F.col("s"), F.col("r"), F.col("place")
    # the whole text is made canonical once, for signals and tokens alike
    jobs = jobs.withColumn("description_c", text.canon_unicode(F.col("description")))
    both = F.concat_ws(" ", text.canon_unicode(F.col("title")), "description_c")
    tokens = F.filter(F.array_distinct(text.words(both)), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$"))
    share = lambda t: F.size(F.array_intersect(t, F.array(*map(F.lit, profile)).cast("array<string>"))) / F.greatest(F.least(F.size(t), F.lit(12)), F.lit(1))
    overlap = text.let(tokens, share) if profile else F.lit(0.0)
    out = jobs.withColumns({"s": signals(request, canonical=True), "r": recency(request), "place": location_match(request), "overlap": F.least(overlap, F.lit(1.0))})
    cap = lambda x: text.bounded(x, 0.0, 100.0)
    q = F.col("quality") / 100.0
    out = out.withColumns({"score_100": cap(s["total"] / (2.8 if request.broad else 2.6) * 100.0), "title_match": cap(18.0 + s["title"] * 34.0 + s["keyword"] * 18.0 + F.when(F.lit(request.broad) & (s["families"] > 0), 8.0).otherwise(0.0))})
    out = out.withColumns({
        "resume_match": cap(16.0 + F.col("score_100") * 0.24 + F.col("title_match") * 0.16 + F.col("overlap") * 48.0 + q * 8.0),
        "salary_score": cap(10.0 + s["salary"] * 100.0 + q * 10.0 + F.when(F.col("url_kind") == "direct", 6.0).otherwise(0.0)),
        "location_score": cap(place["score"] * 0.82 + s["work_mode"] * 45.0 + q * 6.0),
        "seniority": cap(12.0 + s["experience"] * 220.0 + F.when(F.lit(request.broad) & (F.col("level") == "entry"), 8.0).otherwise(0.0)), "recency_score": r["score"],
    })
    weighted = F.round(reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()]), 2)
    overall = F.round(cap(F.greatest("score_100", weighted) - r["missing_penalty"] - r["old_penalty"]), 2)
    return out.withColumns({"overall": overall, "penalty": quality_penalty()}).withColumns({k: F.round(F.col(k), 2) for k in (*WEIGHTS, "score_100")}).drop("description_c")


def blend(scored: DataFrame, captured: DataFrame, request: Request) -> DataFrame:
    """Fallback scores joined with captured model scores(job_id, location_score, overall): a row that has them is mixed .55/.45 and .88/.12, the others take the larger of theirs."""
    c = captured.select("job_id", F.col("location_score").alias("m_location"), F.col("overall").alias("m_overall"))
    j = scored.join(c, "job_id", "left")
    place, has = F.col("place")["score"], F.col("m_overall").isNotNull()
    where = F.when(place < 25, 16.0).when(place < 50, 8.0).otherwise(0.0)
    mixed = text.bounded(F.col("m_overall") * 0.88 + F.col("recency_score") * 0.12, 0.0, 100.0)
    late = F.col("r")["missing_penalty"] + F.col("r")["old_penalty"]
    overall = text.bounded(text.bounded(F.when(has, mixed).otherwise(F.col("overall")) - where, 0.0, 100.0) - late, 0.0, 100.0)
    location = F.when(has, F.col("m_location") * 0.55 + place * 0.45).otherwise(F.greatest("location_score", place))
    return j.withColumns({"overall": F.round(overall, 2), "location_score": F.round(location, 2), "mode_of_score": F.when(has, "model").otherwise("deterministic")}).drop("m_location", "m_overall")


#: Rows of one company or title that take more and more points off: the fourth and all later ones lose the same.
MOST_REPEATS = 3


def diversity(scored: DataFrame, *, by: str = "pipeline") -> DataFrame:
    """Scores less penalties for repeated companies and titles and a dominant source, plus a bonus for rare ones; then rank and tier of every row in its pipeline, however many there are.

    Penalties stop growing after a few rows of a company, title or source, so only these first ones are sought; Spark cuts each task's rows to them before it deals them out. Ranks are numbers
    of one sort of all rows, less where the pipeline begins. So neither a pipeline nor a hot company gathers in a task.
    """
    order = [F.desc("overall"), F.desc("resume_match"), F.desc("title_match"), F.asc("job_id")]
    keys = {"company_c": text.canon_unicode(F.col("company")), "title_c": text.canon_unicode(F.col("title")), "source_c": F.lower(F.trim(F.coalesce("source", F.lit("unknown"))))}
    rows = stage(scored.withColumns(keys).withColumn("_row", F.monotonically_increasing_id()), "scored")

    def first(key: str, n: int) -> DataFrame:
        """(_row, key, before): the first n rows of each value of the key, with how many of that value are before them."""
        nth = F.row_number().over(Window.partitionBy(by, key).orderBy(*order))
        return rows.select("_row", by, key, "overall", "resume_match", "title_match", "job_id").withColumn("_n", nth).filter(F.col("_n") <= n).select("_row", F.lit(key).alias("key"), (F.col("_n") - 1).alias("before"))

    firsts = reduce(DataFrame.unionByName, [first(k, n) for k, n in (("company_c", MOST_REPEATS), ("title_c", MOST_REPEATS), ("source_c", 1))])
    firsts = firsts.groupBy("_row").agg(*[F.max(F.when(F.col("key") == k, F.col("before"))).alias(f"_{k}") for k in keys])
    totals = rows.groupBy(by, "source_c").agg(F.count(F.lit(1)).alias("of_source"))
    all_ = totals.groupBy(by).agg(F.sum("of_source").alias("of_all"))
    out = rows.join(firsts, "_row", "left").join(totals.join(all_, by), [by, "source_c"])
    share = F.col("of_source") / F.col("of_all")
    before = lambda key: F.coalesce(F.col(f"_{key}"), F.lit(MOST_REPEATS))
    out = out.withColumns({
        "company_penalty": before("company_c") * 6.0, "title_penalty": before("title_c") * 3.0,
        "source_penalty": F.when((share > 0.5) & (before("source_c") > 0), 2.5).otherwise(0.0), "source_bonus": F.greatest(F.lit(0.0), (1.0 - share) * 2.0), "quality_off": F.least(F.col("penalty") * 0.6, F.lit(7.0)),
    })
    adjusted = F.round(text.bounded(F.col("overall") - F.col("company_penalty") - F.col("title_penalty") - F.col("source_penalty") - F.col("quality_off") + F.col("source_bonus"), 0.0, 100.0), 2)
    out = out.withColumn("adjusted", adjusted).drop("_row", "of_source", "of_all", *keys, *[f"_{k}" for k in keys])
    # numbers are consecutive inside a sorted part; a pipeline's rows in earlier parts come before
    final = [by, F.desc("adjusted"), F.desc("overall"), F.desc("resume_match"), F.asc("job_id")]
    numbered = stage(out.orderBy(*final).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    parts = numbered.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(by, "_part", (F.col("_first") - F.coalesce(earlier, F.lit(0))).alias("_start"))
    rank = (F.col("_at") - F.col("_start") + 1).cast("int")
    return numbered.join(parts, [by, "_part"]).withColumns({"rank": rank, "tier": fit_tier(F.col("adjusted") / 50.0)}).drop("_part", "_at", "_start")


def fit_tier(score: Column) -> Column:
    return F.when(score >= 1.6, "strong_match").when(score >= 1.15, "good_match").when(score >= 0.75, "stretch_match").otherwise("low_match")


def top_ranked(rows: DataFrame, n: int, *order: Column, by: str = "pipeline") -> DataFrame:
    """The first n rows of each pipeline; Spark cuts each task's rows to n before it deals them out."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


@dataclass(frozen=True)
class ShortlistPolicy:
    """pool: how many rows of a pipeline, by rank, may be picked at all; None for all of them."""

    most: int = 10
    least_score: float = 37.5
    per_source: int = 4
    per_company: int = 2
    source_weight: float = 2.0
    company_weight: float = 4.0
    similar: float = 0.8
    freshness_bonus: float = 4.0
    repeat_penalty: float = 6.0
    resurface: bool = True
    pool: int | None = 200


def shortlist(rows: DataFrame, policy: ShortlistPolicy) -> DataFrame:
    """Greedy picks in each pipeline: again and again the row with the largest score less penalties for what is picked already; ties go to the better rank.

    rows: pipeline, job_id (once in its pipeline), rank, source, company, title, adjusted, freshness, group_id, in_cooldown, repeat_factor, and, if there, resurfaced (seen in
    an earlier run, but never shown). Returns pipeline, job_id, pick, effective for picks, and for the others reason. All pipelines pick at once, one row a round, so there are as many
    rounds as picks at most. A round is a maximum per pipeline, begun on the map side, over rows joined with their pipeline's picks so far, of which
    there are at most `most`; a pipeline's rows are never gathered.
    """
    spark = rows.sparkSession
    chosen = rows.filter(F.col("rank") <= policy.pool) if policy.pool is not None else rows
    resurfaced = F.coalesce("resurfaced", F.lit(False)) if "resurfaced" in rows.columns else F.lit(False)
    never = F.when(F.col("adjusted") < policy.least_score, "below_min_score").when(F.coalesce("in_cooldown", F.lit(False)), "notification_cooldown").when(F.lit(not policy.resurface) & resurfaced, "resurface_disabled")
    base = chosen.select(
        "pipeline", "job_id", "rank", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("company", F.lit("")).alias("company"), F.array_distinct(text.words(text.canon_unicode(F.col("title")))).alias("tokens"),
        F.nullif("group_id", F.lit("")).alias("group_id"), "adjusted", (F.col("adjusted") + F.col("freshness") * policy.freshness_bonus).alias("worth"), (F.col("repeat_factor") * policy.repeat_penalty).alias("repeat_off"), never.alias("never"),
    )
    base, base_path = staged(base, "pool")
    fields = ("job_id", "source", "company", "tokens", "group_id")
    kinds = {c: base.schema[c].dataType.simpleString() for c in fields}
    none = F.array().cast(f"array<struct<{', '.join(f'{c}:{kinds[c]}' for c in fields)}, effective:double>>")
    of_source, of_company = F.size(F.filter("p", lambda x: x["source"] == F.col("source"))), F.size(F.filter("p", lambda x: x["company"] == F.col("company")))
    taken = F.coalesce(F.exists("p", lambda x: x["group_id"] == F.col("group_id")), F.lit(False))
    alike = lambda x: F.when(F.size(F.array_union(x["tokens"], F.col("tokens"))) > 0, F.size(F.array_intersect(x["tokens"], F.col("tokens"))) / F.size(F.array_union(x["tokens"], F.col("tokens"))))
    near = F.array_max(F.filter(F.transform(F.filter("p", lambda x: x["company"] == F.col("company")), alike), lambda s: s >= policy.similar))
    barred = F.when(F.col("of_source") >= policy.per_source, "per_source_cap").when(F.col("of_company") >= policy.per_company, "per_company_cap").when(F.col("taken"), "duplicate_group_repeat")
    seen = lambda frame, picks: frame.join(picks, "pipeline").withColumns({"of_source": of_source, "of_company": of_company, "taken": taken, "near": near})
    effective = F.col("worth") - F.col("of_source") * policy.source_weight - F.col("of_company") * policy.company_weight - F.col("repeat_off") - F.coalesce(10.0 + F.col("near") * 10.0, F.lit(0.0))
    picks, path = staged(base.select("pipeline").distinct().withColumn("p", none), "picks")
    for _ in range(policy.most):
        open_ = seen(base.filter("never is null"), picks).filter(~F.exists("p", lambda x: x["job_id"] == F.col("job_id")))
        r = open_.withColumn("effective", effective)
        order = F.when(barred.isNull(), F.struct("effective", (-F.col("rank")).alias("early")))
        best = r.groupBy("pipeline").agg(F.max_by(F.struct(*fields, "effective"), order).alias("best")).filter("best is not null")
        grown, new_path = staged(picks.join(best, "pipeline", "left").select("pipeline", F.when(F.col("best").isNotNull(), F.concat("p", F.array("best"))).otherwise(F.col("p")).alias("p"), F.col("best").isNotNull().alias("grew")), "picks")
        done = grown.filter("grew").isEmpty()
        drop(spark, path)
        picks, path = grown.drop("grew"), new_path
        if done:
            break
    at = F.array_position(F.transform("p", lambda x: x["job_id"]), F.col("job_id"))
    reason = F.coalesce("never", barred, F.when(F.col("near").isNotNull(), "near_duplicate_company_title"), F.lit("max_items"))
    out = seen(base, picks).withColumn("at", F.nullif(at, F.lit(0).cast("long")))
    out, _ = staged(out.select("pipeline", "job_id", F.col("at").alias("pick"), F.round(F.get("p", F.col("at") - 1)["effective"], 4).alias("effective"), F.when(F.col("at").isNull(), reason).alias("reason")), "shortlist")
    drop(spark, path, base_path)
    return out


def shortlist_fail_soft(rows: DataFrame, policy: ShortlistPolicy, *, floor: float = 20.0, at_least: int = 3) -> DataFrame:
    """The shortlist, and for pipelines with fewer than at_least picks a second pass with a lower threshold, which counts where it picks more.

    selection_basis is fail_soft for the rows of such a pipeline, but threshold for what the first pass picked, too.
    """
    first = shortlist(rows, policy)
    n = lambda frame, name: frame.groupBy("pipeline").agg(F.count("pick").alias(name))
    short = n(first, "n").filter(F.col("n") < min(at_least, policy.most))
    second = shortlist(rows.join(short.select("pipeline"), "pipeline", "left_semi"), replace(policy, least_score=floor, most=min(at_least, policy.most)))
    better = n(second, "m").join(short, "pipeline").filter("m > n").select("pipeline")
    standard = first.filter("pick is not null").select("pipeline", "job_id", F.lit("threshold").alias("b"))
    soft = second.join(better, "pipeline", "left_semi").join(standard, ["pipeline", "job_id"], "left").select(*second.columns, F.coalesce("b", F.lit("fail_soft")).alias("selection_basis"))
    return first.join(better, "pipeline", "left_anti").withColumn("selection_basis", F.lit("threshold")).unionByName(soft)


#: What a history keeps of a listing: the last value that wasn't empty.
ATTRIBUTES = ("title", "company", "source", "url")
COUNTS = ("seen", "shortlisted", "notified")


def history_merge(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The next snapshot: counts added up, first and last times kept, and of each attribute the last value that wasn't empty, with its time.

    batch(job_key, seen, shortlisted, notified, at, title, company, source, url); rows without a key are left out. history has for each attribute a struct(at, value); the larger one stays (ties of
    time go to the larger value), so attributes and times come out the same in whatever order batches arrive, and however often. Counts add up each time: apply_batch takes a batch once.
    """
    given = lambda c: F.when(F.trim(c) != "", F.struct("at", F.trim(c).alias("value")))
    at = lambda c: F.max(F.when(F.col(c) > 0, F.col("at")))
    b = batch.filter(F.trim("job_key") != "").groupBy("job_key").agg(
        *[F.sum(c).alias(f"{c}_b") for c in COUNTS], F.min("at").alias("first_b"), F.max("at").alias("last_b"), at("shortlisted").alias("shortlisted_b_at"), at("notified").alias("notified_b_at"), *[F.max(given(c)).alias(f"{c}_b") for c in ATTRIBUTES],
    )
    j = history.join(b, "job_key", "full_outer")
    zero = F.lit(0).cast("long")
    counts = [(F.coalesce(F.col(c), zero) + F.coalesce(F.col(f"{c}_b"), zero)).alias(c) for c in COUNTS]
    times = [F.least("first_at", "first_b").alias("first_at"), F.greatest("last_at", "last_b").alias("last_at"), F.greatest("last_shortlisted", "shortlisted_b_at").alias("last_shortlisted"), F.greatest("last_notified", "notified_b_at").alias("last_notified")]
    return j.select("job_key", *counts, *times, *[F.greatest(c, f"{c}_b").alias(c) for c in ATTRIBUTES])


def history_schema(at: str = "timestamp") -> str:
    return f"job_key string, {', '.join(f'{c} long' for c in COUNTS)}, first_at {at}, last_at {at}, last_shortlisted {at}, last_notified {at}, {', '.join(f'{c} struct<at:{at},value:string>' for c in ATTRIBUTES)}"


def history_view(history: DataFrame) -> DataFrame:
    """A history with plain attributes."""
    return history.withColumns({c: F.col(c)["value"] for c in ATTRIBUTES})


def read_history(spark: SparkSession, path: str, *, at: str = "timestamp") -> DataFrame:
    return read_snapshot(spark, path, f"{history_schema(at)}, batch_id string").filter("batch_id is null").drop("batch_id")


def apply_batch(spark: SparkSession, path: str, batch: DataFrame, batch_id: str, *, at: str = "timestamp") -> bool:
    """Merges a batch into the history at path, unless it has been merged before; tells whether it was.

    The ids of merged batches are rows of the same snapshot, so a run that dies leaves neither the batch nor its id.
    """
    old = read_snapshot(spark, path, f"{history_schema(at)}, batch_id string")
    if not old.filter(F.col("batch_id") == batch_id).isEmpty():
        return False
    merged = history_merge(old.filter("batch_id is null").drop("batch_id"), batch).withColumn("batch_id", F.lit(None).cast("string"))
    ids = old.filter("batch_id is not null").select("batch_id").union(spark.range(1).select(F.lit(batch_id)))
    write_snapshot(merged.unionByName(ids, allowMissingColumns=True), path)
    return True


def expand_queries(titles: DataFrame, locations: DataFrame, *, most: int = 50) -> DataFrame:
    """titles(title_pos, title) by locations(location_pos, location) by variants, the variants in turn, distinct and cut to most. Parameter tables of a run, a few rows each."""
    t = F.col("title")
    variants = F.array(F.struct(F.lit(0).alias("turn"), t.alias("query")), F.struct(F.lit(1).alias("turn"), F.concat(F.lit("senior "), t).alias("query")), F.struct(F.lit(2).alias("turn"), F.replace(t, F.lit("engineer"), F.lit("developer")).alias("query")))
    grid = titles.join(locations).select("title_pos", "location_pos", "location", F.inline(variants))
    first = Window.partitionBy("query", "location").orderBy("turn", "title_pos", "location_pos")
    plan = grid.withColumn("_n", F.row_number().over(first)).filter("_n = 1").orderBy("turn", "title_pos", "location_pos").limit(most)
    return plan.withColumn("query_index", F.row_number().over(Window.orderBy("turn", "title_pos", "location_pos"))).select("query_index", "query", "location", "turn")


def requirement_lines(docs: DataFrame, hints: tuple[str, ...], *, most: int = 8) -> DataFrame:
    """(id, pos, line): lines or bullets of 12 characters or more with a hint word, the first of equal 180-character beginnings, at most the first `most` of a text."""
    pieces = F.transform(F.split("text", r"[\n•;]"), text.squeeze)
    good = F.filter(pieces, lambda p: (F.length(p) >= 12) & any_of([F.lower(p).contains(h) for h in hints]))
    lines = F.slice(F.array_distinct(F.transform(good, lambda p: F.substring(p, 1, 180))), 1, most)
    return docs.select("id", F.posexplode(lines).alias("pos", "line"))




# Titles that an entry-level search drops, and how many days old a listing may be where recent ones are preferred.
SENIOR_TITLE = r"(?i)\b(senior|sr|lead|staff|principal|manager)\b"
RECENT_DAYS = 14


def experience_filter(request: Request) -> Column:
    """Whether a listing fits the level asked for: an entry-level request drops senior levels and titles, any other nothing."""
    if "entry" not in request.experience:
        return F.lit(True)
    return (F.coalesce("level", F.lit("")) != "senior") & ~F.coalesce("title", F.lit("")).rlike(SENIOR_TITLE)


def recency_filter(request: Request, *, most: int = RECENT_DAYS) -> Column:
    """Where recent listings are preferred, those of at most so many days; undated ones go."""
    return F.coalesce(F.col("age_days") <= most, F.lit(False)) if request.prefer_recent else F.lit(True)


MANUAL = "struct<title:string,company:string,location:string,url:string,source_url:string,salary_min:double,salary_max:double,salary_currency:string,experience_level:string,work_mode:string,posted_at:string,description_snippet:string>"


def manual_rows(payloads: DataFrame) -> DataFrame:
    """Listings typed into requests, in the shape of collected ones: payloads(request_id, payload) with a JSON object whose manual_jobs is a list of objects.

    source is manual; source_url is the url where none is given. Entries that are no objects and payloads without a list give nothing.
    """
    entries = F.from_json(F.get_json_object("payload", "$.manual_jobs"), "array<string>")
    rows = payloads.select("request_id", F.posexplode(entries).alias("pos", "x")).filter(F.startswith(F.trim("x"), F.lit("{"))).select("request_id", "pos", F.from_json("x", MANUAL).alias("j"))
    filled = F.coalesce(F.when(F.trim("j.source_url") != "", F.col("j.source_url")), F.when(F.trim("j.url") != "", F.col("j.url")))
    return rows.select("request_id", "pos", F.lit("manual").alias("source"), filled.alias("source_url"), *[F.col(f"j.{c}").alias(c) for c in ("title", "company", "location", "url", "salary_min", "salary_max", "salary_currency", "experience_level", "work_mode", "posted_at", "description_snippet")])


@dataclass(frozen=True)
class Limits:
    """Of a collecting run."""

    per_source: int = 250
    pages: int = 5
    queries_per_pair: int = 4
    queries: int = 8
    least_raw: int = 0
    least_unique: int = 0
    least_per_source: int = 0
    seconds: int | None = None
    expand: bool = False
    stop_at_least: bool = True
    stop_when_dry: bool = True


# What a request means where it says nothing, and the ranges that its numbers are held to.
DEFAULT_QUERY, DEFAULT_PLACE = "software engineer", "United States"
RANGES = {"per_source": (1, 1000), "pages": (1, 20), "queries_per_pair": (1, 10), "queries": (1, 20), "least_raw": (0, 5000), "least_unique": (0, 5000), "least_per_source": (0, 1000), "seconds": (1, 3600)}
ENTRY_NAMES = ("entry-level", "entry level", "junior", "new grad", "associate")


@dataclass(frozen=True)
class Resolved:
    """A request's parameters, complete: what to search for, how, and how much."""

    query: str
    mode: str
    request: Request
    limits: Limits


def resolve_request(raw: dict | None) -> Resolved:
    """Parameters of a run from what a caller gave: names that mean one thing are joined, lists made distinct, levels and modes normalised, numbers clamped, and the search mode inferred: broad discovery for generic titles alone."""
    raw = raw if isinstance(raw, dict) else {}

    def words(*names: str) -> tuple[str, ...]:
        found: dict[str, str] = {}
        for name in names:
            given = raw.get(name)
            for x in given if isinstance(given, list) else [given]:
                if isinstance(x, str) and (t := " ".join(x.split())):
                    found.setdefault(t.lower(), t)
        return tuple(found.values())

    def number(*names: str) -> float | None:
        for name in names:
            try:
                return float(str(raw[name]).strip().lstrip("$").replace(",", ""))
            except (KeyError, ValueError):
                continue
        return None

    def clamped(key: str, default: int | None, *names: str) -> int | None:
        low, high = RANGES[key]
        n = number(*names)
        return default if n is None or (n == 0 and low > 0) else int(min(max(n, low), high))

    def switch(name: str, default: bool) -> bool:
        x = raw.get(name)
        if isinstance(x, str):
            return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(x.strip().lower(), default)
        return x if isinstance(x, bool) else default

    level = lambda x: "entry" if x.lower() in ENTRY_NAMES else x.lower()
    work = lambda x: {"on-site": "onsite"}.get(x.lower(), x.lower())
    named = words("query", "search_query")
    recent = switch("prefer_recent", False) or (words("shortlist_freshness_preference") or ("",))[0].lower() in ("prefer_recent", "strong_prefer_recent")
    request = Request(
        titles=words("desired_title", "titles"), keywords=words("keywords", "desired_title_keywords"), excluded=words("excluded_keywords", "excluded_title_keywords"),
        locations=words("locations") or words("location", "search_location") or (DEFAULT_PLACE,), work_modes=tuple(dict.fromkeys(w for x in words("work_mode_preference") or words("work_modes") if (w := work(x)) in text.WORK_MODES)),
        experience=tuple(dict.fromkeys(map(level, words("experience_level", "experience_levels")))), salary_min=number("minimum_salary", "desired_salary_min"), salary_max=number("desired_salary_max"), prefer_recent=recent,
        clearance={"required": True, "true": True, "yes": True, "none": False, "false": False, "no": False}.get(str(raw.get("clearance_required")).strip().lower()) if isinstance(raw.get("clearance_required"), str | bool) else None,
        clearances=words("required_clearances"), require=frozenset({"clearance"} if switch("require_clearance_match", False) else ()),
    )
    given = (words("search_mode") or ("",))[0].lower().replace("-", "_").replace(" ", "_")
    mode = given if given in ("broad_discovery", "precision_match") else "broad_discovery" if request.broad else "precision_match"
    broad = mode == "broad_discovery"
    limits = Limits(
        per_source=clamped("per_source", 250, "result_limit_per_source", "max_jobs_per_source", "max_jobs_per_board"), pages=clamped("pages", 5, "max_pages_per_source"), queries_per_pair=clamped("queries_per_pair", 4, "max_queries_per_title_location_pair"),
        queries=clamped("queries", 14 if broad else 8, "max_queries_per_run"), least_raw=clamped("least_raw", 0, "minimum_raw_jobs_total"), least_unique=clamped("least_unique", 0, "minimum_unique_jobs_total"), least_per_source=clamped("least_per_source", 0, "minimum_jobs_per_source"),
        seconds=clamped("seconds", None, "collection_time_cap_seconds"), expand=switch("enable_query_expansion", broad), stop_at_least=switch("stop_when_minimum_reached", True), stop_when_dry=switch("early_stop_when_no_new_results", True),
    )
    return Resolved(named[0] if named else DEFAULT_QUERY, mode, request, limits)
