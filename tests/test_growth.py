"""Work grows with the input: rows that a step shuffles, places where a text is cleaned, rows that are objects at a time."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from lodestream.operators import reports
from lodestream.streaming import stateful


def shuffled(spark, df) -> tuple[list, int]:
    """A frame's rows, and how many rows its stages wrote for others."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    rows = df.collect()
    return rows, total() - before


def plain_label(label: str, phrases: list[tuple[str, str]], least: float):
    best = []
    for key, p in phrases:
        lw, pw = set(label.split()), set(p.split())
        l_, p_ = f" {label} ", f" {p} "
        rule = 1 if label == p else 2 if l_.startswith(p_) else 3 if p_ in l_ else 4 if len(lw & pw) / max(len(lw), len(pw)) >= least else None
        if rule and lw & pw:
            best.append((rule, -len(p), key))
    return min(best)[::2] if best else None


def test_best_label_agrees_with_all_pairs(spark):
    r = random.Random(5)
    text = lambda most: " ".join(r.choice("abcdefg") for _ in range(r.randint(0, most)))
    labels, phrases = [(i, text(7)) for i in range(300)], [(f"k{i % 40}", text(5)) for i in range(120)]
    got = reports.best_label(spark.createDataFrame(labels, "id long, label string"), spark.createDataFrame(phrases, "key string, phrase string"), least=0.65).collect()
    want = {i: m for i, label in labels if (m := plain_label(label, phrases, 0.65))}
    assert {x["id"]: (x["rule"], x["key"]) for x in got} == want
    assert {m[0] for m in want.values()} == {1, 2, 3, 4}


def test_best_label_common_words_do_not_meet(spark):
    labels = spark.range(2000).select("id", F.format_string("the x%d of y%d here", "id", "id").alias("label"))
    phrases = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.format_string("the x%d of", "id").alias("phrase"))
    rows, moved = shuffled(spark, reports.best_label(labels, phrases))
    assert len(rows) == 2000 and {x["rule"] for x in rows} == {2}
    assert moved < 100 * 2000


def test_watcher_summary_runs_of_equal_time_and_id(spark):
    t = datetime.datetime(2024, 1, 1)
    templates = spark.createDataFrame([("w1", "a")], "id string, task_type string")
    tasks = spark.createDataFrame([(7, "a", "{}", t)], "task_id long, task_type string, payload string, updated timestamp")
    artifacts = spark.createDataFrame([], "task_id long, artifact_id long, is_result boolean, at timestamp")
    for order in (("F", "O"), ("O", "F")):
        runs = spark.createDataFrame([(7, 71, s, t) for s in order], "task_id long, run_id long, status string, at timestamp").coalesce(1)
        assert [x["status"] for x in reports.watcher_summary(templates, tasks, runs, artifacts).collect()] == ["O"]


class Handle:
    def __init__(self):
        self.value, self.timers = None, []

    getValueState = lambda self, *a: self
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: self.timers
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)

    def update(self, v):
        self.value = v


def test_rate_limit_leaves_in_chunks_in_order():
    n = 2 * stateful.CHUNK + 5
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    rows = pd.DataFrame({"identity": "a", "id": ids, "ts": pd.Timestamp("2024-01-01"), "at_s": [float(i) for i in ids]})
    p = stateful.TokenBucket(3.0, 0.5)
    p.init(Handle())
    out = list(p.handleInputRows(("a",), iter([rows[:7], rows[7:]]), None))
    assert max(map(len, out)) <= stateful.CHUNK
    assert pd.concat(out)["id"].tolist() == list(range(n)) and p.state.value[1] == float(n - 1)
    # a token each two seconds: after the first ones, every second row passes
    assert pd.concat(out)["allowed"].iloc[10:].sum() == (n - 9) // 2


def test_texts_are_cleaned_once(spark, sf):
    from lodestream.plans import registry

    for name in ("exclude_terms", "entry_listings"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[A-Za-z0-9]+") == 1 and "[^A-Za-z0-9 ]" not in plan, name


def test_offer_prices_look_a_page_up_once(spark):
    from lodestream.sources import html

    c = F.col
    df = spark.createDataFrame([("h", "s", "t", "k")], "h string, s string, t string, k string")
    plan = df.select(html.offer_prices(c("h"), c("s"), c("t"), c("k"), "bestbuy").alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(html.NEAR_PRICE["customer"]) == 1 and plan.count(html.NEAR_PRICE["regular"]) == 1
    assert plan.count(html.SKU_PRICE["customer"]) == 2 and plan.count(html.SKU_PRICE["regular"]) == 2


def plain_similar(x: str, y: str, least: float) -> float | None:
    a, b = set(x.split()), set(y.split())
    s = len(a & b) / len(a | b) if a and b else 0.0
    return s if round(s, 4) >= least else None


def made_titles(seed: int, n: int) -> list[tuple]:
    """Titles of 0 to 12 tokens in two buckets, many alike, in no order of id."""
    r = random.Random(seed)
    titles = {(f"k{r.randrange(2)}", " ".join(r.sample("abcdefghijklmnop", r.randrange(0, 13) if i % 4 == 0 else r.randrange(0, 6)))) for i in range(n)}
    ids = r.sample(range(1000), len(titles))
    return [(i, r.randrange(50), *t) for i, t in zip(ids, sorted(titles))]


TITLES = "id long, ord long, bucket string, title_key string"


def test_title_links_count_all_pairs(spark):
    from lodestream.operators import listings

    rows = made_titles(3, 160)
    for low, high in ((0.4, 0.84), (0.5, 0.6)):
        got = {x["id"]: (x["component"], x["links"], x["merges"], x["nearest"]) for x in listings.title_links(spark.createDataFrame(rows, TITLES), low=low, high=high).collect()}
        near = {i: {j: s for j, _, c, u in rows if j != i and c == b and (s := plain_similar(t, u, low))} for i, _, b, t in rows}
        label = {i: i for i in near}
        while (after := {i: min([label[i], *[label[j] for j in near[i]]]) for i in near}) != label:
            label = after
        assert got == {i: (label[i], len(n), sum(s >= high for s in n.values()), round(max(n.values()), 4) if n else None) for i, n in near.items()}


def test_title_links_grow_with_the_titles(spark):
    from lodestream.operators import listings

    def moved(n: int) -> int:
        titles = spark.range(n).select("id", F.lit("b").alias("bucket"), F.concat(F.lit("senior x"), "id", F.lit(" api lead")).alias("title_key"))
        rows, records = shuffled(spark, listings.title_links(titles, low=0.4))
        assert {(x["component"], x["links"], x["nearest"]) for x in rows} == {(0, n - 1, 0.6)}
        return records

    assert moved(2000) < 100 * 2000


def test_leaders_with_long_titles_are_first_come(spark):
    from lodestream.operators import listings

    rows = made_titles(4, 160)
    for least in (0.4, 0.6):
        want, leaders = {}, []
        for i, _, b, t in sorted(rows, key=lambda r: (r[1], r[0])):
            want[i] = next((j for j, c, u in leaders if c == b and plain_similar(t, u, least)), i)
            if want[i] == i:
                leaders.append((i, b, t))
        assert {x["id"]: x["leader"] for x in listings.leader_clusters(spark.createDataFrame(rows, TITLES), threshold=least).collect()} == want


def test_leader_rounds_grow_with_the_titles(spark):
    from lodestream.operators import listings

    titles = spark.range(2000).select("id", F.col("id").alias("ord"), F.lit("b").alias("bucket"), F.concat(F.lit("senior x"), "id", F.lit(" api lead")).alias("title_key"))
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert {x["leader"] for x in listings.leader_clusters(titles, threshold=0.5).collect()} == {0}
    assert written() - before < 100 * 2000


def test_first_seen_deals_sort_no_rows(spark, sf):
    from lodestream.plans import registry

    assert "SortAggregate" not in registry.QUERIES["first_seen_deals"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_deal_state_sorts_no_rows(spark, sf):
    from lodestream.plans import deal_queries

    state, _ = deal_queries.state_and_batch(spark, sf)
    assert "SortAggregate" not in state._jdf.queryExecution().executedPlan().toString()


def test_deal_pipeline_moves_targets_only(spark):
    from lodestream.operators import deals

    c = F.col
    title = F.when(c("id") % 100 == 0, F.concat(F.lit("GeForce  RTX 5090 graphics card "), "id")).otherwise(F.concat(F.lit("Teapot "), "id"))
    rows = spark.range(2000).select(c("id").alias("pos"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("url"), title.alias("title"), F.lit(1500.0).alias("price"), F.lit(1600.0).alias("old_price"), F.lit(True).alias("in_stock"))
    # a later, cheaper row of a key whose first one is too dear stays out, and so does its title in capitals
    dear = rows.filter("pos = 300").select((c("pos") - 1000).alias("pos"), "source", "sku", "url", F.upper("title").alias("title"), F.lit(2500.0).alias("price"), "old_price", "in_stock")
    state = spark.createDataFrame([], "deal_key string, last_price double, last_status string, last_alerted_at timestamp, cooldown_until timestamp, alert_count int")
    got, moved = shuffled(spark, deals.pipeline(rows.unionByName(dear), state, now=F.lit(datetime.datetime(2024, 1, 1)), policy=deals.AlertPolicy()))
    assert sorted(x["pos"] for x in got) == [i for i in range(0, 2000, 100) if i != 300]
    assert moved < 500
