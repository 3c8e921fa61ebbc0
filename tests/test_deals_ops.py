"""Alert sequences, state, snapshots and streams on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from lodestream.operators import deals, ops
from lodestream.operators.deals import AlertPolicy
from lodestream.sources import html, sinks
from lodestream.streaming import stateful

STATE = "deal_key string, last_price double, last_status string, last_alerted_at timestamp, cooldown_until timestamp, alert_count int"
START = dt.datetime(2026, 1, 1)


def test_alert_then_silence_then_price_move(spark):
    state, seen = spark.createDataFrame([], STATE), []
    for minutes, price in ((0, 3799.0), (30, 3799.0), (60, 3599.0)):
        batch = spark.createDataFrame([("k", 1, price, "in_stock"), ("k", 2, price, "in_stock")], "deal_key string, pos int, price double, status string")
        d = deals.alert_decisions(batch, state, now=F.lit(START + dt.timedelta(minutes=minutes)), policy=AlertPolicy())
        rows = {r["pos"]: r for r in d.collect()}
        seen.append(rows[1]["should_alert"])
        assert rows[2]["reasons"] == "duplicate_in_batch"
        state = spark.createDataFrame(deals.next_state(state, d, policy=AlertPolicy()).collect(), STATE)
    assert seen == [True, False, True]
    assert state.first()["alert_count"] == 2 and state.first()["last_price"] == 3599.0


def test_slow_drift_is_measured_from_the_last_alert(spark):
    state, seen = spark.createDataFrame([], STATE), []
    for i, price in enumerate((1000.0, 1010.0, 1020.0, 1030.0)):
        batch = spark.createDataFrame([("k", 1, price, "in_stock")], "deal_key string, pos int, price double, status string")
        d = deals.alert_decisions(batch, state, now=F.lit(START + dt.timedelta(minutes=i)), policy=AlertPolicy())
        seen.append(d.first()["should_alert"])
        state = spark.createDataFrame(deals.next_state(state, d, policy=AlertPolicy()).collect(), STATE)
    assert seen == [True, False, False, True]


def test_target_rows(spark):
    rows = [("GeForce RTX 5090 card", 1999.0), ("Gaming desktop RTX 5090", 3999.0), ("RTX 5090 card", 2400.0), ("Laptop RTX 5090", 1999.0)]
    d = spark.createDataFrame(rows, "title string, price double").withColumn("old_price", F.lit(None).cast("double"))
    assert sorted(r["price"] for r in deals.under_threshold(d).collect()) == [1999.0, 3999.0]


def test_snapshot_versions(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", "k string, n long"
    assert sinks.read_snapshot(spark, path, schema).count() == 0
    for n in range(4):
        old = sinks.read_snapshot(spark, path, schema)
        sinks.write_snapshot(sinks.upsert(old, spark.createDataFrame([("a", n), (f"b{n}", n)], schema), "k"), path)
    assert {r["k"]: r["n"] for r in sinks.read_snapshot(spark, path, schema).collect()} == {"a": 3, "b0": 0, "b1": 1, "b2": 2, "b3": 3}
    assert sinks.versions(spark, path) == [3, 4]


def test_map_merge_prefers_new_entries(spark):
    schema = "agent string, status string, meta map<string,string>"
    old, new = spark.createDataFrame([("a", "up", {"x": "1", "y": "1"}), ("b", "up", None)], schema), spark.createDataFrame([("a", "down", {"y": "2"})], schema)
    got = {r["agent"]: (r["status"], r["meta"]) for r in sinks.upsert(old, new, "agent", merge_map="meta").collect()}
    assert got == {"a": ("down", {"x": "1", "y": "2"}), "b": ("up", {})}


def test_alert_groups(spark):
    e = spark.createDataFrame([(i, START + dt.timedelta(seconds=i), "watchdog_alert", "warning", "watchdog", f"watchdog agent w{i} heartbeat stale {i}s") for i in range(5)], "event_id int, ts timestamp, event_type string, level string, source string, message string")
    r = ops.compress_alerts(ops.event_signals(e), now=F.lit(START)).collect()
    assert len(r) == 1 and r[0]["n"] == 5 and r[0]["family"] == "watchdog" and r[0]["severity"] == "warning"


def test_anchors_and_sku_prices(spark):
    page = '<html><a href="/p/1">First item &amp; more</a> now $ 1,200.50 <a href="x.html">No</a>{"sku":"a1","customerPrice":5}{"sku":"a1","customerPrice":7.5}</html>'
    p = spark.createDataFrame([(1, "https://s.example/shop/", page), (2, "https://s.example/", None)], "page_id long, url string, html string")
    rows = html.anchors(p).collect()
    assert [(r["url"], r["label"]) for r in rows] == [("https://s.example/p/1", "First item & more"), ("https://s.example/shop/x.html", "No")]
    assert p.select(html.sku_prices(F.col("html")).alias("m")).first()["m"] == {"a1": 7.5}
    assert html.product_deals(p, "item").first()["price"] == 1200.5


def test_raw_items(spark):
    p = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"deals":[{"a":1}],"items":[{"a":2},{"a":3}]}',), ('{"title":"x"}',)], "p string")
    assert [len(r["i"]) for r in p.select(html.raw_items(F.col("p")).alias("i")).collect()] == [2, 3, 1]


def run_stream(spark, tmp_path, name, rows, schema, make):
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    for k, v in stateful.STATE_STORE.items():
        spark.conf.set(k, v)
    return stateful.drain(make(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/ckpt").collect()


def test_rate_limit_stream(spark, tmp_path):
    rows = [("u", i, START + dt.timedelta(seconds=s)) for i, s in enumerate((0, 0, 0, 1, 10, 10, 10))]
    got = run_stream(spark, tmp_path, "rate", rows, "identity string, id long, ts timestamp", lambda s: stateful.rate_limit(s, capacity=2.0, rate=1.0))
    assert [r["allowed"] for r in sorted(got, key=lambda r: r["id"])] == [True, True, False, True, True, True, False]


def test_notify_stream_does_not_prolong(spark, tmp_path):
    rows = [("c", "k", i, START + dt.timedelta(seconds=s)) for i, s in enumerate((0, 50, 99, 100, 150))]
    got = run_stream(spark, tmp_path, "notify", rows, "channel string, dedupe_key string, id long, ts timestamp", lambda s: stateful.notify_once(s, 100.0))
    assert [r["sent"] for r in sorted(got, key=lambda r: r["id"])] == [True, False, False, True, False]


def test_deal_stream_equals_batch(spark, tmp_path):
    prices = (1000.0, 1010.0, 1020.0, 1030.0, 1030.0)
    rows = [("k", START + dt.timedelta(minutes=i), i, p, "in_stock") for i, p in enumerate(prices)]
    got = run_stream(spark, tmp_path, "deals", rows, "deal_key string, ts timestamp, pos long, price double, status string", lambda s: stateful.deal_alerts(s, AlertPolicy()))
    assert [r["should_alert"] for r in sorted(got, key=lambda r: r["pos"])] == [True, False, False, True, False]


def test_deal_stream_takes_unknown_prices_and_states(spark, tmp_path):
    given = [(None, "in_stock"), (1000.0, None), (None, "out_of_stock"), (1000.0, "out_of_stock"), (1000.0, "in_stock")]
    rows = [("k", START + dt.timedelta(minutes=i), i, p, s) for i, (p, s) in enumerate(given)]
    got = run_stream(spark, tmp_path, "unknown", rows, "deal_key string, ts timestamp, pos long, price double, status string", lambda s: stateful.deal_alerts(s, AlertPolicy()))
    # a price that wasn't known before is no change, nor is a status that isn't known
    want = [(None, "new_item"), (1000.0, "in_cooldown"), (None, "status_changed"), (1000.0, "in_cooldown"), (1000.0, "status_changed")]
    assert [(r["price"], r["reason"]) for r in sorted(got, key=lambda r: r["pos"])] == want


def test_silent_agents_are_told_by_a_timer(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("a", 0, at(0)), ("a", 1, at(50)), ("a", 2, at(400)), ("b", 3, at(0)), ("clock", 4, at(1000)), ("clock", 5, at(1030))]
    got = run_stream(spark, tmp_path, "beats", rows, "agent string, id long, ts timestamp", lambda s: stateful.heartbeat_changes(s, 100.0, 200.0, late="0 seconds"))
    seen = sorted((r["agent"], int((r["ts"] - START).total_seconds()), r["event"], r["retry_after"]) for r in got if r["agent"] != "clock")
    a = [("a", 150, "stale", 60.0), ("a", 350, "stale", 120.0), ("a", 400, "recovered", None), ("a", 550, "stale", 60.0), ("a", 750, "stale", 120.0), ("a", 950, "stale", 240.0)]
    assert seen == [*a, *[("b", 100 + 200 * i, "stale", 60.0 * 2**i) for i in range(5)]]


def test_a_batch_that_runs_again_replaces_its_snapshot(spark, tmp_path):
    path, schema = f"file://{tmp_path}/snap", "k string, n long"
    for version, n in ((1, 5), (2, 7), (2, 7)):
        old = sinks.read_snapshot(spark, path, schema, before=version)
        both = old.unionByName(spark.createDataFrame([("x", n)], schema)).groupBy("k").agg(F.sum("n").alias("n"))
        sinks.write_snapshot(both, path, version=version)
    assert [r["n"] for r in sinks.read_snapshot(spark, path, schema).collect()] == [12]


def test_risk_and_creation_time(spark):
    rows = spark.createDataFrame([(1, 2e7, 0.5, 0.1), (2, 9e7, 0.9, 0.9), (3, None, None, 1.0)], "pos long, size_usd double, debt_ratio double, churn double")
    assert [(r["pos"], r["risk"]) for r in deals.top_risk(rows, 3).collect()] == [(2, 1.0), (1, 0.68), (3, 0.3)]
    state = spark.createDataFrame([("old", 5.0, "in_stock", START, START, 1, START)], "deal_key string, last_price double, last_status string, last_alerted_at timestamp, cooldown_until timestamp, alert_count int, created_at timestamp")
    batch = spark.createDataFrame([("old", 1, 500.0, "in_stock"), ("new", 2, 9.0, "in_stock")], "deal_key string, pos long, price double, status string")
    later = START + dt.timedelta(days=3)
    after = deals.next_state(state, deals.alert_decisions(batch, state, now=F.lit(later), policy=AlertPolicy()), policy=AlertPolicy())
    assert {r["deal_key"]: (r["created_at"], r["last_price"]) for r in after.collect()} == {"old": (START, 500.0), "new": (later, 9.0)}
