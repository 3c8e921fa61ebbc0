"""Queries that run as streams over the event table, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ops
from ..operators.deals import AlertPolicy
from ..sources import sinks
from ..streaming import stateful
from . import inputs
from .ops_queries import SIGNED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = inputs.with_views(sql)
        return f

    return add


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files, shaped like the batch frame."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(inputs.EVENTS, events=raw).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream with its state and its output in the shared folder, or a local one where the session names none."""
    spark = stream.sparkSession
    path = sinks.shared_path(spark, "streams")
    for k, v in stateful.STATE_STORE.items():
        spark.conf.set(k, v)
    return stateful.drain(stream, f"{path}/out", f"{path}/checkpoint", mode)


# A stream in append mode gives a window once the watermark has passed its end; the rows of windows still open stay in the state.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events_)"


@query("stream_windows", f"""WITH w AS (SELECT ts, level, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events_)
SELECT s AS "start", s + INTERVAL 1 HOUR AS "end", count(*) AS n, count_if(level = 'error') AS errors, round(sum(value), 2) AS spend, count_if(level = 'error') / count(*)::DOUBLE > 0.3 AS alert FROM w, {CLOSED} WHERE s + INTERVAL 1 HOUR <= mark GROUP BY s""")
def stream_windows(spark, sf_dir):
    out = drained(stateful.windowed_monitor(event_stream(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_signatures", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, signature, count(*) AS n FROM {SIGNED}, {CLOSED} WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2")
def stream_signatures(spark, sf_dir):
    out = drained(stateful.signature_counts(ops.event_signals(event_stream(spark, sf_dir)).select("ts", "signature")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_notify", """WITH RECURSIVE m AS (SELECT source AS channel, event_type AS dedupe_key, event_id AS id, ts FROM events_), s AS (SELECT channel, dedupe_key, min(struct_pack(ts, id)) AS f FROM m GROUP BY 1, 2
 UNION ALL SELECT s.channel, s.dedupe_key, (SELECT min(struct_pack(m.ts, m.id)) FROM m WHERE m.channel = s.channel AND m.dedupe_key = s.dedupe_key AND m.ts >= s.f.ts + INTERVAL 6 HOUR) AS f FROM s WHERE s.f IS NOT NULL)
 SELECT m.*, s.f IS NOT NULL AS sent FROM m LEFT JOIN s ON s.channel = m.channel AND s.dedupe_key = m.dedupe_key AND s.f.id = m.id AND s.f.ts = m.ts""")
def stream_notify(spark, sf_dir):
    m = event_stream(spark, sf_dir).select(F.col("source").alias("channel"), F.col("event_type").alias("dedupe_key"), F.col("event_id").alias("id"), "ts")
    return drained(stateful.notify_once(m, 6 * 3600.0)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_rate_limit", """WITH RECURSIVE c AS (SELECT event_type AS identity, event_id AS id, ts, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events_),
 b AS (SELECT identity, n, id, ts, sec, true AS allowed, 2.0::DOUBLE AS tokens FROM c WHERE n = 1
 UNION ALL SELECT c.identity, c.n, c.id, c.ts, c.sec, least(3.0, b.tokens + (c.sec - b.sec) * (1 / 3600::DOUBLE)) >= 1, least(3.0, b.tokens + (c.sec - b.sec) * (1 / 3600::DOUBLE)) - CASE WHEN least(3.0, b.tokens + (c.sec - b.sec) * (1 / 3600::DOUBLE)) >= 1 THEN 1 ELSE 0 END FROM b JOIN c ON c.identity = b.identity AND c.n = b.n + 1)
 SELECT identity, id, ts, allowed FROM b""")
def stream_rate_limit(spark, sf_dir):
    c = event_stream(spark, sf_dir).select(F.col("event_type").alias("identity"), F.col("event_id").alias("id"), "ts")
    return drained(stateful.rate_limit(c, capacity=3.0, rate=1 / 3600)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_heartbeats", """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS agent, ts, event_id FROM events_), wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM e),
 b AS (SELECT agent, ts, row_number() OVER k AS n, lead(ts) OVER k AS later FROM e WINDOW k AS (PARTITION BY agent ORDER BY ts, event_id)),
 g AS (SELECT *, epoch_us(ts) AS t, epoch_us(coalesce(later, w)) AS z, later IS NOT NULL AS back FROM b, wm),
 s AS (SELECT agent, n, t, z, back, t + 21600000000 AS due, CASE WHEN t + 21600000000 <= z THEN (z - t - 21600000000) // 86400000000 + 1 ELSE 0 END AS k FROM g WHERE n = 1
 UNION ALL SELECT agent, n, t, z, back, due, CASE WHEN due <= z THEN (z - due) // 86400000000 + 1 ELSE 0 END FROM (SELECT g.agent, g.n, g.t, g.z, g.back, greatest(g.t + 21600000000, q.warned + 86400000000) AS due FROM g JOIN (SELECT agent, n, CASE WHEN k > 0 THEN due + (k - 1) * 86400000000 ELSE due - 86400000000 END AS warned FROM s) q ON q.agent = g.agent AND g.n = q.n + 1))
 SELECT agent, make_timestamp(due + i * 86400000000) AS ts, 'stale' AS event, least(60.0 * 2 ** i, 3600.0) AS retry_after FROM (SELECT agent, due, unnest(range(k)) AS i FROM s WHERE k > 0)
 UNION ALL SELECT agent, make_timestamp(z), 'recovered', NULL FROM s WHERE back AND z - t > 21600000000""")
def stream_heartbeats(spark, sf_dir):
    b = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("agent"), F.col("event_id").alias("id"), "ts")
    return drained(stateful.heartbeat_changes(b, 6 * 3600.0, 24 * 3600.0)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_deal_alerts", """WITH RECURSIVE d AS (SELECT user_id::VARCHAR AS deal_key, ts, event_id AS pos, round(value, 2) AS price, CASE WHEN event_type = 'error' THEN 'out_of_stock' ELSE 'in_stock' END AS status, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events_),
 s AS (SELECT deal_key, n, ts, pos, price, 'new_item' AS reason, price AS lp, status AS ls, sec AS la FROM d WHERE n = 1
 UNION ALL SELECT deal_key, n, ts, pos, price, reason, CASE WHEN reason = 'in_cooldown' THEN lp ELSE price END, CASE WHEN reason = 'in_cooldown' THEN ls ELSE status END, CASE WHEN reason = 'in_cooldown' THEN la ELSE sec END FROM (
  SELECT d.*, s.lp, s.ls, s.la, CASE WHEN abs(d.price - s.lp) >= 25 OR (s.lp > 0 AND abs(d.price - s.lp) / s.lp * 100 >= 3) THEN 'material_price_change' WHEN d.status <> s.ls THEN 'status_changed' WHEN d.sec >= s.la + 21600 THEN 'cooldown_expired' ELSE 'in_cooldown' END AS reason FROM s JOIN d ON d.deal_key = s.deal_key AND d.n = s.n + 1))
 SELECT deal_key, ts, pos, price, reason <> 'in_cooldown' AS should_alert, reason FROM s""")
def stream_deal_alerts(spark, sf_dir):
    d = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("deal_key"), "ts", F.col("event_id").alias("pos"), F.round(F.col("value"), 2).alias("price"), F.when(F.col("event_type") == "error", "out_of_stock").otherwise("in_stock").alias("status"))
    return drained(stateful.deal_alerts(d, AlertPolicy())).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_idempotent", "SELECT task_type, count(*) AS n FROM (SELECT DISTINCT event_type AS task_type, event_id // 2 AS k FROM events_) GROUP BY task_type")
def stream_idempotent(spark, sf_dir):
    r = event_stream(spark, sf_dir).select(F.col("event_type").alias("task_type"), F.floor(F.col("event_id") / 2).cast("string").alias("idempotency_key"), "ts")
    return drained(stateful.idempotent(r, late="1 day")).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_history", "SELECT user_id::VARCHAR AS k, count(*) AS seen, max(ts) AS last_at FROM events_ GROUP BY 1")
def stream_history(spark, sf_dir):
    """Counters per key, merged into a snapshot by each micro-batch."""
    path, schema = sinks.shared_path(spark, "streams"), "k string, seen long, last_at timestamp"

    def merge(batch: DataFrame, number: int) -> None:
        # a batch that is run again starts from the state before it
        old = sinks.read_snapshot(batch.sparkSession, f"{path}/snapshot", schema, before=number + 1)
        both = old.unionByName(batch.groupBy("k").agg(F.count(F.lit(1)).alias("seen"), F.max("ts").alias("last_at")))
        sinks.write_snapshot(both.groupBy("k").agg(F.sum("seen").alias("seen"), F.max("last_at").alias("last_at")), f"{path}/snapshot", version=number + 1)

    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), "ts")
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sinks.read_snapshot(spark, f"{path}/snapshot", schema).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
