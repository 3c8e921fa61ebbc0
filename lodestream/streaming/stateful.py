"""Keyed state as Structured Streaming: alerts with cooldown, notification de-duplication, heartbeats, rate limits, and windowed monitors.

Each has a batch twin: the same function over a DataFrame, or the operator in operators/.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.deals import AlertPolicy

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Rows of one key that are Python objects at a time.
CHUNK = 20_000


def rows_in_order(batches: Iterator[pd.DataFrame], keys: tuple[str, ...], *by: str) -> Iterator:
    """A key's rows of one micro-batch in order, without the key. A key may have most of the table, so its rows are kept as plain columns, sorted by position, and become objects a chunk at a time."""
    have = pd.concat([b.drop(columns=list(keys)) for b in batches], ignore_index=True)
    order = np.lexsort([have[c].to_numpy() for c in reversed(by)])
    for i in range(0, len(order), CHUNK):
        yield from have.iloc[order[i : i + CHUNK]].itertuples(index=False)


def timed(rows: DataFrame, late: str) -> DataFrame:
    """rows with a watermark on ts and at_s, its seconds since 1970, whatever the session's time zone is."""
    return rows.withWatermark("ts", late).withColumn("at_s", F.unix_micros("ts") / 1e6)


class Timed(StatefulProcessor):
    """State of a key that is dropped once it no longer matters: at the event time that `wake` was last called with. Results leave in frames of at most a chunk of rows."""

    columns: tuple[str, ...] = ()

    def wake(self, at: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(at * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


class DealAlerts(Timed):
    """Per deal key: last alerted price, status and time. Emits each row with should_alert and a reason. A deal unseen for `forget` seconds is new again."""

    columns = ("deal_key", "ts", "pos", "price", "should_alert", "reason")

    def __init__(self, policy: AlertPolicy, forget: float):
        self.policy, self.forget = policy, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("deal", "price double, status string, alerted double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        have, out = self.state.get() if self.state.exists() else None, []
        for r in rows_in_order(rows, ("deal_key",), "at_s", "pos"):
            now = r.at_s
            reason = "new_item"
            if have:
                # a price or status that isn't known is no change
                delta = abs(r.price - have[0]) if pd.notna(r.price) and have[0] is not None else 0.0
                moved = delta >= self.policy.change_abs or bool(have[0] and have[0] > 0 and delta / have[0] * 100 >= self.policy.change_pct)
                changed = r.status is not None and have[1] is not None and r.status != have[1]
                reason = "material_price_change" if moved else "status_changed" if changed else "cooldown_expired" if now >= have[2] + self.policy.cooldown_seconds else ""
            if reason:
                have = (float(r.price) if pd.notna(r.price) else None, r.status, now)
            out.append((key[0], r.ts, r.pos, r.price, bool(reason), reason or "in_cooldown"))
            if len(out) == CHUNK:
                yield self.frame(out)
                out = []
        self.state.update(have)
        self.wake(now + self.forget)
        yield self.frame(out)


def deal_alerts(deals: DataFrame, policy: AlertPolicy, *, forget_days: float = 180.0, late: str = "10 minutes") -> DataFrame:
    """deals(deal_key, ts, pos, price, status) as a stream."""
    return timed(deals, late).groupBy("deal_key").transformWithStateInPandas(DealAlerts(policy, forget_days * 86400), "deal_key string, ts timestamp, pos long, price double, should_alert boolean, reason string", "Append", "EventTime")


class NotifyOnce(Timed):
    """Per channel and key: sent, then suppressed until ttl seconds after the sending; suppressed rows don't prolong it."""

    columns = ("channel", "dedupe_key", "id", "ts", "sent")

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("sent", "until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, out = self.state.get()[0] if self.state.exists() else float("-inf"), []
        for r in rows_in_order(rows, ("channel", "dedupe_key"), "at_s", "id"):
            send = r.at_s >= until
            until = r.at_s + self.ttl if send else until
            out.append((key[0], key[1], r.id, r.ts, send))
            if len(out) == CHUNK:
                yield self.frame(out)
                out = []
        self.state.update((until,))
        self.wake(until)
        yield self.frame(out)


def notify_once(messages: DataFrame, ttl: float, *, late: str = "10 minutes") -> DataFrame:
    """messages(channel, dedupe_key, id, ts) as a stream."""
    return timed(messages, late).groupBy("channel", "dedupe_key").transformWithStateInPandas(NotifyOnce(ttl), "channel string, dedupe_key string, id long, ts timestamp, sent boolean", "Append", "EventTime")


class Heartbeats(Timed):
    """Per agent: stale once no beat came for stale_after seconds, which a timer tells even if none comes again; while it stays silent, a warning each cooldown and never more often. A warning says when to try a restart: backoff, doubled by each further one, up to a limit, and reset by the next beat, which is a recovery.

    An agent that has been silent for `forget` seconds is dropped. Results are the same however rows fall into micro-batches.
    """

    columns = ("agent", "at", "event", "retry_after")

    def __init__(self, stale_after: float, cooldown: float, forget: float, backoff: float = 60.0, most: float = 3600.0):
        self.stale_after, self.cooldown, self.forget, self.backoff, self.most = stale_after, cooldown, forget, backoff, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("beat", "last double, warned double, wait double, due double")

    def warn(self, key: str, until: float, warned: float, wait: float, due: float, out: list) -> tuple[float, float, float]:
        while due <= until:
            out.append((key, due, "stale", wait))
            warned, wait, due = due, min(wait * 2, self.most), due + self.cooldown
        return warned, wait, due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, warned, wait, due = self.state.get() if self.state.exists() else (None, float("-inf"), self.backoff, 0.0)
        out = []
        for r in rows_in_order(rows, ("agent",), "at_s", "id"):
            now = r.at_s
            if last is not None and now - last > self.stale_after:
                warned, wait, due = self.warn(key[0], min(now, last + self.forget), warned, wait, due, out)
                out.append((key[0], now, "recovered", None))
            last, wait, due = now, self.backoff, max(now + self.stale_after, warned + self.cooldown)
            if len(out) >= CHUNK:
                yield self.frame(out)
                out = []
        self.state.update((last, warned, wait, due))
        self.wake(min(due, last + self.forget))
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, warned, wait, due = self.state.get()
        out, now = [], timerValues.getCurrentWatermarkInMs() / 1000
        warned, wait, due = self.warn(key[0], min(now, last + self.forget), warned, wait, due, out)
        if now >= last + self.forget:
            self.state.clear()
        else:
            self.state.update((last, warned, wait, due))
            self.wake(min(due, last + self.forget))
        yield self.frame(out)


def heartbeat_changes(beats: DataFrame, stale_after: float, cooldown: float, *, forget_days: float = 90.0, late: str = "10 minutes") -> DataFrame:
    """beats(agent, id, ts) as a stream -> agent, ts (when a beat was due, or came), event (stale or recovered), retry_after."""
    out = timed(beats, late).groupBy("agent").transformWithStateInPandas(Heartbeats(stale_after, cooldown, forget_days * 86400), "agent string, at double, event string, retry_after double", "Append", "EventTime")
    return out.select("agent", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")).alias("ts"), "event", "retry_after")


class TokenBucket(Timed):
    """Per identity: capacity tokens, refilled at rate per second; a row takes one or is refused. A bucket that must be full again is dropped."""

    columns = ("identity", "id", "ts", "allowed")

    def __init__(self, capacity: float, rate: float):
        self.capacity, self.rate = capacity, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("bucket", "tokens double, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, at = self.state.get() if self.state.exists() else (self.capacity, None)
        out = []
        for r in rows_in_order(rows, ("identity",), "at_s", "id"):
            now = r.at_s
            tokens = min(self.capacity, tokens + (now - at if at is not None else 0) * self.rate)
            at, ok = now, tokens >= 1
            tokens -= ok
            out.append((key[0], r.id, r.ts, bool(ok)))
            if len(out) == CHUNK:
                yield self.frame(out)
                out = []
        self.state.update((tokens, at))
        self.wake(at + self.capacity / self.rate)
        yield self.frame(out)


def rate_limit(calls: DataFrame, capacity: float = 120.0, rate: float = 2.0, *, late: str = "10 minutes") -> DataFrame:
    """calls(identity, id, ts) as a stream."""
    return timed(calls, late).groupBy("identity").transformWithStateInPandas(TokenBucket(capacity, rate), "identity string, id long, ts timestamp, allowed boolean", "Append", "EventTime")


def windowed_monitor(events: DataFrame, *, look_back: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes", limit: float = 0.3) -> DataFrame:
    """Counts, error rate and spend in sliding windows, flagged over a limit; works on streams and tables. events(ts, level, value)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", look_back, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("spend"))
    rate = F.col("errors") / F.col("n")
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors", "spend", (rate > limit).alias("alert"))


def signature_counts(signals: DataFrame, *, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Signatures per tumbling window; works on streams and tables. signals(ts, signature)."""
    return signals.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "signature").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "signature", "n")


def idempotent(rows: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """The first row of each (task_type, idempotency_key) within the watermark; works on streams and tables."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_type", "idempotency_key"])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a Parquet table, to its end, and reads the table."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
