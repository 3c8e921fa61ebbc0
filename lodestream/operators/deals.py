"""Deals: normalisation, classes and thresholds, first-seen rows, and the alert decision with its state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls


def first_seen(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key. A minimum of the row's struct, begun on the map side, instead of a window over hot keys."""
    cols = [F.col(c) for c in rows.columns]
    named = rows.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_o"), F.struct(*cols).alias("_r"))
    return named.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def first_positions(rows: DataFrame, keys: list[Column], at: Column) -> DataFrame:
    """Each key and the least position of its rows, as at. Only the keys and a number move, and a minimum of numbers is kept in hash tables, where that of a row's struct sorts all rows."""
    return rows.groupBy(*keys).agg(F.min(at).alias("at"))


def natural_key() -> list[Column]:
    """source, url and title, the way rows of one listing or deal are found equal."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return [F.lower(clean("source")), clean("url"), F.lower(clean("title"))]


def is_target(c: Column) -> Column:
    """Whether a title's class is a graphics card or a whole computer of the wanted model."""
    return ~c["laptop"] & c["is_5090"] & ((c["gpu"] & ~c["peripheral"]) | (c["computer"] & (~c["peripheral"] | c["strong_computer"])))


def within_limits(c: Column, price: Column, *, gpu_most: float = 2000.0, pc_most: float = 4000.0) -> Column:
    return (c["gpu"] & (price <= gpu_most)) | (c["computer"] & (price <= pc_most))


def with_classes(deals: DataFrame) -> DataFrame:
    c = text.title_class(F.col("title"))
    return deals.withColumns({"c": c}).withColumns({
        "is_target": is_target(F.col("c")),
        "discount": text.discount_pct(F.col("price"), F.col("old_price")),
    })


def target_items(deals: DataFrame) -> DataFrame:
    """Graphics cards and whole computers of the wanted model; laptops and accessories go."""
    return with_classes(deals).filter("is_target")


def under_threshold(deals: DataFrame, *, gpu_most: float = 2000.0, pc_most: float = 4000.0) -> DataFrame:
    """Target classes at or below their price limit, cheapest first where the caller orders by price then title."""
    return with_classes(deals).filter(F.expr("not c.laptop and c.is_5090") & within_limits(F.col("c"), F.col("price"), gpu_most=gpu_most, pc_most=pc_most))


def cheapest(deals: DataFrame, n: int) -> DataFrame:
    """The first n by price, then title; rows without a price last."""
    return deals.orderBy(F.asc_nulls_last("price"), "title", "pos").limit(n)


# What a deal's size in dollars, its debt ratio and its customers' churn add to the risk.
RISK_PER_10M, RISK_OF_DEBT, RISK_OF_CHURN = 0.2, 0.5, 0.3


def risk_score(size: Column, debt_ratio: Column, churn: Column) -> Column:
    """0 to 1; what isn't known adds nothing."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return F.round(F.least(z(size) / 1e7 * RISK_PER_10M + z(debt_ratio) * RISK_OF_DEBT + z(churn) * RISK_OF_CHURN, F.lit(1.0)), 4)


def top_risk(deals: DataFrame, n: int = 5) -> DataFrame:
    """The n riskiest of deals(pos, size_usd, debt_ratio, churn); ties go to the first."""
    return deals.withColumn("risk", risk_score(F.col("size_usd"), F.col("debt_ratio"), F.col("churn"))).orderBy(F.desc("risk"), "pos").limit(n)


@dataclass(frozen=True)
class AlertPolicy:
    cooldown_seconds: int = 21_600
    change_pct: float = 3.0
    change_abs: float = 25.0


def material_change(old: Column, new: Column, policy: AlertPolicy) -> Column:
    delta = F.abs(new - old)
    return F.coalesce((delta >= policy.change_abs) | ((old > 0) & (delta / old * 100.0 >= policy.change_pct)), F.lit(False))


def alert_decisions(deals: DataFrame, state: DataFrame, *, now: Column, policy: AlertPolicy) -> DataFrame:
    """deals(deal_key, pos, price, status) against state(deal_key, last_price, last_status, last_alerted_at, cooldown_until, alert_count).

    One decision per deal row: should_alert, reasons, and the state that follows. The second and later rows of a key in a batch
    are suppressed. While suppressed, the state keeps the price of the last alert, so slow drifts are measured from there.
    """
    rows = deals.withColumn("nth", F.row_number().over(Window.partitionBy("deal_key").orderBy("pos")))
    j = rows.join(state.withColumn("known", F.lit(True)), "deal_key", "left")
    new, again = F.col("known").isNull(), F.col("nth") > 1
    material = material_change(F.col("last_price"), F.col("price"), policy)
    changed = F.coalesce((F.col("last_status") != F.col("status")), F.lit(False))
    until = F.coalesce("cooldown_until", F.col("last_alerted_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(policy.cooldown_seconds)))
    expired = F.col("last_alerted_at").isNull() | until.isNull() | (now >= until)
    alert = ~again & (material | changed | expired)
    reasons = F.when(again, F.array(F.lit("duplicate_in_batch"))).otherwise(F.array_compact(F.array(F.when(new, "new_item"), F.when(material, "material_price_change"), F.when(changed, "status_changed"), F.when(expired & ~new, "cooldown_expired"), F.when(~alert, "in_cooldown"))))
    return j.select(
        "deal_key", "pos", "price", "status", alert.alias("should_alert"), F.array_join(reasons, ",").alias("reasons"),
        F.when(alert, F.col("price")).otherwise(F.col("last_price")).alias("next_price"), F.when(alert, F.col("status")).otherwise(F.col("last_status")).alias("next_status"),
        F.when(alert, now).otherwise(F.col("last_alerted_at")).alias("next_alerted_at"), (F.coalesce("alert_count", F.lit(0)) + alert.cast("int")).alias("next_count"), again.alias("repeated"),
    )


def next_state(state: DataFrame, decisions: DataFrame, *, policy: AlertPolicy) -> DataFrame:
    """The snapshot after a batch: decided keys replaced, the others as they were. Where the state has created_at, a key keeps its own, and a new one gets the time of its first alert."""
    kept = ["created_at"] if "created_at" in state.columns else []
    d = decisions.filter("not repeated")
    if kept:
        d = d.join(state.select("deal_key", "created_at"), "deal_key", "left").withColumn("created_at", F.coalesce("created_at", "next_alerted_at"))
    d = d.select("deal_key", *kept, F.col("next_price").alias("last_price"), F.col("next_status").alias("last_status"), F.col("next_alerted_at").alias("last_alerted_at"), (F.col("next_alerted_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(policy.cooldown_seconds))).alias("cooldown_until"), F.col("next_count").alias("alert_count"))
    return state.join(d.select("deal_key"), "deal_key", "left_anti").select(d.columns).unionByName(d)


def pipeline(deals: DataFrame, state: DataFrame, *, now: Column, policy: AlertPolicy) -> DataFrame:
    """Normalised deals to alert decisions: target classes, first-seen rows, price limits, then the alert policy.

    A class is of the title in lower case, which is part of a row's key: all rows of a key are targets or none, so the others go before first-seen rows are sought. Prices differ inside a key: their limits come after.
    """
    c = F.struct(*[F.col("c")[k].alias(k) for k in ("gpu", "computer")]).alias("c")
    targets = deals.withColumn("c", text.title_class(text.squeeze(F.col("title")))).filter(is_target(F.col("c")))
    rows = first_seen(targets.select("pos", "source", "sku", "url", "title", "price", "in_stock", c), natural_key(), [F.col("pos")])
    good = rows.filter(within_limits(F.col("c"), F.col("price"))).withColumn("title", text.squeeze(F.col("title")))
    keyed = good.select(urls.deal_key(F.col("source"), F.col("sku"), F.col("url"), F.col("title")).alias("deal_key"), "pos", "price", text.stock_key(F.col("in_stock")).alias("status"))
    return alert_decisions(keyed, state, now=now, policy=policy)
