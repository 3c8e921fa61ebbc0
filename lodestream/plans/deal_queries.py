"""Queries over deals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import deals as ops
from ..operators.deals import AlertPolicy
from ..sources import html
from . import inputs

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "1999-01-01 00:00:00"
POLICY = AlertPolicy()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = inputs.with_views(sql)
        return f

    return add


CLASSES = r"""(SELECT *, regexp_matches(low, '\b(laptop|notebook)\b') AS laptop, regexp_matches(low, '\b(desktop|gaming pc|pc|prebuilt|workstation|tower|gaming computer)\b') AS computer, regexp_matches(low, '\b(desktop|gaming pc|prebuilt|workstation|tower|gaming computer)\b') AS strong, regexp_matches(low, '\b(rtx|geforce)\s*5090\b') AS wanted,
 regexp_matches(low, '\b(rtx\s*\d{4}|radeon\s*(rx\s*)?\d{4}|graphics card|video card|gpu)\b') AS gpu_words, low = '' OR regexp_matches(low, 'mouse|keyboard|headset|earbuds|speaker|monitor|webcam|dock|ssd|hdd|nvme|ram|ddr4|ddr5|psu|power supply|motherboard|mobo|case|chassis|cooler|heatsink|thermal paste|thermal pad|fan|cable|adapter|riser|water block|backplate|mount|bracket|hub|controller') AS peripheral
FROM (SELECT *, lower(trim(title)) AS low FROM deals))"""
GPU = "(gpu_words AND NOT laptop AND NOT computer)"


@query("title_classes", f"SELECT order_key, line, {GPU} AS gpu, computer, wanted AS is_5090, laptop, peripheral FROM {CLASSES}")
def title_classes(spark, sf_dir):
    return inputs.deals(spark, sf_dir).withColumn("c", text.title_class(F.col("title"))).select("order_key", "line", "c.gpu", "c.computer", "c.is_5090", "c.laptop", "c.peripheral")


@query("target_items", f"SELECT order_key, line, title FROM {CLASSES} WHERE NOT laptop AND wanted AND (({GPU} AND NOT peripheral) OR (computer AND (NOT peripheral OR strong)))")
def target_items(spark, sf_dir):
    return ops.target_items(inputs.deals(spark, sf_dir)).select("order_key", "line", "title")


@query("price_thresholds", f"SELECT order_key, line, title, round(price, 2) AS price FROM {CLASSES} WHERE NOT laptop AND wanted AND (({GPU} AND price <= 2000) OR (computer AND price <= 4000))")
def price_thresholds(spark, sf_dir):
    return ops.under_threshold(inputs.deals(spark, sf_dir)).select("order_key", "line", "title", F.round("price", 2).alias("price"))


@query("discounts", "SELECT order_key, line, CASE WHEN old_price > 0 AND price >= 0 THEN round((old_price - price) / old_price * 100.0, 1) + 0.0 END AS discount, CASE WHEN in_stock THEN 'in_stock' WHEN NOT in_stock THEN 'out_of_stock' ELSE 'unknown' END AS stock FROM deals")
def discounts(spark, sf_dir):
    return inputs.deals(spark, sf_dir).select("order_key", "line", F.round((F.col("old_price") - F.col("price")) / F.col("old_price") * 100.0, 1).alias("discount"), text.stock_key(F.col("in_stock")).alias("stock"))


KEY = "CASE WHEN sku IS NOT NULL THEN s || '|sku|' || lower(sku) WHEN url IS NOT NULL THEN s || '|url|' || 'https://shop.example.com/p/' || regexp_extract(url, '/p/([0-9]+)', 1) || '?v=1' ELSE s || '|title|' || lower(trim(title)) END"
KEYED = f"(SELECT *, {KEY} AS deal_key FROM (SELECT *, lower(trim(source)) AS s FROM deals))"


@query("deal_keys", f"SELECT order_key, line, deal_key FROM {KEYED}")
def deal_keys(spark, sf_dir):
    c = F.col
    return inputs.deals(spark, sf_dir).select("order_key", "line", urls.deal_key(c("source"), c("sku"), c("url"), c("title")).alias("deal_key"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.deals(spark, sf_dir).withColumn("pos", F.col("order_key") * 10 + F.col("line"))


@query("first_seen_deals", "SELECT order_key, line, s AS source, u AS url, t AS title FROM (SELECT *, row_number() OVER (PARTITION BY s, u, t ORDER BY order_key, line) AS n FROM (SELECT *, lower(trim(source)) AS s, coalesce(trim(url), '') AS u, lower(trim(title)) AS t FROM deals)) WHERE n = 1")
def first_seen_deals(spark, sf_dir):
    c = F.col
    keys = [F.lower(F.trim("source")).alias("source"), F.coalesce(F.trim("url"), F.lit("")).alias("url"), F.lower(F.trim("title")).alias("title")]
    # a row's order and line as one number; lines are below 65,536
    rows = ops.first_positions(inputs.deals(spark, sf_dir), keys, F.shiftleft(c("order_key").cast("long"), 16) + c("line"))
    return rows.select(F.shiftright("at", 16).alias("order_key"), c("at").bitwiseAND(65535).cast("int").alias("line"), "source", "url", "title")


def state_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    d = numbered(spark, sf_dir).select(urls.deal_key(c("source"), c("sku"), c("url"), c("title")).alias("deal_key"), "pos", F.round("price", 2).alias("price"), "in_stock", "shipped")
    # numbers, flags and dates one by one stay in hash tables; a struct of them, or the status as text, would sort all rows
    state = d.filter("shipped < '1998-01-01'").groupBy("deal_key").agg(*[F.max_by(v, "pos").alias(v) for v in ("price", "in_stock", "shipped")], F.count(F.lit(1)).cast("int").alias("alert_count"))
    at, status = c("shipped").cast("timestamp"), text.stock_key(c("in_stock"))
    batch = d.filter("shipped >= '1998-01-01'").select("deal_key", "pos", "price", status.alias("status"))
    return state.select("deal_key", c("price").alias("last_price"), status.alias("last_status"), at.alias("last_alerted_at"), (at + F.expr("interval 400 days")).alias("cooldown_until"), "alert_count"), batch


@query("alert_decisions", f"""WITH d AS (SELECT deal_key, order_key * 10 + line AS pos, round(price, 2) AS price, CASE WHEN in_stock THEN 'in_stock' WHEN NOT in_stock THEN 'out_of_stock' ELSE 'unknown' END AS status, shipped FROM {KEYED}),
st AS (SELECT deal_key, arg_max(price, pos) AS lp, arg_max(status, pos) AS ls, arg_max(shipped, pos)::TIMESTAMP AS la, count(*) AS ac FROM d WHERE shipped < '1998-01-01' GROUP BY 1),
j AS (SELECT b.deal_key, pos, price, status, lp, ls, la, ac, row_number() OVER (PARTITION BY b.deal_key ORDER BY pos) > 1 AS again, st.deal_key IS NULL AS fresh FROM d b LEFT JOIN st USING (deal_key) WHERE shipped >= '1998-01-01'),
k AS (SELECT *, coalesce(abs(price - lp) >= 25 OR (lp > 0 AND abs(price - lp) / lp * 100 >= 3), false) AS moved, coalesce(ls <> status, false) AS changed, fresh OR TIMESTAMP '{NOW}' >= la + INTERVAL 400 DAY AS expired FROM j)
SELECT deal_key, pos, price, NOT again AND (moved OR changed OR expired) AS should_alert, CASE WHEN again THEN 'duplicate_in_batch' ELSE concat_ws(',', CASE WHEN fresh THEN 'new_item' END, CASE WHEN moved THEN 'material_price_change' END, CASE WHEN changed THEN 'status_changed' END, CASE WHEN expired AND NOT fresh THEN 'cooldown_expired' END, CASE WHEN NOT (moved OR changed OR expired) THEN 'in_cooldown' END) END AS reasons,
 (coalesce(ac, 0) + CASE WHEN NOT again AND (moved OR changed OR expired) THEN 1 ELSE 0 END)::INTEGER AS next_count FROM k""")
def alert_decisions(spark, sf_dir):
    state, batch = state_and_batch(spark, sf_dir)
    return ops.alert_decisions(batch, state, now=F.lit(NOW).cast("timestamp"), policy=POLICY).select("deal_key", "pos", "price", "should_alert", "reasons", "next_count")


DECIDED = SQL["alert_decisions"].split("SELECT deal_key, pos, price, NOT again")[0]


@query("alert_state")
def alert_state(spark, sf_dir):
    state, batch = state_and_batch(spark, sf_dir)
    after = ops.next_state(state, ops.alert_decisions(batch, state, now=F.lit(NOW).cast("timestamp"), policy=POLICY), policy=POLICY)
    return after.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_alerted_at", "cooldown_until")})


SQL["alert_state"] = DECIDED + f"""SELECT deal_key, CASE WHEN a THEN price ELSE lp END AS last_price, CASE WHEN a THEN status ELSE ls END AS last_status, CASE WHEN a THEN TIMESTAMP '{NOW}' ELSE la END AS last_alerted_at, CASE WHEN a THEN TIMESTAMP '{NOW}' ELSE la END + INTERVAL 6 HOUR AS cooldown_until, (coalesce(ac, 0) + a::INT)::INTEGER AS alert_count
 FROM (SELECT *, moved OR changed OR expired AS a FROM k WHERE NOT again) UNION ALL SELECT deal_key, lp, ls, la, la + INTERVAL 400 DAY, ac::INTEGER FROM st WHERE deal_key NOT IN (SELECT deal_key FROM k)"""


@query("deal_pipeline", f"""WITH st AS (SELECT deal_key, arg_max(price, pos) AS lp, arg_max(status, pos) AS ls, arg_max(shipped, pos)::TIMESTAMP AS la FROM (SELECT deal_key, order_key * 10 + line AS pos, round(price, 2) AS price, CASE WHEN in_stock THEN 'in_stock' WHEN NOT in_stock THEN 'out_of_stock' ELSE 'unknown' END AS status, shipped FROM {KEYED}) WHERE shipped < '1998-01-01' GROUP BY 1),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(source)), coalesce(trim(url), ''), lower(trim(title)) ORDER BY order_key, line) AS nth FROM {CLASSES}) WHERE nth = 1),
g AS (SELECT *, regexp_replace(trim(title), '\\s+', ' ', 'g') AS tq FROM u WHERE NOT laptop AND wanted AND (({GPU} AND price <= 2000 AND NOT peripheral) OR (computer AND price <= 4000 AND (NOT peripheral OR strong)))),
b AS (SELECT {KEY.replace("lower(trim(title))", "lower(tq)")} AS deal_key, order_key * 10 + line AS pos, price, CASE WHEN in_stock THEN 'in_stock' WHEN NOT in_stock THEN 'out_of_stock' ELSE 'unknown' END AS status FROM (SELECT *, lower(trim(source)) AS s FROM g)),
j AS (SELECT b.*, lp, ls, row_number() OVER (PARTITION BY b.deal_key ORDER BY pos) > 1 AS again, st.deal_key IS NULL AS fresh, st.deal_key IS NULL OR TIMESTAMP '{NOW}' >= la + INTERVAL 400 DAY AS expired FROM b LEFT JOIN st USING (deal_key)),
k AS (SELECT *, coalesce(abs(price - lp) >= 25 OR (lp > 0 AND abs(price - lp) / lp * 100 >= 3), false) AS moved, coalesce(ls <> status, false) AS changed FROM j)
SELECT deal_key, pos, round(price, 2) AS price, NOT again AND (moved OR changed OR expired) AS should_alert, CASE WHEN again THEN 'duplicate_in_batch' ELSE concat_ws(',', CASE WHEN fresh THEN 'new_item' END, CASE WHEN moved THEN 'material_price_change' END, CASE WHEN changed THEN 'status_changed' END, CASE WHEN expired AND NOT fresh THEN 'cooldown_expired' END, CASE WHEN NOT (moved OR changed OR expired) THEN 'in_cooldown' END) END AS reasons FROM k""")
def deal_pipeline(spark, sf_dir):
    state, _ = state_and_batch(spark, sf_dir)
    return ops.pipeline(numbered(spark, sf_dir), state, now=F.lit(NOW).cast("timestamp"), policy=POLICY).select("deal_key", "pos", F.round("price", 2).alias("price"), "should_alert", "reasons")


@query("top_risk", "SELECT order_key * 10 + line AS pos, round(least(coalesce(price * 1000, 0) / 1e7 * 0.2 + supplier % 7 / 10.0 * 0.5 + coalesce(CASE WHEN line > 1 THEN line % 5 / 5.0 END, 0) * 0.3, 1.0), 4) AS risk FROM deals ORDER BY risk DESC, pos LIMIT 5")
def top_risk(spark, sf_dir):
    d = numbered(spark, sf_dir).select("pos", (F.col("price") * 1000).alias("size_usd"), (F.col("supplier") % 7 / 10.0).alias("debt_ratio"), F.when(F.col("line") > 1, F.col("line") % 5 / 5.0).alias("churn"))
    return ops.top_risk(d).select("pos", "risk")


@query("cheapest_targets", f"SELECT order_key * 10 + line AS pos, title, price FROM (SELECT order_key, line, title, round(price, 2) AS price FROM {CLASSES} WHERE NOT laptop AND wanted AND (({GPU} AND price <= 2000) OR (computer AND price <= 4000))) ORDER BY price, title, pos LIMIT 20")
def cheapest_targets(spark, sf_dir):
    good = ops.under_threshold(numbered(spark, sf_dir)).select("pos", "title", F.round("price", 2).alias("price"))
    return ops.cheapest(good, 20)


@query("reason_counts", f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM ({'__ALERTS__'})) GROUP BY reason")
def reason_counts(spark, sf_dir):
    return alert_decisions(spark, sf_dir).select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


SQL["reason_counts"] = SQL["reason_counts"].replace("__ALERTS__", SQL["alert_decisions"])


@query("price_snippets", r"SELECT order_key, line, [round(a, 2), round(b, 2)] = list_transform(regexp_extract_all(s, '\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?)', 1), lambda p: replace(p, ',', '')::DOUBLE) AS found_both, coalesce(list_max(list_filter([a, b], lambda x: x <= 10000)), list_max(list_filter([a, b], lambda x: x >= 50))) AS plausible FROM (SELECT order_key, line, floor(price * 100) / 100 AS a, floor(old_price * 100) / 100 AS b, format('was ${:.2f} now $ {:.2f}', floor(price * 100) / 100, floor(old_price * 100) / 100) AS s FROM deals)")
def price_snippets(spark, sf_dir):
    cents = lambda c: F.floor(F.col(c) * 100) / 100
    d = inputs.deals(spark, sf_dir).select("order_key", "line", cents("price").alias("a"), cents("old_price").alias("b"))
    d = d.withColumn("s", F.format_string("was $%.2f now $ %.2f", "a", "b"))
    prices = text.price_values(F.col("s"))
    return d.select("order_key", "line", (F.array(F.round("a", 2), F.round("b", 2)) == prices).alias("found_both"), text.plausible_price(prices, F.lit("")).alias("plausible"))


OFFERS = """SELECT order_key, line, title, CASE WHEN line % 3 = 0 THEN NULL ELSE CAST(10000 + supplier AS VARCHAR(9)) END AS sku, CASE line % 5 WHEN 0 THEN 'was $1,299.99 and now only $999.50' WHEN 1 THEN 'from $50 up to $70.25, before: $80.00' WHEN 2 THEN 'no price' WHEN 3 THEN 'list $10.00, price: $20' ELSE '<b itemprop="price"> <i>$5.50</i></b> data-price="6.75"' END AS snippet,
 '{{"price": {{"currentPrice": 1, "customerPrice": ' || CAST(100 + line AS VARCHAR(9)) || '.5, "displayableRegularPrice": ' || CAST(90 + 20 * line AS VARCHAR(9)) || ', "skuId": "' || CAST(10000 + supplier AS VARCHAR(9)) || '"}}}} <b>' || CASE line % 4 WHEN 0 THEN '' WHEN 1 THEN replace(title, '"', '\\"') ELSE title END || '</b> {{"price": {{"customerPrice": 77, "displayableRegularPrice": 99.5, "skuId": "99999"}}}}' || CASE WHEN order_key % 2 = 0 THEN ' {{"price":{{"customerPrice":' || CAST(200 + line AS VARCHAR(9)) || ',"displayableRegularPrice":150,"skuId":"' || CAST(10000 + supplier AS VARCHAR(9)) || '"}}}}' ELSE '' END AS html
 FROM (SELECT order_key, line, supplier, CASE WHEN order_key % 3 = 0 THEN title || ' 12"' ELSE title END AS title FROM {deals})"""
_VALUES = "list_transform(regexp_extract_all(snippet, '\\$\\s*([0-9][0-9,]*(?:\\.[0-9]{2})?)', 1), lambda p: replace(p, ',', '')::DOUBLE)"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pair(shop: str, name: str) -> str:
    rules = html.SHOPS[shop]
    number = lambda p: f"try_cast(replace(nullif(regexp_extract(snippet, {_q(p)}, 1), ''), ',', '') AS DOUBLE)"
    otherwise = "list_min(v)" if rules["else"] == "least" else "coalesce(list_max(list_filter(v, lambda p: p <= 10000)), list_max(list_filter(v, lambda p: p >= 50)))"
    return f"coalesce({', '.join(map(number, rules['now']))}, {otherwise}) AS {name}, {number(rules['before'])} AS {name}_b"


_OLD = lambda n: f"CASE WHEN {n} IS NULL OR coalesce({n}_b, CASE WHEN len(v) >= 2 AND list_max(v) > {n} THEN list_max(v) END) > {n} THEN coalesce({n}_b, CASE WHEN len(v) >= 2 AND list_max(v) > {n} THEN list_max(v) END) END"
_MAPPED = lambda kind: f"list_filter(list_zip(regexp_extract_all(html, {_q(html.SKU_PRICE[kind])}, 2), regexp_extract_all(html, {_q(html.SKU_PRICE[kind])}, 1)), lambda x: x[1] = sku)[-1][2]::DOUBLE"


@query("offer_prices", f"""WITH o AS (SELECT *, {_VALUES} AS v, strpos(html, title) AS plain_at, strpos(html, replace(title, '"', '\\"')) AS quoted_at FROM (__OFFERS__)), p AS (SELECT *, {", ".join(_pair(s, s) for s in html.SHOPS)} FROM o),
 f AS (SELECT *, {", ".join(f"{_OLD(s)} AS {s}_old" for s in html.SHOPS)}, coalesce(nullif(plain_at, 0), quoted_at) AS spot FROM p), m AS (SELECT *, coalesce({_MAPPED('customer')}, bestbuy) AS price1, {_MAPPED('regular')} AS regular, substr(html, greatest(spot - 3500, 1), spot + 9000 - greatest(spot - 3500, 1)) AS near FROM f),
 h AS (SELECT *, CASE WHEN regular > price1 THEN regular ELSE bestbuy_old END AS old1, CASE WHEN spot > 0 THEN list_min(list_transform(regexp_extract_all(near, {_q(html.NEAR_PRICE['customer'])}, 1), lambda x: x::DOUBLE)) END AS hint, CASE WHEN spot > 0 THEN list_transform(regexp_extract_all(near, {_q(html.NEAR_PRICE['regular'])}, 1), lambda x: x::DOUBLE) END AS regulars FROM m),
 g AS (SELECT *, list_min(list_filter(regulars, lambda x: hint IS NULL OR x >= hint)) AS hint_old FROM h)
 SELECT order_key, line, coalesce(price1, hint) AS price, CASE WHEN price1 IS NOT NULL THEN old1 WHEN hint_old > hint THEN hint_old ELSE old1 END AS old_price, newegg AS newegg_price, newegg_old, microcenter AS microcenter_price, microcenter_old FROM g""".replace("__OFFERS__", OFFERS.format(deals="deals")))
def offer_prices(spark, sf_dir):
    c = F.col
    rows = spark.sql(OFFERS, deals=inputs.deals(spark, sf_dir))
    out = rows.select("order_key", "line", html.offer_prices(c("html"), c("snippet"), c("title"), c("sku"), "bestbuy").alias("p"), *[html.price_pair(c("snippet"), s).alias(s) for s in ("newegg", "microcenter")])
    return out.select("order_key", "line", "p.price", "p.old_price", c("newegg.price").alias("newegg_price"), c("newegg.old_price").alias("newegg_old"), c("microcenter.price").alias("microcenter_price"), c("microcenter.old_price").alias("microcenter_old"))
