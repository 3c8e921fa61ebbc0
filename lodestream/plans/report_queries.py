"""Queries for look-ups, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import ops, reports
from ..sources import html
from . import inputs
from .page_queries import stripped

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = inputs.with_views(sql)
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("alias_jobs", "SELECT job_id AS row_id, title, company, least(a, b) AS salary_min, greatest(a, b) AS salary_max, 'USD' AS currency FROM (SELECT job_id, nullif(trim(regexp_replace(CASE WHEN job_id % 4 <> 0 THEN title END, '\\s+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(coalesce(company, source), '\\s+', ' ', 'g')), '') AS company, (n_chars % 90 * 1000)::DOUBLE AS a, (n_chars % 70 * 1000)::DOUBLE AS b FROM jobs)")
def alias_jobs(spark, sf_dir):
    j = inputs.jobs(spark, sf_dir)
    n = F.col("n_chars")
    raw = j.select(F.col("job_id").alias("row_id"), F.when(F.col("job_id") % 4 != 0, F.col("title")).alias("job_title"), F.lit(" ").alias("title"), "company", F.col("source").alias("employer"), F.concat(F.lit("$"), F.format_number(n % 90 * 1000, 0)).alias("min_salary"), F.format_number(n % 70 * 1000, 0).alias("max_salary"))
    return reports.alias_jobs(raw)


@query("alias_drops", "SELECT count(*) AS rows, count_if(job_id % 4 = 0) AS missing_title FROM jobs")
def alias_drops(spark, sf_dir):
    return reports.alias_drops(alias_jobs(spark, sf_dir))


@query("alias_deals", "SELECT order_key * 10 + line AS row_id, coalesce(nullif(trim(title), ''), 'Untitled deal') AS title, price, floor(old_price) AS old_price, CASE WHEN line % 2 = 0 THEN 12.5 ELSE floor(round((floor(old_price) - price) / floor(old_price) * 100.0, 2)) + 0.0 END AS effective_discount, CASE line % 3 WHEN 0 THEN true WHEN 1 THEN false END AS in_stock FROM deals")
def alias_deals(spark, sf_dir):
    d = inputs.deals(spark, sf_dir)
    raw = d.select((F.col("order_key") * 10 + F.col("line")).alias("row_id"), F.col("title").alias("name"), F.concat(F.lit("$"), F.format_number("price", 2)).alias("sale_price"), F.format_number(F.floor("old_price"), 0).alias("msrp"), F.when(F.col("line") % 2 == 0, "12.5%").alias("discount"), F.when(F.col("line") % 3 == 0, "In Stock").when(F.col("line") % 3 == 1, "sold out").alias("available"))
    return reports.alias_deals(raw).withColumn("effective_discount", F.when(F.col("row_id") % 2 == 0, F.col("effective_discount")).otherwise(F.floor("effective_discount").cast("double")))


@query("sku_extract", "SELECT order_key, line, CASE WHEN sku IS NOT NULL AND line % 2 = 0 THEN sku WHEN url IS NOT NULL THEN regexp_extract(url, '/p/([0-9]+)', 1) END AS sku FROM deals")
def sku_extract(spark, sf_dir):
    d = inputs.deals(spark, sf_dir)
    snippet = F.when(F.col("line") % 2 == 0, F.concat(F.lit("Save now! SKU: "), F.col("sku")))
    return d.select("order_key", "line", reports.sku_of(snippet, F.col("url")).alias("sku"))


@query("price_hints", r"SELECT page_id, length(html) AS n, CASE WHEN page_id % 3 <> 0 THEN 5.0 END AS price FROM pages")
def price_hints(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    marked = F.concat(F.lit("<b>Card X1</b> was $ 19.00 now $5.00 "), F.repeat(F.lit("-"), 4000), F.lit("$ 1.00"), F.col("html"))
    name = F.when(F.col("page_id") % 3 != 0, "Card X1").otherwise("Card Z9 never there")
    return p.select("page_id", F.length("html").alias("n"), reports.price_hint(marked, name).alias("price"))


DOTTED = r"replace(trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\s+', ' ', 'g')), ' ', ' · ')"


@query("card_tokens", f"SELECT page_id, len(list_distinct(list_filter(list_transform(string_split_regex({stripped(DOTTED)}, '[·•]'), lambda t: trim(t)), lambda t: t <> ''))) AS n FROM pages")
def card_tokens(spark, sf_dir):
    h1 = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(html.card_tokens(F.regexp_replace(text.squeeze(h1), " ", " · "))).cast("long").alias("n"))


@query("best_urls", "SELECT job_id, CASE WHEN job_id % 4 = 0 THEN trim(url) WHEN job_id % 4 = 1 THEN 'https://board.example.com/viewjob/' || job_id WHEN url IS NOT NULL THEN 'https://board.example.com/viewjob/' || job_id ELSE 'https://board.example.com/viewjob/' || job_id END AS url FROM jobs")
def best_urls(spark, sf_dir):
    return inputs.jobs(spark, sf_dir).select("job_id", urls.best_url(F.col("url"), F.concat(F.lit("https://board.example.com/viewjob/"), F.col("job_id").cast("string"))).alias("url"))


@query("point_lookup", "SELECT event_id, ts, level FROM events_ WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")
def point_lookup(spark, sf_dir):
    return inputs.events(spark, sf_dir).filter("user_id = 7").agg(F.max_by(F.struct("event_id", "ts", "level"), F.struct("ts", "event_id")).alias("r")).filter("r is not null").select("r.*")


@query("step_totals", "SELECT l_orderkey AS run_id, count(*)::INTEGER AS n_steps, round(sum(l_quantity), 2) AS seconds, max(l_quantity)::DOUBLE AS longest FROM lineitem GROUP BY 1")
def step_totals(spark, sf_dir):
    step = F.struct(F.col("l_linenumber").alias("name"), F.col("l_quantity").cast("double").alias("seconds"))
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return reports.step_totals(runs).withColumn("seconds", F.round("seconds", 2))


@query("transient_errors", "SELECT run_id, run_id % 600 >= 500 OR run_id % 600 = 429 OR coalesce(regexp_matches(lower(error), 'timeout|timed out|temporar|connection|rate limit|unavailable|reset'), false) AS transient FROM runs")
def transient_errors(spark, sf_dir):
    return inputs.runs(spark, sf_dir).select("run_id", reports.transient(F.col("error"), F.col("run_id") % 600).alias("transient"))


@query("usage_rows", "SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 42 ELSE run_id % 100 + run_id % 7 END AS total_tokens, cost FROM runs")
def usage_rows(spark, sf_dir):
    n = F.col("run_id")
    r = inputs.runs(spark, sf_dir).select("run_id", (n % 100).alias("tokens_in"), (n % 7).alias("tokens_out"), F.when(n % 3 == 0, F.lit(42).cast("long")).alias("total_tokens"), "cost")
    return reports.usage_filled(r).select("run_id", "total_tokens", "cost")


@query("metadata_values", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events_")
def metadata_values(spark, sf_dir):
    bad = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not json "), F.col("props"))).otherwise(F.col("props"))
    return inputs.events(spark, sf_dir).select("event_id", reports.metadata_value(bad, "k").alias("k"))


METADATA = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN 'plain "words" ' || props WHEN 2 THEN '[1,"two",{{"k":3}}]' WHEN 3 THEN ' {{"a":{{"b":[' || CAST(event_id AS VARCHAR(20)) || ',null,true]}},"k":"x"}} ' WHEN 4 THEN ' ' ELSE NULL END AS m FROM {events}"""


@query("metadata_codec", "SELECT event_id, CASE WHEN trim(m) = '' THEN NULL WHEN json_valid(m) THEN json(m)::VARCHAR ELSE trim(m) END AS kept, CASE WHEN trim(m) <> '' AND json_valid(m) THEN json(m)::VARCHAR END AS strict, CASE WHEN json_valid(m) THEN json_extract_string(m, '$.k') END AS k FROM (" + METADATA.format(events="events") + ")")
def metadata_codec(spark, sf_dir):
    rows = spark.sql(METADATA, events=table(spark, sf_dir, "events")).select("event_id", reports.metadata_of(F.col("m")).alias("v"), reports.metadata_of(F.col("m"), keep_bad=False).alias("s"))
    return rows.select("event_id", reports.metadata_text(F.col("v")).alias("kept"), reports.metadata_text(F.col("s")).alias("strict"), F.try_variant_get("v", "$.k", "string").alias("k"))


@query("digest_row_texts", r"SELECT job_id, concat_ws(' at ', t, c) AS heading, array_to_string(list_filter([CASE WHEN c IS NULL THEN 'company missing' END, CASE WHEN location IS NULL THEN 'location missing' END, CASE WHEN url IS NULL THEN 'link missing' END, CASE WHEN posted_text IS NULL THEN 'date missing' END], lambda x: x IS NOT NULL), ', ') AS gaps FROM (SELECT *, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t, trim(regexp_replace(company, '\s+', ' ', 'g')) AS c FROM jobs)")
def digest_row_texts(spark, sf_dir):
    c = F.col
    return inputs.jobs(spark, sf_dir).select("job_id", reports.heading(c("title"), c("company")).alias("heading"), reports.gaps({"company": c("company"), "location": c("location"), "link": c("url"), "date": c("posted_text")}).alias("gaps"))


@query("model_tiers", "SELECT run_id, CASE WHEN 0.4 - cost <= 0 THEN 'none' WHEN task_type IN ('1-URGENT', '2-HIGH') AND 0.4 - cost > 0.25 THEN 'large' WHEN run_id % 5000 > 3000 AND 0.4 - cost > 0.1 THEN 'large' WHEN 0.4 - cost > 0.05 THEN 'small' ELSE 'tiny' END AS tier FROM runs")
def model_tiers(spark, sf_dir):
    left = F.lit("0.4").cast("decimal(12,8)") - F.col("cost")
    return inputs.runs(spark, sf_dir).select("run_id", reports.model_tier(left, F.col("run_id") % 5000, F.col("task_type")).alias("tier"))


@query("showcase", "SELECT job_id, source FROM (SELECT *, bool_and(weak) OVER (PARTITION BY source) AS every FROM (SELECT job_id, source, company IS NULL OR location IS NULL AS weak FROM jobs)) WHERE NOT weak OR every")
def showcase(spark, sf_dir):
    return reports.drop_unless_all(inputs.jobs(spark, sf_dir), F.col("company").isNull() | F.col("location").isNull(), "source").select("job_id", "source")


@query("skipped_on_purpose", "SELECT event_id FROM events_ WHERE regexp_matches(lower(m), 'notify skipped|skipped_empty_shortlist|empty shortlist|should_notify false|intentional skip')".replace("FROM events_", "FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'Notify Skipped: ' || message ELSE message END AS m FROM events_)"))
def skipped_on_purpose(spark, sf_dir):
    m = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("Notify Skipped: "), F.col("message"))).otherwise(F.col("message"))
    return inputs.events(spark, sf_dir).filter(reports.has_any(m, reports.SKIP_PHRASES)).select("event_id")


@query("split_messages", "SELECT source, CASE WHEN regexp_matches(lower(message), 'error|failed|blocked|timeout|denied|exception') THEN 'error' ELSE 'warning' END AS kind, source || ': ' || message AS message FROM events_")
def split_messages(spark, sf_dir):
    return reports.split_messages(inputs.events(spark, sf_dir).select("source", F.array("message").alias("messages")))


@query("masked_fields", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN c_name END AS shown FROM customer")
def masked_fields(spark, sf_dir):
    k = F.col("c_custkey")
    name, kind = F.when(k % 3 == 0, "API Token").otherwise("Full name"), F.when(k % 7 == 0, "password").otherwise("text")
    return table(spark, sf_dir, "customer").select(k.alias("id"), reports.masked(F.col("c_name"), name, kind).alias("shown"))


@query("question_classes", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'why|describe|tell us|explain|cover letter|in your own words') THEN 'long_form' WHEN regexp_matches(lower(text), 'salary|compensation') THEN 'salary' WHEN regexp_matches(lower(text), 'authorized|visa|sponsor') THEN 'eligibility' ELSE 'short' END AS kind FROM conversations WHERE role = 'user'")
def question_classes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", reports.question_class(F.coalesce("text", F.lit(""))).alias("kind"))


@query("task_list", "SELECT c_custkey AS task_id, coalesce(n, 0) AS attempts FROM customer LEFT JOIN (SELECT task_id, count(*) AS n FROM runs GROUP BY 1) ON task_id = c_custkey WHERE contains(lower(c_mktsegment), 'build')")
def task_list(spark, sf_dir):
    tasks = table(spark, sf_dir, "customer").filter(F.lower("c_mktsegment").contains("build")).select(F.col("c_custkey").alias("task_id"))
    n = inputs.runs(spark, sf_dir).groupBy("task_id").agg(F.count(F.lit(1)).alias("attempts"))
    return tasks.join(n, "task_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


@query("due_rows", "SELECT run_id, CASE WHEN status = 'running' THEN 'stale' ELSE 'due' END AS selection FROM runs WHERE (status = 'running' AND epoch(TIMESTAMP '1998-06-01') - epoch(started::TIMESTAMP) > 24 * 3600) OR (status <> 'running' AND started <= '1998-06-01')")
def due_rows(spark, sf_dir):
    r = inputs.runs(spark, sf_dir).select("run_id", "status", F.col("started").alias("at"))
    return reports.due(r, F.lit("1998-06-01").cast("timestamp"), stale_hours=24).select("run_id", "selection")


HIST = "(SELECT source || '|' || lang AS job_key, count(*) AS times_seen, max(TIMESTAMP '2026-03-01' + to_seconds((n_chars % 20) * 86400)) AS last_notified FROM jobs WHERE job_id % 3 = 0 GROUP BY 1)"


@query("history_flags", f"SELECT job_id, coalesce(times_seen > 0, false) AS seen_before, coalesce(greatest(ceil(7 - (epoch(TIMESTAMP '2026-03-20 12:00:00') - epoch(last_notified)) / 86400.0)::BIGINT, 0), 0) AS cooldown_left FROM (SELECT *, source || '|' || lang AS job_key FROM jobs) LEFT JOIN {HIST} USING (job_key)")
def history_flags(spark, sf_dir):
    j = inputs.jobs(spark, sf_dir).withColumn("job_key", F.concat_ws("|", "source", "lang"))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2026-03-01").cast("timestamp")) + (F.col("n_chars") % 20) * 86400)
    h = j.filter("job_id % 3 = 0").groupBy("job_key").agg(F.count(F.lit(1)).alias("times_seen"), F.max(at).alias("last_notified"))
    return reports.with_history(j, h, now=F.lit("2026-03-20 12:00:00").cast("timestamp"), cooldown_days=7).select("job_id", "seen_before", "cooldown_left")


@query("chained_summary", """WITH t AS (SELECT o_custkey // 3 AS key, o_custkey AS task_id, max(o_orderdate) AS made FROM orders GROUP BY 1, 2), lt AS (SELECT key, arg_max(task_id, struct_pack(made, task_id)) AS task_id FROM t GROUP BY 1), lr AS (SELECT task_id, arg_max(run_id, struct_pack(started, run_id)) AS run_id, arg_max(status, struct_pack(started, run_id)) AS status FROM runs GROUP BY 1),
a AS (SELECT l_orderkey AS run_id, l_orderkey * 10 + l_linenumber AS artifact_id, l_linenumber % 2 = 1 AS is_result, l_shipdate AS made FROM lineitem), la AS (SELECT run_id, arg_max(artifact_id, struct_pack(is_result, made, artifact_id)) AS artifact_id FROM a GROUP BY 1)
SELECT c_custkey AS key, lt.task_id, lr.run_id, la.artifact_id, CASE WHEN lt.task_id IS NULL THEN 'none' WHEN lr.run_id IS NULL THEN 'queued' WHEN status = 'failed' THEN 'failed' WHEN la.artifact_id IS NULL THEN 'running' ELSE 'ready' END AS state FROM customer LEFT JOIN lt ON key = c_custkey LEFT JOIN lr ON lr.task_id = lt.task_id LEFT JOIN la ON la.run_id = lr.run_id""")
def chained_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tasks = o.groupBy(F.floor(F.col("o_custkey") / 3).cast("long").alias("key"), F.col("o_custkey").alias("task_id")).agg(F.max("o_orderdate").alias("at"))
    li = table(spark, sf_dir, "lineitem")
    artifacts = li.select(F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("artifact_id"), (F.col("l_linenumber") % 2 == 1).alias("is_result"), F.col("l_shipdate").alias("at"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return reports.chained_summary(keys, tasks, inputs.runs(spark, sf_dir), artifacts).select("key", "task_id", "run_id", "artifact_id", "state")


_CANON = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("label_keys", f"""WITH l AS (SELECT p_partkey AS id, {_CANON.format("concat_ws(' ', p_name, p_type)")} AS l FROM part), d AS (SELECT DISTINCT p_brand AS key, {_CANON.format("p_name")} AS p FROM part), lw AS (SELECT *, list_distinct(string_split(l, ' ')) AS lt FROM l), dw AS (SELECT *, list_distinct(string_split(p, ' ')) AS pt FROM d),
r AS (SELECT id, key, p, CASE WHEN l = p THEN 1 WHEN starts_with(' ' || l || ' ', ' ' || p || ' ') THEN 2 WHEN contains(' ' || l || ' ', ' ' || p || ' ') THEN 3 WHEN len(list_intersect(lt, pt)) / greatest(len(lt), len(pt))::DOUBLE >= 0.65 THEN 4 END AS rule FROM lw, dw)
SELECT id, m.key AS key, m.rule AS rule FROM (SELECT id, min(struct_pack(rule, n := -length(p), key)) AS m FROM r WHERE rule IS NOT NULL GROUP BY id)""")
def label_keys(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    labels = parts.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return reports.best_label(labels, parts.select(F.col("p_brand").alias("key"), F.col("p_name").alias("phrase")).distinct())


@query("option_matches", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'I do' WHEN 2 THEN c_mktsegment ELSE NULL END AS \"option\" FROM customer")
def option_matches(spark, sf_dir):
    k = F.col("c_custkey") % 4
    value = F.when(k == 0, F.lower("c_mktsegment")).when(k == 1, "yes").when(k == 2, F.substring("c_mktsegment", 1, 4)).otherwise("zzz")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), value.alias("value"), F.array(F.lit("maybe"), F.col("c_mktsegment"), F.lit("I do")).alias("options"))
    return reports.best_option(rows).select("id", "option")


FUNNEL = "(SELECT source, (doc_id % 5)::INTEGER AS query_index, doc_id AS pos, md5(coalesce(text, '')) AS key, n_chars > 800 AS kept FROM documents)"


@query("query_funnel", f"WITH f AS {FUNNEL}, g AS (SELECT *, row_number() OVER (PARTITION BY source, key, kept ORDER BY query_index, pos) AS n FROM f) SELECT source, query_index, count(*) AS found, count_if(kept) AS kept, count_if(kept AND n = 1) AS new_rows, count_if(kept AND n > 1) AS duplicates FROM g GROUP BY 1, 2")
def query_funnel(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 5).cast("int").alias("query_index"), F.col("doc_id").alias("pos"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), (F.col("n_chars") > 800).alias("kept"))
    return reports.query_funnel(d)


@query("group_sources", "WITH g AS (SELECT coalesce(text, '') AS t, list_distinct(list(source)) AS s, count(*) AS members FROM documents GROUP BY 1) SELECT source, count(*) AS n_groups, sum(members - 1)::BIGINT AS collapsed FROM (SELECT unnest(s) AS source, members FROM g) GROUP BY source")
def group_sources(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("group_id")).agg(F.collect_set("source").alias("sources"), F.count(F.lit(1)).alias("members"))
    return reports.group_sources(g)


@query("suspected_blocking", "SELECT page_id, CASE WHEN regexp_matches(lower(html), 'sign in|password') THEN 'login_wall' WHEN regexp_matches(lower(html), 'cookie|consent') THEN 'consent_wall' WHEN page_id % 13 = 0 THEN 'redirect' END AS signal FROM pages")
def suspected_blocking(spark, sf_dir):
    low = F.lower("html")
    return table(spark, sf_dir, "pages").select("page_id", reports.suspected_blocking({"login_wall": low.rlike("sign in|password"), "consent_wall": low.rlike("cookie|consent"), "redirect": F.col("page_id") % 13 == 0}).alias("signal"))


@query("shortfalls", "SELECT source, count(*) AS n, count(DISTINCT title) AS n_unique, greatest(40 - count(DISTINCT title), 0) AS shortfall, count(DISTINCT title) >= 40 AS reached FROM jobs GROUP BY source")
def shortfalls(spark, sf_dir):
    return reports.shortfalls(inputs.jobs(spark, sf_dir).select("source", F.col("title").alias("key")), target=40)


@query("source_caps", "WITH r AS (SELECT job_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, job_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM jobs) SELECT job_id, source, greatest(c - 10, 0) AS truncated FROM r WHERE n <= 10")
def source_caps(spark, sf_dir):
    return reports.capped(inputs.jobs(spark, sf_dir).select("job_id", "source", "n_chars"), 10, "source", F.desc("n_chars"), F.asc("job_id")).select("job_id", "source", "truncated")


@query("spend_today", "SELECT count(*) AS runs, coalesce(sum(cost), 0)::DECIMAL(22,8) AS spent, 1::DECIMAL(22,8) - coalesce(sum(cost), 0)::DECIMAL(22,8) AS remaining, 1 - coalesce(sum(cost), 0) > 0 AS allowed FROM runs WHERE (started - INTERVAL 5 HOUR)::DATE = '1997-01-14'")
def spend_today(spark, sf_dir):
    return reports.spend_today(inputs.runs(spark, sf_dir), day="1997-01-14", zone="America/New_York", budget=1.0)


@query("task_totals", "SELECT task_id, count(*) AS runs, sum(cost)::DECIMAL(22,8) AS cost FROM runs GROUP BY task_id")
def task_totals(spark, sf_dir):
    return inputs.runs(spark, sf_dir).groupBy("task_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("cost").alias("cost"))


@query("today_summary", "SELECT (SELECT string_agg(level || '=' || n, ',' ORDER BY level) FROM (SELECT level, count(*) AS n FROM events_ WHERE ts::DATE = '2024-01-15' GROUP BY 1)) AS levels, count(*) AS n_events, arg_max(event_id, struct_pack(ts, event_id)) AS newest FROM events_ WHERE ts::DATE = '2024-01-15'")
def today_summary(spark, sf_dir):
    return reports.level_map(ops.in_window(inputs.events(spark, sf_dir), "ts", "2024-01-15", "2024-01-16"))


@query("queue_state", "SELECT count_if(status = 'running') AS running, count_if(status = 'failed') AS failed, count_if(status = 'failed' AND started >= '2001-01-01') AS failed_lately, count(DISTINCT task_id) AS tasks FROM runs")
def queue_state(spark, sf_dir):
    s, late = F.col("status"), F.col("started") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return inputs.runs(spark, sf_dir).agg(F.count_if(s == "running").alias("running"), F.count_if(s == "failed").alias("failed"), F.count_if((s == "failed") & late).alias("failed_lately"), F.countDistinct("task_id").alias("tasks"))


@query("top_sources", "SELECT source, count(*) AS n FROM events_ GROUP BY source ORDER BY n DESC, source LIMIT 4")
def top_sources(spark, sf_dir):
    return inputs.events(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(4)


@query("result_else_latest", "SELECT run_id, artifact_id, is_result FROM (SELECT l_orderkey AS run_id, l_orderkey * 10 + l_linenumber AS artifact_id, l_linenumber % 3 = 1 AS is_result, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber % 3 = 1) DESC, l_shipdate DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def result_else_latest(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("artifact_id"), (F.col("l_linenumber") % 3 == 1).alias("is_result"), F.col("l_shipdate").alias("at"), "l_linenumber")
    return ops.latest_per_key(a, ["run_id"], "is_result", "at", "l_linenumber").select("run_id", "artifact_id", "is_result")


@query("union_of_sources", "SELECT 'listing' AS kind, source, title FROM jobs UNION ALL SELECT 'deal', trim(lower(source)), trim(title) FROM deals")
def union_of_sources(spark, sf_dir):
    a = inputs.jobs(spark, sf_dir).select(F.lit("listing").alias("kind"), "source", "title")
    b = inputs.deals(spark, sf_dir).select(F.lit("deal").alias("kind"), F.trim(F.lower("source")).alias("source"), F.trim("title").alias("title"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_differences", "SELECT user_id AS agent FROM events_ EXCEPT SELECT s_suppkey FROM supplier")
def set_differences(spark, sf_dir):
    return inputs.events(spark, sf_dir).select(F.col("user_id").alias("agent")).distinct().join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("agent")), "agent", "left_anti")


@query("markdown_digest", "SELECT source, n, '## ' || source || ' (' || n || ')' || chr(10) || body AS markdown FROM (SELECT source, max(c) AS n, string_agg(k || '. ' || title, chr(10) ORDER BY k) AS body FROM (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, job_id) AS k, count(*) OVER (PARTITION BY source) AS c FROM jobs) WHERE k <= 5 GROUP BY source)")
def markdown_digest(spark, sf_dir):
    return reports.digest(inputs.jobs(spark, sf_dir), by="source", most=5, title=F.col("title"), order=[F.desc("n_chars"), F.asc("job_id")])


@query("daily_report", "WITH e AS (SELECT ts::DATE AS day, count(*) AS events, count_if(level = 'error') AS errors, round(sum(value), 2) AS cost FROM events_ GROUP BY 1), s AS (SELECT day, string_agg(source || ' ' || n, ', ' ORDER BY n DESC, source) AS busiest FROM (SELECT ts::DATE AS day, source, count(*) AS n, row_number() OVER (PARTITION BY ts::DATE ORDER BY count(*) DESC, source) AS r FROM events_ GROUP BY 1, 2) WHERE r <= 2 GROUP BY day) SELECT day, events, errors, cost, busiest, format('{:d} events, {:d} errors; busiest: {}', events, errors, busiest) AS line FROM e JOIN s USING (day)")
def daily_report(spark, sf_dir):
    from pyspark.sql import Window

    e = inputs.events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    per = e.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("cost"))
    s = e.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"))
    two = s.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "source"))).filter("r <= 2")
    busiest = two.groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "source", "n"))), lambda x: F.concat_ws(" ", x["source"], x["n"].cast("string"))), ", ").alias("busiest"))
    return per.join(busiest, "day").withColumn("line", F.format_string("%d events, %d errors; busiest: %s", "events", "errors", "busiest"))


WATCHED = "CASE {0} % 3 WHEN 0 THEN 'solo' || {0} ELSE 'pair' || ({0} // 3) END"


@query("watcher_summary", f"""WITH tp AS (SELECT 'w' || c_custkey AS id, {WATCHED.format('c_custkey')} AS task_type FROM customer), tk AS (SELECT o_orderkey AS task_id, {WATCHED.format('o_custkey')} AS task_type, CASE WHEN o_orderkey % 4 < 2 THEN 'w' || o_custkey END AS marker, o_orderdate AS u FROM orders),
 nm AS (SELECT marker AS id, task_type, arg_max(task_id, struct_pack(u, task_id)) AS named FROM tk WHERE marker IS NOT NULL GROUP BY 1, 2), ty AS (SELECT task_type, arg_max(task_id, struct_pack(u, task_id)) AS by_type FROM tk WHERE task_type IN (SELECT task_type FROM tp GROUP BY 1 HAVING count(*) = 1) GROUP BY 1),
 f AS (SELECT tp.id, tp.task_type, coalesce(named, by_type) AS task_id FROM tp LEFT JOIN nm USING (id, task_type) LEFT JOIN ty ON ty.task_type = tp.task_type), r AS (SELECT l_orderkey AS task_id, arg_max(l_orderkey * 10 + l_linenumber, struct_pack(l_shipdate, l_linenumber)) AS run_id, arg_max(l_linestatus, struct_pack(l_shipdate, l_linenumber, l_linestatus)) AS status FROM lineitem GROUP BY 1),
 a AS (SELECT l_orderkey AS task_id, arg_max(l_partkey, struct_pack(r := l_linenumber % 2 = 0, d := l_shipdate, k := l_partkey)) AS artifact_id FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
 SELECT f.id, task_type, f.task_id, run_id, status, artifact_id FROM f LEFT JOIN r ON r.task_id = f.task_id LEFT JOIN a ON a.task_id = f.task_id""")
def watcher_summary(spark, sf_dir):
    c = F.col
    kind = lambda k: F.when(c(k) % 3 == 0, F.concat(F.lit("solo"), c(k).cast("string"))).otherwise(F.concat(F.lit("pair"), F.floor(c(k) / 3).cast("string")))
    templates = table(spark, sf_dir, "customer").select(F.concat(F.lit("w"), c("c_custkey").cast("string")).alias("id"), kind("c_custkey").alias("task_type"))
    payload = F.when(c("o_orderkey") % 4 < 2, F.format_string('{"planner_template_id": " w%d "}', "o_custkey")).otherwise('{"other": 1}')
    tasks = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("task_id"), kind("o_custkey").alias("task_type"), payload.alias("payload"), c("o_orderdate").alias("updated"))
    li = table(spark, sf_dir, "lineitem")
    runs = li.select(c("l_orderkey").alias("task_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("run_id"), c("l_linestatus").alias("status"), c("l_shipdate").alias("at"))
    artifacts = li.filter("l_orderkey % 5 <> 0").select(c("l_orderkey").alias("task_id"), c("l_partkey").alias("artifact_id"), (c("l_linenumber") % 2 == 0).alias("is_result"), c("l_shipdate").alias("at"))
    return reports.watcher_summary(templates, tasks, runs, artifacts)


@query("run_preview", """WITH s AS (SELECT level AS source, count(*) AS raw, count_if(value > 20) AS kept, count(DISTINCT user_id) AS pages, count(*) < 200 AS under, CASE WHEN count_if(source = 'planner') > 5 THEN 'login_wall' END AS blocking FROM events_ GROUP BY 1), f AS (SELECT *, list_position(['warning', 'error', 'info'], source) AS spot, upper(source[1]) || source[2:] AS label FROM s),
 l AS (SELECT spot, list_filter([label || ' contributed ' || raw || ' raw jobs', label || ' kept ' || kept || ' jobs after filtering', label || ' attempted ' || pages || ' pages', CASE WHEN under THEN label || ' is under target for this run' END, CASE WHEN blocking IS NOT NULL THEN label || ' suspected blocking: ' || blocking END], lambda x: x IS NOT NULL) AS x FROM f)
 SELECT (spot * 10 + generate_subscripts(x, 1) - 1)::INTEGER AS pos, unnest(x) AS line FROM l UNION ALL SELECT 0, CASE len(n) WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' + ' || n[2] ELSE n[1] || ', ' || n[2] || ', and ' || n[3] END || ' active' FROM (SELECT list(label ORDER BY spot) AS n FROM f)""")
def run_preview(spark, sf_dir):
    c = F.col
    e = inputs.events(spark, sf_dir).groupBy(c("level").alias("source")).agg(F.count(F.lit(1)).alias("raw"), F.count_if(c("value") > 20).alias("kept"), F.countDistinct("user_id").alias("pages"), (F.count(F.lit(1)) < 200).alias("under_target"), F.when(F.count_if(c("source") == "planner") > 5, "login_wall").alias("blocking"))
    return reports.run_preview(e, ("warning", "error", "info"))
