"""Listings, deals, runs and events shaped from the given tables, in SQL that Spark and DuckDB read alike.

The queries apply operators to these frames; their SQL twins start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

JOBS = r"""
SELECT doc_id AS job_id, n_chars, lang, lower(source) AS source,
  CASE doc_id % 6 WHEN 0 THEN upper(w1 || ' ' || w2 || ' sr eng') WHEN 1 THEN lower('the ' || w1 || ' of ' || w2 || ' ml dev') WHEN 2 THEN w1 || ' Remote ' || w2
    WHEN 3 THEN 'Senior ' || w1 || ' API Lead' WHEN 4 THEN lower(w1 || ' entry-level') ELSE w1 || ' ' || w2 || ' intern' END AS title,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown  Company' WHEN 2 THEN 'at ' || source || ' Inc. |' WHEN 3 THEN upper(source) || ', LLC' ELSE source || ' Group' END AS company,
  CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'new york city' WHEN 2 THEN 'Remote' WHEN 3 THEN 'san francisco - ca' WHEN 4 THEN 'united states' WHEN 5 THEN 'x' WHEN 6 THEN 'austin, tx' WHEN 7 THEN 'greater los angeles area' ELSE lang || ' - springfield' END AS location,
  CASE doc_id % 8 WHEN 0 THEN '$' || CAST(60 + n_chars % 90 AS VARCHAR(9)) || 'k - $' || CAST(70 + n_chars % 60 AS VARCHAR(9)) || 'k' WHEN 1 THEN 'USD 120,000 to 100,500.50' WHEN 2 THEN '$85,000 / year' WHEN 3 THEN 'From $' || CAST(100 + n_chars % 50 AS VARCHAR(9)) || 'k a month'
    WHEN 4 THEN 'Up to 90k' WHEN 5 THEN 'competitive' ELSE NULL END AS salary_text,
  CASE doc_id % 8 WHEN 0 THEN '2026-03-' || CASE WHEN 1 + n_chars % 19 < 10 THEN '0' ELSE '' END || CAST(1 + n_chars % 19 AS VARCHAR(9)) || ' 10:30:00' WHEN 1 THEN CAST(1 + n_chars % 45 AS VARCHAR(9)) || ' days ago' WHEN 2 THEN 'Yesterday' WHEN 3 THEN '30+ days ago' WHEN 4 THEN 'an hour ago' WHEN 5 THEN 'Posted today' WHEN 6 THEN '2 weeks ago' ELSE NULL END AS posted_text,
  CASE doc_id % 5 WHEN 0 THEN 'On-Site' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'field' ELSE NULL END AS work_mode_text,
  CASE doc_id % 5 WHEN 0 THEN 'New Grad' WHEN 1 THEN 'Principal' WHEN 2 THEN 'wizard' ELSE NULL END AS experience_text,
  CASE doc_id % 4 WHEN 0 THEN 'https://WWW.' || source || '.example.com/jobs/view/' || CAST(n_chars % 500 AS VARCHAR(9)) || '/?utm_source=x&b=2&a=1#top' WHEN 1 THEN 'https://' || source || '.example.com/search?q=dev' WHEN 2 THEN 'https://' || source || '.example.com/jobs' ELSE NULL END AS url,
  w3 AS description
FROM (
  SELECT doc_id, n_chars, lang, source, split_part(t, ' ', 1) AS w1, split_part(t, ' ', 2) AS w2, t AS w3
  FROM (SELECT doc_id, n_chars, lang, source, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', ' '), ' +', ' ')) AS t FROM {documents})
)
"""
# The words come from the text's ASCII letters alone: other letters change case differently from engine to engine.
JOBS_DUCKDB = JOBS.replace("'[^A-Za-z0-9 ]', ' ')", "'[^A-Za-z0-9 ]', ' ', 'g')").replace("' +', ' ')", "' +', ' ', 'g')").replace("{documents}", "documents")

DEALS = r"""
SELECT l_orderkey AS order_key, l_linenumber AS line, l_suppkey AS supplier, l_shipdate AS shipped,
  CASE WHEN l_suppkey % 11 = 0 THEN ' Store' ELSE 'store' END || CAST(l_suppkey % 7 AS VARCHAR(9)) AS source,
  CASE l_partkey % 10 WHEN 0 THEN 'GeForce RTX 5090 graphics card ' WHEN 1 THEN 'Gaming PC desktop RTX 5090 with 64GB RAM ' WHEN 2 THEN 'Laptop RTX 5090 ' WHEN 3 THEN 'RTX 4080 video card ' WHEN 4 THEN 'PC case fan for RTX 5090 ' WHEN 5 THEN 'RTX 5090 water block ' ELSE '' END || p_name AS title,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'sku-' || CAST(l_partkey AS VARCHAR(9)) END AS sku,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'HTTPS://Shop.example.com/p/' || CAST(l_partkey AS VARCHAR(9)) || '/?utm_campaign=z&v=1' END AS url,
  CAST(floor(l_extendedprice / l_quantity * 100) AS DOUBLE) / 100 AS price, CAST(p_retailprice AS DOUBLE) * (1 + (l_partkey % 5) * 0.1) AS old_price,
  CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS in_stock
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

RUNS = r"""
SELECT o_orderkey AS run_id, o_custkey AS task_id, o_orderdate AS started, o_orderpriority AS task_type,
  CASE o_orderstatus WHEN 'P' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(o_totalprice / 1000000 AS DECIMAL(12, 8)) AS cost,
  CASE o_orderkey % 7 WHEN 0 THEN 'QUEUE_ENQUEUE_ERROR[scheduler]: no redis' WHEN 1 THEN 'APIConnectionError: reset' WHEN 2 THEN 'VALIDATION_ERROR: title' WHEN 3 THEN 'NON_RETRYABLE_ERROR: auth' WHEN 4 THEN 'task blocked by budget' WHEN 5 THEN 'ValueError: bad row' ELSE NULL END AS error
FROM {orders}
"""

EVENTS = r"""
SELECT event_id, ts, user_id, event_type, CAST(value AS DOUBLE) AS value, props,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'warning' ELSE 'info' END AS level,
  CASE event_id % 6 WHEN 0 THEN 'watchdog' WHEN 1 THEN 'notify_v1' WHEN 2 THEN 'planner' WHEN 3 THEN 'scheduler' ELSE 'worker' END AS source,
  CASE event_id % 6 WHEN 0 THEN 'watchdog agent ' || CAST(user_id AS VARCHAR(9)) || ' heartbeat stale 300s' WHEN 1 THEN 'notify failed for run ' || CAST(event_id AS VARCHAR(9)) WHEN 2 THEN 'planner tick ' || CAST(event_id AS VARCHAR(9))
    WHEN 3 THEN 'task_failed deadbeef' || CAST(10000000 + event_id AS VARCHAR(9)) WHEN 4 THEN 'blocked_budget for task' ELSE 'resume digest ready' END AS message
FROM {events}
"""


def shaped(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql, **frames)


#: JOBS over documents whose words are there already: w1 and w2, the first two, and w3, the whole cleaned text.
JOBS_OF_WORDS = JOBS[: JOBS.index("FROM (\n")] + "FROM {documents}"


def first_words(documents: DataFrame) -> DataFrame:
    """documents with w1, w2 and w3 as JOBS has them.

    The text is cleaned in one pass, by looking its words up, and once a row: the row comes out of a generator, which no filter or column that uses the words is pushed through, as that would clean the
    text again at each place.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    nth = lambda w, i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    words = text.each(found, lambda w: F.struct(nth(w, 0).alias("w1"), nth(w, 1).alias("w2"), F.array_join(w, " ").alias("w3")))
    return documents.select("doc_id", "n_chars", "lang", "source", words)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JOBS_OF_WORDS, documents=first_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, DEALS, "lineitem", "part")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, RUNS, "orders")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, EVENTS, "events")


def with_views(sql: str) -> str:
    """A DuckDB query with the shaped frames it names as common table expressions."""
    views = {"jobs": JOBS_DUCKDB, "deals": DEALS.replace("{lineitem}", "lineitem").replace("{part}", "part"), "runs": RUNS.replace("{orders}", "orders"), "events_": EVENTS.replace("{events}", "events")}
    used = [f"{name} AS ({text})" for name, text in views.items() if f" {name}" in sql]
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{', '.join([*used, body[len(head):]])}"
    return f"WITH {', '.join(used)} {body}" if used else body
