"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from lodestream.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("daily_flags", "alert_feed", "usage_by_model", "budget_ledger", "latest_run_per_task", "early_stop", "first_seen_deals", "target_items", "alert_decisions", "deal_pipeline", "normalized_listings", "duplicate_groups", "title_similarity", "rank_listings", "shortlist", "page_links")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(HEADLINE)
    try:
        from lodestream.llm import queries as corpus

        run = registry.QUERIES | corpus.QUERIES
        names += sorted(corpus.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    except ModuleNotFoundError:
        run = registry.QUERIES
    took = {}
    for name in names:
        began = time.time()
        run[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
