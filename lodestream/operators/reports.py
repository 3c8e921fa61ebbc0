"""Look-ups, roll-ups and texts for digests, watchers and daily reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text

# Phrases that tell messages and form questions apart.
TRANSIENT = ("timeout", "timed out", "temporar", "connection", "rate limit", "unavailable", "reset")
SKIP_PHRASES = ("notify skipped", "skipped_empty_shortlist", "empty shortlist", "should_notify false", "intentional skip")
ERROR_MARKS = ("error", "failed", "blocked", "timeout", "denied", "exception")
SECRETS = ("password", "secret", "token", "otp", "passcode")
LONG_FORM = ("why", "describe", "tell us", "explain", "cover letter", "in your own words")


def has_any(x: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(x).contains(t) for t in terms])


def first_present(*columns: Column) -> Column:
    """The first alias that holds a text."""
    return F.coalesce(*[text.as_text(c) for c in columns])


def alias_jobs(raw: DataFrame) -> DataFrame:
    """Rows of any alias columns in the shape of a raw listing; turned-round salaries are put right. Rows without a title keep a null there, for alias_drops to count."""
    have = set(raw.columns)
    pick = lambda *names: first_present(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    low, high = text.as_float(pick("salary_min", "min_salary")), text.as_float(pick("salary_max", "max_salary"))
    return raw.select(
        "row_id", pick("title", "job_title", "name").alias("title"), pick("company", "employer", "organization").alias("company"), F.coalesce(F.least(low, high), low).alias("salary_min"), F.coalesce(F.greatest(low, high), high).alias("salary_max"),
        F.coalesce(pick("salary_currency", "currency"), F.lit("USD")).alias("currency"),
    )


def alias_drops(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("title").isNull()).alias("missing_title"))


def alias_deals(raw: DataFrame) -> DataFrame:
    """Rows of any alias columns in the shape of a deal, with the discount worked out where none is given."""
    have = set(raw.columns)
    pick = lambda *names: first_present(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    price, old = text.as_float(pick("price", "current_price", "sale_price", "amount")), text.as_float(pick("old_price", "list_price", "original_price", "msrp"))
    given = text.as_float(pick("discount_pct", "discount_percent", "discount"))
    return raw.select("row_id", F.coalesce(pick("title", "name", "deal_title"), F.lit("Untitled deal")).alias("title"), price.alias("price"), old.alias("old_price"), F.coalesce(given, text.discount_pct(price, old)).alias("effective_discount"), text.as_bool(pick("in_stock", "available")).alias("in_stock"))


def sku_of(snippet: Column, url: Column) -> Column:
    """The sku of a snippet, or else of two shapes of address."""
    return F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for x, p in ((snippet, r"(?i)\bsku[:#\s]*([A-Za-z0-9-]{3,})"), (url, r"/p/([0-9]+)"), (url, r"[?&]skuId=([0-9]+)"))])


def price_hint(html: Column, title: Column, reach: int = 3500) -> Column:
    """The least price within reach characters of the title's first place in the page."""
    at = F.instr(html, title)
    start = F.greatest(at - reach, F.lit(1))
    near = F.substring(html, start, at + F.length(title) + reach - start)
    return F.when(at > 0, F.array_min(text.price_values(near)))


def step_totals(runs: DataFrame) -> DataFrame:
    """runs(run_id, steps array<struct<name, seconds>>) -> count, sum and longest step."""
    seconds = F.transform("steps", lambda s: s["seconds"])
    return runs.select("run_id", F.size("steps").alias("n_steps"), F.aggregate(seconds, F.lit(0.0), lambda a, x: a + x).alias("seconds"), F.array_max(seconds).alias("longest"))


def transient(error: Column, status: Column) -> Column:
    return F.coalesce(status >= 500, F.lit(False)) | F.coalesce(status == 429, F.lit(False)) | F.coalesce(has_any(error, TRANSIENT), F.lit(False))


def usage_filled(rows: DataFrame) -> DataFrame:
    """total_tokens from both parts where it is not given; cost to 8 decimals, halves up."""
    return rows.withColumns({"total_tokens": F.coalesce("total_tokens", F.col("tokens_in") + F.col("tokens_out")), "cost": F.round(F.col("cost").cast("decimal(20,12)"), 8).cast("decimal(12,8)")})


def metadata_value(json: Column, key: str) -> Column:
    """A value of a JSON object; null where the text is no JSON."""
    return F.get_json_object(json, f"$.{key}")


def metadata_of(json: Column, *, keep_bad: bool = True) -> Column:
    """A metadata text as a VARIANT: its value, or the text itself where it is no JSON (null, if bad texts aren't kept). Empty texts give null."""
    t = F.nullif(F.trim(json), F.lit(""))
    parsed = F.try_parse_json(t)
    return F.coalesce(parsed, t.cast("variant")) if keep_bad else parsed


def metadata_text(value: Column) -> Column:
    """JSON text of a VARIANT, map or struct; a VARIANT that is a text alone is written as that text."""
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string")).otherwise(F.to_json(value))


def gaps(job: dict[str, Column]) -> Column:
    """What a digest row lacks, in words."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.as_text(c).isNull(), f"{name} missing") for name, c in job.items()])), ", ")


def heading(title: Column, company: Column) -> Column:
    return F.concat_ws(" at ", text.as_text(title), text.as_text(company))


def model_tier(remaining: Column, tokens: Column, kind: Column) -> Column:
    return F.when(remaining <= 0, "none").when(kind.isin("1-URGENT", "2-HIGH") & (remaining > 0.25), "large").when((tokens > 3000) & (remaining > 0.1), "large").when(remaining > 0.05, "small").otherwise("tiny")


def drop_unless_all(rows: DataFrame, weak: Column, by: str) -> DataFrame:
    """Rows that aren't weak, and all rows of a group in which every row is. Groups are summed up before the join, so none is gathered."""
    flagged = rows.withColumn("_weak", F.coalesce(weak, F.lit(False)))
    all_weak = flagged.groupBy(by).agg(F.min("_weak").alias("_all"))
    return flagged.join(all_weak, by).filter(~F.col("_weak") | F.col("_all")).drop("_weak", "_all")


def split_messages(rows: DataFrame) -> DataFrame:
    """rows(source, messages array) -> (source, kind, message), message prefixed by its source."""
    m = rows.select("source", F.explode("messages").alias("m"))
    return m.select("source", F.when(has_any(F.col("m"), ERROR_MARKS), "error").otherwise("warning").alias("kind"), F.concat_ws(": ", "source", "m").alias("message"))


def masked(value: Column, *hints: Column) -> Column:
    """value, hidden where a name, label or type speaks of a secret."""
    return F.when(~F.coalesce(has_any(F.concat_ws(" ", *hints), SECRETS), F.lit(False)), value)


def question_class(q: Column) -> Column:
    low = F.lower(q)
    return F.when(has_any(low, LONG_FORM), "long_form").when(low.rlike("salary|compensation"), "salary").when(low.rlike("authorized|visa|sponsor"), "eligibility").otherwise("short")


def due(rows: DataFrame, now: Column, *, stale_hours: int) -> DataFrame:
    """Rows with the selection they fall into: due now, stale while running, or none of both (left out)."""
    age = (F.unix_seconds(now) - F.unix_seconds(F.col("at").cast("timestamp"))) / 3600
    chosen = F.when((F.col("status") == "running") & (age > stale_hours), "stale").when((F.col("status") != "running") & (F.col("at").cast("timestamp") <= now), "due")
    return rows.withColumn("selection", chosen).filter(F.col("selection").isNotNull())


def with_history(jobs: DataFrame, history: DataFrame, *, now: Column, cooldown_days: int) -> DataFrame:
    """jobs left joined with their history, with flags and the days that a cooldown still lasts."""
    j = jobs.join(history, "job_key", "left")
    passed = (F.unix_seconds(now) - F.unix_seconds(F.col("last_notified").cast("timestamp"))) / 86400
    left = F.greatest(F.ceil(F.lit(cooldown_days) - passed), F.lit(0).cast("long"))
    return j.withColumns({"seen_before": F.coalesce(F.col("times_seen") > 0, F.lit(False)), "cooldown_left": F.coalesce(left, F.lit(0).cast("long")), "in_cooldown": F.coalesce(left > 0, F.lit(False))})


def chained_summary(keys: DataFrame, tasks: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """keys <- latest task <- latest run <- latest artifact, all left joins on frames of one row a key, and the state that results."""
    from .ops import latest_per_key

    t = latest_per_key(tasks, ["key"], "at", "task_id")
    r = latest_per_key(runs, ["task_id"], "started", "run_id").select("task_id", "run_id", "status")
    a = latest_per_key(artifacts, ["run_id"], "is_result", "at", "artifact_id").select("run_id", "artifact_id", "is_result")
    j = keys.join(t.select("key", "task_id"), "key", "left").join(r, "task_id", "left").join(a, "run_id", "left")
    state = F.when(F.col("task_id").isNull(), "none").when(F.col("run_id").isNull(), "queued").when(F.col("status") == "failed", "failed").when(F.col("artifact_id").isNull(), "running").otherwise("ready")
    return j.withColumn("state", state)


def best_label(labels: DataFrame, dictionary: DataFrame, *, least: float = 0.65) -> DataFrame:
    """Form labels matched to the canonical key of a phrase dictionary(key, phrase): equal, then a prefix, then contained, then by token overlap of at least `least`.

    labels(id, label). Equal texts are one on both sides, a phrase with the least of its keys. Phrases that are in a label are found by equality, with the label's runs of as many words as some phrase has. Only labels without
    one are compared by tokens: two sets that similar share one of their first n - ceil(least * n) + 1, in order of rarity, so the common words of both sides don't meet.
    """
    tokens = lambda c: F.array_distinct(text.words(F.col(c)))
    clean = labels.select("id", text.canon_ascii(F.col("label")).alias("l")).filter("l <> ''")
    phrases = dictionary.select("key", text.canon_ascii(F.col("phrase")).alias("p")).filter("p <> ''").groupBy("p").agg(F.min("key").alias("key"))
    texts, w = clean.select("l").distinct(), text.words(F.col("l"))
    sizes = phrases.agg(F.collect_set(F.size(text.words(F.col("p")))).alias("sizes"))
    runs = F.transform(F.filter("sizes", lambda n: n <= F.size(w)), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
    inside = texts.crossJoin(F.broadcast(sizes)).select("l", F.explode(F.array_distinct(F.flatten(runs))).alias("p")).join(phrases, "p")
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    best = lambda rows, rule: rows.groupBy("l").agg(F.min(F.struct(rule.alias("rule"), (-F.length("p")).alias("len"), "key")).alias("m"))
    found = best(inside, F.when(F.col("l") == F.col("p"), 1).when(spaced("l").startswith(spaced("p")), 2).otherwise(3))
    rest = texts.join(found, "l", "left_anti")
    df = phrases.select(F.explode(tokens("p")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def first(rows: DataFrame, c: str) -> DataFrame:
        order = Window.partitionBy(c).orderBy(F.coalesce("df", F.lit(0)), "w")
        ranked = rows.select("*", F.size(tokens(c)).alias("n"), F.explode(tokens(c)).alias("w")).join(df, "w", "left").withColumn("i", F.row_number().over(order))
        return ranked.filter(F.col("i") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).drop("n", "i", "df")

    pairs = first(rest, "l").join(first(phrases, "p"), "w").select("l", "key", "p").distinct()
    overlap = F.size(F.array_intersect(tokens("l"), tokens("p"))) / F.greatest(F.size(tokens("l")), F.size(tokens("p")))
    matched = found.unionByName(best(pairs.filter(overlap >= least), F.lit(4)))
    return clean.join(matched, "l").groupBy("id").agg(F.min("m").alias("m")).select("id", F.col("m.key").alias("key"), F.col("m.rule").alias("rule"))


def best_option(rows: DataFrame) -> DataFrame:
    """rows(id, value, options array): the option that fits best: equal, prefix, contained, or of the same yes/no class; null if none does."""
    yes = lambda c: F.when(c.isin("yes", "y", "true", "i do"), True).when(c.isin("no", "n", "false", "i do not"), False)
    e = rows.select("id", F.lower(F.trim("value")).alias("v"), F.posexplode_outer("options").alias("pos", "option"))
    o = F.lower(F.trim("option"))
    rule = F.when(o == F.col("v"), 1).when(o.startswith(F.col("v")), 2).when(o.contains(F.col("v")) | F.col("v").contains(o), 3).when(yes(o) == yes(F.col("v")), 4)
    return e.withColumn("r", rule).groupBy("id").agg(F.min(F.when(F.col("r").isNotNull(), F.struct("r", "pos", "option"))).alias("m")).select("id", F.col("m.option").alias("option"), F.col("m.r").alias("rule"))


def query_funnel(rows: DataFrame) -> DataFrame:
    """rows(source, query_index, pos, key, kept): per query found, kept, duplicate and new; a row counts for the first query that found it. First places come from a minimum per key, begun on the map side."""
    first = rows.filter("kept").groupBy("source", "key").agg(F.min(F.struct("query_index", "pos")).alias("first"))
    j = rows.join(first, ["source", "key"], "left")
    new = F.col("kept") & (F.col("first") == F.struct("query_index", "pos"))
    return j.groupBy("source", "query_index").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("kept")).alias("kept"), F.count_if(new).alias("new_rows"), F.count_if(F.col("kept") & ~new).alias("duplicates"))


def group_sources(groups: DataFrame) -> DataFrame:
    """groups(group_id, sources array, members): per source its groups and rows that collapsed; a group counts once for each of its sources."""
    e = groups.select("group_id", "members", F.explode(F.array_distinct("sources")).alias("source"))
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("members") - 1).alias("collapsed"))


def suspected_blocking(signals: dict[str, Column]) -> Column:
    """The name of the first signal that is true."""
    return F.coalesce(*[F.when(c, name) for name, c in signals.items()])


def shortfalls(rows: DataFrame, *, target: int) -> DataFrame:
    """Per source: rows, distinct keys, how many are missing to the target, and whether it is reached."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_unique"))
    return per.withColumns({"shortfall": F.greatest(F.lit(target) - F.col("n_unique"), F.lit(0).cast("long")), "reached": F.col("n_unique") >= target})


def capped(rows: DataFrame, n: int, by: str, *order: Column) -> DataFrame:
    """The first n rows of each group, and in every row how many the group lost."""
    w = Window.partitionBy(by).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    lost = rows.groupBy(by).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0).cast("long")).alias("truncated"))
    return kept.join(lost, by)


def spend_today(runs: DataFrame, *, day: str, zone: str, budget: float) -> DataFrame:
    """Spend of one operational day, failed runs included and rows without a start left out; what remains and whether more is allowed."""
    chosen = runs.filter(F.col("started").isNotNull() & (dates.operational_day(F.col("started").cast("timestamp"), zone) == F.lit(day).cast("date")))
    s = chosen.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("cost"), F.lit(0).cast("decimal(12,8)")).cast("decimal(22,8)").alias("spent"))
    return s.withColumn("remaining", F.lit(budget).cast("decimal(22,8)") - F.col("spent")).withColumn("allowed", F.col("remaining") > 0)


def level_map(events: DataFrame) -> DataFrame:
    """One row: counts by level as one text, and the newest event."""
    per = events.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "event_id")).alias("last"))
    levels = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "n"))), lambda x: F.concat_ws("=", x["level"], x["n"].cast("string"))), ",")
    return per.agg(levels.alias("levels"), F.sum("n").alias("n_events"), F.max("last").alias("last")).select("levels", "n_events", F.col("last.event_id").alias("newest"))


def digest(rows: DataFrame, *, by: str, most: int, title: Column, order: list[Column]) -> DataFrame:
    """A Markdown list per group: a heading with the group's size, then the first `most` lines in order. Only those lines are gathered."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select(by, F.struct("_n", title.alias("line")).alias("l"))
    lines = first.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: F.concat(x["_n"].cast("string"), F.lit(". "), x["line"])), "\n").alias("body"))
    return sizes.join(lines, by).select(by, "n", F.concat(F.lit("## "), F.col(by).cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.col("body")).alias("markdown"))


def watcher_summary(templates: DataFrame, tasks: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """templates(id, task_type) with their latest task, its latest run and artifact: the task whose payload names the template as planner_template_id, or else the latest of its type where the type has this one template.

    tasks(task_id, task_type, payload, updated), runs(task_id, run_id, status, at), artifacts(task_id, artifact_id, is_result, at). Of runs of equal time and id the one with the larger status counts. Each side is cut to a row a key by a maximum before it is joined.
    """
    from .ops import latest_per_key

    marker = F.nullif(F.trim(F.get_json_object("payload", "$.planner_template_id")), F.lit(""))
    t = tasks.select("task_id", "task_type", "updated", marker.alias("id"))
    named = latest_per_key(t.filter("id is not null"), ["id", "task_type"], "updated", "task_id").select("id", "task_type", F.col("task_id").alias("named"))
    lone = templates.groupBy("task_type").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("task_type")
    by_type = latest_per_key(t.drop("id"), ["task_type"], "updated", "task_id").join(lone, "task_type", "left_semi").select("task_type", F.col("task_id").alias("by_type"))
    found = templates.join(named, ["id", "task_type"], "left").join(by_type, "task_type", "left").select("id", "task_type", F.coalesce("named", "by_type").alias("task_id"))
    r = latest_per_key(runs, ["task_id"], "at", "run_id", "status").select("task_id", "run_id", "status")
    a = latest_per_key(artifacts, ["task_id"], "is_result", "at", "artifact_id").select("task_id", "artifact_id")
    return found.join(r, "task_id", "left").join(a, "task_id", "left").select("id", "task_type", "task_id", "run_id", "status", "artifact_id")


def digest_rows(digest: DataFrame, listings: DataFrame) -> DataFrame:
    """digest(job_id, rank, title, company, salary) completed from listings(job_id, title, company, salary) of the same id; a digest's row stays where there is none."""
    s = listings.select("job_id", *[F.col(c).alias(f"s_{c}") for c in ("title", "company", "salary")])
    filled = lambda c, otherwise: text.short_text(F.coalesce(text.as_text(F.col(c)), text.as_text(F.col(f"s_{c}")), F.lit(otherwise)), 120).alias(c)
    return digest.join(s, "job_id", "left").select("job_id", "rank", filled("title", "Unknown role"), filled("company", "Unknown company"), filled("salary", "Not listed"))


def run_preview(sources: DataFrame, focus: tuple[str, ...]) -> DataFrame:
    """(pos, line): what a collecting run says of the sources in focus that it has, in the order of focus.

    sources(source, raw, kept, pages, under_target, blocking) has a row a source; focus is a parameter, so the first line's names are few.
    """
    place = F.array_position(F.array(*map(F.lit, focus)), F.col("source")).cast("int")
    s = sources.filter(F.col("source").isin(*focus)).withColumns({"at": place, "label": F.initcap("source")})
    lines = F.array_compact(F.array(
        F.format_string("%s contributed %d raw jobs", "label", "raw"), F.format_string("%s kept %d jobs after filtering", "label", "kept"), F.format_string("%s attempted %d pages", "label", "pages"),
        F.when(F.col("under_target"), F.concat("label", F.lit(" is under target for this run"))), F.when(F.col("blocking").isNotNull(), F.concat("label", F.lit(" suspected blocking: "), "blocking")),
    ))
    each = s.select("at", F.posexplode(lines).alias("i", "line")).select((F.col("at") * 10 + F.col("i")).alias("pos"), "line")
    names = s.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("n")).filter(F.size("n") > 0)
    n = F.size("n")
    head = F.when(n == 1, F.col("n")[0]).when(n == 2, F.array_join("n", " + ")).otherwise(F.concat(F.array_join(F.slice("n", F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at("n", -1)))
    return names.select(F.lit(0).alias("pos"), F.concat(head, F.lit(" active")).alias("line")).unionByName(each)
