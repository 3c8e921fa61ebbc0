"""Search plans: what to ask the boards for, expanded from a request's titles, places, keywords and levels; for many requests at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Other names of titles and of remote work, what keywords say of a role, how levels are written.
SYNONYMS = ((r"(?i)\bsoftware engineer\b", ("Backend Software Engineer", "Backend Engineer", "SWE", "Software Developer")), (r"(?i)\bmachine learning engineer\b", ("ML Engineer", "Applied ML Engineer", "AI Engineer")), (r"(?i)\bdata engineer\b", ("Analytics Engineer", "Platform Data Engineer")))
REMOTE, REMOTE_NAMES = r"(?i)\b(remote|work from home|wfh|distributed|anywhere)\b", ("remote", "work from home", "distributed")
ROLES = {"backend": "Backend", "frontend": "Frontend", "full stack": "Full Stack", "full-stack": "Full Stack", "platform": "Platform", "api": "API", "distributed": "Distributed Systems"}
LEVELS = {"entry": ("Junior {}", "{} I", "Entry Level {}", "Associate {}"), "mid": ("{} II", "Intermediate {}", "Mid Level {}"), "senior": ("Senior {}", "Lead {}", "Staff {}")}
MOST_QUERIES = 20

STRINGS = "array<string>"


def strings(*values: Column) -> Column:
    return F.array(*values).cast(STRINGS)


def distinct(values: Column, key=lambda x: F.lower(x)) -> Column:
    """Squeezed, non-empty, the first of those that are equal but for case."""
    clean = F.filter(F.transform(F.coalesce(values, strings()), lambda v: text.squeeze(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return text.let(clean, lambda c: F.filter(c, lambda v, i: F.array_position(F.transform(c, key), key(v)) == i + 1))


def remote(x: Column) -> Column:
    return x.rlike(REMOTE)


def title_variants(title: Column, keywords: Column, levels: Column, most: Column, expand: Column) -> Column:
    """array<struct<title, kind>>: the title itself, then by turns a level's name, a synonym and a specialisation, each once, at most `most`."""
    canonical = text.canon_ascii(title)
    levelled = lambda level: reduce(lambda c, kv: c.when(level == kv[0], strings(*[F.concat(*[p for part in (t.split("{}")) for p in (F.lit(part), title)][:-1]) for t in kv[1]])), LEVELS.items(), F).otherwise(strings())
    seniority = F.filter(F.flatten(F.transform(F.coalesce(levels, strings()), levelled)), lambda v: text.canon_ascii(v) != canonical)
    synonyms = F.flatten(F.array(*[F.when(title.rlike(p), strings(*map(F.lit, names))).otherwise(strings()) for p, names in SYNONYMS]))
    role = lambda k: reduce(lambda c, kv: c.when(k == kv[0], F.lit(kv[1])), ROLES.items(), F)
    named = F.filter(F.transform(F.coalesce(keywords, strings()), lambda k: text.canon_ascii(F.coalesce(k, F.lit("")))), lambda k: (k != "") & ~canonical.contains(k) & role(k).isNotNull())
    special = F.transform(named, lambda k: F.concat(role(k), F.lit(" "), title))

    def turns(b: Column) -> Column:
        one = lambda c, kind, i: F.when(i < F.size(b[c]), F.struct(F.get(b[c], i).alias("title"), F.lit(kind).alias("kind")))
        n = F.greatest(F.size(b["a"]), F.size(b["b"]), F.size(b["c"]))
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_compact(F.array(one("a", "seniority", i), one("b", "title_synonym", i), one("c", "role_specialization", i))))
        base = F.array(F.struct(title.alias("title"), F.lit("base_title").alias("kind")))
        every = F.when(F.coalesce(expand, F.lit(False)), F.concat(base, F.flatten(each))).otherwise(base)
        first = lambda e: F.filter(e, lambda v, i: F.array_position(F.transform(e, lambda x: F.lower(x["title"])), F.lower(v["title"])) == i + 1)
        return F.slice(text.let(every, first), F.lit(1), F.greatest(most, F.lit(1)))

    return text.let(F.struct(distinct(seniority).alias("a"), distinct(synonyms).alias("b"), distinct(special).alias("c")), turns)


def plan_queries(requests: DataFrame) -> DataFrame:
    """(request_id, query_index, query, location, title_seed, expansion_type) of requests(request_id, explicit, titles, locations, keywords, levels, remote, most, per_pair, expand).

    First the explicit query in each place; then place by place and title by title the title's variants; with expand at last the titles under other names of remote places. A query counts once, whatever its
    case; a request has at most `most` of them, held between 1 and 20, so its rows are few. Nulls count as empty.
    """
    c = F.col
    clean = lambda x: text.squeeze(F.coalesce(x, F.lit("")))
    r = requests.select("request_id", clean(c("explicit")).alias("explicit"), distinct(c("titles")).alias("titles"), distinct(c("locations")).alias("locations"), "keywords", "levels", F.coalesce("remote", F.lit(False)).alias("remote"), F.greatest(F.lit(1), F.least(F.coalesce("most", F.lit(12)), F.lit(MOST_QUERIES))).alias("most"), F.greatest(F.coalesce("per_pair", F.lit(4)), F.lit(1)).alias("per_pair"), F.coalesce("expand", F.lit(False)).alias("expand"))
    r = r.withColumn("locations", F.when(c("remote") & ~F.exists("locations", remote), F.concat("locations", F.array(F.lit("Remote")))).otherwise(c("locations")))
    place = r.select("*", F.posexplode("locations").alias("lp", "location")).withColumn("names", F.when(remote(c("location")), strings(*map(F.lit, REMOTE_NAMES))).otherwise(F.array("location"))).drop("locations")
    put = lambda what, where: F.when(remote(where) & remote(what), what).otherwise(F.concat_ws(" ", what, where))
    row = lambda stage, tp, vp, q, seed, kind: F.struct(F.lit(stage).alias("stage"), c("lp"), tp.cast("int").alias("tp"), vp.cast("int").alias("vp"), q.alias("query"), seed.alias("title_seed"), kind.alias("expansion_type"))
    zero = F.lit(0)
    asked = place.filter("explicit <> ''").select("request_id", "most", "location", row(0, zero, zero, put(c("explicit"), c("names")[0]), c("explicit"), F.lit("explicit_query")).alias("q"))
    titled = place.select("*", F.posexplode("titles").alias("tp", "seed")).withColumn("v", title_variants(c("seed"), c("keywords"), c("levels"), c("per_pair"), c("expand")))
    first = titled.select("request_id", "most", "location", "lp", "tp", "seed", "names", F.posexplode("v").alias("vp", "x")).select("request_id", "most", "location", row(1, c("tp"), c("vp"), put(c("x.title"), c("names")[0]), c("seed"), c("x.kind")).alias("q"))
    other = titled.filter("expand").select("request_id", "most", "location", "lp", "tp", "seed", "v", F.posexplode(F.slice("names", F.lit(2), F.size("names"))).alias("vp", "name"))
    other = other.select("request_id", "most", "location", row(2, c("tp"), c("vp"), put(c("v")[0]["title"], c("name")), c("seed"), F.concat(c("v")[0]["kind"], F.lit("_location_synonym"))).alias("q"))
    every = asked.unionByName(first).unionByName(other).select("request_id", "most", "location", "q.*")
    once = Window.partitionBy("request_id", F.lower("query")).orderBy("stage", "lp", "tp", "vp")
    kept = every.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    index = F.row_number().over(Window.partitionBy("request_id").orderBy("stage", "lp", "tp", "vp"))
    return kept.withColumn("query_index", index).filter(c("query_index") <= c("most")).select("request_id", "query_index", "query", "location", "title_seed", "expansion_type")
