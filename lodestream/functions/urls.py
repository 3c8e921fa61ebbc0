"""Addresses and keys of listings and deals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_text

# Query keys that only track, and signs of a search page or a single listing.
SEARCH_KEYS = ("q", "query", "keywords", "sc.keyword")
DIRECT_PATHS = ("/jobs/view", "/viewjob", "joblisting", "/stu/jobs/")


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def normal_url(url: Column) -> Column:
    """Scheme and host lower-cased, no trailing slash, tracking keys and fragment dropped, the query sorted."""
    u = F.trim(url)
    keep = lambda kv: (kv != "") & ~F.lower(kv).startswith("utm_") & ~F.lower(F.split_part(kv, F.lit("="), F.lit(1))).isin("fbclid", "gclid")
    query = F.array_join(F.array_sort(F.filter(F.split(F.coalesce(part(u, "QUERY"), F.lit("")), "&"), keep)), "&")
    path = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", ""), F.lit("")), F.lit("/"))
    return F.when(u.isNotNull(), F.concat(F.lower(F.coalesce(part(u, "PROTOCOL"), F.lit("https"))), F.lit("://"), F.lower(F.coalesce(part(u, "AUTHORITY"), F.lit(""))), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def url_kind(url: Column) -> Column:
    """missing, search, direct or unknown."""
    path = F.lower(F.coalesce(part(url, "PATH"), F.lit("")))
    keys = F.transform(F.split(F.lower(F.coalesce(part(url, "QUERY"), F.lit(""))), "&"), lambda kv: F.split_part(kv, F.lit("="), F.lit(1)))
    direct = path.contains(DIRECT_PATHS[0])
    for p in DIRECT_PATHS[1:]:
        direct = direct | path.contains(p)
    return (
        F.when(as_text(url).isNull(), "missing")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, SEARCH_KEYS))), "search")
        .when(path.contains("search") & ~path.contains("view") & ~path.contains("listing"), "search")
        .when(direct | ~path.isin("", "/", "/jobs"), "direct")
        .otherwise("unknown")
    )


def best_url(*candidates: Column) -> Column:
    """The first address of a single listing, or else the first at all."""
    return F.coalesce(*[F.when(url_kind(c) == "direct", as_text(c)) for c in candidates], *map(as_text, candidates))


def without_dots(target: Column) -> Column:
    """A path, with or without a query, whose segments . and .. are resolved; it begins with a slash."""
    path, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "[?#].*$", 0)
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s))))
    slash = F.when(path.rlike("/[.]{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), slash, rest)
    return F.when(path.rlike("/[.]{1,2}(/|$)"), resolved).otherwise(target)


def absolute_url(base: Column, href: Column) -> Column:
    """href resolved against base: absolute, scheme-relative, root-relative, query, fragment and relative forms. Dot segments of a path are resolved, those above the root dropped."""
    scheme, host, path = part(base, "PROTOCOL"), part(base, "AUTHORITY"), F.coalesce(part(base, "PATH"), F.lit(""))
    root, h = F.concat(scheme, F.lit("://"), host), F.trim(href)
    query = F.coalesce(F.concat(F.lit("?"), part(base, "QUERY")), F.lit(""))
    folder = F.regexp_replace(F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), "[^/]*$", "")
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h.startswith("/"), F.concat(root, without_dots(h)))
        .when(h.startswith("?"), F.concat(root, path, h)).when((h == "") | h.startswith("#"), F.concat(root, path, query, h)).otherwise(F.concat(root, without_dots(F.concat(folder, h))))
    )


def job_key(company_key: Column, title_key: Column, location_key: Column, url: Column, job_id: Column) -> Column:
    """Canonical key of a listing: company, title and place; without a company the title; or else the address or the id."""
    place = F.coalesce(F.nullif(location_key, F.lit("")), F.lit("unspecified"))
    return (
        F.when((company_key != "") & (title_key != ""), F.concat(F.lit("job:"), F.concat_ws("|", company_key, title_key, place)))
        .when(title_key != "", F.concat(F.lit("job:title:"), title_key, F.lit("|"), place))
        .when(as_text(url).isNotNull(), F.concat(F.lit("url:"), F.lower(url)))
        .otherwise(F.concat(F.lit("id:"), job_id.cast("string")))
    )


def deal_key(source: Column, sku: Column, url: Column, title: Column) -> Column:
    s = F.coalesce(F.nullif(F.lower(F.trim(source)), F.lit("")), F.lit("unknown"))
    return F.coalesce(
        F.concat(s, F.lit("|sku|"), F.nullif(F.lower(F.trim(sku)), F.lit(""))),
        F.concat(s, F.lit("|url|"), normal_url(F.nullif(F.trim(url), F.lit("")))),
        F.concat(s, F.lit("|title|"), F.lower(F.trim(F.coalesce(title, F.lit("untitled"))))),
    )


def short_hash(x: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, n)


def digest_key(prefix: str, at: Column, urls: Column, most: int) -> Column:
    """prefix, the hour, and a hash of the first distinct addresses."""
    return F.concat(F.lit(f"{prefix}:"), F.date_format(at, "yyyyMMdd-HH"), F.lit(":"), short_hash(F.array_join(F.slice(F.array_distinct(urls), 1, most), "|")))
