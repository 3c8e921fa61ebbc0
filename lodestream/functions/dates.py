"""Dates of listings, operational days, ages and decays. Every "now" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_text, let

RELATIVE = r"\b(\d+|an?)\s*(minute|min|hour|hr|day|d|week|wk|month|mo)s?\b"
PLUS_DAYS = r"(\d+)\+\s*days?"
SECONDS = {"mi": 60, "h": 3600, "w": 7 * 86400, "mo": 30 * 86400}


def posted_at(x: Column, scraped_at: Column) -> Column:
    """Time of an ISO text (UTC unless it says otherwise), or of today, yesterday, N+ days and N units ago against scraped_at; else null."""
    each = lambda unit: F.when(unit.startswith("mo"), SECONDS["mo"]).when(unit.startswith("mi"), SECONDS["mi"]).when(unit.startswith("h"), SECONDS["h"]).when(unit.startswith("w"), SECONDS["w"]).otherwise(86400)

    def back(text: Column) -> Column:
        units = let(F.regexp_extract(text, RELATIVE, 2), each) * F.coalesce(F.regexp_extract(text, RELATIVE, 1).try_cast("long"), F.lit(1))
        return (
            F.when(text.rlike(r"\b(today|just posted)\b"), 0).when(text.rlike(r"\byesterday\b"), 86400)
            .when(text.rlike(PLUS_DAYS), F.regexp_extract(text, PLUS_DAYS, 1).try_cast("long") * 86400).when(text.rlike(RELATIVE), units)
        )

    return let(as_text(x), lambda t: F.coalesce(F.try_to_timestamp(t), F.timestamp_seconds(F.unix_seconds(scraped_at) - let(F.lower(t), back))))


def age_days(given: Column, posted: Column, now: Column) -> Column:
    """The given age, or else whole days since posted; never below 0, and null where neither is known."""
    days = F.coalesce(given.cast("long"), F.floor((F.unix_seconds(now) - F.unix_seconds(posted)) / 86400))
    return let(days, lambda d: F.when(d > 0, d).when(d.isNotNull(), 0).cast("long"))


def recency_quality(posted: Column, raw_was_relative: Column, age: Column) -> Column:
    return F.when(age.isNull(), "missing").when(posted.isNull(), "age_only").when(raw_was_relative, "relative_normalized").otherwise("timestamp")


def posted_display(age: Column, posted: Column) -> Column:
    return F.when(age == 0, "today").when(age <= 30, F.concat(age.cast("string"), F.lit("d ago"))).otherwise(F.coalesce(F.date_format(posted, "yyyy-MM-dd"), F.lit("date missing")))


def operational_day(at: Column, zone: str) -> Column:
    """The local date in zone of a UTC time."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def day_bounds(day: Column, zone: str) -> Column:
    """struct(start, end) in UTC of a local day; 23 or 25 hours where the clocks change."""
    return F.struct(F.to_utc_timestamp(day.cast("timestamp"), zone).alias("start"), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone).alias("end"))


def history_factor(last: Column, now: Column) -> Column:
    """How much an earlier showing still counts: 1 in the first week, then .65, .35 and .2; .35 if unknown."""
    days = (F.unix_seconds(now) - F.unix_seconds(last)) / 86400
    return F.when(last.isNull(), 0.35).when(days <= 7, 1.0).when(days <= 30, 0.65).when(days <= 90, 0.35).otherwise(0.2)


def freshness(age: Column) -> Column:
    return F.coalesce(F.exp(-age.cast("double") / 21.0), F.lit(0.35))
