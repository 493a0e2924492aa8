"""Hashes, tiers, durations and scores as Column expressions. Times are explicit arguments, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a block of a tier is stale; 90 for others.
STALE_DAYS = {"short": 1, "medium": 30, "long": 180}


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(model: Column, text: Column) -> Column:
    """sha256 of model, a zero byte and text."""
    return F.sha2(F.concat(model, F.lit("\0"), text), 256)


def model_fingerprint(model: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(model)), 256), 1, 16)


def model_changed(before: Column, now: Column) -> Column:
    return (before != "") & (now != "") & (model_fingerprint(before) != model_fingerprint(now))


def etag(*parts: Column) -> Column:
    return F.concat(F.lit('"'), F.substring(F.sha2(F.concat(*parts), 256), 1, 12), F.lit('"'))


def short_id(key: Column) -> Column:
    return F.substring(key, 1, 8)


def block_id(content: Column, label: Column, at: Column) -> Column:
    return F.substring(F.sha2(F.concat(content, label, at.cast("string")), 256), 1, 16)


def tier(name: Column) -> Column:
    """short, medium or long, also from names with -term; null for others."""
    base = F.regexp_replace(F.lower(F.trim(name)), r"[-_]term$", "")
    return F.when(base.isin("short", "medium", "long"), base)


def seconds(duration: Column) -> Column:
    """Seconds of a duration such as 1h30m, 45s, 250ms, 30d or 2w; null if it isn't one."""
    units = {"w": 604800.0, "d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 1e-6, "ns": 1e-9}
    known = F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(v))])
    parts = F.regexp_extract_all(duration, F.lit(r"[0-9]+(?:\.[0-9]+)?(?:ms|us|ns|[wdhms])"), F.lit(0))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.regexp_extract(p, r"^[0-9.]+", 0).cast("double") * F.element_at(known, F.regexp_extract(p, "[a-z]+$", 0)))
    return F.when(duration.rlike(r"^(?:[0-9]+(?:\.[0-9]+)?(?:ms|us|ns|[wdhms]))+$"), total)


def time_or_ago(text: Column, now: Column) -> Column:
    """A timestamp, or now less a duration; null if the text is neither."""
    ago = F.timestamp_micros((F.unix_micros(now) - F.round(seconds(text) * 1_000_000)).cast("long"))
    return F.coalesce(F.try_to_timestamp(text), ago)


def to_number(value: Column) -> Column:
    """The longest numeric prefix; 0 without one."""
    return F.coalesce(F.regexp_extract(value.cast("string"), r"^\s*([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def validity(confirms: Column, conflicts: Column, age_days: Column, accesses: Column) -> Column:
    """Beta mean, halved every 90 days, raised with accesses, at most 1."""
    mean = (1 + confirms) / (2 + confirms + conflicts)
    return F.least(F.lit(1.0), mean * F.pow(F.lit(0.5), age_days / 90) * (1 + 0.1 * F.log(1 + accesses)))


def validity_label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score >= 0.2, "low").otherwise("unreliable")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "critical").when(score >= 0.5, "high").when(score >= 0.25, "medium").otherwise("low")


def stale(tier_name: Column, last: Column, now: Column) -> Column:
    days = F.lit(90)
    for name, n in STALE_DAYS.items():
        days = F.when(tier_name == name, n).otherwise(days)
    return F.unix_timestamp(now) - F.unix_timestamp(last) > days * 86400


def expired(expires_at: Column, now: Column) -> Column:
    return F.coalesce(now > expires_at, F.lit(False))
