"""Labels, buckets, scores, thresholds, messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def reputation(score: Column) -> Column:
    return F.when(
        score.isNull() | (score < 0), "Unknown"
    ).when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")


def popularity_range(installs: Column) -> Column:
    n = F.coalesce(installs, F.lit(0))
    return F.when(n <= 0, "0").when(n < 100, "<100").when(n < 500, "<500").when(n < 1000, "<1000").otherwise("1000+")


def popularity_score(stars: Column, weight: Column, sources: Column) -> Column:
    """Stars on a logarithmic scale, then the best source's weight, then how many sources know the library."""
    return F.round(
        F.log10(
            F.greatest(F.lit(10.0), stars + F.lit(10.0))
        ) * 1_000_000 + weight * 10_000 + F.least(F.lit(10), sources) * 100
    ).cast("bigint")


def refresh_days(rank: Column) -> Column:
    """How old an index may become, by the library's rank."""
    return F.when(rank <= 100, 1).when(rank <= 1000, 15).when(rank <= 5000, 30).otherwise(45)


def is_fresh(checked_at: Column, now: Column, days: Column | int = 1) -> Column:
    """Whether the last check is known and less than so many days ago."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(checked_at.cast("timestamp"))
    return F.coalesce(age < (days if isinstance(days, Column) else F.lit(days)) * F.lit(86_400_000_000), F.lit(False))


def token_expired(expires_at: Column, now: Column, skew_seconds: int = 60) -> Column:
    return F.unix_seconds(now.cast("timestamp")) >= F.unix_seconds(expires_at.cast("timestamp")) - skew_seconds


def status_message(status: Column, with_key: Column) -> Column:
    """What to tell a user about a failed request."""
    # The messages.
    return (
        F.when((status == 429) & with_key, "Rate limited or quota exceeded. Upgrade your plan for higher limits.")
        .when(status == 429, "Rate limited or quota exceeded. Create an API key for higher limits.")
        .when(status == 404, "The library you are trying to access does not exist.")
        .when(status == 401, "Invalid API key.")
        .otherwise(F.concat(F.lit("Request failed with status "), status.cast("string"), F.lit(".")))
    )


def hint(code: Column, hints: Mapping[str, str], default: str) -> Column:
    """A hint for an error code."""
    if not hints:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def first_alias(args: Column, canonical: str, aliases: list[str]) -> Column:
    """The value of an argument in a map, under its own name or the first alias that is there."""
    return F.coalesce(*[F.try_element_at(args, F.lit(n)) for n in (canonical, *aliases)])


def clamp(value: Column, least: int, most: int, default: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(value, F.lit(default))))


def paging(page: Column, total: Column, more: Column) -> Column:
    """Typed paging headers; null unless all can be read."""
    p, t = page.try_cast("int"), total.try_cast("int")
    m = F.when(F.lower(more) == "true", True).when(F.lower(more) == "false", False)
    return F.when(
        p.isNotNull() & t.isNotNull() & m.isNotNull(),
        F.struct(p.alias("page"), t.alias("total_pages"), m.alias("has_more"))
    )


def passes_quality(
    verified: Column, trust: Column, updated_days: Column, stars: Column, only_verified: bool = False,
    least_trust: float | None = None, most_days: int | None = None, least_stars: int | None = None
) -> Column:
    """A policy's quality filters; one that is not set lets all through, an unknown figure fails those that are."""
    tests = [verified] if only_verified else []
    tests += [trust >= least_trust] if least_trust is not None else []
    tests += [updated_days <= most_days] if most_days is not None else []
    tests += [stars >= least_stars] if least_stars is not None else []
    out = F.lit(True)
    for t in tests:
        out &= F.coalesce(t, F.lit(False))
    return out


def positive_number(text: Column, default: int) -> Column:
    """A positive whole number of a setting; else the default."""
    n = F.trim(text).try_cast("bigint")
    return F.when(n > 0, n).otherwise(F.lit(default))


def answer(status: Column, body: Column, with_key: Column) -> Column:
    """A hosted answer as a typed row: ok with its body, redirect with the new library, or error with a message."""
    moved = F.get_json_object(body, "$.redirectUrl")
    said = F.coalesce(F.get_json_object(body, "$.error"), F.get_json_object(body, "$.message"))
    kind = F.when((status == 301) & moved.isNotNull(), "redirect").when((status >= 200) & (status < 300), "ok").otherwise(
        "error"
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "ok", body).when(kind == "redirect", moved).otherwise(
            F.coalesce(said, status_message(status, with_key))
        ).alias("value")
    )
