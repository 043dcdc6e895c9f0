"""URL filters by a Bloom filter cascade.

A cascade stores which keys of a known universe are listed. Level 1 encodes the listed keys; the keys of the
universe that it wrongly accepts are encoded in level 2; the listed keys that level 2 wrongly accepts in level 3,
and so on until no key is wrong. A lookup asks the levels in turn, so membership is exact for every key of the
universe and needs no join: each level is one binary literal, named once in the expression. Its size follows the list,
not the corpus.

Only DataFrame and SQL functions run here. What goes to the driver is the bytes of the levels, whose size is
checked (``max_bits``).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import ascii_lower, cut


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    data: bytes


def _positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + j), key), F.lit(bits)) for j in range(hashes)]


def _in(level: Level, data: Column, key: Column) -> Column:
    """Whether a key's bits are all set in the level's bytes, given as a column."""

    def is_set(p: Column) -> Column:
        at = F.conv(F.hex(F.substring(data, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", at, p.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1

    hit = F.lit(True)
    for p in reversed(_positions(key, level.seed, level.bits, level.hashes)):
        hit = F.when(is_set(p), hit).otherwise(False)
    return hit


def _has(level: Level, key: Column) -> Column:
    return F.transform(F.array(F.lit(level.data)), lambda data: _in(level, data, key))[0]


def _level(keys: DataFrame, seed: int, bits_per_key: int, hashes: int, max_bits: int) -> Level | None:
    """A Bloom filter over the column ``key``; None if there are no keys."""
    n = keys.count()
    if not n:
        return None
    bits = max(64, 1 << (n * bits_per_key - 1).bit_length())
    if bits > max_bits:
        raise ValueError(f"{n} keys need a filter of {bits} bits; max_bits is {max_bits}")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, bits, hashes))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("mask")).collect()
    words = [0] * (bits // 64)
    for r in rows:  # at most bits / 64 rows
        words[r["word"]] = r["mask"]
    return Level(seed, bits, hashes, struct.pack(f"<{len(words)}q", *words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed; a null key is not."""
        hit = F.lit(False)
        for level in reversed(self.levels):
            hit = F.when(_has(level, key), ~hit).otherwise(False)
        return F.coalesce(hit, F.lit(False))

    def listed(self, keys: Column) -> Column:
        """Those of an array of keys that are listed, in their order; each level's bytes are bound once."""

        def asked(k: int, data: list[Column]) -> Column:
            if k < len(self.levels):
                literal = F.array(F.lit(self.levels[k].data))
                return F.transform(literal, lambda d: asked(k + 1, [*data, d]))[0]

            def hit(key: Column) -> Column:
                out = F.lit(False)
                for level, d in reversed(list(zip(self.levels, data, strict=True))):
                    out = F.when(_in(level, d, key), ~out).otherwise(False)
                return out

            return F.filter(keys, lambda key: F.coalesce(hit(key), F.lit(False)))

        return asked(0, [])


def build_cascade(
    listed: DataFrame, universe: DataFrame, bits_per_key: int = 12, hashes: int = 4, max_bits: int = 1 << 26,
    max_levels: int = 32
) -> Cascade:
    """The cascade of the listed keys over the universe; both have a column ``key``.

    Duplicates and nulls in either are ignored. An empty list gives a cascade that contains nothing. The universe is
    scanned once: only keys that level 1 accepts (listed ones and a few in a thousand others) are shuffled.
    """
    listed = cut(listed.select("key").where(F.col("key").isNotNull()).distinct())
    first = _level(listed, 1, bits_per_key, hashes, max_bits)
    if first is None:
        return Cascade(())
    passed = universe.select("key").where(F.col("key").isNotNull() & _has(first, F.col("key")))
    marked = passed.withColumn("mark", F.lit(0)).unionByName(listed.withColumn("mark", F.lit(1)))
    wrong = cut(marked.groupBy("key").agg(F.max("mark").alias("mark")).where("mark = 0").select("key"))
    levels, inside, outside = [first], listed, wrong
    while len(levels) < max_levels:
        nxt = _level(outside, len(levels) + 1, bits_per_key, hashes, max_bits)
        if nxt is None:
            return Cascade(tuple(levels))
        levels.append(nxt)
        inside, outside = outside, cut(inside.where(_has(nxt, F.col("key"))))
    raise RuntimeError("the cascade did not end; raise bits_per_key")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. A url that is null or has no ``://`` gives two empty strings."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """The strings ``host suffix + path prefix`` that could be one of the rules, longest first.

    Only suffixes with as many labels and prefixes as long as some rule's are made, so the array is as long as there
    are shapes of rules, whatever the url's length.
    """
    shapes = {(h.count(".") + 1, len(r) - len(h)) for r in rules for h in [r.split("/")[0]]}
    labels = F.size(F.split(host, r"\."))
    made = [
        F.when(
            (labels >= n) & (F.length(path) >= k), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k))
        )
        for n, k in sorted(shapes)
    ]
    keys = F.array_distinct(F.array_compact(F.array(*made)))
    by = lambda a, b: F.when(
        F.length(a) != F.length(b), F.sign(F.length(b) - F.length(a))
    ).when(a < b, -1).when(a > b, 1).otherwise(0).cast("int")
    return F.array_sort(keys, by)


def filter_urls(pages: DataFrame, rules: dict[str, str], default: str = "allow", url: str = "url") -> DataFrame:
    """Judge every row's url by rules ``host/path -> allow or block``; the longest rule that fits wins.

    Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (``default`` where the cascades list no key
    of the url). All rows and columns stay; columns of these names are replaced. Rules that contain no ``/`` are
    refused. Null, empty and malformed urls fit no rule, very long ones are read whole; an empty table stays empty;
    rows of equal urls get equal verdicts.
    """
    if bad := [r for r in rules if "/" not in r]:
        raise ValueError(f"rules without a path: {bad}")
    host, path = split_url(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    keys = rule_keys(F.col("host"), F.col("path"), list(rules))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    universe = parts.select(F.explode(keys).alias("key"))
    spark = pages.sparkSession
    cascades = {
        verdict: build_cascade(spark.createDataFrame([(r,) for r in own], "key string"), universe)
        for verdict in sorted(set(rules.values()))
        if (own := [r for r, v in rules.items() if v == verdict])
    }
    # The longest listed key of each verdict; keys come longest first, and a key is in one cascade only.
    found = F.array(
        *[F.struct(F.get(c.listed(keys), F.lit(0)).alias("rule"), F.lit(v).alias("verdict")) for v, c in cascades.items()]
    )
    longest = F.array_sort(
        F.filter(found, lambda x: x["rule"].isNotNull()),
        lambda a, b: F.when(F.length(a["rule"]) > F.length(b["rule"]), -1).when(
            F.length(a["rule"]) < F.length(b["rule"]), 1
        ).when(a["rule"] < b["rule"], -1).otherwise(1)
    )
    best = "best"
    while best in parts.columns:
        best += "_"
    return (
        parts.withColumn(best, F.get(longest, F.lit(0)))
        .withColumns({"rule": F.col(best)["rule"], "verdict": F.coalesce(F.col(best)["verdict"], F.lit(default))})
        .drop(best)
    )
