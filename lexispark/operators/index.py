"""Searching an index: scores, phrases and literals from its tables, without reading texts.

A ranked search reads the windows' bounds of its terms first. The windows with the highest bounds of each facet are
scored; the score of the last candidate that is wanted is then a threshold, and of the others only windows whose bound
reaches it are scored at all. Phrases are found by intersecting positions. Scores are those of a scan over all chunks.
Only the chunks that an answer names are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.operators.postings import GRAMS, POSTINGS, bucket_of, grams, window_of, write_index
from lexispark.operators.reading import snippet_of
from lexispark.operators.search import DIGITS, FIELDS, Figures, answer, facet_scores, idf_of, part_of, top_of_facets
from lexispark.plans.planner import Facet, candidate_limit, plan_query
from lexispark.scratch import cut

__all__ = ["Index", "grep_index", "index_chunks", "open_index", "search_index", "write_index"]

#: Windows of each facet that are scored to find the threshold.
FIRST = 8
#: Chunks of a literal search that are verified first.
WAVE = 1024


@dataclass(frozen=True)
class Index:
    """A written index and the figures of its corpus."""

    spark: SparkSession
    root: str
    n: int
    mean: float
    buckets: int
    window: int
    shelf: int
    literal: bool
    schemas: dict[str, str | T.StructType] = field(repr=False)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")

    def rows_of(self, name: str, key: str, values: list) -> DataFrame:
        """The rows of some keys: a few folders, and in them the row groups that may have the keys."""
        if not values:
            return self.table(name).where("false")
        kind = self.table(name).schema[key].dataType.simpleString()
        one = self.spark.range(1).select(
            F.array_distinct(F.transform(F.array(*[F.lit(v).cast(kind) for v in values]), lambda v: bucket_of(v, self.buckets)))
        )
        return self.table(name).where(F.col("bucket").isin(one.first()[0]) & F.col(key).isin(values))

    def chunks(self) -> DataFrame:
        return self.table("chunks").drop("shelf")

    def chunks_of(self, ids: list[int]) -> DataFrame:
        """The chunks of a bounded list of ids, from the folders that can have them."""
        shelves = sorted({i // (self.window * self.shelf) for i in ids})
        return self.table("chunks").where(F.col("shelf").isin(shelves) & F.col("id").isin(ids)).drop("shelf")


def open_index(spark: SparkSession, root: str) -> Index:
    f = spark.read.parquet(f"{root}/figures").first()
    schemas = {
        "postings": f"{POSTINGS}, bucket int", "grams": f"{GRAMS}, bucket int",
        "chunks": T.StructType.fromJson(json.loads(f["chunks"]))
    }
    return Index(spark, root, f["n"], f["mean"] or 1.0, f["buckets"], f["window"], f["shelf"], f["literal"], schemas)


def _weight(fields: dict[str, float]) -> Column:
    """The weight of a row's field."""
    return reduce(lambda w, f: F.when(F.col("field") == f, F.lit(float(fields[f]))).otherwise(w), fields, F.lit(0.0))


def _overlaps(unit: tuple[str, ...]) -> bool:
    """Whether a phrase can begin inside an occurrence of itself."""
    return any(unit[k:] == unit[:-k] for k in range(1, len(unit)))


def _occurrences(starts: Column, unit: tuple[str, ...]) -> Column:
    """How often a phrase occurs without overlaps, given where it begins, in ascending order."""
    if not _overlaps(unit):
        return F.size(starts)
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    step = lambda s, p: F.when(
        p >= s["end"], F.struct((s["n"] + 1).alias("n"), (p + len(unit)).alias("end"))
    ).otherwise(s)
    return F.aggregate(starts, start, step)["n"]


def phrases(index: Index, units: Sequence[tuple[str, ...]], fields: dict[str, float] | None = None) -> DataFrame:
    """(unit, win, off, tf, len) of chunks that have a phrase: its number in ``units``, the weighted count, the length.

    The rows of a window and field meet in one task; where they have all of a phrase's tokens, the positions of a chunk's
    tokens, each moved back by its place in the phrase, are intersected.
    """
    fields = fields or FIELDS
    out = None
    for k, unit in enumerate(units):
        tokens = list(dict.fromkeys(unit))
        rows = index.rows_of("postings", "term", tokens).where(F.col("field").isin(list(fields)))
        placed = rows.select("field", "win", "term", "offs", "tfs", "lens", "positions").repartition(
            "field", "win"
        ).sortWithinPartitions("field", "win")
        found = placed.mapInArrow(
            lambda batches, unit=unit: _starts(batches, unit), "field string, win bigint, off int, len int, starts array<int>"
        ).withColumn("c", _occurrences(F.col("starts"), unit))
        one = found.groupBy("win", "off").agg(
            F.sum(F.col("c") * _weight(fields)).alias("tf"), F.first("len").alias("len")
        ).select(F.lit(k).alias("unit"), "win", "off", "tf", "len")
        out = one if out is None else out.unionByName(one)
    return out


def _starts(batches: Iterator[pa.RecordBatch], unit: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(field, win, off, len, starts) of chunks in which a phrase begins, from rows of its tokens sorted by field and
    window; a window may have several rows of a token."""
    at, held = None, {}

    def flush() -> pa.RecordBatch:
        have = [np.concatenate([p for p, _ in held[t]]) - by for by, t in enumerate(unit)]
        # A place is its chunk's in the window and its own in one number, one further, so none moves to another chunk.
        begin = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(have, key=len)) - len(unit)
        off = begin >> 32
        first = np.flatnonzero(np.diff(off, prepend=-1))
        own = off[first].astype(np.int32)
        lens = np.zeros(int(own.max(initial=0)) + 1, np.int32)
        for _, (o, n) in held[unit[0]]:
            lens[o[o < len(lens)]] = n[o < len(lens)]
        field, win = at
        return pa.RecordBatch.from_arrays(
            [
                pa.array([field] * len(own), pa.string()), pa.array(np.full(len(own), win, np.int64)), pa.array(own), pa.array(lens[own]),
                pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(begin)).astype(np.int32)), pa.array((begin & 0xFFFFFFFF).astype(np.int32))
                )
            ],
            ["field", "win", "off", "len", "starts"]
        )

    for b in batches:
        for i, (field, win, term) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)):
            if (field, win) != at:
                if at is not None and len(held) == len(set(unit)):
                    yield flush()
                at, held = (field, win), {}
            offs, tfs, lens, positions = (c.slice(i, 1).flatten().to_numpy().astype(np.int64) for c in b.columns[3:])
            held.setdefault(term, []).append(((np.repeat(offs, tfs) << 32) + positions + len(unit), (offs, lens)))
    if at is not None and len(held) == len(set(unit)):
        yield flush()


def _bound(tf: Column, length: Column, idf: float, mean: float) -> Column:
    """No chunk of a window scores higher for a unit; none has it where there is no count."""
    return F.when(tf > 0, part_of(tf, length, idf, mean))


def score_index(
    index: Index, facets: Sequence[Facet], fields: dict[str, float] | None = None, limit: int | None = None
) -> DataFrame:
    """A row (facet, score, id) for each facet that a chunk matches; with ``limit``, of each facet its best ``limit`` at least."""
    fields = fields or FIELDS
    usable = [(k, f) for k, f in enumerate(facets) if f.units and () not in f.units]
    units = list(dict.fromkeys(u for _, f in usable for u in f.units))
    none = index.spark.createDataFrame([], "facet int, score double, id bigint")
    if not units:
        return none
    words = [u[0] for u in units if len(u) == 1]
    longer = [u for u in units if len(u) > 1]
    postings = index.rows_of("postings", "term", words).where(F.col("field").isin(list(fields)))
    # What each window has of a word at most, from the bounds alone.
    best = postings.groupBy("win", "term", "field").agg(
        F.max("max_tf").alias("tf"), F.min("min_len").alias("len"), F.sum("own").alias("own")
    ).groupBy("win", "term").agg(
        F.sum(F.col("tf") * _weight(fields)).alias("tf"), F.min("len").alias("len"), F.sum("own").alias("own")
    ).select(F.col("term").alias("unit"), "win", "tf", "len", "own")
    found = cut(phrases(index, longer, fields)) if longer else None
    if found is not None:
        best = best.unionByName(
            found.groupBy("unit", "win").agg(F.max("tf").alias("tf"), F.min("len").alias("len"), F.count("*").alias("own"))
            .select(F.element_at(F.array(*[F.lit(" ".join(u)) for u in longer]), F.col("unit") + 1).alias("unit"), "win", "tf", "len", "own")
        )
    names = [" ".join(u) for u in units]
    of_unit = best.groupBy("unit").agg(F.sum("own").alias("df"), F.count("*").alias("wins")).collect()  # one row a unit
    df = {r["unit"]: r["df"] for r in of_unit}
    known = Figures(index.n, index.mean, [df.get(u, 0) for u in names])

    def scored(wins: DataFrame | None) -> DataFrame:
        """Scores in some windows, or in all."""
        within = lambda rows: rows if wins is None else rows.join(F.broadcast(wins), "win", "left_semi")
        each = within(postings).select("term", "field", "win", F.inline(F.arrays_zip("offs", "tfs", "lens"))).select(
            F.col("term").alias("unit"), "win", F.col("offs").alias("off"), (F.col("tfs") * _weight(fields)).alias("tf"),
            F.col("lens").alias("len")
        )
        if found is not None:
            name = F.element_at(F.array(*[F.lit(" ".join(u)) for u in longer]), F.col("unit") + 1)
            each = each.unionByName(within(found).withColumn("unit", name))
        rows = each.groupBy("win", "off").agg(
            F.first("len").alias("__len"),
            *[F.sum(F.when(F.col("unit") == u, F.col("tf")).otherwise(0.0)).alias(f"__u{i}") for i, u in enumerate(names)]
        ).withColumn("id", F.col("win") * index.window + F.col("off"))
        return facet_scores(rows, facets, units, known)

    # Where a unit has few windows in all, the first ones are most of them.
    if limit is None or max((r["wins"] for r in of_unit), default=0) <= 4 * FIRST:
        return scored(None)
    best = cut(best)
    # The bound of each facet in each window.
    by_window = best.groupBy("win").agg(
        *[F.max(F.when(F.col("unit") == u, F.col("tf"))).alias(f"t{i}") for i, u in enumerate(names)],
        *[F.min(F.when(F.col("unit") == u, F.col("len"))).alias(f"l{i}") for i, u in enumerate(names)]
    )
    bounds = []
    for k, f in usable:
        parts = []
        for u in f.units:
            i = units.index(u)
            parts.append(_bound(F.col(f"t{i}"), F.col(f"l{i}"), idf_of(known.n, known.df[i]), known.mean))
        # Without a unit, "all" of them is null; "any" of them counts it as nothing, and is null without any.
        total = reduce(lambda a, b: a + b, parts if f.mode == "all" else [F.coalesce(p, F.lit(0.0)) for p in parts])
        bounds.append(F.struct(F.lit(k).alias("facet"), F.when(F.coalesce(*parts).isNotNull(), total).alias("bound")))
    bounded = cut(by_window.select("win", F.inline(F.array(*bounds))).where("bound IS NOT NULL"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("bound"), "win"))
    ahead = cut(bounded.withColumn("r", rank).where(F.col("r") <= FIRST).select("win").distinct())
    first = cut(scored(ahead))
    reached = {
        r["facet"]: r["score"] for r in top_of_facets(first, limit).where(F.col("rank") == limit - 1).collect()
    }  # one row a facet
    # A facet that has not enough yet wants all of its windows. Scores are rounded, so a bound may be lower by as much.
    least = reduce(
        lambda w, f: F.when(F.col("facet") == f, F.lit(reached[f] - 2 * 10.0**-DIGITS)).otherwise(w), reached, F.lit(-1.0)
    )
    rest = bounded.where(F.col("bound") >= least).select("win").distinct().join(ahead, "win", "left_anti")
    rest = cut(rest)
    return first if rest.isEmpty() else first.unionByName(_in_windows(scored, rest))


def _in_windows(scored, wins: DataFrame, most: int = 100_000) -> DataFrame:
    """Scores in the windows, which are broadcast if they are few; where most windows are left, in all."""
    return scored(wins) if wins.limit(most + 1).count() <= most else scored(None)


def ranked(index: Index, topic: str, limit: int | None = None, fields: dict[str, float] | None = None) -> DataFrame:
    """The ranked chunks of each of a topic's facets, as ``search.candidates`` gives them."""
    wanted = candidate_limit(limit)
    best = cut(top_of_facets(score_index(index, plan_query(topic), fields, wanted), wanted))
    ids = [r["id"] for r in best.select("id").distinct().collect()]  # at most facets times their limit
    # A bounded list that an answer reads more than once: its texts are read from the index once.
    return cut(index.chunks_of(ids).join(F.broadcast(best), "id"))


def search_index(
    spark: SparkSession, root: str, topic: str, limit: int | None = None, max_tokens: int | None = None,
    seen: DataFrame | None = None, again: int | None = None
) -> DataFrame:
    """``search`` over an index."""
    index = open_index(spark, root)
    return answer(lambda most: ranked(index, topic, most), topic, limit, max_tokens, seen, again)


def literal_candidates(index: Index, pattern: str) -> DataFrame | None:
    """(id) of chunks that have all trigrams of a pattern, ascending within a window; None if it has no trigram."""
    lower = index.spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    own = grams(lower).tolist()
    if not own or not index.literal:
        return None
    rows = index.rows_of("grams", "gram", own)
    # A window's places of a trigram may lie in several rows; what all trigrams have in common stays.
    each = rows.groupBy("win", "gram").agg(F.flatten(F.collect_list("offs")).alias("offs"))
    common = each.groupBy("win").agg(F.collect_list("offs").alias("all")).where(F.size("all") == len(own))
    smallest_first = F.array_sort(F.transform("all", lambda a: F.struct(F.size(a).alias("n"), a.alias("a"))))
    offs = F.aggregate(
        F.slice(smallest_first, 2, len(own)), F.get(smallest_first, F.lit(0))["a"], lambda s, x: F.array_intersect(s, x["a"])
    )
    return common.select(
        "win", F.explode(offs).alias("off")
    ).select((F.col("win") * index.window + F.col("off")).alias("id"))


def grep_index(index: Index, pattern: str, limit: int | None = None) -> DataFrame:
    """``reading.grep`` over an index: candidates by trigrams, verified in their texts, a wave of ids at a time.

    Patterns of one or two characters have no trigram; for them all chunks are read.
    """
    if not 1 <= len(pattern) <= 200:
        raise ValueError("a pattern has 1 to 200 characters")
    most = max(1, min(limit if limit is not None else 20, 50))
    ids = literal_candidates(index, pattern)
    if ids is None:
        return snippet_of(index.chunks(), pattern).orderBy("id").limit(most)
    ids, at, wave, found = cut(ids), None, WAVE, []
    while len(found) < most:
        own = [
            r["id"] for r in (ids if at is None else ids.where(F.col("id") > at)).orderBy("id").limit(wave).collect()
        ]  # at most a wave
        if not own:
            break
        hits = snippet_of(index.chunks_of(own), pattern).orderBy("id").limit(most - len(found))
        found += hits.collect()
        if len(own) < wave:
            break
        at = own[-1]
    schema = snippet_of(index.chunks(), pattern).schema
    return index.spark.createDataFrame(found, schema)


def grep_index_all(index: Index, pattern: str) -> DataFrame:
    """All chunks that hold a literal, from the texts of the candidates alone."""
    ids = literal_candidates(index, pattern)
    if ids is None:
        return snippet_of(index.chunks(), pattern)
    shelf = window_of(F.col("id"), index.window * index.shelf)
    wanted = ids.withColumn("shelf", shelf)
    return snippet_of(index.table("chunks").join(wanted, ["shelf", "id"], "left_semi").drop("shelf"), pattern)


def index_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of an index."""
    return open_index(spark, root).chunks()
