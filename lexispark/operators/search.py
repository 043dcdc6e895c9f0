"""Search: weighted BM25 for each facet, rank fusion, selection.

A search analyses each chunk once: its fields become token strings, in which native string functions count phrases,
and what stays is a few numbers a chunk, checkpointed in the shared folder. Corpus figures (count, mean length, document
frequencies) come from one aggregate over them, pre-aggregated in each task. The candidates of each facet are cut to
their limit before the shuffle, and only theirs are the texts that are read again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import IDENTIFIER, fingerprint, phrase_count, token_count, token_string
from lexispark.scratch import cut
from lexispark.plans.planner import Facet, candidate_limit, plan_query, terms, token_budget

K1, B = 1.2, 0.75
FIELDS = {"doc_title": 6.0, "section_title": 12.0, "content": 1.0}
DIGITS = 9
# Fixed values of the fusion.
RRF_K, TITLE_HIT, BODY_HIT, IDENTIFIER_HIT, LATE_FACET = 50, 0.018, 0.003, 0.025, 0.008


def analyzed(chunks: DataFrame, fields: dict[str, float] | None = None) -> DataFrame:
    """Chunks with a token string for each field (__t_<field>) and their length in tokens (__len)."""
    fields = fields or FIELDS
    out = chunks.withColumns({f"__t_{f}": token_string(F.col(f)) for f in fields})
    return out.withColumn("__len", sum((token_count(F.col(f"__t_{f}")) for f in fields), F.lit(0)))


def _unit_columns(units: Sequence[tuple[str, ...]], fields: dict[str, float]) -> dict[str, Column]:
    """For each unit its weighted count over the fields."""

    def count(unit: tuple[str, ...]) -> Column:
        return sum((phrase_count(F.col(f"__t_{f}"), list(unit)) * F.lit(w) for f, w in fields.items()), F.lit(0.0))

    return {f"__u{i}": count(u) for i, u in enumerate(units)}


@dataclass(frozen=True)
class Figures:
    """Of a corpus: chunks, their mean length, and in how many each unit occurs."""

    n: int
    mean: float
    df: list[int]


def idf_of(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def part_of(tf: Column, length: Column, idf: float, mean: float) -> Column:
    """What a unit adds to a score where it occurs."""
    return F.lit(idf) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean)))


def facet_scores(
    counted: DataFrame, facets: Sequence[Facet], units: Sequence[tuple[str, ...]], known: Figures
) -> DataFrame:
    """(facet, score, id) of rows (id, __len, a weighted count __u<i> for each unit)."""

    def score(u: tuple[str, ...]) -> Column:
        i = units.index(u)
        tf = F.col(f"__u{i}")
        return F.when(tf > 0, part_of(tf, F.col("__len"), idf_of(known.n, known.df[i]), known.mean)).otherwise(0.0)

    scored = []
    for k, f in enumerate(facets):
        if not f.units or () in f.units:
            continue
        hits = [F.col(f"__u{units.index(u)}") > 0 for u in f.units]
        match = hits[0]
        for h in hits[1:]:
            match = (match | h) if f.mode == "any" else (match & h)
        scored.append(
            F.when(
                match,
                F.struct(
                    F.lit(k).alias("facet"),
                    F.round(sum((score(u) for u in f.units), F.lit(0.0)), DIGITS).alias("score")
                )
            )
        )
    if not scored:
        return counted.where("false").select(F.lit(0).alias("facet"), F.lit(0.0).alias("score"), "id")
    return counted.select("id", F.explode(F.array_compact(F.array(*scored))).alias("__s")).select("__s.*", "id")


def score_facets(
    chunks: DataFrame, facets: Sequence[Facet], fields: dict[str, float] | None = None,
    corpus: tuple[int, float] | None = None
) -> DataFrame:
    """A row (facet, score, id) for each facet that a chunk matches.

    ``corpus`` is the number of chunks and their mean length where ``chunks`` are only those that can match.
    """
    fields = fields or FIELDS
    units = list(dict.fromkeys(u for f in facets for u in f.units if u))
    counted = analyzed(chunks, fields).withColumns(_unit_columns(units, fields))
    counted = cut(counted.select("id", "__len", *[f"__u{i}" for i in range(len(units))]))
    stats = counted.agg(
        F.count("*").alias("n"), F.avg("__len").alias("mean"),
        *[F.sum(F.when(F.col(f"__u{i}") > 0, 1).otherwise(0)).alias(f"d{i}") for i in range(len(units))]
    ).first()
    n, mean = corpus or (stats["n"], stats["mean"] or 1.0)
    return facet_scores(counted, facets, units, Figures(n, mean, [stats[f"d{i}"] or 0 for i in range(len(units))]))


def top_of_facets(scored: DataFrame, limit: int) -> DataFrame:
    """The best chunks of each facet, ranked from 0; ties by id."""
    w = Window.partitionBy("facet").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


def with_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked candidates with their chunks' columns; they are at most as many as facets times their limit."""
    return chunks.join(F.broadcast(ranked), "id")


def candidates(chunks: DataFrame, topic: str, limit: int | None = None, corpus: tuple[int, float] | None = None) -> DataFrame:
    """The ranked chunks of each of a topic's facets."""
    scored = score_facets(chunks, plan_query(topic), corpus=corpus)
    return with_chunks(top_of_facets(scored, candidate_limit(limit)), chunks)


def lexical_boost(query_terms: Sequence[str]) -> Column:
    """What a chunk gains for terms in its titles and in its text, more for identifiers."""
    title, body = F.lower(F.concat_ws(" ", "doc_title", "section_title")), F.lower("content")
    hits = lambda where, of: sum((F.contains(where, F.lit(t)).cast("int") for t in of), F.lit(0))
    names = [t for t in query_terms if re.search(IDENTIFIER, t)]
    return hits(title, query_terms) * F.lit(TITLE_HIT) + hits(body, query_terms) * F.lit(BODY_HIT) + hits(body, names) * F.lit(IDENTIFIER_HIT)


def fuse(ranked: DataFrame, query_terms: Sequence[str], seen: DataFrame | None = None) -> DataFrame:
    """Merge the facets' ranked lists: reciprocal ranks add up, boosts count once, chunks already seen are left out.

    Ranks are given before chunks are left out. Rows: the chunk's columns, score, matched_queries.
    """
    if seen is not None:
        ranked = ranked.join(seen.select("id").distinct(), "id", "left_anti")
    own = [c for c in ranked.columns if c not in ("facet", "score", "rank", "id")]
    merged = ranked.groupBy("id").agg(
        F.sum(
            F.lit(1.0) / (F.col("rank") + (RRF_K + 1))
        ).alias("rrf"), F.count("*").alias("matched_queries"), F.min("facet").alias("first_facet"), F.first(F.struct(*own)).alias("chunk")
    )
    rows = merged.select("id", "chunk.*", "rrf", "matched_queries", "first_facet")
    late = F.when(F.col("first_facet") > 1, LATE_FACET).otherwise(0.0)
    return rows.withColumn(
        "score", F.round(F.col("rrf") + lexical_boost(query_terms) + late, DIGITS)
    ).drop("rrf", "first_facet")


def select_diverse(matches: DataFrame, budget: int, limit: int, per_document: int = 3) -> DataFrame:
    """Take matches in order unless their document has enough, their like was taken, or the budget would be passed.

    The first always fits. What is left out changes nothing. The matches of one search are a bounded list (facets
    times their limit), so the fold runs in one row.
    """
    order = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("score")).alias("s"), (-F.col("matched_queries")).alias("m"), "id", "doc_path", "tokens",
                fingerprint(F.col("content")).alias("print")
            )
        )
    )
    start = F.struct(
        F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("paths"),
        F.array().cast("array<string>").alias("prints"), F.lit(0).cast("bigint").alias("tokens")
    )

    def step(s: Column, r: Column) -> Column:
        full = F.size(F.filter(s["paths"], lambda p: p == r["doc_path"])) >= per_document
        over = (F.size(s["ids"]) > 0) & (s["tokens"] + r["tokens"] > budget)
        skip = full | F.array_contains(s["prints"], r["print"]) | over | (F.size(s["ids"]) >= limit)
        taken = F.struct(
            F.array_append(s["ids"], r["id"]).alias("ids"), F.array_append(
                s["paths"], r["doc_path"]
            ).alias("paths"), F.array_append(s["prints"], r["print"]).alias("prints"), (
                s["tokens"] + r["tokens"]
            ).cast("bigint").alias("tokens")
        )
        return F.when(skip, s).otherwise(taken)

    chosen = matches.agg(
        F.aggregate(order, start, step)["ids"].alias("ids")
    ).select(F.posexplode("ids").alias("position", "id"))
    return matches.join(F.broadcast(chosen), "id")  # at most ``limit`` rows


def answer(
    find: Callable[[int | None], DataFrame], topic: str, limit: int | None = None, max_tokens: int | None = None,
    seen: DataFrame | None = None, again: int | None = None
) -> DataFrame:
    """Fuse and select what ``find`` ranks for a limit; position gives the order of the answer.

    If all that matches was seen before, it is searched again with nothing left out, with the limit ``again`` if given.
    """
    if not 1 <= len(topic) <= 2000:
        raise ValueError("a topic has 1 to 2000 characters")
    matches = fuse(find(limit), terms(topic), seen)
    if seen is not None and matches.isEmpty():
        return answer(find, topic, limit if again is None else again, max_tokens)
    return select_diverse(matches, token_budget(topic, max_tokens), limit if limit is not None else 12)


def search(
    chunks: DataFrame, topic: str, limit: int | None = None, max_tokens: int | None = None,
    seen: DataFrame | None = None, corpus: tuple[int, float] | None = None, again: int | None = None
) -> DataFrame:
    """Search chunks for a topic: see ``answer``."""
    return answer(lambda most: candidates(chunks, topic, most, corpus), topic, limit, max_tokens, seen, again)


def legacy_top(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The baseline that searches are compared with: any of the first 16 words, weights 5, 10 and 1."""
    words = [w for w in dict.fromkeys(re.findall(r"\w+", query.lower())) if len(w) > 1][:16]
    scored = score_facets(
        chunks, [Facet("any", tuple((w,) for w in words))], {"doc_title": 5.0, "section_title": 10.0, "content": 1.0}
    )
    return with_chunks(top_of_facets(scored, k), chunks)


def build_postings(chunks: DataFrame, fields: dict[str, float] | None = None) -> DataFrame:
    """The inverted index: (term, id, field, tf). Written clustered by term, it answers a query without a text scan."""
    fields = fields or FIELDS
    pairs = None
    for f in fields:
        one = chunks.select(
            "id", F.lit(f).alias("field"), F.explode(F.split(F.trim(token_string(F.col(f))), " +")).alias("term")
        ).where("term != ''")
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs.groupBy("term", "id", "field").agg(F.count("*").alias("tf"))
