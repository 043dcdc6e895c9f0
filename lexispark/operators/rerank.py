"""Rerank search results by embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.vectors import cosine

LEXICAL, SEMANTIC = 0.65, 0.35


def normalized(c: str) -> Column:
    """A score between 0 and 1 over the candidates; 1 if all are equal."""
    w = Window.partitionBy()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, 1.0).otherwise((F.col(c) - lo) / (hi - lo))


def rerank(matches: DataFrame, vectors: DataFrame, query: list[float], candidates: int = 24) -> DataFrame:
    """Blend lexical and cosine scores over a bounded number of candidates; fewer than two stay as they are.

    Rows without a vector have similarity -1. position counts from 0 by score, then id. The candidates are few, so their
    windows have one partition.
    """
    top = matches.orderBy(F.desc("score"), "id").limit(max(2, candidates))
    q = F.array(*[F.lit(float(x)) for x in query])
    own = top.join(vectors.select(F.col("id"), F.col("embedding")), "id", "left").withColumn(
        "similarity", F.coalesce(cosine(F.col("embedding"), q), F.lit(-1.0))
    )
    own = own.withColumns(
        {
            "lexical": normalized("score"), "semantic": normalized("similarity"),
            "few": F.count("*").over(Window.partitionBy()) < 2
        }
    )
    blended = F.when(F.col("few"), F.col("score")).otherwise(
        F.round(F.col("lexical") * LEXICAL + F.col("semantic") * SEMANTIC, 9)
    )
    own = own.withColumn("score", blended).drop("embedding", "lexical", "semantic", "few")
    return own.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)


def sliced(ranked: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` results by position."""
    return ranked.where(F.col("position") < limit)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select("id"), "id", "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a keyed table after new rows have replaced those of their keys."""
    return current.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def cosine_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors nearest to one query by cosine; a scan with a top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn(
        "similarity", F.round(cosine(F.col("embedding"), q), 6)
    ).orderBy(F.desc("similarity"), "id").limit(k)
