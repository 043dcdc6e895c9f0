"""Reading around a result and literal search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import collapse


def neighbours(
    chunks: DataFrame, anchors: DataFrame, max_tokens: int | None = None, before: int = 2, after: int = 3
) -> DataFrame:
    """The chunks around each anchor (column anchor_id) in its document, within a budget, nearest first.

    Each anchor names its before + after + 1 ids, so it is an equi-join on document and id.
    """
    budget = max(500, min(max_tokens if max_tokens is not None else 5000, 10_000))
    a = chunks.select(F.col("id").alias("anchor_id"), "doc_path").join(
        anchors.select("anchor_id").distinct(), "anchor_id"
    )
    least, most = F.greatest(F.lit(1), F.col("anchor_id") - before), F.col("anchor_id") + after
    ids = F.array_union(
        F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<bigint>")),
        F.array(F.col("anchor_id"))
    )
    near = a.select("anchor_id", "doc_path", F.explode(ids).alias("id")).join(chunks, ["doc_path", "id"])
    visits = F.array_sort(F.collect_list(F.struct(F.abs(F.col("id") - F.col("anchor_id")).alias("d"), "id", "tokens")))
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("sum"))

    def step(s: Column, r: Column) -> Column:
        skip = (F.size(s["ids"]) > 0) & (s["sum"] + r["tokens"] > budget)
        return F.when(skip, s).otherwise(
            F.struct(
                F.array_append(s["ids"], r["id"]).alias("ids"), (s["sum"] + r["tokens"]).cast("bigint").alias("sum")
            )
        )

    chosen = near.groupBy("anchor_id").agg(
        F.aggregate(visits, start, step)["ids"].alias("ids")
    ).select("anchor_id", F.explode("ids").alias("id"))
    return near.join(chosen, ["anchor_id", "id"]).withColumn("is_anchor", F.col("id") == F.col("anchor_id"))


def grep(chunks: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Chunks that hold a literal pattern in any case, by id, with a snippet around its first place.

    The place is sought in the text on one line; a pattern that spans collapsed white space is found, with the start
    of the text as its snippet.
    """
    if not 1 <= len(pattern) <= 200:
        raise ValueError("a pattern has 1 to 200 characters")
    most = max(1, min(limit if limit is not None else 20, 50))
    return snippet_of(chunks, pattern).orderBy("id").limit(most)


def snippet_of(chunks: DataFrame, pattern: str) -> DataFrame:
    """All chunks that hold a literal pattern in any case, with a snippet."""
    needle = F.lower(F.lit(pattern))
    line = collapse(F.col("content"))
    at = F.instr(F.lower(line), needle) - 1
    hits = chunks.where(F.contains(F.lower("content"), needle))
    return hits.withColumn("snippet", F.substring(line, F.greatest(F.lit(0), at - 120) + 1, F.lit(360)))
