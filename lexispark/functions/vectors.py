"""Vector functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for other lengths or a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0) | norms.isNull(), -1.0).otherwise(dot(a, b) / norms)


def embedding_text(doc_title: Column, section_title: Column, content: Column, most: int = 6000) -> Column:
    return F.concat_ws("\n", doc_title, section_title, F.substring(content, 1, most))


def query_text(query: str, most: int = 4000) -> str:
    """What of a query is embedded."""
    return query[:most]
