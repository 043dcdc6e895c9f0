"""From documents to chunks: the rows that are indexed, searched and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.paths import basename
from lexispark.functions.text import html_element, visible_text
from lexispark.scratch import cut


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def chunk_markdown(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content), cut at ATX headings.

    doc_title is the first level-one heading, else the file's name; section_title the heading of the chunk. A chunk
    that holds a fence has code. Ids run by path and position: a count within a path plus the rows of the paths
    before, so no order over all chunks is needed in one task.
    """
    text = F.concat(F.lit("\n"), F.coalesce("content", F.lit("")))
    marked = F.regexp_replace(text, r"\n(#{1,6}[ \t])", "\n\u0000$1")
    parts = files.select(
        F.col("path").alias("doc_path"), F.posexplode(F.split(marked, "\u0000")).alias("pos", "part"),
        F.trim(F.regexp_extract(text, r"\n#[ \t]+([^\n]*)", 1)).alias("h1")
    )
    heading = F.trim(F.regexp_extract("part", r"^#{1,6}[ \t]+([^\n]*)", 1))
    body = F.trim(F.regexp_replace("part", r"^#{1,6}[ \t][^\n]*", ""))
    title = F.when(F.col("h1") != "", F.col("h1")).otherwise(basename(F.col("doc_path")))
    rows = parts.select(
        "doc_path", "pos", title.alias("doc_title"),
        F.when(heading != "", heading).otherwise(title).alias("section_title"),
        F.trim(body, F.lit("\n ")).alias("content")
    )
    return number_chunks(rows.where("content != ''")).withColumns(
        {"tokens": estimated_tokens(F.col("content")), "has_code": F.contains("content", F.lit("```"))}
    )


def number_chunks(rows: DataFrame) -> DataFrame:
    """Add id: 1, 2, ... by (doc_path, pos).

    Paths are dealt into ranges, which are numbered side by side; as a whole, only a row for each range is ordered.
    """
    sizes = rows.groupBy("doc_path").agg(F.count("*").alias("n"))
    ranged = cut(sizes.repartitionByRange("doc_path").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("m"))
    before = parts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("doc_path")) - F.col("n")
    bases = ranged.withColumn("inside", run).join(F.broadcast(before), "part").select(
        "doc_path", (F.col("before") + F.col("inside")).alias("base")
    )  # ``before`` has a row for each partition
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_path").orderBy("pos")))
    return numbered.join(bases, "doc_path").withColumn(
        "id", (F.col("base") + F.col("at")).cast("bigint")
    ).drop("base", "at", "pos")


def document_chunks(docs: DataFrame) -> DataFrame:
    """One chunk for each row of documents: the source is its path."""
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("doc_path"), F.col("lang").alias("doc_title"), F.lit("").alias("section_title"), F.col("text").alias("content"),
        estimated_tokens(F.col("text")).alias("tokens"), F.contains("text", F.lit("```")).alias("has_code"),
    )


def page_chunks(pages: DataFrame) -> DataFrame:
    """One chunk for each web page: title, first heading, visible text."""
    text = visible_text(F.col("html"))
    return pages.select(
        F.col("page_id").alias("id"), F.regexp_replace("url", r"[?#].*$", "").alias("doc_path"), html_element(
            F.col("html"), "title"
        ).alias("doc_title"), html_element(F.col("html"), "h1").alias("section_title"), text.alias("content"),
    ).withColumns(
        {"tokens": estimated_tokens(F.col("content")), "has_code": F.col("content").rlike("(?i)<(pre|code)")}
    )
