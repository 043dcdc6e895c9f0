"""Streams of JSON lines that come in chunks of bytes, cut anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.running import running_sum

EVENT = "type string, content string, libraryName string, message string"
#: One character for each byte, so that bytes are cut and put together as texts.
BYTES = "ISO-8859-1"
SPACES = r"^[\s ﻿]+|[\s ﻿]+$"


def chunk_summary(data: Column) -> Column:
    """What a chunk of bytes is to the lines of its stream: its head (up to the first line end), its whole lines, its tail
    (after the last one); without a line end all of it is head and the tail is null.

    Summaries compose: of two chunks, the first's tail and the second's head are one line, or part of one.
    """
    parts = F.split(F.decode(data, BYTES), "\n", -1)
    n = F.size(parts)
    return F.struct(
        F.get(parts, F.lit(0)).alias("head"),
        F.when(n > 2, F.slice(parts, F.lit(2), n - 2)).otherwise(F.array().cast("array<string>")).alias("lines"),
        F.when(n > 1, F.element_at(parts, -1)).alias("tail"), (n - 1).cast("bigint").alias("ends")
    )


def chunk_lines(chunks: DataFrame, stream: str = "stream", seq: str = "seq", data: str = "data") -> DataFrame:
    """(stream, line, value): the lines of each stream, numbered from 0, of its chunks in the order of ``seq``.

    A chunk is cut where the network cut it, within a line or a character. The number of line ends before a chunk, a
    running sum, says which line its head belongs to; pieces of a line are put together by its number. What follows the
    last line end is a line as well. Null chunks are empty; bytes that are no UTF-8 become replacement characters.
    """
    cutted = chunks.select(
        F.col(stream).alias("stream"), F.col(seq).alias("seq"),
        chunk_summary(F.coalesce(F.col(data), F.lit(b""))).alias("c")
    )
    placed = running_sum(cutted, ["stream"], ["seq"], F.col("c.ends"), "before")
    piece = lambda line, k, text: F.struct(line.alias("line"), F.lit(k).alias("k"), text.alias("text"))
    whole = F.transform("c.lines", lambda x, i: piece(F.col("before") + 1 + i, 0, x))
    ends = F.array_compact(
        F.array(
            piece(F.col("before"), 0, F.col("c.head")),
            F.when(F.col("c.tail").isNotNull(), piece(F.col("before") + F.col("c.ends"), 1, F.col("c.tail")))
        )
    )
    pieces = placed.select("stream", "seq", F.explode(F.concat(whole, ends)).alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "p.k", "p.text"))), lambda x: x["text"]), "")
    return pieces.groupBy("stream", F.col("p.line").alias("line")).agg(
        F.decode(F.encode(joined, BYTES), "UTF-8").alias("value")
    )


def chunk_events(chunks: DataFrame, stream: str = "stream", seq: str = "seq", data: str = "data") -> DataFrame:
    """The events (stream, line, type, content, libraryName, message) of the lines of byte chunks; empty and malformed
    lines are left out."""
    lines = chunk_lines(chunks, stream, seq, data)
    return lines.select("stream", "line", F.from_json(F.regexp_replace("value", SPACES, ""), EVENT).alias("e")).where(
        "e.type IS NOT NULL"
    ).select("stream", "line", "e.*")


def stream_outcome(events: DataFrame) -> DataFrame:
    """What each stream came to: (stream, content, library_name, error).

    content and library_name are those of the last complete event, error the message of the last error event; one does
    not displace the other. Without a complete event content is empty; a stream without either event has no row.
    """
    done, failed = F.col("type") == "complete", F.col("type") == "error"
    last = lambda value, when: F.max_by(value, F.when(when, F.col("line")))
    return events.where(done | failed).groupBy("stream").agg(
        F.coalesce(last(F.col("content"), done), F.lit("")).alias("content"),
        last(F.col("libraryName"), done).alias("library_name"), last(F.col("message"), failed).alias("error")
    )
