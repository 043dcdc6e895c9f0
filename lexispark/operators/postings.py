"""The tables of an index over chunks: postings with positions, trigrams, the chunks themselves, and the corpus' figures.

Ids are dealt into windows of equal width. A posting row holds what one window has of a term in a field: places in the
window, counts, lengths and positions, and with them the largest count and the smallest length, from which no score of
the window can be higher. Windows are the same for all terms, so what terms have in common is found window by window.
Rows lie in folders by the hash of their term, sorted in them; chunks lie in folders of neighbouring windows. Numbers
are delta-coded by the file format.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import token_string
from lexispark.operators.search import FIELDS

WINDOW, SHELF = 1024, 64
#: Chunks of a folder of postings and trigrams, and how many folders there are at most.
FOLDER, MOST_FOLDERS = 4096, 4096
#: Tokens and trigrams that a task holds before it writes what it has of a window.
HELD = 1 << 21
#: Delta coding of numbers.
FORMAT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true"}

POSTINGS = (
    "term string, field string, win bigint, n int, own int, max_tf int, min_len int, offs array<int>, tfs array<int>,"
    " lens array<int>, positions array<int>"
)
GRAMS = "gram bigint, win bigint, n int, offs array<int>"


def window_of(i: Column, width: int = WINDOW) -> Column:
    """The window of an id; the last one below zero is -1."""
    return F.call_function("div", i - F.pmod(i, F.lit(width)), F.lit(width))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All tokens of token strings: of each the number of its text, itself, and its place in the text."""
    lists = pc.split_pattern(pc.utf8_trim(texts, " "), "  ")
    n, tokens = pc.list_value_length(lists).to_numpy(), lists.flatten()
    text, place = np.repeat(np.arange(len(n)), n), np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    some = pc.not_equal(tokens, "")  # a text without any is one empty token
    keep = some.to_numpy(zero_copy_only=False)
    return text[keep], tokens.filter(some), place[keep]


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one window each, at most as many as have ``most`` bytes of text, a longer text alone."""
    for b in batches:
        wins = b.column(0).to_numpy()
        size = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[2:])
        block = np.cumsum(size) // most
        ends = np.flatnonzero((np.diff(wins) != 0) | (np.diff(block) != 0)) + 1
        for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), len(wins)], strict=True):
            if end > begin:
                yield int(wins[begin]), b.slice(begin, end - begin)


def _rows_of(win: int, fields: list[str], offs: np.ndarray, tokens: pa.Array, at: np.ndarray) -> pa.RecordBatch:
    """Rows of ``POSTINGS`` of one window: of each token its field, the number of its chunk among ``offs``, its place."""
    field, chunk, place = at
    lens = np.bincount(chunk, minlength=len(offs))
    terms = tokens.dictionary_encode()
    key = terms.indices.to_numpy().astype(np.int64) * len(fields) + field
    order = np.argsort(key, kind="stable")
    key, chunk = key[order], chunk[order]
    # Where a posting begins: a term in a field of a chunk; and where a row begins.
    first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(chunk) != 0)])[: len(key)])
    tf = np.diff(np.append(first, len(key)))
    key, chunk = key[first], chunk[first]
    rows = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])[: len(key)])
    ends = np.append(rows, len(key))
    # A chunk counts for a term in the first field that has it.
    own, pair, kind = np.ones(len(key), np.int32), key // len(fields) * len(offs) + chunk, key % len(fields)
    for f in range(1, len(fields)):
        before, mine = np.unique(pair[kind < f]), kind == f
        if len(before) and mine.any():
            near = before[np.minimum(np.searchsorted(before, pair[mine]), len(before) - 1)]
            own[mine] = near != pair[mine]
    length = lens[chunk].astype(np.int32)
    lists = lambda x, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x.astype(np.int32)))
    of = lambda f, x: pa.array(f.reduceat(x, rows).astype(np.int32) if len(rows) else np.zeros(0, np.int32))
    return pa.RecordBatch.from_arrays(
        [
            terms.dictionary.take(pa.array(key[rows] // len(fields))), pa.array(fields, pa.string()).take(pa.array(kind[rows])),
            pa.array(np.full(len(rows), win, np.int64)), pa.array(np.diff(ends).astype(np.int32)), of(np.add, own),
            of(np.maximum, tf), of(np.minimum, length), lists(offs[chunk], ends), lists(tf, ends), lists(length, ends),
            lists(place[order], np.append(first, len(order))[ends])
        ],
        [f.split()[0] for f in POSTINGS.split(", ")]
    )


def _post(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``POSTINGS`` from rows (win, off, a token string for each field) that come sorted by window."""
    offs: list[np.ndarray] = []
    found: list[pa.Array] = []
    where: list[np.ndarray] = []
    at, held, chunks = None, 0, 0

    def flush() -> pa.RecordBatch:
        return _rows_of(at, fields, np.concatenate(offs), pa.concat_arrays(found), np.concatenate(where, axis=1))

    for win, piece in pieces(batches, 4 * HELD):
        if win != at or held > HELD:
            if held:
                yield flush()
            offs, found, where = [], [], []
            at, held, chunks = win, 0, 0
        for f in range(len(fields)):
            chunk, tokens, place = tokens_of(piece.column(2 + f))
            found.append(tokens)
            where.append(np.stack([np.full(len(tokens), f), chunk + chunks, place]))
            held += len(found[-1])
        offs.append(piece.column(1).to_numpy())
        chunks += piece.num_rows
    if held:
        yield flush()


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each three code points in one number."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``GRAMS`` from rows (win, off, lower-case text) that come sorted by window."""
    found: list[np.ndarray] = []
    offs: list[int] = []
    at, held = None, 0

    def flush() -> pa.RecordBatch:
        gram = np.concatenate(found)
        off = np.repeat(np.array(offs, np.int32), [len(g) for g in found])
        order = np.argsort(gram, kind="stable")
        own, first = np.unique(gram[order], return_index=True)
        ends = np.append(first, len(gram)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(own), pa.array(np.full(len(own), at, np.int64)), pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(off[order]))
            ],
            [f.split()[0] for f in GRAMS.split(", ")]
        )

    for b in batches:
        for win, off, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if win != at or held > HELD:
                if found:
                    yield flush()
                found, offs = [], []
                at, held = win, 0
            found.append(grams(text or ""))
            offs.append(off)
            held += len(found[-1])
    if found:
        yield flush()


def _by_window(chunks: DataFrame, window: int) -> DataFrame:
    """Chunks with their window and place in it, a window's together and in order."""
    own = chunks.withColumns(
        {"__win": window_of(F.col("id"), window), "__off": F.pmod("id", F.lit(window)).cast("int")}
    )
    return own.repartition("__win").sortWithinPartitions("__win", "__off")


def _write(rows: DataFrame, key: str, buckets: int, path: str) -> None:
    """Rows in folders by the hash of their key, sorted by key and window; a key that most windows have is spread over
    tasks by window, so a folder has a few sorted files."""
    dealt = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
    dealt = dealt.repartition("bucket", F.pmod(F.xxhash64("win"), F.lit(4))).sortWithinPartitions("bucket", key, "win")
    dealt.write.options(**FORMAT).partitionBy("bucket").mode("overwrite").parquet(path)


def write_index(
    chunks: DataFrame, root: str, buckets: int | None = None, window: int = WINDOW, shelf: int = SHELF, literal: bool = True
) -> None:
    """Write chunks, postings, trigrams (if ``literal``) and figures below a folder.

    ``window`` is the width of a window in ids, ``shelf`` the windows of one folder of chunks, ``buckets`` the folders of
    postings, by the number of chunks if it isn't given. Ids are distinct.
    """
    fields = list(FIELDS)
    if buckets is None:
        buckets = min(MOST_FOLDERS, chunks.count() // FOLDER + 1)
    own = chunks.withColumn("shelf", window_of(F.col("id"), window * shelf))
    own.repartition("shelf", F.pmod(window_of(F.col("id"), window), F.lit(4))).sortWithinPartitions("shelf", "id").write.partitionBy(
        "shelf"
    ).mode("overwrite").parquet(f"{root}/chunks")
    placed = _by_window(chunks, window)
    token_strings = placed.select("__win", "__off", *[token_string(F.col(f)).alias(f"__t_{f}") for f in fields])
    _write(token_strings.mapInArrow(lambda b: _post(b, fields), POSTINGS), "term", buckets, f"{root}/postings")
    if literal:
        lower = placed.select("__win", "__off", F.lower(F.coalesce("content", F.lit(""))).alias("text"))
        _write(lower.mapInArrow(_grams, GRAMS), "gram", buckets, f"{root}/grams")
    spark, kept = chunks.sparkSession, own.schema.json()
    # Every token of a chunk is in one posting, so the lengths' sum is that of the counts.
    tokens = spark.read.schema(POSTINGS).parquet(f"{root}/postings").agg(
        F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0)).alias("tokens")
    )
    spark.read.schema(own.schema).parquet(f"{root}/chunks").agg(F.count("*").alias("n")).crossJoin(tokens).select(
        "n", F.try_divide("tokens", "n").alias("mean"), F.lit(buckets).alias("buckets"),
        F.lit(window).alias("window"), F.lit(shelf).alias("shelf"), F.lit(literal).alias("literal"),
        F.lit(kept).alias("chunks")
    ).coalesce(1).write.mode("overwrite").parquet(f"{root}/figures")
