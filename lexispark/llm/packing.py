"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two, largest first: as many of the full length as
fit, then the binary digits of the rest. Each piece is a sequence of its own in the bucket of its length, so no
sequence crosses documents and none is padded. Batches take sequences of one bucket, so many that all batches have the
same number of tokens; ``write_buckets`` writes a folder for each length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import small_batches

LONG_RUN = 10_000
SPACES = re.compile(rf"\s{{{LONG_RUN}}}")

_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE file as the library tokenizers gives them, special strings included as it reads them.

    The file's own vocabulary runs in tiktoken's engine, in a fifth of the library's time. The library itself encodes
    texts with very long runs of white space or of other characters, on which that engine's pattern can fail, and one
    text of each batch once more, as a check that both agree; where they don't, it encodes the whole batch.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or any(
            t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]
        ):
            raise ValueError("not a plain byte-level BPE file")
        self.library = Tokenizer.from_file(path)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The byte-level alphabet in the order of bytes: printable bytes stand for themselves, the others follow from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)
        }
        if set(byte_of) != set(ByteLevel.alphabet()):
            raise ValueError("another byte alphabet")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the pattern of byte-level BPE
        self.own = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and (SPACES.search(text) or max(map(len, text.split()), default=0) > LONG_RUN):
            return self._by_library(text)
        return self.own.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = [self.ids(t) for t in texts]
        k = next((k for k, t in enumerate(texts) if 0 < len(t) < LONG_RUN), None)
        if k is not None and not np.array_equal(out[k], self._by_library(texts[k])):
            return [self._by_library(t) for t in texts]
        return out


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(n: int, most: int) -> list[int]:
    """Lengths that add up to n: ``most`` as often as it fits, then falling powers of two."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if (n % most) >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 0, with_ids: bool = False,
    batch_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut every document into sequences of power-of-two lengths up to ``most`` (itself a power of two).

    A row per piece: the id, start (the document's ids before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers), doc_tokens, sequence_id, offset (always 0), bucket (the length's logarithm), batch_id
    and, with ``with_ids``, the ids. A batch has sequences of one bucket of one task, ``batch_tokens`` tokens in all;
    the last one of each may have fewer. A null or empty text is one piece, the end id; a long text is read whole, as
    one row. Rows with the same or a null id are documents of their own; their sequences differ. sequence_id and
    batch_id are the task's number and a count in it, so they are unique and the same whenever a task is run again on
    the same split. No rows give no pieces. Other columns are left out. No shuffle.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId() << 40
        seq, filled = task, np.zeros(most.bit_length(), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                doc, start, length, crc, total, ids = [], [], [], [], [], []
                for k, found in enumerate(enc.many(part.column(1).to_pylist())):
                    own = np.append(found, np.uint32(end_id)).astype("<u4")
                    s = 0
                    for n in pieces(len(own), most):
                        doc.append(k)
                        start.append(s)
                        length.append(n)
                        piece = own[s : s + n]
                        crc.append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                        s += n
                    total.append(len(own))
                doc = np.array(doc, np.int64)
                n = len(doc)
                lengths = np.array(length, np.int64)
                bucket = np.log2(lengths).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n) - np.searchsorted(bucket[order], bucket[order])
                no = (filled[bucket] + rank) // np.maximum(1, batch_tokens >> bucket)
                filled += np.bincount(bucket, minlength=len(filled))
                cols = [
                    part.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(
                        np.array(total, np.int64)[doc]
                    ),
                    pa.array(
                        np.arange(seq, seq + n, dtype=np.int64)
                    ), pa.array(np.zeros(n, np.int64)), pa.array(bucket),
                    pa.array(task + (bucket.astype(np.int64) << 32) + no),
                ]
                seq += n
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, batch_id bigint" + (
        ", ids array<int>" if with_ids else ""
    )
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def write_buckets(packed: DataFrame, at: str) -> None:
    """Write pieces below a folder, those of each length in a folder of their own (bucket=0, bucket=1, ...), so that a
    reader of one bucket reads sequences of one length only. Each task writes a file to each folder; no shuffle."""
    packed.write.partitionBy("bucket").option("compression", "zstd").parquet(at)
