import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm.packing import encoder, pack, pieces, write_buckets
from lexispark.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def check(df, got):
    left = {}
    for r in df.collect():
        ids = [*LIB.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        left.setdefault(r["doc_id"], []).append(ids)
    seen = {}
    for r in got:
        assert r["offset"] == 0 and r["length"] == 1 << r["bucket"] and r["length"] <= 1024
        seen.setdefault(
            (r["doc_id"], r["doc_tokens"], r["ids_crc32"], r["start"], r["length"]), []
        ).append(r["sequence_id"])
    want = {}
    for doc, lists in left.items():
        for ids in lists:
            at = 0
            for n in pieces(len(ids), 1024):
                key = (doc, len(ids), zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), at, n)
                want[key] = want.get(key, 0) + 1
                at += n
    assert {k: len(v) for k, v in seen.items()} == want
    every = [s for v in seen.values() for s in v]
    assert len(every) == len(set(every))


def test_whole_table(docs):
    check(docs, pack(docs, PATH).collect())


def test_odd_rows(odd, none):
    check(odd, pack(odd, PATH).collect())
    assert pack(none, PATH).count() == 0
    whole = [r for r in pack(odd, PATH, with_ids=True).collect() if r["doc_id"] == 8]
    ids = [i for r in sorted(whole, key=lambda r: r["start"]) for i in r["ids"]]
    assert LIB.decode(ids[:-1], skip_special_tokens=False) == "\x00 <|endoftext|> <s> \u2581 日本語 😀"


@settings(deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder(PATH).ids(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=500)
@given(st.lists(st.sampled_from([" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "it's", "9", "!", "é", "日", "<|endoftext|>", "word "]), max_size=14))
def test_same_ids_around_white_space(parts):
    text = "".join(parts)
    assert encoder(PATH).ids(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "\t" * 1_000_000, "x" * 100_000, "ab \n " * 50_000])
def test_long_runs(text):
    enc = encoder(PATH)
    assert enc.many(["a b", text, "c"])[1].tolist() == LIB.encode(text, add_special_tokens=False).ids
    assert enc.ids(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_where_engines_disagree_the_library_encodes_the_batch(monkeypatch):
    enc = encoder(PATH)
    monkeypatch.setattr(enc, "own", type("Own", (), {"encode_to_numpy": lambda self, t, **k: np.array([1], np.uint32)})())
    texts = ["", "some words", "é", "more of them"]
    assert [i.tolist() for i in enc.many(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_long_run_of_spaces_as_a_row(spark):
    df = spark.createDataFrame([(1, " " * 1_000_000), (2, "a b")], "doc_id bigint, text string")
    check(df, pack(df, PATH).collect())


def test_batches_and_folders_have_sequences_of_one_length(spark, docs, tmp_path):
    packed = pack(docs, PATH, batch_tokens=4096, with_ids=True)
    batches = {}
    for r in packed.select("batch_id", "length").collect():
        batches.setdefault(r["batch_id"], []).append(r["length"])
    assert all(len(set(b)) == 1 and sum(b) <= 4096 for b in batches.values())
    by_length = {}
    for b in batches.values():
        by_length.setdefault(b[0], []).append(sum(b))
    parts = packed.rdd.getNumPartitions()
    assert all(sum(x < 4096 for x in full) <= parts for full in by_length.values())
    write_buckets(packed, str(tmp_path / "out"))
    for b in range(11):
        got = spark.read.parquet(str(tmp_path / f"out/bucket={b}"))
        assert {r["n"] for r in got.selectExpr("size(ids) AS n").distinct().collect()} == {1 << b}


@given(st.integers(1, 100_000))
def test_pieces_add_up(n):
    p = pieces(n, 1024)
    assert sum(p) == n and all(x & (x - 1) == 0 for x in p) and p == sorted(p, reverse=True)
