"""Each stage of the pipeline against a brute-force version, and the whole on odd rows."""

import math
import zlib

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from lexispark.llm.packing import pieces
from lexispark.llm.quality import label_grade, train
from lexispark.llm.queries import tokenizer_path
from tests.llm.test_near_dedup import sets_of
from tests.llm.test_quality import plain_features

LIB = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def classes(rows, percent):
    """The rows' classes by the similarity of all pairs of word sets."""
    sets, root = sets_of(list(enumerate(t for _, t in rows))), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))], sets


def packed(rows):
    """Pieces of documents: (doc_id, start, length, ids_crc32, doc_tokens), as often as they occur."""
    out = {}
    for i, text in rows:
        ids, at = [*LIB.encode(text or "", add_special_tokens=False).ids, 0], 0
        for n in pieces(len(ids), 1024):
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n]))
            out[i, at, n, crc, len(ids)] = out.get((i, at, n, crc, len(ids)), 0) + 1
            at += n
    return out


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rated(spark, data, docs):
    return corpus_pipeline.quality_classifier(spark, docs, data).cache()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "mixing_sources", "packing"
    ]


def test_quality_against_plain_sums(spark, data, docs, rated):
    model = train(docs, spark.read.parquet(f"{data}/labels.parquet"), label_grade(), 3)
    want = set()
    for r in docs.collect():
        f = sum(float(model.weights[zlib.crc32(k.encode()) % 2**20]) * v for k, v in plain_features(r["text"] or ""))
        p = 1 / (1 + math.exp(model.thresholds[1] - f))
        assert abs(p - 0.4) > 1e-5
        want |= {r["doc_id"]} if p >= 0.4 else set()
    assert rated.columns == docs.columns and {r["doc_id"] for r in rated.collect()} == want
    assert 0 < len(want) < docs.count()


def test_near_dedup_against_all_pairs(spark, data, docs):
    """At a similarity of 0.8, on all documents: one of each class stays, the one with the smallest id."""
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    root, _ = classes(rows, 80)
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, data)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [rows[k][0] for k in range(len(rows)) if root[k] == k]


def test_mixing_keeps_all_and_repeats_at_most_twice(spark, data, rated):
    """Source weights against their bisection; tests of op5 hold the single rows against loops."""
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in rated.collect()]
    mixed = corpus_pipeline.mixing_sources(spark, rated, data)
    assert mixed.columns == rated.columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) == {i for i, _, _ in rows} and max(times.values()) <= 2
    own, got = {}, {}
    for i, s, n in rows:
        own[s] = own.get(s, 0) + n
        got[s] = got.get(s, 0) + n * times[i]
    top = max(own.values())
    a = 1 - math.log(2) / math.log(top / min(own.values())) if top > 2 * min(own.values()) else 0.0
    used = {s: (n / top) ** a for s, n in own.items()}
    most = max(own[s] / used[s] for s in own)
    longest = max(n for _, _, n in rows)
    assert all(0 <= used[s] * most - got[s] <= longest for s in own)


def test_packing_against_the_library(spark, data, rated):
    got = {}
    for r in corpus_pipeline.packing(spark, rated, data).collect():
        key = r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]
        got[key] = got.get(key, 0) + 1
    assert got == packed((r["doc_id"], r["text"]) for r in rated.collect())


def test_stages_on_odd_rows(spark, odd, none, data):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows."""
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, data)
        if name != "packing":
            assert rows.columns == odd.columns
        assert rows.count() >= 0 and stage(spark, none, data).count() == 0
    kept = [r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, odd, data).collect()]
    assert sorted(kept) == [1, 3, 4, 5, 6, 7, 8]


def test_run(spark, data, docs):
    """The whole: pieces of documents that all stages keep, each document whole as often as it was mixed in."""
    rows = corpus_pipeline.run(spark, data).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in rows:
        key = r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]
        got[key] = got.get(key, 0) + 1
    ids = {k[0] for k in got}
    one = packed((i, texts[i]) for i in ids)
    assert set(got) == set(one)
    assert all(got[k] % one[k] == 0 and got[k] // one[k] in (1, 2) for k in got)
