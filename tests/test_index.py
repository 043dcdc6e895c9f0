"""Searches of a written index against scans of all chunks."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import chunks, index, reading, search, topics
from lexispark.operators.postings import grams, window_of, write_index
from lexispark.plans.planner import Facet, plan_query

FACETS = [
    Facet("any", (("the",), ("history",), ("that",))), Facet("all", (("the",), ("of",), ("that",))),
    Facet("all", (("of", "the"),)), Facet("any", (("of", "the"), ("in",), ("zzzz",))), Facet("all", (("zzzz",), ("the",))),
    Facet("any", ())
]


@pytest.fixture(scope="module")
def every(spark, data):
    return chunks.document_chunks(spark.read.parquet(f"{data}/documents.parquet"))


@pytest.fixture(scope="module")
def made(spark, every, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    write_index(every, at, buckets=8, window=4, shelf=16)  # windows enough for pruning
    return index.open_index(spark, at)


def listed(df):
    return sorted((r["facet"], r["id"], r["score"]) for r in df.collect())


def test_scores_are_those_of_a_scan(every, made):
    assert listed(index.score_index(made, FACETS)) == listed(search.score_facets(every, FACETS))
    other = {"doc_title": 5.0, "section_title": 10.0, "content": 1.0}
    assert listed(index.score_index(made, FACETS, other)) == listed(search.score_facets(every, FACETS, other))


@pytest.mark.parametrize("limit", [1, 20])
def test_top_of_facets(every, made, limit):
    """Windows that can't reach the threshold are not scored; what is wanted is the same."""
    got = search.top_of_facets(index.score_index(made, FACETS, None, limit), limit)
    want = search.top_of_facets(search.score_facets(every, FACETS), limit)
    assert sorted(map(tuple, got.select("facet", "rank", "id", "score").collect())) == sorted(
        map(tuple, want.select("facet", "rank", "id", "score").collect())
    )


def test_windows_are_skipped(spark, made):
    """A rare word beside a common one: only windows with the rare one can reach the best scores."""
    texts = [(i, "common " * 3 + ("rare " * 5 if i in (40, 900) else "") + "filler") for i in range(1000)]
    df = spark.createDataFrame(texts, "id bigint, content string").selectExpr(
        "id", "'p' AS doc_path", "'' AS doc_title", "'' AS section_title", "content", "1 AS tokens", "false AS has_code"
    )
    at = made.root + "-rare"
    write_index(df, at, buckets=4, window=10, shelf=10, literal=False)
    own = index.open_index(spark, at)
    scored = index.score_index(own, [Facet("any", (("common",), ("rare",)))], None, 2)
    # Eight windows come first; the others have no chunk that could enter the first two.
    assert scored.select(window_of(F.col("id"), 10)).distinct().count() == index.FIRST
    assert [r["id"] for r in search.top_of_facets(scored, 2).orderBy("rank").collect()] == [40, 900]


def test_no_texts_are_read_for_scores(every, made):
    """The scans that scores come from have the bounds' or the postings' columns, never texts."""
    plan = index.score_index(made, FACETS[:2])._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert read and all("content:" not in line.split("ReadSchema")[1] for line in read)
    assert all("positions" not in line.split("ReadSchema")[1] for line in read)
    ids = [r["id"] for r in every.select("id").limit(3).collect()]
    plan = made.chunks_of(ids)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan or "PartitionFilters: [shelf" in plan


TOPICS = ["onthe 'of the' the_of", "zzzz", "\"the the\" history of that"]


@pytest.mark.parametrize("topic", TOPICS)
def test_answers(spark, every, made, topic):
    rows = lambda df: [(r["position"], r["id"], r["score"]) for r in df.orderBy("position").collect()]
    assert rows(index.search_index(spark, made.root, topic)) == rows(search.search(every, topic))
    seen = every.where("id % 2 = 0").select("id")
    assert rows(index.search_index(spark, made.root, topic, 5, seen=seen)) == rows(search.search(every, topic, 5, seen=seen))


def small(spark, rows):
    return spark.createDataFrame(rows, "id bigint, doc_title string, section_title string, content string").selectExpr(
        "*", "concat('p', id % 3) AS doc_path", "1 AS tokens", "false AS has_code"
    )


def test_phrases_in_any_text(spark, tmp_path):
    """Phrases that overlap themselves, cross fields or repeat, in random texts, negative and scattered ids."""
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choices(["a", "b", "A", "c-d", "é", "1", "..."], k=rng.randrange(n)))
    rows = [(i, word(4), word(4), word(30)) for i in [-5, -1, 0, 3, 10**12, *range(20, 120)]]
    rows += [(5, None, "", None), (6, "", "a", "b " * 500)]
    df = small(spark, rows)
    write_index(df, str(tmp_path), buckets=3, window=8, shelf=2)
    own = index.open_index(spark, str(tmp_path))
    units = [("a", "a"), ("a", "b"), ("a", "b", "a"), ("b",), ("c", "d"), ("d", "c"), ("a", "a", "a"), ("x", "a"), ("é",)]
    facets = [Facet("all", (u,)) for u in units] + [Facet("any", tuple(units)), Facet("all", (("a", "b"), ("b",)))]
    assert listed(index.score_index(own, facets)) == listed(search.score_facets(df, facets))
    for limit in (1, 4):
        got = search.top_of_facets(index.score_index(own, facets, None, limit), limit)
        want = search.top_of_facets(search.score_facets(df, facets), limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("pattern", ["The Of", "e", "zzzqqq", " of the "])
def test_literals(every, made, pattern):
    rows = lambda df: [tuple(r) for r in df.select("id", "snippet").orderBy("id").collect()]
    assert rows(index.grep_index(made, pattern)) == rows(reading.grep(every, pattern))
    assert rows(index.grep_index(made, pattern, 3)) == rows(reading.grep(every, pattern, 3))
    assert rows(index.grep_index_all(made, pattern)) == rows(reading.snippet_of(every, pattern))


def test_literal_candidates_are_few(every, made, monkeypatch):
    """Only texts with all trigrams are verified, a wave at a time."""
    ids = {r["id"] for r in index.literal_candidates(made, "history").collect()}
    want = {r["id"] for r in every.where("lower(content) LIKE '%history%'").select("id").collect()}
    assert want <= ids and len(ids) <= len(want) + 5
    assert index.literal_candidates(made, "ab") is None
    monkeypatch.setattr(index, "WAVE", 2)
    assert [r["id"] for r in index.grep_index(made, "the of").collect()] == [r["id"] for r in reading.grep(every, "the of").collect()]
    with pytest.raises(ValueError):
        index.grep_index(made, "x" * 201)


def test_grams():
    assert len(grams("ab")) == 0 and len(grams("aaaa")) == 1 and len(grams("日本語😀")) == 2
    assert set(grams("abc")) < set(grams("xabcx"))


def test_small_parts_of_a_window(spark, every, tmp_path, monkeypatch):
    """A window that is written in several rows of a term scores the same."""
    from lexispark.operators import postings

    fields = ["doc_title", "section_title", "content"]
    placed = postings._by_window(every, 64).select("__win", "__off", *[postings.token_string(F.col(f)) for f in fields])
    monkeypatch.setattr(postings, "HELD", 500)
    batches = [b for b in placed.toArrow().to_batches()]
    parts = [r for b in postings._post(iter(batches), fields) for r in b.to_pylist()]
    assert len({(r["term"], r["field"], r["win"]) for r in parts}) < len(parts)
    tokens = sum(sum(r["tfs"]) for r in parts if r["field"] == "content")
    assert tokens == every.select(search.token_count(search.token_string(F.col("content"))).alias("n")).agg(F.sum("n")).first()[0]
    assert all(r["max_tf"] == max(r["tfs"]) and r["min_len"] == min(r["lens"]) and r["n"] == len(r["offs"]) for r in parts)


def test_a_row_has_one_list_of_places(spark, tmp_path):
    """Rows of the postings against counting in plain Python; places of all chunks are one list, counts divide it."""
    texts = [(3, "A a", "", "b a. A"), (5, None, "b", ""), (6, "", "", None), (9, "é-1", "é", "é b é"), (70, "x", "", "b")]
    df = small(spark, texts)
    write_index(df, str(tmp_path), buckets=2, window=8, shelf=2, literal=False)
    own = index.open_index(spark, str(tmp_path))
    want = {}
    for i, *fields in texts:
        words = [(t or "").lower().replace("-", " ").replace(".", " ").split() for t in fields]
        for f, found in zip(search.FIELDS, words, strict=True):
            for t in dict.fromkeys(found):
                row = want.setdefault((t, f, i // 8), [[], [], [], [], 0])
                for x, v in zip(row, (i % 8, found.count(t), sum(map(len, words))), strict=False):
                    x.append(v)
                row[3] += [p for p, x in enumerate(found) if x == t]
                before = words[: list(search.FIELDS).index(f)]
                row[4] += not any(t in w for w in before)
    got = {
        (r["term"], r["field"], r["win"]): [r["offs"], r["tfs"], r["lens"], r["positions"], r["own"]]
        for r in own.table("postings").collect()
    }
    assert got == want and own.n == 5 and own.mean == sum(
        sum(len((t or "").replace("-", " ").split()) for t in f) for _, *f in texts
    ) / 5


def test_an_empty_index(spark, every, tmp_path):
    write_index(every.where("false"), str(tmp_path))
    assert index.search_index(spark, str(tmp_path), "the history").count() == 0
    own = index.open_index(spark, str(tmp_path))
    assert index.grep_index(own, "the").count() == 0 and plan_query("the") == []


def test_many_topics_from_postings(spark, data, every, made):
    """Topics ranked from the index are those of a scan whose lengths count all fields."""
    bench = spark.read.parquet(f"{data}/benchmark.parquet").selectExpr("item_id AS topic", "concat(text, ' en the') AS text")
    rows = lambda x: sorted(map(tuple, topics.rank_parts(*x, 5).rows.select("topic", "rank", "id", "score").collect()))
    assert rows(topics.index_parts(made, bench)) == rows(topics.topic_parts(every, bench))
