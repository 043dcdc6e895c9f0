"""JSON lines in byte chunks, keyed tables, many topics, trends, counters."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import catalog, chunks, running, selection, topics
from lexispark.sources import stores
from lexispark.sources.keyed import KeyedTable
from lexispark.streaming import ndjson

LINES = [
    '{"type": "progress", "content": "é日😀"}', "", "  ", '{"type": "comp', '{"type": "complete", "content": "ü", "libraryName": "/a/b"}',
    " {\"type\": \"error\", \"message\": \"müll\"}\r", "null", "[1]", '{"x": 1}', '{"type": "complete", "libraryName": "/c/d"}'
]


def pieces(data, rng):
    cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(12)))
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]


def test_events_of_chunks_cut_anywhere(spark):
    rng, rows, want = random.Random(6), [], {}
    for s in range(60):
        lines = rng.choices(LINES, k=rng.randrange(6))
        data = "\n".join(lines).encode() + (b"\n" if rng.random() < 0.5 else b"")
        rows += [(s, k, p) for k, p in enumerate(pieces(data, rng))]
        own = []
        for n, line in enumerate(lines):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if isinstance(e, dict) and "type" in e:
                own.append((n, e["type"], e.get("content"), e.get("libraryName"), e.get("message")))
        want[s] = own
    df = spark.createDataFrame(rows, "stream int, seq int, data binary").repartition(7)
    got = {}
    for r in ndjson.chunk_events(df).collect():
        got.setdefault(r["stream"], []).append(tuple(r)[1:])
    assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in want.items() if v}
    ends = {r["stream"]: (r["content"], r["library_name"], r["error"]) for r in ndjson.stream_outcome(ndjson.chunk_events(df)).collect()}
    for s, own in want.items():
        done = [e for e in own if e[1] == "complete"]
        failed = [e for e in own if e[1] == "error"]
        if done or failed:
            assert ends[s] == ((done[-1][2] or "") if done else "", done[-1][3] if done else None, failed[-1][4] if failed else None)
        else:
            assert s not in ends


def test_summaries(spark):
    df = spark.createDataFrame([(b"a\nb\nc",), (b"abc",), (b"",), (b"\n",)], "d binary")
    got = [tuple(r["c"]) for r in df.select(ndjson.chunk_summary(F.col("d")).alias("c")).collect()]
    assert got == [("a", ["b"], "c", 2), ("abc", [], None, 0), ("", [], None, 0), ("", [], "", 1)]


def test_one_stream_over_many_ranges(spark):
    line = json.dumps({"type": "complete", "content": "x" * 50})
    data = ("\n".join([line] * 300)).encode()
    rows = [(0, k, data[k * 7 : k * 7 + 7]) for k in range(-(-len(data) // 7))]
    df = spark.createDataFrame([*rows, (1, 0, None)], "stream int, seq int, data binary")
    assert ndjson.chunk_events(df).count() == 300


def test_running_sums(spark):
    rng = random.Random(0)
    rows = [(k % 2, k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, k int, v bigint")
    got = {(r["g"], r["k"]): r["s"] for r in running.running_sum(df, ["g"], ["k"], F.col("v"), "s").collect()}
    for g in (0, 1):
        total = 0
        for h, k, v in rows:
            if h == g:
                assert got[g, k] == total
                total += v


def size_of(spark, at):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).agg(F.sum("length")).first()[0] or 0


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ("id", "model"))
    rows = lambda: sorted(map(tuple, table.read().collect()))
    base = spark.range(5000).selectExpr("id", "'m' AS model", "cast(id AS double) AS v")
    table.create(base)
    before = size_of(spark, str(tmp_path / "t"))
    batch = spark.createDataFrame([(3, "m", -1.0), (9999, "m", 1.0), (3, "n", 5.0)], "id bigint, model string, v double")
    table.upsert(batch)
    table.upsert(spark.createDataFrame([(3, "m", -2.0), (3, "m", -2.0)], "id bigint, model string, v double"))
    assert size_of(spark, str(tmp_path / "t")) - before < before / 5  # what was there isn't written again
    want = {(i, "m"): float(i) for i in range(5000)} | {(3, "m"): -2.0, (9999, "m"): 1.0, (3, "n"): 5.0}
    assert rows() == sorted((*k, v) for k, v in want.items())
    now = rows()
    table.compact()
    assert rows() == now and len(table.log()) == 1
    table.upsert(batch)
    assert dict(((a, b), v) for a, b, v in rows())[3, "m"] == -1.0 and len(table.log()) == 2


def every_pair(asked, parts, limit):
    """The ranking of all pairs of topics and chunks."""
    scored = parts.join(asked, "term").groupBy("topic", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    out = {}
    for r in scored.collect():
        out.setdefault(r["topic"], []).append((-r["score"], r["id"]))
    return {t: [(i, -s) for s, i in sorted(v)[:limit]] for t, v in out.items()}, scored.count()


@pytest.mark.parametrize("limit", [1, 10])
def test_many_topics(spark, data, limit):
    docs = chunks.document_chunks(spark.read.parquet(f"{data}/documents.parquet"))
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    asked, parts = topics.topic_parts(
        docs, bench.selectExpr("item_id AS topic", "concat(text, ' the of and') AS text"), {"content": 1.0}
    )
    found = topics.rank_parts(asked, parts, limit)
    want, pairs = every_pair(asked, parts, limit)
    got = {}
    for r in found.rows.orderBy("topic", "rank").collect():
        got.setdefault(r["topic"], []).append((r["id"], r["score"]))
    assert got == want
    assert found.scored.count() <= found.met.count() < pairs


def test_common_words_meet_few_chunks(spark):
    """A word that all chunks have joins a topic only with the chunks that its rare word has."""
    df = spark.range(2000).selectExpr("id", "concat('common filler', CASE WHEN id % 100 = 7 THEN ' rare' ELSE '' END) AS content")
    asked, parts = topics.topic_parts(df, spark.createDataFrame([(1, "common rare")], "topic int, text string"), {"content": 1.0})
    found = topics.rank_parts(asked, parts, 10)
    assert found.met.count() == 20 and [r["id"] for r in found.rows.orderBy("rank").collect()][:2] == [7, 107]


def test_trends_from_sketches(spark):
    e = spark.range(30_000).selectExpr(
        "timestamp'2024-01-01' + make_dt_interval(id % 3) AS ts", "id % 7000 AS user", "concat('t', id % 2) AS topic"
    )
    sketches = catalog.usage_sketches(e, "ts", "user", ["topic"])
    got = catalog.usage_trends(sketches, [["period", "topic"], ["topic"], []])
    levels = {r["level"]: 0 for r in got.collect()}
    assert sorted(levels) == [0, 1, 2] and got.where("level = 0").count() == 6
    whole = got.where("level = 2").first()
    assert whole["n"] == 30_000 and abs(whole["users"] - 7000) < 0.05 * 7000 and whole["topic"] is None
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 30000") == 1


def test_counters_of_the_writing_pass(spark, tmp_path):
    files = spark.createDataFrame(
        [("docs/a.md", "A" * 10), ("docs/b.md", "A" * 10), ("LICENSE.md", "x"), ("docs/c.md", "c" * 99)], "path string, content string"
    )
    chosen = selection.select_files(files, max_file_bytes=50)
    counts = selection.write_selected(chosen, str(tmp_path / "out")).first()
    want = selection.selection_counts(chosen).first()
    assert counts.asDict() == want.asDict()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want["selected_files"]


def test_progress_of_the_appending_pass(spark, tmp_path):
    rows = [("/a/a", "succeeded"), ("/b/b", "failed"), ("/c/c", "succeeded"), ("/d/d", "skipped")]
    events = spark.createDataFrame(rows, "libraryId string, status string")
    got = stores.append_counted(events, str(tmp_path / "log"), 5).first().asDict()
    assert got == catalog.progress(events, 5).first().asDict() and got["remaining"] == 3
    assert stores.read_event_log(spark, str(tmp_path / "log")).count() == 4
