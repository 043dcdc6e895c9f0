"""The whole surface on a small library."""

import pytest

from lexispark import service
from lexispark.sources.stores import valid_vectors
from tests.test_search import FILES, TASK

SHA = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture(scope="module")
def engine(spark):
    s = service.Service(spark)
    counts = s.index(
        "/example/garden", spark.createDataFrame(FILES, "path string, content string"), SHA,
        "https://github.com/example/garden.git", n_rules=2
    ).first()
    assert counts["selected_files"] == 3
    return s


def test_search_and_sessions(engine):
    first = engine.search_docs("/Example/Garden", "watering", session="a").orderBy("position").collect()
    assert len(first) == 2 and first[0]["key"].startswith(SHA) and first[0]["url"].startswith(
        f"https://github.com/example/garden/blob/{SHA}/"
    )
    again = engine.search_docs("/example/garden", "valve", session="a").collect()
    assert {r["id"] for r in again}.isdisjoint({r["id"] for r in first}) or len(again) > 0
    assert len(engine.search_docs("/example/garden", "watering", session="b").collect()) == 2
    with pytest.raises(KeyError):
        engine.search_docs("/x/y", "watering")


def test_answers(engine, spark):
    text = engine.query_docs("/example/garden", "opening schedule")
    assert "valve.openUntil()" in text and SHA in text and "Project rules omitted: 2" in text
    key = engine.search_docs("/example/garden", "stop watering", limit=1).first()["key"]
    read = engine.read_docs("/example/garden", key)
    assert "Opening schedule" in read and "Stop watering" in read and "Soil moisture" not in read
    assert "stale" in engine.read_docs(
        "/example/garden", "f" * 40 + ":1"
    ) and "invalid" in engine.read_docs("/example/garden", "x")
    assert [
        r["section_title"] for r in engine.grep_docs("/example/garden", "checkRain()").collect()
    ] == ["Night round"]
    engine.vectors["/example/garden"] = spark.createDataFrame(
        [(i, [1.0, i / 10]) for i in range(1, 5)], "id bigint, embedding array<float>"
    )
    engine.query_vector = lambda q: [0.0, 1.0]
    assert "watering" in engine.query_docs("/example/garden", "watering")
    engine.vectors.clear()


def test_seen_by_commit_with_a_time_and_a_number(spark):
    now = [0.0]
    seen = service.Seen(ttl_s=10, most=3, clock=lambda: now[0])
    seen.add("s", "/a/b@1", [1, 2])
    seen.add("s", "/a/b@1", [1, 3, 4])
    assert seen.ids("s", "/a/b@1") == [2, 3, 4] and seen.ids("s", "/a/b@2") == [] and seen.ids("t", "/a/b@1") == []
    now[0] = 9
    assert seen.ids("s", "/a/b@1") == [2, 3, 4]
    now[0] = 18  # asking has kept it alive
    assert seen.ids("s", "/a/b@1") == [2, 3, 4]
    now[0] = 28  # the last moment, which keeps it alive
    assert seen.ids("s", "/a/b@1") == [2, 3, 4]
    now[0] = 38.1
    assert seen.ids("s", "/a/b@1") == []


def test_one_time_to_live_for_all_libraries():
    now = [0.0]
    seen = service.Seen(ttl_s=3600, clock=lambda: now[0])
    seen.add("s", "/A/a@1", [1])
    for k in range(1, 8):
        now[0] = 1000.0 * k
        seen.add("s", "/b/b@1", [k])
    assert seen.ids("s", "/a/A@1") == [1]
    seen.clear("s", "/a/a@1")
    assert seen.ids("s", "/a/a@1") == [] and len(seen.ids("s", "/b/b@1")) == 7
    seen.clear("s")
    assert seen.ids("s", "/b/b@1") == [] and not seen.touched


def discovered(spark, commit, calls):
    def find(ident):
        calls.append(ident)
        if ident.lower() != "/example/garden":
            return None
        files = lambda: spark.createDataFrame(FILES, "path string, content string")
        return service.Found("/example/garden", "https://github.com/example/garden.git", commit[0], files, 2)

    return find


def test_a_search_makes_its_index_ready(spark):
    now, commit, calls, asked = [1000.0], ["a" * 40], [], []

    def remote(ident):
        asked.append(ident)
        if commit[0] is None:
            raise TimeoutError
        return commit[0]

    s = service.Service(spark, discover=discovered(spark, commit, calls), remote_commit=remote, clock=lambda: now[0])
    assert s.search_text("/Example/garden", "watering").startswith("Local index indexed: /example/garden is ready.\n\nLibrary: ")
    assert s.ready("/example/garden").disposition == "cached" and not asked and len(calls) == 1
    now[0] += 86_400
    assert s.ready("/example/garden").disposition == "cached" and len(asked) == 1  # the same commit
    assert s.ready("/example/garden").disposition == "cached" and len(asked) == 1  # just checked
    now[0] += 86_400
    commit[0] = None
    ready = s.ready("/example/garden")
    assert ready.disposition == "stale-fallback" and "a" * 40 in ready.warning
    assert s.search_text("/example/garden", "watering").startswith("Warning: Freshness check failed")
    commit[0] = "b" * 40
    assert s.ready("/example/garden").disposition == "refreshed" and s.library("/example/garden").commit == "b" * 40
    assert s.ready("/example/garden", force=True).disposition == "refreshed"
    s.library("/example/garden").parser = "older"
    assert s.ready("/example/garden").disposition == "refreshed" and s.library("/example/garden").parser == service.PARSER
    with pytest.raises(KeyError):
        s.search_docs("/no/where", "x")


def test_answers_as_texts(engine):
    text = engine.search_text("/example/garden", "watering", limit=1)
    key = engine.search_docs("/example/garden", "watering", limit=1).first()["key"]
    lines = text.splitlines()
    assert "Search returned 1 sections using 1 lexical facets and fused lexical retrieval (budget: 1780 tokens)." in lines
    assert f"Result key: {key}" in lines and any(x.startswith("## 1. ") for x in lines)
    assert any(x.startswith("Source: https://github.com/example/garden/blob/") for x in lines)
    assert any(x.startswith("Relevance: ") and x.endswith("(1 retrieval paths)") for x in lines)
    assert engine.search_text("/example/garden", "zebra").endswith("No indexed section matched the query.")
    found = engine.grep_text("/example/garden", "checkRain()")
    assert "Exact literal matches: 1" in found and "Night round" in found and f"- Result {SHA}:" in found
    assert engine.grep_text("/example/garden", "%%").endswith("No exact matches.")


def test_missing_vectors_are_embedded_and_kept(spark, tmp_path):
    batches = []

    def texts(batch):
        return [[1.0 + x.count("watering"), float(len(x) % 5)] for x in batch]

    s = service.Service(spark, str(tmp_path), embed_texts=texts, query_vector=lambda q: batches.append(q) or [1.0, 0.0])
    files = spark.createDataFrame(FILES, "path string, content string")
    s.index("/example/garden", files, SHA, "https://github.com/example/garden.git")
    lib = s.library("/example/garden")
    assert len(s.search_docs("/example/garden", "watering").collect()) == 2
    table = s._cached_vectors(lib)
    assert table.read().count() == 2 and len(table.log()) == 2
    assert len(s.search_docs("/example/garden", "watering").collect()) == 2
    assert len(table.log()) == 2 and batches == ["watering", "watering"]  # nothing was missing
    s.search_docs("/example/garden", "soil").collect()
    assert table.read().count() == 3
    assert "local hybrid lexical + local reranking" in s.search_text("/example/garden", "soil")

    def failing(batch):
        raise ConnectionError

    t = service.Service(spark, embed_texts=failing, libraries=s.libraries)
    lib.root, kept = None, lib.root
    assert len(t.search_docs("/example/garden", "watering").collect()) == 2 and t.breaker.open()
    lib.root = kept


def test_a_search_leaves_no_checkpoints(spark, tmp_path):
    import pathlib

    s = service.Service(spark, str(tmp_path))
    files = spark.createDataFrame(FILES, "path string, content string")
    s.index("/example/garden", files, SHA, "https://github.com/example/garden.git")
    at = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(at.iterdir())
    s.search_docs("/example/garden", "watering").collect()
    s.query_docs("/example/garden", "watering")
    assert {p for p in at.iterdir() if any(p.iterdir())} <= before


def test_a_written_index_gives_the_same_answers(spark, engine, tmp_path):
    s = service.Service(spark, str(tmp_path))
    files = spark.createDataFrame(FILES, "path string, content string")
    s.index("/example/garden", files, SHA, "https://github.com/example/garden.git", n_rules=2)
    assert s.query_docs("/example/garden", TASK) == engine.query_docs("/example/garden", TASK)
    rows = lambda e, **k: [tuple(r) for r in e.search_docs("/example/garden", "watering", **k).collect()]
    assert rows(s) == rows(engine) and len(rows(s)) == 2
    first = rows(s, session="x", limit=1)
    assert len(first) == 1 and rows(s, session="x") == [(0, *rows(s)[1][1:])] and len(rows(s, session="x")) == 2
    s.index("/example/garden", files, "f" * 40, "https://github.com/example/garden.git")
    assert len(rows(s, session="x")) == 2  # another commit, nothing of it seen


def test_reranking_is_left_out_for_a_while_after_a_failure(spark, engine):
    calls = []

    def vector(text):
        calls.append(text)
        raise ConnectionError

    s = service.Service(spark, libraries=engine.libraries, query_vector=vector)
    s.vectors["/example/garden"] = spark.createDataFrame([(2, [1.0])], "id bigint, embedding array<float>")
    plain = [r["id"] for r in engine.search_docs("/example/garden", "watering").collect()]
    for _ in range(2):
        assert [r["id"] for r in s.search_docs("/example/garden", "watering").collect()] == plain
    assert calls == ["watering"] and s.breaker.open()
    s.breaker.until = 0
    s.query_vector = lambda text: [1.0]
    got = s.search_docs("/example/garden", "watering", limit=1).collect()
    assert [(r["position"], r["id"]) for r in got] == [(0, 2)]


def test_candidates_until_one_can_be_indexed(spark):
    tried = []

    def make(ident):
        tried.append(ident)
        if ident != "/c":
            raise ValueError(ident)

    s = service.Service(spark)
    assert s.index_first(["/a", "/b", "/c", "/d"], make) == "/c" and tried == ["/a", "/b", "/c"]
    assert s.index_first([f"/{k}" for k in range(9)], make) is None and len(tried) == 8


def test_libraries_and_health(engine, spark):
    assert [
        r["id"] for r in engine.resolve("Gar-den").collect()
    ] == ["/example/garden"] and engine.resolve("zzz").count() == 0
    h = engine.status().first()
    assert (h["libraries"], h["sections"], h["outdated"]) == (1, 4, 0)
    assert service.Service(spark).status().first()["libraries"] == 0


def test_evaluation(engine):
    rows = engine.evaluate(
        "/example/garden",
        [(TASK, "docs\\Beds.md"), ("soil moisture", "docs/sensors.md"), ("night", "nowhere.md")]
    ).collect()
    assert [(r["fused_rank"], r["legacy_rank"]) for r in rows] == [(1, 1), (1, 1), (0, 0)]


def test_helpers(spark):
    now = [0.0]
    b = service.CircuitBreaker(clock=lambda: now[0])
    assert not b.open()
    b.failed()
    assert b.open()
    now[0] = 301
    assert not b.open()
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert service.with_retries(flaky, sleep=pauses.append) == "ok" and [round(p, 3) for p in pauses] == [0.05, 0.136]
    assert [service.positive_int(x, 5) for x in ("7", "0", "-1", "x", None)] == [7, 5, 5, 5, 5]
    texts = spark.createDataFrame([(i, "t" * i) for i in range(5)], "id bigint, text string")
    got = service.embed(texts, lambda ts: [[1.0, float(len(t))] for t in ts], batch=2).collect()
    assert sorted((r["id"], r["embedding"][1]) for r in got) == [(i, float(i)) for i in range(5)]
    with pytest.raises(Exception, match="other vectors"):
        service.embed(texts, lambda ts: [[1.0]]).collect()
    cache = spark.createDataFrame([(1, "c", "m"), (2, "c", "n")], "id bigint, commit string, model string")
    assert [r["id"] for r in valid_vectors(cache, "c", "m").collect()] == [1]
