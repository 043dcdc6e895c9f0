"""Trees, manifests, logs, stores and streams on temporary folders."""

import json

from lexispark.sources import files, stores
from lexispark.streaming import sessions
from pyspark.sql import functions as F


def test_bounded_reading(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in (
        ("docs/api.md", "small"), ("docs/oversized.md", "x" * 2000), ("docs/ignored.txt", "t"),
        ("node_modules/a.md", "n"), ("docs/.hidden.md", "h")
    ):
        (tmp_path / name).write_text(text)
    got = files.read_bounded(spark, str(tmp_path), 10, 1000, 10_000).collect()
    assert [(r["path"], r["content"]) for r in got] == [("docs/api.md", "small")]
    assert files.read_bounded(spark, str(tmp_path / "docs"), 10, 1, 10).count() == 0
    (tmp_path / "docs/link.md").symlink_to(tmp_path / "docs/api.md")
    (tmp_path / "linked").symlink_to(tmp_path / "docs")
    assert [r["path"] for r in files.walk(spark, str(tmp_path), 1000).collect()] == ["docs/api.md"]


def test_project_settings(spark):
    text = '{ // a comment\n "folders": ["docs"], "previousVersions": [{"tag": "v1"}], "branchVersions": [{"branch": "next"}] }'
    df = spark.createDataFrame([(text,), ("nonsense",), ('{"description": 7, "name": " x "}',)], "t string")
    c = files.project_config(F.col("t"))
    got = df.select(
        files.versions(c).alias("v"), c["folders"].alias("f"),
        files.json_string(F.col("t"), "$.description").alias("d"), files.json_string(F.col("t"), "$.name").alias("n")
    ).collect()
    assert got[0]["v"] == ["v1", "next"] and got[0]["f"] == ["docs"] and got[1]["v"] == [] and got[2]["d"] is None and got[2]["n"] == "x"


def test_dependencies(spark):
    rows = [
        (
            "package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"@types/node": "1", "vite": "2"}}'
        ), ("a/requirements.txt", "# c\nflask==1\n-r x\n\nnumpy>=2"),
        (
            "pyproject.toml",
            '[project]\ndependencies = ["httpx>=1", "flask"]\n\n[tool.poetry.dependencies]\npython = "3"\nrich = "1"\n\n[x]\ny = 1\n'
        ),
    ]
    got = files.dependencies(spark.createDataFrame(rows, "path string, content string"))
    assert {r["name"] for r in got.collect()} == {"react", "vite", "flask", "numpy", "httpx", "rich"}


def test_refs_trees_and_toml(spark):
    refs = spark.createDataFrame(
        [("aaa\trefs/tags/v1",), ("bbb\trefs/tags/v1^{}",), ("ccc\trefs/heads/main",)], "value string"
    )
    assert files.preferred_commit(refs, "v1").first()["sha"] == "bbb" and files.preferred_commit(refs, "main").first()["sha"] == "ccc"
    tree = spark.createDataFrame(
        [("skills/a/SKILL.md", "blob"), ("skills/b", "tree"), ("x/skill.md", "blob")], "path string, type string"
    )
    assert files.skill_files(tree, "skills/").count() == 1 and files.skill_files(tree).count() == 2
    t = spark.range(1).select(
        files.toml_section(F.lit('[a]\nx = 1\n\n[b.c]\ny = "q"\nz = true\n'), "b\\.c").alias("m")
    ).first()["m"]
    assert t == {"y": '"q"', "z": "true"}


def test_manifests_and_logs(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for n, m in enumerate(
        [
            {"schemaVersion": 1, "id": "/A/b", "commitSha": "c"}, {"schemaVersion": 2, "id": "/x/y", "commitSha": "c"},
            {"schemaVersion": 1}
        ]
    ):
        (tmp_path / "m" / f"{n}.json").write_text(json.dumps(m))
    (tmp_path / "m" / "bad.json").write_text("{")
    found = stores.read_manifests(spark, str(tmp_path / "m"))
    assert [r["id"] for r in found.collect()] == ["/A/b"] and stores.find_manifest(found, "/a/B").count() == 1
    log = tmp_path / "log.jsonl"
    log.write_text(
        '{"libraryId": "/a/b", "status": "failed"}\n\n{"libraryId": "/A/b", "status": "succeeded"}\n{"libraryId": "/c/d", "sta'
    )
    assert [
        (r["libraryId"], r["status"]) for r in stores.read_event_log(spark, str(log)).collect()
    ] == [("/A/b", "succeeded")]


def test_publish_and_upsert(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame(v, "id int, v string")
    root = str(tmp_path)
    stores.publish(spark, rows((1, "a"), (2, "b")), root, "t")
    stores.upsert_published(spark, rows((2, "c"), (3, "d")), root, "t", ["id"])
    assert sorted(tuple(r) for r in stores.published(spark, root, "t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    old, new = rows((1, "a")), rows((1, "z"), (2, "y"))
    assert sorted(tuple(r) for r in stores.import_libraries(old, new).collect()) == [(1, "a"), (2, "y")]
    assert sorted(tuple(r) for r in stores.import_libraries(old, new, force=True).collect()) == [(1, "z"), (2, "y")]
    stores.write_report(old, f"{root}/r", "1")
    stores.write_report(new, f"{root}/r", "2")
    assert spark.read.json(f"{root}/r/latest").count() == 2


def test_registries(spark):
    rows = [
        ("npm", "x", '{"repository": {"url": "git+https://github.com/a/b.git"}}'),
        ("pypi", "y", '{"info": {"project_urls": {"Source": "https://x.org", "Code": "https://github.com/c/d"}}}'),
        ("crates", "z", "{}")
    ]
    got = stores.registry_repositories(
        spark.createDataFrame(rows, "registry string, name string, json string")
    ).collect()
    assert {(r["name"], r["id"]) for r in got} == {("x", "/a/b"), ("y", "/c/d")}


def test_streams(spark, tmp_path):
    rows = [
        ("s", "L", 1, "2024-01-01 00:00:00"), ("s", "l", 1, "2024-01-01 00:30:00"),
        ("s", "l", 2, "2024-01-01 00:31:00"), ("s", "l", 1, "2024-01-01 03:00:00"), ("t", "l", 1, "2024-01-01 00:00:00")
    ]
    spark.createDataFrame(
        rows, "session string, library string, id bigint, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(
        "session string, library string, id bigint, ts timestamp"
    ).parquet(f"{tmp_path}/in")
    run = sessions.stream_seen(stream, most=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(
        (r["session"], r["id"], r["fresh"], r["seen_count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()
    )
    assert got == [("s", 1, False, 1), ("s", 1, True, 1), ("s", 1, True, 1), ("s", 2, True, 1), ("t", 1, True, 1)]
    assert sessions.protocol_session(None, 5) == (None, False) and sessions.protocol_session(5, 5) == (None, False)
    assert sessions.protocol_session(86_400_001, 2) == (
        2 + 7 * 86_400_000, True
    ) and sessions.protocol_session(86_400_005, 2) == (86_400_005, True)
    lines = spark.createDataFrame(
        [('{"type": "progress"}',), ("{",), ('{"type": "complete", "content": "x"}',)], "value string"
    )
    assert [r["type"] for r in sessions.parse_lines(lines).collect()] == ["progress", "complete"]


def test_locks_caches_and_lists(spark, tmp_path):
    import os
    import time

    import pytest

    lock = str(tmp_path / "lock")
    with stores.BuildLock(lock), pytest.raises(TimeoutError), stores.BuildLock(lock, wait_s=0.05, poll_s=0.01):
        pass
    assert not os.path.exists(lock)
    for stale in ("nonsense", json.dumps([2**22 + 1, time.time()]), json.dumps([os.getpid(), time.time() - 4000])):
        (tmp_path / "lock").write_text(stale)
        with stores.BuildLock(lock, wait_s=1):
            pass
    now = [0.0]
    cache = stores.TtlCache(10, clock=lambda: now[0])
    assert [cache.get("k", lambda: 1), cache.get("k", lambda: 2)] == [1, 1]
    now[0] = 10
    assert cache.get("k", lambda: 3) == 3
    for name in ("s/one/SKILL.md", "s/two/SKILL.md", "s/three/README.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r["name"] for r in files.installed_skills(spark, [str(tmp_path / "s")]).collect()} == {"one", "two"}
    assert files.installed_skills(spark, [str(tmp_path / "nowhere")]).count() == 0
    site = spark.createDataFrame(
        [("https://a/b#x", 1), ("https://a/b", 2), ("https://a/old/c", 1), ("https://a/d", 9), ("https://a/", 0)],
        "url string, depth int"
    )
    assert [r["url"] for r in files.site_pages(site, ["old"]).collect()] == ["https://a/", "https://a/b"]
    rows = spark.createDataFrame(
        [("L", "2024-01-01 00:00:00"), ("l", "2024-01-01 00:00:01"), ("m", "2024-01-01 00:00:02")],
        "library string, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/requests")
    stream = sessions.single_flight(
        spark.readStream.schema("library string, ts timestamp").parquet(f"{tmp_path}/requests")
    )
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/first").option(
        "checkpointLocation", f"{tmp_path}/flight"
    ).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/first").count() == 2
