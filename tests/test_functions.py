"""Scalar functions on single values."""

import pytest

from lexispark.functions import formats, identifiers as ids, labels, paths
from lexispark.operators import catalog
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def one(spark):
    def of(expression):
        return spark.range(1).select(expression.alias("x")).first()["x"]

    return of


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("/vercel/next.js/v16.0.0", "/vercel/next.js/v16.0.0"), (" a/b/ ", "/a/b"), ("/owner/repo;whoami", None),
        ("/owner/repo/../../main", None), ("a", None), ("/a/..", None), ("", None), (None, None)
    ],
)
def test_library_ids(one, text, want):
    got = one(ids.parse_library_id(F.lit(text).cast("string")))
    assert (got["id"] if got else None) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (
            "git+https://github.com/fastify/fastify.git", "/fastify/fastify"
        ), (
            "git@github.com:a/b-c.git", "/a/b-c"
        ), ("ssh://git@github.com/a/b", "/a/b"), ("git://GitHub.com/a/b.git", "/a/b"), ("a/b.git", "/a/b"),
        (
            "https://example.com/owner/repo", None
        ), ("https://github.com/a/b/c", None), (
            "https://github.com/a/b?x=1", "/a/b"
        ), ("http://github.com/a/b", None), ("", None),
    ],
)
def test_repositories(one, text, want):
    got = one(ids.parse_repository(F.lit(text)))
    assert (got["id"] if got else None) == want


def test_versions(one):
    for a, b, want in (
        ("0.3.14", "0.3.13", 1), ("0.3.13", "0.3.13", 0), ("0.3.13-beta", "0.3.14", -1), ("1.x", "1.0.0", 0),
        ("2", "1.9", 1)
    ):
        assert one(ids.compare_versions(F.lit(a), F.lit(b))) == want


def test_keys_and_urls(one):
    sha = "0123456789abcdef0123456789abcdef01234567"
    assert tuple(one(ids.parse_result_key(F.lit(f"{sha.upper()}:12"), F.lit(sha)))) == (12, "ok")
    assert tuple(one(ids.parse_result_key(F.lit("7"), F.lit(sha)))) == (7, "ok")
    assert tuple(one(ids.parse_result_key(F.lit("f" * 40 + ":7"), F.lit(sha)))) == (None, "stale")
    assert tuple(one(ids.parse_result_key(F.lit("x:7"), F.lit(sha)))) == (None, "invalid")
    assert one(
        ids.source_url(F.lit("https://github.com/a/b.git"), F.lit("c"), F.lit("d e/(f)'!~*.md"))
    ) == "https://github.com/a/b/blob/c/d%20e/(f)'!~*.md"
    assert one(ids.canonical_url(F.lit("https://a/b?c=1#d"))) == "https://a/b?c=1"
    assert one(ids.recover_library_id(F.lit("C:/Program Files/Git/a/b"))) == "/a/b"
    assert one(ids.tree_address(F.lit("https://github.com/a/b/tree/main/x/y")))["path"] == "x/y"
    assert one(ids.safe_skill_name(F.lit("../x"))) is False and one(ids.safe_skill_name(F.lit("my-skill"))) is True
    assert tuple(one(ids.front_matter(F.lit("---\nname: 'x'\ndescription: >\n  a\n  b\n---\ntext")))) == ("x", "a b")


def test_paths(one):
    assert one(paths.priority(F.lit("docs/api.md"))) == 310 - 0 and one(paths.priority(F.lit("README.md"))) == 250
    assert one(paths.priority(F.lit("z.md"), F.lit(262_144 * 3))) == 47
    for path, pattern, want in (
        ("a/temp/x.md", "temp", True), ("temp", "**/temp", False), ("a/temp/x", "**/temp", True), (
            "docs/internal/x", "docs/**/internal", False
        ), ("x/docs/a.md", "./docs", False), ("docs/a.md", "./docs", True),
        ("a/b/c.md", "a/b", True), ("a/v1.x/c.md", "v1.?", True), ("a/V1/c.md", "v?", True),
    ):
        assert one(paths.in_folder(F.lit(path), pattern)) is want, (path, pattern)
    kept = lambda p: one(paths.wanted(F.lit(p), ["docs"], ["docs/old"], ["LICENSE.md"]))
    assert [
        kept(p) for p in ("README.md", "docs/a.md", "docs/old/a.md", "src/a.md", "docs/license.md")
    ] == [True, True, False, False, False]
    assert one(paths.is_documentation(F.lit("A.MDX"))) and not one(paths.is_documentation(F.lit("a.txt")))
    assert one(
        paths.in_excluded_folder(F.lit("a/Node_Modules/b.md"))
    ) and one(paths.in_excluded_folder(F.lit(".x/b.md")))


def test_labels(one):
    assert [
        one(labels.reputation(F.lit(x).cast("double"))) for x in (None, -1, 0, 4, 7)
    ] == ["Unknown", "Unknown", "Low", "Medium", "High"]
    assert one(labels.popularity_score(F.lit(50_000), F.lit(100), F.lit(1))) == 5_699_157
    assert [one(labels.refresh_days(F.lit(x))) for x in (100, 101, 1001, 5001)] == [1, 15, 30, 45]
    assert one(labels.first_alias(F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")), "a", ["b", "c"])) == "2"
    assert one(labels.clamp(F.lit(99), 1, 50, 20)) == 50 and one(labels.clamp(F.lit(None).cast("int"), 1, 50, 20)) == 20
    assert one(labels.paging(F.lit("1"), F.lit("x"), F.lit("true"))) is None
    assert tuple(one(labels.paging(F.lit("1"), F.lit("2"), F.lit("True")))) == (1, 2, True)
    assert one(labels.hint(F.lit("x"), {"a": "b"}, "c")) == "c"
    assert "API key" in one(labels.status_message(F.lit(429), F.lit(False)))
    now = F.lit("2024-01-02 00:00:00")
    assert one(
        labels.is_fresh(F.lit("2024-01-01 00:00:01"), now)
    ) and not one(labels.is_fresh(F.lit("2024-01-01 00:00:00"), now)) and not one(labels.is_fresh(F.lit(None), now))
    assert one(labels.token_expired(F.lit("2024-01-02 00:00:59"), now))


def test_formats(one):
    assert one(formats.truncate(F.lit("abc"), 3)) == "abc" and one(
        formats.truncate(F.lit("abcd"), 3)
    ).startswith("abc\n")
    codes = F.array(F.struct(F.lit("js").alias("language"), F.lit("x()").alias("code")))
    assert one(formats.code_snippet(F.lit("T"), F.lit("d"), codes)) == "### T\n\nd\n\n```js\nx()\n```"
    assert one(formats.info_snippet(F.lit(""), F.lit("c"))) == "### Documentation\n\nc"
    assert one(formats.provenance(F.lit("/a/b"), F.lit("c"), F.lit(2))).endswith("omitted: 2")
    assert one(
        formats.library_block(F.lit("t"), F.lit("/a/b"), F.lit(""), F.lit(-1), F.lit("High"), F.array(F.lit("v1")))
    ) == "- Title: t\n- Library ID: /a/b\n- Source Reputation: High\n- Versions: v1"


def test_catalog(spark):
    hits = [
        ("/Facebook/React", "React", 250_000, "x", 100, 1), ("/example/new-library", "new", 50_000, "x", 100, 2),
        ("/EXAMPLE/new-library", "again", 40_000, "y", 90, 3)
    ]
    df = spark.createDataFrame(
        [(a, b, None, c, d, e, f) for a, b, c, d, e, f in hits],
        "library_id string, title string, description string, stars bigint, source string, weight int, arrival bigint"
    )
    curated = spark.createDataFrame([("/facebook/react", 0)], "library_id string, position bigint")
    got = catalog.merge_candidates(df, 10, curated).orderBy("rank").collect()
    assert [(r["library_id"], r["score"], r["rank"]) for r in got] == [
        ("/facebook/react", 2_000_000_000, 1), ("/example/new-library", 5_699_257, 2)
    ]
    topics = F.array(F.lit("Awesome-List"))
    none = F.lit(None).cast("boolean")
    row = spark.range(1).select(
        catalog.is_candidate(F.lit("x"), topics, none, none).alias("a"),
        catalog.is_candidate(F.lit("my-Awesome-x"), F.array(F.lit("q")), none, none).alias("b"),
        catalog.is_candidate(F.lit("awesomeness"), F.array(F.lit("q")), none, none).alias("c"),
        catalog.usable_repository(none, none, F.lit(0)).alias("d"),
        catalog.usable_repository(none, none, F.lit(None).cast("int")).alias("e")
    ).first()
    assert tuple(row) == (False, False, True, False, True)


def test_percentiles_and_metrics(spark):
    for n, want in ((9, (4.0, 8.0)), (10, (5.0, 9.0)), (1, (0.0, 0.0))):
        df = spark.range(n).select(F.col("id").cast("double").alias("v"))
        assert tuple(catalog.exact_percentiles(df, "v", [0.5, 0.95]).first()) == want
    r = catalog.retrieval_metrics(spark.createDataFrame([(1,), (0,), (4,), (8,)], "r int"), "r").first()
    assert (r["mrr"], r["recall"]) == ((1 + 0.25 + 0.125) / 4, 0.5)


def test_freshness_and_policies(spark):
    usual = {
        "stored": True, "parser_ok": True, "checked_at": "2024-01-01 00:00:00", "now": "2024-02-01 00:00:00",
        "commit": "a", "remote": "a", "failed": False, "force": False,
    }

    def state(**changed):
        values = [F.lit(v) for v in (usual | changed).values()]
        return spark.range(1).select(catalog.freshness_state(*values)).first()[0]

    assert state() == "cached" and state(stored=False) == "indexed" and state(parser_ok=False) == "refreshed" and state(failed=True) == "stale-fallback"
    assert state(remote="b") == "refreshed" and state(
        remote="b", now="2024-01-01 12:00:00"
    ) == "cached" and state(force=True) == "refreshed"
    rows = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "k int, ok int")
    key = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert [r["k"] for r in catalog.policy_filter(rows, F.col("ok") == 1, "k", key(1), key(1, 3)).collect()] == [3]


def test_defaults_and_kinds(one):
    kept = lambda p: one(paths.wanted_by_default(F.lit(p)))
    assert [
        kept(p) for p in (
            "docs/a.md", "docs/old/a.md", "my-archive-1/a.md", "i18n/de-AT/a.md", "docs/Changelog.md", "i18n/en/a.md"
        )
    ] == [True, False, False, False, False, True]
    assert [one(ids.is_repository_id(F.lit(x))) for x in ("/a/b", "/websites/b", "a/b/c")] == [True, False, False]
    null = F.lit(None).cast("double")
    assert one(labels.passes_quality(F.lit(False), null, null, null)) and not one(
        labels.passes_quality(F.lit(True), null, null, null, least_trust=4)
    )
    assert one(labels.passes_quality(F.lit(True), F.lit(7.0), F.lit(20), F.lit(500), True, 7, 30, 100))
