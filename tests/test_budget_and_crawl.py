"""Budgets in rounds, percentiles of skewed values, crawls and addresses."""

import random
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from lexispark.functions import urls
from lexispark.operators import catalog, crawl, selection


def greedy(sizes, most_rows, most_size):
    taken, rows, room = [], most_rows, most_size
    for s in sizes:
        ok = s is not None and rows > 0 and s <= room
        taken.append(ok)
        if ok:
            rows, room = rows - 1, room - s
    return taken


@pytest.mark.parametrize("few", [0, 5, 10_000])
@pytest.mark.parametrize("most_rows,most_size", [(10, 60), (1000, 200), (3, 10_000), (1000, 0)])
def test_budget_in_rounds(spark, few, most_rows, most_size):
    rng = random.Random(most_rows + most_size)
    rows = [(g, k, rng.choice([0, 1, 3, 7, 20, 55, 300, None])) for g in "abc" for k in range(60)] + [("d", 0, 5)]
    df = spark.createDataFrame(rows, "g string, k int, size bigint")
    got = selection.budget_fold(df, ["g"], ["k"], "size", most_rows, most_size, few=few)
    by_group = {}
    for r in sorted(got.collect(), key=lambda r: (r["g"], r["k"])):
        by_group.setdefault(r["g"], []).append(r["taken"])
    for g in "abcd":
        assert by_group[g] == greedy([s for h, _, s in rows if h == g], most_rows, most_size)


def test_files_in_rounds(spark):
    rng = random.Random(9)
    files = spark.createDataFrame(
        [(f"docs/{k:03}.md", "x" * rng.randrange(1, 400) + str(k % 90)) for k in range(200)], "path string, content string"
    )
    limits = {"max_files": 60, "max_file_bytes": 380, "max_index_bytes": 5000}
    rows = lambda few: sorted(map(tuple, selection.select_files(files, few=few, **limits).collect()))
    assert rows(0) == rows(10_000)


def test_one_group_is_not_one_task(spark):
    """In a round the rows of one group are spread over ranges: no exchange is by the group alone but of sums."""
    df = spark.range(5000).selectExpr("1 AS g", "id AS k", "id % 7 AS size")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = selection.budget_fold(df, ["g"], ["k"], "size", 10**6, 10**6, few=0)
        assert out.where("taken").count() == 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_percentiles_of_skewed_values(spark):
    values = [float(k % 10) for k in range(1000)] + [1e12, -1e9, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    got = catalog.exact_percentiles(df, "v", [0.0, 0.5, 0.95, 0.999, 1.0]).first()
    want = [known[min(len(known) - 1, int(len(known) * f))] for f in (0.0, 0.5, 0.95, 0.999, 1.0)]
    assert list(got) == want
    assert list(catalog.exact_percentiles(df.where("false"), "v", [0.5]).first()) == [None]


BASE = "http://h.org/a/b/c?q=1"
REFERENCES = [
    "d", "./d", "../d", "../../../d", "/x/../y/", "?z=2", "", "#top", "//o.net/p", "https://s.io/b?c#d", "d/..", "d/.",
    "..", "mailto:a@b.c", "/", "e f", " /trim ", "a?b/../c", "HTTP://Big.org", "//o.net"
]


def test_references_resolve_as_in_python(spark):
    df = spark.createDataFrame([(r,) for r in REFERENCES], "r string")
    for base in (BASE, "http://h.org", "https://h.org/x/"):
        got = {r["r"]: r["u"] for r in df.select("r", urls.resolve(F.lit(base), F.col("r")).alias("u")).collect()}
        for r in REFERENCES:
            want = urldefrag(urljoin(base, r.strip()))[0]
            assert got[r].lower().rstrip("/") == want.lower().rstrip("/"), (base, r)
    none = df.limit(1).select(urls.resolve(F.lit(None).cast("string"), F.col("r")).alias("u")).first()
    assert none["u"] is None


def test_links_of_pages(spark):
    pages = [
        ("http://h.org/a#x", "<a href='/b'>1</a> <A class=q HREF=\"c?x=1&amp;y=2#f\">2</A><a href=d>3</a><link href='/no'>"),
        ("http://h.org/e", "<a name=x>no</a><a href='mailto:x@y.z'>m</a><a href='/b'>1</a><a href='/b'>again</a>"),
        (None, "<a href='/b'>"), ("http://h.org/f", None), ("http://h.org/g", "")
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    assert sorted(map(tuple, crawl.page_links(df).collect())) == [
        ("http://h.org/a", "http://h.org/b"), ("http://h.org/a", "http://h.org/c?x=1&y=2"),
        ("http://h.org/a", "http://h.org/d"), ("http://h.org/e", "http://h.org/b")
    ]


def breadth_first(starts, links, max_depth, max_pages, site):
    out = {}
    front = sorted({s for s in starts})
    visited: dict[str, int] = {}
    depth = 0
    while front and depth <= max_depth:
        new = []
        for u in sorted(set(front)):
            if u not in visited and sum(site(v) == site(u) for v in visited) < max_pages:
                visited[u] = depth
                new.append(u)
        front = [t for s, t in links if s in new and site(s) == site(t) and t not in visited]
        depth += 1
    for u, d in visited.items():
        out[u] = (site(u), u, d)
    return sorted(out.values())


@pytest.mark.parametrize("depth,pages", [(0, 9), (1, 9), (3, 4), (9, 100), (9, 1)])
def test_crawl_of_a_graph_with_cycles(spark, depth, pages):
    rng = random.Random(1)
    names = [f"http://s{k % 3}.org/{k}" for k in range(40)]
    links = [(a, rng.choice(names)) for a in names for _ in range(3)]
    starts = names[:4]
    site = lambda u: u.split("/")[2]
    got = crawl.crawl(
        spark.createDataFrame([(s,) for s in [*starts, *starts, None]], "url string"),
        spark.createDataFrame(links, "source string, target string"), depth, pages
    )
    assert sorted(map(tuple, got.select("site", "url", "depth").collect())) == breadth_first(starts, links, depth, pages, site)


def test_crawl_leaves_excluded_addresses_out(spark):
    links = spark.createDataFrame([("http://a.b/1", "http://a.b/x/2"), ("http://a.b/x/2", "http://a.b/3")], "source string, target string")
    starts = spark.createDataFrame([("http://a.b/1",)], "url string")
    kept = crawl.crawl(starts, links, excluded=F.col("url").contains("/x/"))
    assert [r["url"] for r in kept.collect()] == ["http://a.b/1"]
    assert crawl.crawl(starts.where("false"), links).count() == 0
