from lexispark.llm.queries import URL_RULES
from lexispark.llm.url_filters import build_cascade, filter_urls
from pyspark.sql import functions as F


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in URL_RULES:
        h = rule.split("/")[0]
        if (host == h or host.endswith("." + h)) and path.startswith(rule[len(h) :]) and (
            best is None or len(rule) > len(best)
        ):
            best = rule
    return host, path, best, URL_RULES.get(best, "allow")


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1", "http://a.example.org/en/12?x=/es/", "http://example.org/en/2", "http://org", "http://org/", "http://xorg/", "x://com/fr/a#b", "http://a.b.c.com/de/",
    "http://a.com?/fr/", "http://É.com/fr/\nx", "http://.com/fr/", "http://com./fr/", "a://b://com/fr/", "http://" + "a." * 500 + "com/de/" + "x" * 5000,
]


def test_odd_rows(spark):
    pages = spark.createDataFrame(
        [(i, u, "h", 3) for i, u in enumerate(URLS * 2)], "page_id int, url string, rule string, key int"
    )
    got = filter_urls(pages, URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"]), r["url"]
    assert filter_urls(pages.where("false"), URL_RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, {}, default="block").collect()} == {"block"}


def test_cascade_is_exact_over_the_universe(spark):
    universe = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("crc32(key) % 7 = 0")
    cascade = build_cascade(listed.unionByName(listed), universe, bits_per_key=4, hashes=2)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != (F.crc32("key") % 7 == 0))
    assert wrong.count() == 0
    assert build_cascade(listed.where("false"), universe).levels == ()


def test_columns_of_any_name_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", 5, 6, 7)], "page_id int, url string, __best int, best int, data int")
    got = filter_urls(pages, URL_RULES)
    assert got.columns == ["page_id", "url", "__best", "best", "data", "host", "path", "rule", "verdict"]
    assert got.first()["best"] == 6 and got.first()["rule"] == "org/"


def test_a_list_of_hundreds_of_thousands(spark):
    """The plan names each level once, so a long list is planned and asked in seconds."""
    rules = {f"h{k}.example/": "block" if k % 3 else "allow" for k in range(0, 400_000, 2)}
    pages = spark.range(5000).selectExpr("id AS page_id", "concat('http://h', id * 37 % 400000, '.example/p') AS url")
    got = filter_urls(pages, rules, default="none").collect()
    for r in got:
        k = r["page_id"] * 37 % 400_000
        want = (f"h{k}.example/", "block" if k % 3 else "allow") if k % 2 == 0 else (None, "none")
        assert (r["rule"], r["verdict"]) == want
