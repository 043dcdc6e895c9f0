"""The registered queries over the engine's operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import formats, identifiers, labels, paths, text, vectors
from lexispark.operators import catalog, chunks, reading, rerank, search, selection, topics
from lexispark.plans.planner import Facet, candidate_limit, plan_query, terms, token_budget
from lexispark.scratch import cut, fresh_folder
from lexispark.streaming import sessions

TOPIC = "the history of that and is"
PHRASES = Facet("all", (("of", "the"),))
NOW = "2024-01-30 12:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Tables whose texts are worth dealing out before they are analysed, by their key.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A table of texts that comes in fewer parts than there are cores (a small file) is dealt out first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, TEXTS[name]) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.document_chunks(read(spark, sf_dir, "documents"))


# --- SQL building blocks -------------------------------------------------------------------------------------------

SP = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SP}', ' ', 'g')"


def sql_tokens(x: str) -> str:
    return rf"regexp_replace(' ' || lower(coalesce({x}, '')) || ' ', '[^\p{{L}}\p{{N}}]+', '  ', 'g')"


def sql_count(tokens: str, unit: tuple[str, ...]) -> str:
    needle = " " + "  ".join(unit) + " "
    return f"((length({tokens}) - length(replace({tokens}, '{needle}', ''))) // {len(needle)})"


SQL_TERMS = r"""list_filter(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_.$#:@/-]+'), lambda t: regexp_replace(t, '^[/#]+|[/#]+$', '', 'g')),
 lambda t: length(t) > 1 AND t NOT IN ({stop}))"""


def sql_terms(x: str) -> str:
    every = SQL_TERMS.format(x=x, stop=", ".join(f"'{w}'" for w in text.STOP_WORDS))
    return f"list_filter({every}, lambda t, i: list_position({every}, t) = i)"


SQL_DOCS = "SELECT doc_id AS id, source AS doc_path, lang AS doc_title, '' AS section_title, text AS content, ceil(length(text) / 4.0)::INTEGER AS tokens FROM documents"


def sql_visible(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for e, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        bare = f"replace({bare}, '{e}', '{c}')"
    return f"trim({sql_collapse(bare)})"


def sql_element(x: str, tag: str) -> str:
    return sql_visible(f"regexp_extract({x}, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)")


SQL_PAGES = f"""SELECT page_id AS id, regexp_replace(url, '[?#].*$', '') AS doc_path, {sql_element("html", "title")} AS doc_title, {sql_element("html", "h1")} AS section_title,
 {sql_visible("html")} AS content, ceil(length({sql_visible("html")}) / 4.0)::INTEGER AS tokens FROM pages"""


def sql_facets(source: str, facets: list[Facet], limit: int, fields: dict[str, float] | None = None) -> str:
    """CTEs up to ``ranked``: (facet, id, score, rank) of the best of each facet; base has the chunks' columns."""
    fields = fields or search.FIELDS
    units = list(dict.fromkeys(u for f in facets for u in f.units if u))
    tf = {u: " + ".join(f"{w} * {sql_count(f't_{f}', u)}" for f, w in fields.items()) for u in units}
    length = " + ".join(f"(length(t_{f}) - length(replace(t_{f}, ' ', ''))) // 2 - 1" for f in fields)
    out = [
        f"base AS ({source})",
        "analyzed AS (SELECT *, " + ", ".join(f"{sql_tokens(f)} AS t_{f}" for f in fields) + " FROM base)",
        "counted AS (SELECT id, " + ", ".join(
            [*(f"{tf[u]} AS u{i}" for i, u in enumerate(units)), f"{length} AS len"]
        ) + " FROM analyzed)",
        "stats AS (SELECT count(*) AS n, avg(len) AS mean, " + ", ".join(
            f"count(*) FILTER (WHERE u{i} > 0) AS d{i}" for i in range(len(units))
        ) + " FROM counted)",
    ]
    score = lambda i: f"CASE WHEN u{i} > 0 THEN greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * u{i} * 2.2 / (u{i} + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0 END"
    parts = []
    for k, f in enumerate(facets):
        if not f.units or () in f.units:
            continue
        own = [units.index(u) for u in f.units]
        test = (" OR " if f.mode == "any" else " AND ").join(f"u{i} > 0" for i in own)
        parts.append(
            f"SELECT {k} AS facet, id, round({' + '.join(score(i) for i in own)}, 9) AS score FROM counted, stats WHERE {test}"
        )
    out.append("scored AS (" + " UNION ALL ".join(parts) + ")")
    out.append(
        f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY score DESC, id) - 1 AS rank FROM scored) WHERE rank < {limit})"
    )
    return ",\n".join(out)


def sql_boost(known: list[str]) -> str:
    title, body = "lower(doc_title || ' ' || section_title)", "lower(content)"
    hits = lambda where, of: " + ".join([f"contains({where}, '{t}')::INTEGER" for t in of]) or "0"
    names = [t for t in known if any(c in t for c in "._:$#/-")]
    return f"(({hits(title, known)}) * 0.018 + ({hits(body, known)}) * 0.003 + ({hits(body, names)}) * 0.025)::DOUBLE"


def sql_fused(topic: str, source: str, limit: int | None = None, seen: str | None = None) -> str:
    without = f"WHERE id NOT IN ({seen})" if seen else ""
    return f"""{sql_facets(source, plan_query(topic), candidate_limit(limit))},
merged AS (SELECT id, sum(1.0 / (rank + 51)) AS rrf, count(*) AS matched_queries, min(facet) AS first_facet FROM ranked {without} GROUP BY id),
fused AS (SELECT b.*, round(rrf + {sql_boost(terms(topic))} + CASE WHEN first_facet > 1 THEN 0.008 ELSE 0 END, 9) AS score, matched_queries FROM merged JOIN base b USING (id))"""


# --- terms and facets ----------------------------------------------------------------------------------------------


@query(f"SELECT item_id, {sql_terms('text')} AS terms FROM benchmark")
def tokenize_terms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", text.terms(F.col("text")).alias("terms"))


@query(
    f"""WITH t AS (SELECT item_id, {sql_terms('text')} AS ts FROM benchmark)
SELECT item_id, array_to_string(ts[1:18], ' OR ') AS any_facet, array_to_string(ts[1:8], ' AND ') AS all_facet,
 array_to_string(list_filter(ts[1:18], lambda t: regexp_matches(t, '[._:$#/-]'))[1:6], ' | ') AS identifiers,
 least(5000, 1600 + 180 * len(ts))::INTEGER AS token_budget FROM t"""
)
def facet_plan(spark, sf_dir):
    """Facets of every benchmark text, as Column functions; the texts have no quotes, so identifiers follow the first two."""
    t = read(spark, sf_dir, "benchmark").select(
        "item_id", text.facets(F.col("text")).alias("f"), text.token_budget(F.col("text")).alias("token_budget")
    )
    marks = F.filter("f", lambda x: x.rlike(text.IDENTIFIER) & ~F.contains(x, F.lit(" ")))
    return t.select(
        "item_id", F.get("f", F.lit(0)).alias("any_facet"), F.get("f", F.lit(1)).alias("all_facet"),
        F.array_join(marks, " | ").alias("identifiers"), "token_budget"
    )


BM25 = [Facet("any", (("the",), ("history",), ("that",), ("retionth",)))]
BM25_ALL = [Facet("all", (("the",), ("of",), ("that",)))]


@query(f"WITH {sql_facets(SQL_DOCS, BM25, 20)} SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM ranked")
def bm25_or_topk(spark, sf_dir):
    return search.top_of_facets(
        search.score_facets(documents(spark, sf_dir), BM25), 20
    ).select("id", "rank", F.round("score", 6).alias("score"))


@query(
    f"WITH {sql_facets(SQL_DOCS, BM25_ALL, 20)} SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM ranked"
)
def bm25_and_topk(spark, sf_dir):
    return search.top_of_facets(
        search.score_facets(documents(spark, sf_dir), BM25_ALL), 20
    ).select("id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {sql_facets(SQL_DOCS, [PHRASES], 1000000)} SELECT id, round(score, 6) AS score FROM ranked")
def phrase_match(spark, sf_dir):
    """Every document with a phrase of adjacent tokens."""
    return search.score_facets(documents(spark, sf_dir), [PHRASES]).select("id", F.round("score", 6).alias("score"))


@query(
    f"WITH {sql_facets(SQL_DOCS, BM25, 10, {'doc_title': 5.0, 'section_title': 10.0, 'content': 1.0})} SELECT id, rank::INTEGER AS rank, round(score, 6) AS score FROM ranked"
)
def legacy_bm25(spark, sf_dir):
    return search.legacy_top(
        documents(spark, sf_dir), "the history that retionth"
    ).select("id", "rank", F.round("score", 6).alias("score"))


@query(
    f"WITH t AS (SELECT doc_id AS id, unnest(string_split_regex(trim({sql_tokens('text')}), ' +')) AS term FROM documents) SELECT id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL"
)
def inverted_index(spark, sf_dir):
    return search.build_postings(documents(spark, sf_dir), {"content": 1.0}).select("id", "term", "tf")


# --- fusion and selection ------------------------------------------------------------------------------------------


@query(f"WITH {sql_fused(TOPIC, SQL_PAGES)} SELECT id, doc_path, matched_queries, round(score, 6) AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    """The flagship: plan a topic, search all facets over pages, fuse the ranked lists."""
    ranked = search.candidates(chunks.page_chunks(read(spark, sf_dir, "pages")), TOPIC)
    return search.fuse(ranked, terms(TOPIC)).select(
        "id", "doc_path", "matched_queries", F.round("score", 6).alias("score")
    )


@query(f"WITH {sql_fused(TOPIC, SQL_DOCS)} SELECT id, doc_path, matched_queries, round(score, 6) AS score FROM fused")
def rrf_documents(spark, sf_dir):
    ranked = search.candidates(documents(spark, sf_dir), TOPIC)
    return search.fuse(ranked, terms(TOPIC)).select(
        "id", "doc_path", "matched_queries", F.round("score", 6).alias("score")
    )


@query(f"SELECT id, round({sql_boost(terms(TOPIC))}, 6) AS boost FROM ({SQL_PAGES})")
def lexical_boost(spark, sf_dir):
    return chunks.page_chunks(read(spark, sf_dir, "pages")).select(
        "id", F.round(search.lexical_boost(terms(TOPIC)), 6).alias("boost")
    )


SEEN_SQL = "SELECT event_id FROM events WHERE user_id % 3 = 0 AND event_type = 'view'"


@query(
    f"WITH {sql_fused(TOPIC, SQL_DOCS, seen=SEEN_SQL)} SELECT id, matched_queries, round(score, 6) AS score FROM fused"
)
def seen_exclusion(spark, sf_dir):
    """What was shown before is left out, after the ranks are given."""
    seen = read(spark, sf_dir, "events").where(
        "user_id % 3 = 0 AND event_type = 'view'"
    ).select(F.col("event_id").alias("id"))
    ranked = search.candidates(documents(spark, sf_dir), TOPIC)
    return search.fuse(ranked, terms(TOPIC), seen).select("id", "matched_queries", F.round("score", 6).alias("score"))


def sql_search(topic: str, source: str, limit: int | None = None, budget: int | None = None) -> str:
    """A whole search: rows (position, id) of the diverse selection, as the CTE ``found`` and what it needs."""
    budget = token_budget(topic, budget)
    return f"""{sql_fused(topic, source, limit)},
listed AS (SELECT id, doc_path, tokens, substr({sql_collapse('lower(content)')}, 1, 180) AS print, row_number() OVER (ORDER BY score DESC, matched_queries DESC, id) AS n FROM fused),
walk(n, ids, paths, prints, total) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], []::VARCHAR[], 0::BIGINT
  UNION ALL
  SELECT l.n, CASE WHEN ok THEN list_append(ids, l.id) ELSE ids END, CASE WHEN ok THEN list_append(paths, l.doc_path) ELSE paths END,
         CASE WHEN ok THEN list_append(prints, l.print) ELSE prints END, CASE WHEN ok THEN total + l.tokens ELSE total END
  FROM (SELECT w.*, l.id, l.doc_path, l.tokens, l.print, l.n AS ln,
         len(list_filter(paths, lambda p: p = l.doc_path)) < 3 AND NOT list_contains(prints, l.print) AND (len(ids) = 0 OR total + l.tokens <= {budget}) AND len(ids) < {limit or 12} AS ok
        FROM walk w JOIN listed l ON l.n = w.n + 1) AS l(n0, ids, paths, prints, total, id, doc_path, tokens, print, n, ok)
), final AS (SELECT ids FROM walk ORDER BY n DESC LIMIT 1),
found AS (SELECT (generate_subscripts(ids, 1) - 1)::INTEGER AS position, unnest(ids) AS id FROM final)"""


@query(f"WITH RECURSIVE {sql_search(TOPIC, SQL_DOCS)} SELECT position, id FROM found")
def diverse_select(spark, sf_dir):
    """A whole search: plan, facets, fusion, selection within a token budget."""
    return search.search(documents(spark, sf_dir), TOPIC).select("position", "id")


BUDGET_ROWS, BUDGET_BYTES = 20, 20_000


@query(
    f"""WITH RECURSIVE l AS (SELECT source, doc_id, strlen(text) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
walk AS (
  SELECT source, doc_id, bytes, n, bytes <= {BUDGET_BYTES} AS taken, (bytes <= {BUDGET_BYTES})::INTEGER AS k, CASE WHEN bytes <= {BUDGET_BYTES} THEN bytes ELSE 0 END AS total FROM l WHERE n = 1
  UNION ALL
  SELECT l.source, l.doc_id, l.bytes, l.n, k < {BUDGET_ROWS} AND total + l.bytes <= {BUDGET_BYTES}, k + (k < {BUDGET_ROWS} AND total + l.bytes <= {BUDGET_BYTES})::INTEGER,
         total + CASE WHEN k < {BUDGET_ROWS} AND total + l.bytes <= {BUDGET_BYTES} THEN l.bytes ELSE 0 END
  FROM walk w JOIN l ON l.source = w.source AND l.n = w.n + 1)
SELECT source, doc_id, bytes, taken FROM walk"""
)
def budget_select(spark, sf_dir):
    """Files of each library in order while its budgets last."""
    d = read(spark, sf_dir, "documents").select(
        "source", "doc_id", F.octet_length("text").cast("bigint").alias("bytes")
    )
    return selection.budget_fold(d, ["source"], ["doc_id"], "bytes", BUDGET_ROWS, BUDGET_BYTES)


@query(
    "SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies, doc_id = min(doc_id) OVER w AS is_first FROM documents WINDOW w AS (PARTITION BY text)"
)
def exact_dedup(spark, sf_dir):
    return selection.exact_duplicates(
        read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id"
    ).select("doc_id", "digest", "first_id", "copies", "is_first")


# --- paths and urls ------------------------------------------------------------------------------------------------

SQL_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '')"


def page_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").withColumn(
        "path", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "")
    )


def sql_priority(p: str, n: str) -> str:
    return "50 + " + " + ".join(
        f"CASE WHEN regexp_matches({p if part == 'p' else n}, '{rule}') THEN {worth} ELSE 0 END" for part, rule,
        worth in paths.PRIORITIES
    )


@query(
    f"SELECT page_id, path, ({sql_priority('lower(path)', 'lower(name)')})::INTEGER AS priority FROM (SELECT page_id, {SQL_PATH} AS path, regexp_extract({SQL_PATH}, '[^/]*$') AS name FROM pages)"
)
def path_priority(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", "path", paths.priority(F.col("path")).alias("priority"))


@query(
    rf"""SELECT page_id, path, (regexp_matches(path, '(?i)(^|/)e[^/](/|$)') OR list_contains(string_split(path, '/'), 'de') OR NOT contains(path, '/'))
 AND NOT regexp_matches(path, '(?i)(^|/)en/1[^/]*(/|$)') AND lower(regexp_extract(path, '[^/]*$')) NOT IN ('25930') AS kept,
 regexp_matches(lower(path), '({"|".join(e.replace(".", "[.]") for e in paths.EXTENSIONS)})$') AS is_doc FROM (SELECT page_id, {SQL_PATH} AS path FROM pages)"""
)
def path_filter(spark, sf_dir):
    p = F.col("path")
    return page_paths(spark, sf_dir).select(
        "page_id", "path", paths.wanted(p, ["e?", "de"], ["en/1*"], ["25930"]).alias("kept"),
        paths.is_documentation(p).alias("is_doc")
    )


@query(
    "SELECT url, min(page_id) AS page_id, count(*) AS copies FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?][^#]*', '') AS url FROM pages) GROUP BY url"
)
def canonical_url_dedup(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(
        "page_id", identifiers.canonical_url(F.col("url"), keep_query=False).alias("url")
    )
    return p.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query(f"SELECT id, doc_path, doc_title, section_title, content, tokens FROM ({SQL_PAGES})")
def html_section_extract(spark, sf_dir):
    return chunks.page_chunks(read(spark, sf_dir, "pages")).select(
        "id", "doc_path", "doc_title", "section_title", "content", "tokens"
    )


SQL_ID = r"regexp_extract(url, '://([^/?#]*)', 1) || '/' || regexp_replace(url, '^[a-z]+://[^/]*/', '')"


@query(
    rf"""WITH v AS (SELECT page_id, regexp_replace(trim({SQL_ID}), '^/+|/+$', '', 'g') AS b FROM pages),
p AS (SELECT page_id, split_part(b, '/', 1) AS owner, split_part(b, '/', 2) AS repo, regexp_extract(b, '^[^/]*/[^/]*/(.*)$', 1) AS rest FROM v)
SELECT page_id, CASE WHEN ok THEN '/' || owner || '/' || repo || CASE WHEN rest <> '' THEN '/' || rest ELSE '' END END AS id, CASE WHEN ok AND rest <> '' THEN rest END AS version,
 CASE WHEN ok THEN 'https://github.com/' || owner || '/' || repo || '.git' END AS repository_url
FROM (SELECT *, regexp_full_match(owner, '[A-Za-z0-9_.-]+') AND regexp_full_match(repo, '[A-Za-z0-9_.-]+') AND owner NOT IN ('.', '..') AND repo NOT IN ('.', '..')
  AND (rest = '' OR (regexp_full_match(rest, '[A-Za-z0-9_.+/-]+') AND NOT contains(rest, '..'))) AS ok FROM p)"""
)
def parse_library_id(spark, sf_dir):
    v = F.concat(
        F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    )
    ref = identifiers.parse_library_id(v)
    return read(spark, sf_dir, "pages").select(
        "page_id", ref["id"].alias("id"), ref["version"].alias("version"), ref["repository_url"].alias("repository_url")
    )


@query(
    r"""WITH a AS (SELECT page_id, page_id % 4 AS k, regexp_extract(url, '://([^/?#]*)', 1) AS o, 'r' || page_id AS r FROM pages)
SELECT page_id, CASE WHEN k = 3 THEN NULL ELSE '/' || o || '/' || r END AS id FROM a"""
)
def parse_repo_url(spark, sf_dir):
    """Repository addresses in four spellings, the last on another host."""
    o, r = F.regexp_extract("url", "://([^/?#]*)", 1), F.concat(F.lit("r"), F.col("page_id").cast("string"))
    k = F.col("page_id") % 4
    address = (
        F.when(
            k == 0, F.concat(F.lit("git+https://github.com/"), o, F.lit("/"), r, F.lit(".git"))
        ).when(k == 1, F.concat(F.lit("git@github.com:"), o, F.lit("/"), r, F.lit(".git")))
        .when(k == 2, F.concat(o, F.lit("/"), r, F.lit(".git"))).otherwise(
            F.concat(F.lit("https://example.com/"), o, F.lit("/"), r)
        )
    )
    return read(spark, sf_dir, "pages").select("page_id", identifiers.parse_repository(address)["id"].alias("id"))


@query(
    rf"""SELECT page_id, sha256(lower(url)) AS storage_key, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS search_name,
 'https://github.com/a/b/blob/main/' || array_to_string(list_transform(string_split({SQL_PATH}, '/'), lambda p: url_encode(p)), '/') AS source_url,
 'main:' || page_id AS result_key FROM pages"""
)
def source_keys(spark, sf_dir):
    url = F.col("url")
    return page_paths(spark, sf_dir).select(
        "page_id", identifiers.storage_key(url).alias("storage_key"), text.search_name(url).alias("search_name"), identifiers.source_url(
            F.lit("https://github.com/a/b.git"), F.lit("main"), F.col("path")
        ).alias("source_url"),
        identifiers.result_key(F.lit("main"), F.col("page_id")).alias("result_key"),
    )


# --- previews, labels ----------------------------------------------------------------------------------------------


@query(
    f"""SELECT doc_id, substr(trim({sql_collapse("regexp_replace(text, '[\\x{0}-\\x{1F}\\x{7F}]+', ' ', 'g')")}), 1, 300) AS label,
 CASE WHEN length(trim({sql_collapse('text')})) > 360 THEN substr(trim({sql_collapse('text')}), 1, 360) || '…' ELSE trim({sql_collapse('text')}) END AS preview FROM documents"""
)
def safe_preview(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", text.safe_label(F.col("text")).alias("label"), text.preview(F.col("text")).alias("preview")
    )


@query(
    "SELECT s_suppkey, CASE WHEN s_acctbal IS NULL OR s_acctbal < 0 THEN 'Unknown' WHEN s_acctbal / 1000 >= 7 THEN 'High' WHEN s_acctbal / 1000 >= 4 THEN 'Medium' ELSE 'Low' END AS reputation FROM supplier"
)
def reputation_label(spark, sf_dir):
    bal = F.col("s_acctbal")
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", labels.reputation(F.when(bal < 0, bal).otherwise(bal / 1000)).alias("reputation")
    )


@query(
    "SELECT p_partkey, CASE WHEN n <= 0 THEN '0' WHEN n < 100 THEN '<100' WHEN n < 500 THEN '<500' WHEN n < 1000 THEN '<1000' ELSE '1000+' END AS installs FROM (SELECT p_partkey, p_partkey - 1 AS n FROM part)"
)
def popularity_bucket(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", labels.popularity_range(F.col("p_partkey") - 1).alias("installs")
    )


@query(
    "SELECT p_partkey, n AS rank, CASE WHEN n <= 100 THEN 1 WHEN n <= 1000 THEN 15 WHEN n <= 5000 THEN 30 ELSE 45 END AS days FROM (SELECT p_partkey, p_partkey AS n FROM part)"
)
def refresh_threshold(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_partkey").alias("rank"), labels.refresh_days(F.col("p_partkey")).alias("days")
    )


# --- catalog -------------------------------------------------------------------------------------------------------


@query(
    """WITH h AS (SELECT lower('/c' || o_custkey % 97 || '/Lib' || o_custkey % 97) AS key, o_custkey % 97 AS c, o_orderpriority AS source, floor(o_totalprice)::BIGINT AS stars, o_orderkey AS arrival FROM orders),
m AS (SELECT key, c, max(stars) AS stars, max(100 - length(source)) AS weight, count(DISTINCT source) AS sources FROM h GROUP BY key, c)
SELECT '/c' || c || '/Lib' || c AS library_id, stars, sources, score, (row_number() OVER (ORDER BY score DESC, '/c' || c || '/Lib' || c))::INTEGER AS rank
FROM (SELECT *, round(log10(greatest(10.0, stars + 10.0)) * 1000000 + weight * 10000 + least(10, sources) * 100)::BIGINT AS score FROM m) ORDER BY rank LIMIT 50"""
)
def catalog_merge(spark, sf_dir):
    """Search hits merged to a ranked catalog; ids differ in case."""
    c = (F.col("o_custkey") % 97).cast("string")
    ident = F.concat(F.lit("/c"), c, F.lit("/Lib"), c)
    hits = read(spark, sf_dir, "orders").select(
        ident.alias("library_id"), c.alias("title"), F.lit(None).cast("string").alias("description"), F.floor("o_totalprice").cast("bigint").alias("stars"),
        F.col("o_orderpriority").alias("source"), (
            100 - F.length("o_orderpriority")
        ).alias("weight"), F.col("o_orderkey").alias("arrival"),
    )
    return catalog.merge_candidates(hits, 50).select("library_id", "stars", "sources", "score", "rank")


@query(
    "SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), 'dwidget') OR contains(regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g'), 'dwidget') OR contains(regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g'), 'dwidget')"
)
def name_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.where(catalog.name_matches(p, F.lit("D-Widget"), ["p_name", "p_brand", "p_type"])).select("p_partkey")


@query(
    f"""WITH e AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '{NOW}') < 86400000000 AS fresh FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'indexed' WHEN user_id % 7 = 0 THEN 'refreshed' WHEN fresh THEN 'cached' WHEN user_id % 5 = 0 THEN 'stale-fallback' WHEN user_id % 2 = event_id % 2 THEN 'cached' ELSE 'refreshed' END AS state FROM e"""
)
def freshness_state(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    state = catalog.freshness_state(
        F.col("event_type") != "error", u % 7 != 0, F.col("ts"), F.lit(NOW).cast("timestamp"), u % 2, e % 2, u % 5 == 0
    )
    return read(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query(
    "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND (l.quality = 1 OR d.source = 'src3') GROUP BY d.doc_id"
)
def policy_filter(spark, sf_dir):
    """Blocked documents never, excepted ones always, others by a condition."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    rated = d.join(lab.select("doc_id", "quality"), "doc_id")
    return catalog.policy_filter(
        rated, F.col("quality") == 1, "doc_id", lab.where("toxic = 1"), d.where("source = 'src3'")
    ).select("doc_id").distinct()


@query(
    "SELECT count(*) AS libraries, sum(sections)::BIGINT AS sections, sum(tokens)::BIGINT AS tokens, min(checked_at) AS oldest_check, count(*) FILTER (WHERE parser_version <> 'en') AS outdated FROM (SELECT source, count(*) AS sections, sum(ceil(length(text) / 4.0)::INTEGER) AS tokens, min(doc_id) AS checked_at, min(lang) AS parser_version FROM documents GROUP BY source)"
)
def index_health(spark, sf_dir):
    m = read(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("sections"), F.sum(chunks.estimated_tokens(F.col("text"))).alias("tokens"),
        F.min("doc_id").alias("checked_at"), F.min("lang").alias("parser_version")
    )
    return catalog.index_health(m, "en")


@query(
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"
)
def event_log_latest(spark, sf_dir):
    return catalog.latest_events(
        read(spark, sf_dir, "events"), F.col("user_id"), "event_id"
    ).select("user_id", "event_id", "event_type")


@query(
    """WITH l AS (SELECT CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)
SELECT count(*) AS processed, count(*) FILTER (WHERE s = 'succeeded') AS succeeded, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'skipped') AS skipped, greatest(0, 100 - count(*) FILTER (WHERE s = 'succeeded')) AS remaining FROM l"""
)
def progress_counts(spark, sf_dir):
    last = catalog.latest_events(read(spark, sf_dir, "events"), F.col("user_id"), "event_id")
    return catalog.progress(
        last.withColumn(
            "status",
            F.when(
                F.col("event_type") == "purchase", "succeeded"
            ).when(F.col("event_type") == "error", "failed").otherwise("skipped")
        ),
        100
    )


@query(
    """WITH a AS (SELECT DISTINCT user_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' END AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM a WHERE s IS NOT NULL)"""
)
def resumable_work(spark, sf_dir):
    """What a batch still has to do: neither done nor failed before."""
    last = catalog.latest_events(read(spark, sf_dir, "events"), F.col("user_id"), "event_id")
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed")
    events = last.select(F.col("user_id").alias("c_custkey"), status.alias("status"))
    return catalog.pending(read(spark, sf_dir, "customer").select("c_custkey"), events, "c_custkey")


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"
)
def usage_metrics(spark, sf_dir):
    return catalog.usage(read(spark, sf_dir, "events"), "ts", "user_id", ["event_type"]).withColumnRenamed("period", "day")


@query(
    """WITH d AS (SELECT source, count(*) AS v FROM documents WHERE lang <> 'es' GROUP BY source), a AS (SELECT source, count(*) AS v FROM documents WHERE lang <> 'de' AND source <> 'src4' GROUP BY source)
SELECT coalesce(d.source, a.source) AS source, d.v AS want, a.v AS have, CASE WHEN a.v IS NULL THEN 'created' WHEN d.v IS NULL THEN 'pruned' WHEN d.v = a.v THEN 'unchanged' ELSE 'updated' END AS action FROM d FULL JOIN a ON d.source = a.source"""
)
def manifest_reconcile(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    want, have = d.where("lang <> 'es'").groupBy("source").agg(F.count("*").alias("v")), d.where(
        "lang <> 'de' AND source <> 'src4'"
    ).groupBy("source").agg(F.count("*").alias("v"))
    return catalog.reconcile(want, have, "source", "v")


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events WHERE json_valid(props) AND props::JSON ->> 'k' IS NOT NULL")
def ndjson_parse(spark, sf_dir):
    lines = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return sessions.parse_lines(lines, "k bigint", needs="k")


# --- sessions ------------------------------------------------------------------------------------------------------

SQL_SESSIONS = """b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - INTERVAL 1 HOUR > lag(ts) OVER w THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM b)"""


@query(
    f"""WITH {SQL_SESSIONS}, f AS (SELECT user_id, session_no, event_type, event_id, min(ts) AS t FROM s GROUP BY ALL)
SELECT user_id, session_no::BIGINT AS session_no, event_type, event_id, age::INTEGER AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_no, event_type ORDER BY t DESC, event_id DESC) AS age FROM f) WHERE age <= 500"""
)
def session_seen(spark, sf_dir):
    out = catalog.session_seen(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "ts")
    return out.select("user_id", "session_no", "event_type", "event_id", "age")


@query(
    f"WITH {SQL_SESSIONS} SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 1 HOUR AS ends, count(*) AS events FROM s GROUP BY user_id, session_no"
)
def session_ttl(spark, sf_dir):
    """Sessions with a sliding time to live, by Spark's session window."""
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    # A window of one hour and a microsecond: an event exactly an hour later still belongs to the session.
    w = e.groupBy("user_id", F.session_window("t", "1 hour 1 microsecond").alias("w")).agg(F.count("*").alias("events"))
    end = F.col("w.end") - F.expr("INTERVAL 1 MICROSECOND")
    return w.select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("starts"), end.cast("timestamp_ntz").alias("ends"),
        "events"
    )


# --- reading -------------------------------------------------------------------------------------------------------

SQL_TURNS = "SELECT conv_id * 100 + turn AS id, conv_id::VARCHAR AS doc_path, ceil(length(text) / 4.0)::INTEGER AS tokens, text AS content FROM conversations"


def turn_chunks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("doc_path"),
        chunks.estimated_tokens(F.col("text")).alias("tokens"), F.col("text").alias("content")
    )


@query(
    f"""WITH RECURSIVE c AS ({SQL_TURNS}), a AS (SELECT id AS anchor_id, doc_path FROM c WHERE content IS NOT NULL),
n AS (SELECT anchor_id, c.id, tokens, row_number() OVER (PARTITION BY anchor_id ORDER BY abs(c.id - anchor_id), c.id) AS k FROM c JOIN a USING (doc_path) WHERE c.id BETWEEN greatest(1, anchor_id - 2) AND anchor_id + 3 OR c.id = anchor_id),
walk AS (SELECT anchor_id, id, k, true AS taken, tokens::BIGINT AS total FROM n WHERE k = 1
 UNION ALL SELECT n.anchor_id, n.id, n.k, total + tokens <= 500, CASE WHEN total + tokens <= 500 THEN total + tokens ELSE total END FROM walk w JOIN n ON n.anchor_id = w.anchor_id AND n.k = w.k + 1)
SELECT anchor_id, id, anchor_id = id AS is_anchor FROM walk WHERE taken"""
)
def neighbor_expand(spark, sf_dir):
    """Every turn's surroundings in its conversation, within 500 tokens."""
    c = turn_chunks(spark, sf_dir)
    return reading.neighbours(
        c, c.where("content IS NOT NULL").select(F.col("id").alias("anchor_id")), 500
    ).select("anchor_id", "id", "is_anchor")


@query(
    f"""WITH h AS (SELECT doc_id AS id, {sql_collapse('text')} AS line FROM documents WHERE contains(lower(text), lower('The Of')))
SELECT id, substr(line, greatest(0, instr(lower(line), lower('The Of')) - 1 - 120) + 1, 360) AS snippet FROM h ORDER BY id LIMIT 20"""
)
def literal_grep(spark, sf_dir):
    return reading.grep(documents(spark, sf_dir), "The Of").select("id", "snippet")


# --- vectors -------------------------------------------------------------------------------------------------------

QUERY_VECTOR = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]
SQL_VECTOR = f"{QUERY_VECTOR}::DOUBLE[]"
SQL_COSINE = f"list_cosine_similarity(embedding::DOUBLE[], {SQL_VECTOR})"


@query(
    f"SELECT vec_id AS id, round({SQL_COSINE}, 6) AS similarity FROM embeddings ORDER BY similarity DESC, id LIMIT 25"
)
def cosine_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rerank.cosine_top(v, QUERY_VECTOR, 25).select("id", "similarity")


@query(
    f"""WITH {sql_fused(TOPIC, SQL_DOCS, 24)}, top AS (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 24),
v AS (SELECT top.id, score, coalesce({SQL_COSINE}, -1.0) AS sim FROM top LEFT JOIN embeddings ON vec_id = top.id)
SELECT id, round(0.65 * CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END
 + 0.35 * CASE WHEN max(sim) OVER () = min(sim) OVER () THEN 1 ELSE (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) END, 6) AS score FROM v"""
)
def hybrid_rerank(spark, sf_dir):
    ranked = search.candidates(documents(spark, sf_dir), TOPIC, 24)
    matches = search.fuse(ranked, terms(TOPIC))
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rerank.rerank(matches, v, QUERY_VECTOR).select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_cache_missing(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return rerank.missing_vectors(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), v)


@query(
    "SELECT id, label FROM (SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0)"
)
def vector_upsert(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rerank.upsert(v, v.where("id % 3 = 0").withColumn("label", F.col("label") + 100), ["id"])


# --- evaluation ----------------------------------------------------------------------------------------------------


SQL_TOKEN_ROWS = f"SELECT doc_id AS id, unnest(string_split_regex(trim({sql_tokens('text')}), ' +')) AS term FROM documents"


@query(
    f"""WITH occurs AS ({SQL_TOKEN_ROWS}), counts AS (SELECT id, term, count(*) AS tf FROM occurs WHERE term <> '' GROUP BY ALL),
lengths AS (SELECT doc_id AS id, coalesce(sum(tf), 0) AS len FROM documents LEFT JOIN counts ON id = doc_id GROUP BY doc_id),
corpus AS (SELECT count(*) AS n, avg(len) AS mean FROM lengths),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(string_split_regex(trim({sql_tokens('text')}), ' +')) AS term FROM benchmark) WHERE term <> ''),
idf AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS w FROM counts, corpus GROUP BY term),
scored AS (SELECT item_id, id, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM asked JOIN counts USING (term) JOIN idf USING (term) JOIN lengths USING (id), corpus GROUP BY item_id, id),
lists AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10),
hits AS (SELECT l.item_id, min(rank) AS rank FROM lists l JOIN documents d ON d.doc_id = l.id JOIN benchmark b ON b.item_id = l.item_id WHERE contains(d.text, b.text) GROUP BY l.item_id),
r AS (SELECT item_id, coalesce(rank, 0) AS rank FROM benchmark LEFT JOIN hits USING (item_id))
SELECT count(*) AS scenarios, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 6) AS recall FROM r"""
)
def eval_mrr_recall(spark, sf_dir):
    """Rank of the first relevant document in each scenario's result list, then the metrics.

    A scenario's list are the ten best of all documents for any of its passage's tokens; relevant are those that hold
    the passage.
    """
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), "text")
    best = cut(topics.rank_topics(d, b, 10, {"content": 1.0}).select("topic", "id", "rank"))
    found = d.join(F.broadcast(best) if best.count() <= 200_000 else best, "id")  # few rows: no text is shuffled
    ranks = catalog.first_relevant(b, found, "topic", F.contains("content", F.col("text")))
    m = catalog.retrieval_metrics(ranks, "rank")
    return m.select("scenarios", F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


@query(
    "WITH s AS (SELECT list_sort(list(value)) AS v, count(value) AS n FROM events) SELECT v[least(n - 1, floor(n * 0.5))::INTEGER + 1] AS p50, v[least(n - 1, floor(n * 0.95))::INTEGER + 1] AS p95 FROM s"
)
def latency_percentile(spark, sf_dir):
    return catalog.exact_percentiles(read(spark, sf_dir, "events"), "value", [0.5, 0.95])


@query(
    """WITH v AS (SELECT p_partkey, (p_partkey % 3) || '.' || (p_partkey % 11) || '.' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '-beta' ELSE '' END AS version FROM part),
n AS (SELECT *, list_transform(string_split(split_part(version, '-', 1), '.'), lambda x: x::BIGINT) AS a FROM v)
SELECT p_partkey, version, CASE WHEN a > [1, 5, 25]::BIGINT[] THEN 1 WHEN a < [1, 5, 25]::BIGINT[] THEN -1 ELSE 0 END AS compared FROM n"""
)
def version_compare(spark, sf_dir):
    k = F.col("p_partkey")
    version = F.concat_ws(
        ".", (k % 3).cast("string"), (k % 11).cast("string"),
        F.concat(F.col("p_size").cast("string"), F.when(k % 2 == 0, "-beta").otherwise(""))
    )
    return read(spark, sf_dir, "part").select(
        "p_partkey", version.alias("version"), identifiers.compare_versions(version, F.lit("1.5.25")).alias("compared")
    )


# --- formats -------------------------------------------------------------------------------------------------------


@query(
    """SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '### ' || role || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```'
 ELSE '### ' || role || chr(10) || chr(10) || text END, chr(10) || '----------' || chr(10) ORDER BY turn, role, text) AS shown FROM conversations GROUP BY conv_id"""
)
def snippet_format(spark, sf_dir):
    """A conversation as snippets: the assistant's turns as code, others as information."""
    c = read(spark, sf_dir, "conversations")
    code = formats.code_snippet(
        F.col("role"), F.lit(None).cast("string"),
        F.array(F.struct(F.lit("").alias("language"), F.col("text").alias("code")))
    )
    shown = F.when(F.col("role") == "assistant", code).otherwise(formats.info_snippet(F.col("role"), F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text", shown.alias("shown"))))
    return c.groupBy("conv_id").agg(
        F.array_join(F.transform(listed, lambda x: x["shown"]), formats.RULE).alias("shown")
    )


@query(
    """SELECT s_suppkey, '- Title: ' || s_name || chr(10) || '- Library ID: /s/' || s_suppkey || CASE WHEN s_nationkey % 2 = 0 THEN chr(10) || '- Description: nation ' || s_nationkey ELSE '' END
 || CASE WHEN s_suppkey % 3 > 0 THEN chr(10) || '- Code Snippets: ' || s_suppkey ELSE '' END || chr(10) || '- Source Reputation: ' || CASE WHEN s_acctbal < 0 THEN 'Unknown' WHEN s_acctbal >= 7 THEN 'High' WHEN s_acctbal >= 4 THEN 'Medium' ELSE 'Low' END AS block,
 printf('%.4f', s_acctbal / 7) AS score FROM supplier"""
)
def result_format(spark, sf_dir):
    k = F.col("s_suppkey")
    block = formats.library_block(
        F.col("s_name"), F.concat(F.lit("/s/"), k.cast("string")), F.when(
            F.col("s_nationkey") % 2 == 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))
        ),
        F.when(k % 3 > 0, k).otherwise(-1), labels.reputation(F.col("s_acctbal")),
    )
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", block.alias("block"), formats.fixed4(F.col("s_acctbal") / 7).alias("score")
    )


@query(
    "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[])::DECIMAL(9, 6)::DOUBLE AS self FROM embeddings"
)
def cosine_self(spark, sf_dir):
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.cosine(e, e), 6).alias("self"))


# --- batches and lists ---------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status, user_id::VARCHAR AS library, event_id AS t FROM events),
f AS (SELECT library, t FROM e WHERE status = 'failed' ORDER BY t DESC, library LIMIT 100)
SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'succeeded') AS migrated, count(*) FILTER (WHERE status = 'failed') AS failed, (SELECT string_agg(library, ',' ORDER BY t, library) FROM f) AS failures FROM e"""
)
def migration_progress(spark, sf_dir):
    status = F.when(
        F.col("event_type") == "purchase", "succeeded"
    ).when(F.col("event_type") == "error", "failed").otherwise("skipped")
    e = read(spark, sf_dir, "events").select(
        status.alias("status"), F.col("user_id").cast("string").alias("library"), F.col("event_id").alias("at")
    )
    return catalog.migration_progress(e).withColumn("failures", F.array_join("failures", ","))


@query(
    "SELECT n_name AS name, r.registry_no, r.registry FROM nation, (VALUES (0, 'npm'), (1, 'pypi'), (2, 'crates')) r(registry_no, registry)"
)
def registry_lookups(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ordinal"))
    return catalog.product_in_order(n, ["npm", "pypi", "crates"]).select("name", "registry_no", "registry")


@query(
    """WITH u AS (SELECT lower(source) AS name, doc_id AS ordinal, 0 AS list_no FROM documents WHERE lang = 'en' UNION ALL SELECT upper(source), doc_id, 1 FROM documents WHERE lang <> 'en')
SELECT name, ordinal, list_no FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY list_no, ordinal) AS n FROM u) WHERE n = 1"""
)
def candidate_union(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    one, two = d.where("lang = 'en'").select(
        F.lower("source").alias("name"), F.col("doc_id").alias("ordinal")
    ), d.where("lang <> 'en'").select(F.upper("source").alias("name"), F.col("doc_id").alias("ordinal"))
    return catalog.union_keep_first([one, two], "name").select("name", "ordinal", "list_no")


@query(
    "SELECT bool_or(event_type = 'view' AND value > 0) AS cli, bool_or(event_type = 'nothing') AS server, 'cli' AS modes FROM events"
)
def agent_modes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(
        ((F.col("event_type") == "view") & (F.col("value") > 0)).alias("cli"),
        (F.col("event_type") == "nothing").alias("server")
    )
    return catalog.agent_modes(e).withColumn("modes", F.array_join("modes", ","))


@query(
    "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS code, count(*) FILTER (WHERE role <> 'assistant') AS info, count(*) AS snippets FROM conversations GROUP BY conv_id"
)
def snippet_totals(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "role")
    both = catalog.snippets(c.where("role = 'assistant'"), c.where("role <> 'assistant'"))
    return catalog.snippet_counts(both, "conv_id")


@query(
    "SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END, 0) DESC, s_suppkey)::INTEGER AS place FROM supplier QUALIFY place <= 30"
)
def by_installs(spark, sf_dir):
    """The most installed first; unknown counts as none."""
    rows = read(spark, sf_dir, "supplier").withColumn("n", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")))
    return catalog.most_installed(rows, "n", "s_suppkey", 30).select("s_suppkey", "place")


@query(
    "SELECT event_id, floor(epoch(ts)) - 60 <= epoch(TIMESTAMP '2024-01-15 00:00:00') AS expired, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract('milliseconds' FROM ts)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z' AS shown FROM events"
)
def token_expiry(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        "event_id", labels.token_expired(t, F.lit("2024-01-15 00:00:00")).alias("expired"),
        formats.iso_time(t).alias("shown")
    )


@query(
    "SELECT item_id, CASE WHEN s = 429 THEN 'Rate limited or quota exceeded. ' || CASE WHEN item_id % 2 = 0 THEN 'Upgrade your plan for higher limits.' ELSE 'Create an API key for higher limits.' END WHEN s = 404 THEN 'The library you are trying to access does not exist.' WHEN s = 401 THEN 'Invalid API key.' ELSE 'Request failed with status ' || s || '.' END AS message FROM (SELECT item_id, [429, 404, 401, 500][item_id % 4 + 1] AS s FROM benchmark)"
)
def status_messages(spark, sf_dir):
    i = F.col("item_id")
    s = F.element_at(F.array(*map(F.lit, [429, 404, 401, 500])), (i % 4 + 1).cast("int"))
    return read(spark, sf_dir, "benchmark").select("item_id", labels.status_message(s, i % 2 == 0).alias("message"))


@query(
    r"SELECT p_partkey, regexp_replace(p_name || ' documentation Source: https://x.y/z end', '(?i)Source:\s*https?://\S+', '', 'g') AS bare, trim(regexp_replace(p_name || ' Docs reference', '(?i)([ _-]+(docs|documentation|manual|reference|references))+$', '')) AS short FROM part"
)
def snippet_names(spark, sf_dir):
    name = F.col("p_name")
    bare = text.without_source_lines(F.concat(name, F.lit(" documentation Source: https://x.y/z end")))
    names = text.discovery_names(F.concat(name, F.lit(" Docs reference")))
    return read(spark, sf_dir, "part").select("p_partkey", bare.alias("bare"), F.element_at(names, -1).alias("short"))


# --- streams -------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS session, lower(event_type) AS library, event_id % 50 AS id, epoch_us(ts) // 1000 AS t FROM events),
b AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY session ORDER BY t, library, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY t, library, id ROWS UNBOUNDED PRECEDING) AS no FROM b)
SELECT session, library, count(*) AS views, count(DISTINCT (no, id)) AS fresh FROM s GROUP BY session, library"""
)
def stream_seen(spark, sf_dir):
    """Structured Streaming over the events, all that is there: fresh and repeated views of each user.

    The result is read from the sink's files in the shared folder.
    """
    rows = event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("library"),
        (F.col("event_id") % 50).alias("id"), "ts"
    )
    return all_there_is(spark, sessions.stream_seen(rows)).groupBy("session", "library").agg(
        F.count("*").alias("views"), F.count_if("fresh").alias("fresh")
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. Its source is a folder; the table may be a single file, so its path is given as a glob."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def all_there_is(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives for all that its source has, from the files of its sink."""
    at = fresh_folder(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option(
        "checkpointLocation", f"{at}/state"
    ).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


import lexispark.surface_queries  # noqa: E402, F401  registers its queries
import lexispark.index_queries  # noqa: E402, F401
