"""Registered queries over a written index, crawls and state machines, with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexispark.functions import identifiers, urls
from lexispark.operators import catalog, crawl, index, selection, topics
from lexispark.queries import (
    BM25, BM25_ALL, ORACLES, PHRASES, all_there_is, documents, event_stream, query, read, sql_tokens
)
from lexispark.scratch import fresh_folder
from lexispark.sources import stores
from lexispark.sources.event_log import use_event_log
from lexispark.sources.keyed import KeyedTable
from lexispark.streaming import ndjson, sessions
from lexispark.surface_queries import RENEW_MS, TTL_MS, selected_files, text_of

_WRITTEN: dict[tuple[str, str], str] = {}


def written_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the documents' index, which is written once a session and table."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        at = fresh_folder(spark, "index")
        index.write_index(documents(spark, sf_dir), at)
        _WRITTEN[key] = at
    return _WRITTEN[key]


# --- the index -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH t AS (SELECT doc_id, trim({sql_tokens('text')}) AS s FROM documents), w AS (SELECT doc_id, unnest(string_split_regex(s, ' +')) AS term FROM t WHERE s <> ''),
l AS (SELECT trim({sql_tokens('lang')}) AS term FROM documents), p AS (SELECT DISTINCT doc_id, term FROM w)
SELECT count(*) AS content_postings, (SELECT count(DISTINCT term) FROM p) AS content_terms, (SELECT count(*) FROM w) AS content_tokens, (SELECT count(*) FROM l WHERE term <> '') AS title_postings FROM p"""
)
def index_build(spark, sf_dir):
    """What an index that is written from all documents holds; its time is that of writing it."""
    at = fresh_folder(spark, "index")
    index.write_index(documents(spark, sf_dir), at)
    p = index.open_index(spark, at).table("postings")
    content = F.col("field") == "content"
    tokens = F.aggregate("tfs", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return p.agg(
        F.sum(F.when(content, F.col("n"))).alias("content_postings"),
        F.count_distinct(F.when(content, F.col("term"))).alias("content_terms"),
        F.sum(F.when(content, tokens)).alias("content_tokens"),
        F.sum(F.when(F.col("field") == "doc_title", F.col("n"))).alias("title_postings")
    )


def _top(spark, sf_dir, facets, limit):
    own = index.open_index(spark, written_index(spark, sf_dir))
    best = index.top_of_facets(index.score_index(own, facets, None, limit), limit)
    return best.select("id", "rank", F.round("score", 6).alias("score"))


@query(ORACLES["bm25_or_topk"])
def index_or_topk(spark, sf_dir):
    """Any of four words, from postings and their windows' bounds alone."""
    return _top(spark, sf_dir, BM25, 20)


@query(ORACLES["bm25_and_topk"])
def index_and_topk(spark, sf_dir):
    """All of three common words, from the windows that have all."""
    return _top(spark, sf_dir, BM25_ALL, 20)


@query(ORACLES["phrase_match"])
def index_phrase(spark, sf_dir):
    """Every document with a phrase, by intersecting positions."""
    own = index.open_index(spark, written_index(spark, sf_dir))
    return index.score_index(own, [PHRASES]).select("id", F.round("score", 6).alias("score"))


@query(ORACLES["literal_grep"])
def index_grep(spark, sf_dir):
    """A literal, by trigrams and the texts that have them."""
    own = index.open_index(spark, written_index(spark, sf_dir))
    return index.grep_index(own, "The Of").select("id", "snippet")


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), lower(' Thhan'))")
def index_grep_all(spark, sf_dir):
    """All documents with a rare literal."""
    own = index.open_index(spark, written_index(spark, sf_dir))
    return index.grep_index_all(own, " Thhan").select("id")


# --- crawls --------------------------------------------------------------------------------------------------------

SQL_BASE = "regexp_replace(url, '#.*$', '')"
SQL_HREFS = r"""regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', {k})"""


@query(
    f"""WITH h AS (SELECT page_id, html, regexp_extract({SQL_BASE}, '^(https?://[^/?]*)', 1) AS site, {SQL_BASE} AS url FROM pages),
r AS (SELECT url, site, unnest({SQL_HREFS.format(k=1)}) AS a, unnest({SQL_HREFS.format(k=2)}) AS b, unnest({SQL_HREFS.format(k=3)}) AS c FROM h),
l AS (SELECT url, site, trim(replace(coalesce(a, b, c), '&amp;', '&')) AS r FROM r)
SELECT DISTINCT url AS source, site || regexp_replace(r, '#.*$', '') AS target FROM l WHERE starts_with(r, '/') AND NOT starts_with(r, '//')"""
)
def page_references(spark, sf_dir):
    """The links of all pages, resolved against their addresses; here all are paths from the site's root."""
    return crawl.page_links(read(spark, sf_dir, "pages"))


@query(
    f"""WITH RECURSIVE l AS (SELECT source, target, lower(regexp_extract(target, '^[a-z]+://([^/?#:]*)', 1)) AS site FROM ({ORACLES['page_references']})),
starts AS (SELECT DISTINCT {SQL_BASE} AS url FROM pages), s AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS site FROM starts),
walk AS (SELECT site, url, 0 AS depth FROM s UNION SELECT l.site, l.target, w.depth + 1 FROM walk w JOIN l ON l.source = w.url AND l.site = w.site AND l.target <> w.url WHERE w.depth < 3),
least AS (SELECT site, url, min(depth) AS depth FROM walk GROUP BY site, url)
SELECT site, url, depth FROM least QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth, url) <= 25"""
)
def site_crawl(spark, sf_dir):
    """A crawl of every page's site over the pages' links: at most three hops and 25 addresses of a site."""
    p = read(spark, sf_dir, "pages")
    return crawl.crawl(p.select("url"), crawl.page_links(p), 3, 25)


@query(
    "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS site, count(*) AS pages FROM pages GROUP BY site"
)
def pages_by_site(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.groupBy(urls.host(F.col("url")).alias("site")).agg(F.count("*").alias("pages"))


# --- state machines ------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, at_ms, false AS alive, at_ms + {TTL_MS} AS expires_ms FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.at_ms, w.expires_ms > e.at_ms, CASE WHEN w.expires_ms > e.at_ms AND w.expires_ms - e.at_ms >= {RENEW_MS} THEN w.expires_ms ELSE e.at_ms + {TTL_MS} END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id::VARCHAR AS session, at_ms, alive, expires_ms FROM w"""
)
def stream_protocol(spark, sf_dir):
    """Protocol sessions as a stream: their expiry is state, their end a timer."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("session"), "ts")
    return all_there_is(spark, sessions.stream_protocol(rows, TTL_MS, RENEW_MS))



# --- lines of byte chunks ------------------------------------------------------------------------------------------

SQL_EVENTS = """SELECT event_id // 20 AS stream, event_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END AS type,
 'é日😀 ' || event_id AS content, event_type AS "libraryName", 'müll ' || event_id AS message FROM events WHERE event_id % 13 > 0"""


def byte_chunks(spark: SparkSession, sf_dir: str, size: int = 37):
    """Twenty events a stream as JSON lines, some broken, cut into chunks of bytes, within lines and characters."""
    kind, i = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "purchase", "complete").when(kind == "error", "error").otherwise("progress")
    line = text_of(
        '{"type": "', status, '", "content": "é日😀 ', i, '", "libraryName": "', kind, '", "message": "müll ', i, '"}'
    )
    line = F.when(i % 13 == 0, F.substring(line, 1, 20)).otherwise(line)
    lines = read(spark, sf_dir, "events").select(F.call_function("div", i, F.lit(20)).alias("stream"), i.alias("i"), line.alias("l"))
    whole = lines.groupBy("stream").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]), "\n").cast("binary").alias("b")
    )  # twenty lines
    starts = F.sequence(F.lit(0), F.octet_length("b") - 1, F.lit(size))
    return whole.select("stream", "b", F.explode(starts).alias("seq")).select(
        "stream", "seq", F.substring(F.col("b"), F.col("seq") + 1, F.lit(size)).alias("data")
    )


@query(f'SELECT stream, type, content, "libraryName", message FROM ({SQL_EVENTS})')
def chunked_events(spark, sf_dir):
    """Events of byte chunks that are cut anywhere: those of the whole lines."""
    return ndjson.chunk_events(byte_chunks(spark, sf_dir)).drop("line")


@query(
    f"""SELECT stream, coalesce(arg_max(content, event_id) FILTER (WHERE type = 'complete'), '') AS content, arg_max("libraryName", event_id) FILTER (WHERE type = 'complete') AS library_name,
 arg_max(message, event_id) FILTER (WHERE type = 'error') AS error FROM ({SQL_EVENTS}) WHERE type <> 'progress' GROUP BY stream"""
)
def chunked_outcomes(spark, sf_dir):
    """What each stream came to: its last complete event and its last error, side by side."""
    return ndjson.stream_outcome(ndjson.chunk_events(byte_chunks(spark, sf_dir)))


# --- many topics, keyed tables, trends, counters -------------------------------------------------------------------


@query(
    f"""WITH occurs AS (SELECT doc_id AS id, unnest(string_split_regex(trim({sql_tokens('text')}), ' +')) AS term FROM documents),
counts AS (SELECT id, term, count(*) AS tf FROM occurs WHERE term <> '' GROUP BY ALL), lengths AS (SELECT id, sum(tf) AS len FROM counts GROUP BY id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM lengths) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM counts, corpus GROUP BY term, n),
asked AS (SELECT DISTINCT p_brand AS topic, unnest(string_split_regex(trim({sql_tokens("p_name || ' the of and ' || substr(p_type, 1, 9)")}), ' +')) AS term FROM part WHERE p_partkey <= 50),
scored AS (SELECT topic, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM asked JOIN counts USING (term) JOIN idf USING (term) JOIN lengths USING (id), corpus GROUP BY topic, id)
SELECT topic, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5"""
)
def many_topics(spark, sf_dir):
    """The best five documents for each brand's words and some common ones, in one job."""
    words = read(spark, sf_dir, "part").where("p_partkey <= 50").select(
        F.col("p_brand").alias("topic"), text_of(F.col("p_name"), " the of and ", F.substring("p_type", 1, 9)).alias("text")
    )
    d = documents(spark, sf_dir).select("id", "content")
    return topics.rank_topics(d, words, 5, {"content": 1.0}).select("topic", "id", F.round("score", 6).alias("score"), "rank")


SQL_ALL = "length(regexp_replace({x}, '[^ ]', '', 'g')) // 2 - 1"


@query(
    f"""WITH occurs AS (SELECT doc_id AS id, unnest(string_split_regex(trim({sql_tokens('text')}), ' +')) AS term FROM documents),
counts AS (SELECT id, term, count(*) AS tf FROM occurs WHERE term <> '' GROUP BY ALL), lengths AS (SELECT doc_id AS id, {SQL_ALL.format(x=sql_tokens('text'))} + {SQL_ALL.format(x=sql_tokens('lang'))} AS len FROM documents),
corpus AS (SELECT count(*) AS n, avg(len) AS mean FROM lengths),
idf AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM counts, corpus GROUP BY term, n),
asked AS (SELECT DISTINCT item_id AS topic, unnest(string_split_regex(trim({sql_tokens('text')}), ' +')) AS term FROM benchmark),
scored AS (SELECT topic, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM asked JOIN counts USING (term) JOIN idf USING (term) JOIN lengths USING (id), corpus GROUP BY topic, id)
SELECT topic, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 3"""
)
def indexed_topics(spark, sf_dir):
    """The best three documents for every benchmark text, from the postings of an index."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), "text")
    own = index.open_index(spark, written_index(spark, sf_dir))
    found = topics.rank_index(own, b, 3, {"content": 1.0})
    return found.select("topic", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "SELECT vec_id AS id, CASE WHEN vec_id % 15 = 0 THEN label + 300 WHEN vec_id % 5 = 0 THEN label + 200 WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT -1, 7"
)
def keyed_upserts(spark, sf_dir):
    """A vector table after three batches, one of them past a compaction: the last row of each key."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    own = KeyedTable(spark, fresh_folder(spark, "keyed"), ("id",))
    own.create(v)
    own.upsert(v.where("id % 3 = 0").withColumn("label", F.col("label") + 100))
    own.upsert(v.where("id % 5 = 0").withColumn("label", F.col("label") + 200))
    own.compact()
    own.upsert(v.where("id % 15 = 0").withColumn("label", F.col("label") + 300).unionByName(spark.sql("SELECT -1L AS id, 7 AS label")))
    return own.read()


TRENDS = [["period", "topic", "country"], ["period", "topic"], ["country"], ["period"], []]


@query(
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS period, event_type AS topic, n_name AS country, user_id FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT period, topic, country, CASE grouping_id(period, topic, country) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 6 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS level, count(*) AS n, true AS close
FROM e GROUP BY GROUPING SETS ((period, topic, country), (period, topic), (country), (period), ())"""
)
def usage_trends(spark, sf_dir):
    """Requests by period, topic and country and over each alone, from sketches that are merged; the estimated users are
    within 5 % of the exact ones, which are counted beside them."""
    nations = read(spark, sf_dir, "customer").join(
        read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")
    ).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("country"))
    e = read(spark, sf_dir, "events").join(nations, "user_id", "left").withColumn("topic", F.col("event_type"))
    estimated = catalog.usage_trends(catalog.usage_sketches(e, "ts", "user_id", ["topic", "country"]), TRENDS)
    days = e.withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    every = [F.col(c) for c in ("period", "topic", "country")]
    exact = days.groupingSets([[F.col(c) for c in s] for s in TRENDS], *every).agg(
        F.count_distinct("user_id").alias("exact"), F.grouping_id().alias("g")
    )
    level = F.element_at(F.create_map(*[F.lit(x) for x in (0, 0, 1, 1, 6, 2, 3, 3, 7, 4)]), F.col("g").cast("int"))
    exact = exact.select(*[c.alias(f"x_{n}") for n, c in zip(("period", "topic", "country"), every, strict=True)], "exact", level.alias("x_level"))
    same = F.col("level") == F.col("x_level")
    for c in ("period", "topic", "country"):
        same &= F.col(c).eqNullSafe(F.col(f"x_{c}"))
    close = F.abs(F.col("users") - F.col("exact")) <= 0.05 * F.col("exact")
    return estimated.join(exact, same).select("period", "topic", "country", "level", "n", close.alias("close"))


@query(ORACLES["selection_statistics"])
def observed_selection(spark, sf_dir):
    """The counters of a selection, from the pass that writes the selected files."""
    return selection.write_selected(selected_files(spark, sf_dir), fresh_folder(spark, "selected"))


@query(ORACLES["progress_counts"])
def observed_progress(spark, sf_dir):
    """The counts of a batch, from the pass that appends its last events to a log."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("skipped")
    last = catalog.latest_events(read(spark, sf_dir, "events"), F.col("user_id"), "event_id")
    events = last.select(F.col("user_id").cast("string").alias("libraryId"), status.alias("status"))
    return stores.append_counted(events, fresh_folder(spark, "log"), 100)


# --- catalog and arguments -----------------------------------------------------------------------------------------

SQL_SEARCHES = ", ".join(f"({k}, '{n}', '{q} {catalog.ONLY}', {w})" for k, (n, q, w) in enumerate(catalog.SEARCHES))


@query(
    f"""WITH s(k, source, query, weight) AS (VALUES {SQL_SEARCHES}), h AS (SELECT c_custkey // 3 AS c, source, weight, c_custkey * 7 AS stars FROM customer LEFT JOIN s ON k = c_custkey % 30),
m AS (SELECT c, max(stars) AS stars, max(coalesce(weight, 100)) AS weight, count(DISTINCT coalesce(source, 'other')) AS sources FROM h GROUP BY c)
SELECT '/o/r' || c AS library_id, sources, round(log10(greatest(10.0, stars + 10.0)) * 1000000 + weight * 10000 + least(10, sources) * 100)::BIGINT AS score FROM m"""
)
def popular_catalog(spark, sf_dir):
    """A catalog from the hits of the popular searches, weighted by their search; hits of no known search have the usual
    weight."""
    searches = catalog.popular_searches(spark)
    names = F.array(*[F.lit(n) for n, *_ in catalog.SEARCHES])
    c = F.col("c_custkey")
    own = F.call_function("div", c, F.lit(3))
    hits = read(spark, sf_dir, "customer").select(
        text_of("/o/r", own).alias("library_id"), text_of("r", own).alias("title"), F.lit(None).cast("string").alias("description"),
        (c * 7).alias("stars"), F.coalesce(F.get(names, (c % 30).cast("int")), F.lit("other")).alias("source"), c.alias("arrival")
    )
    return catalog.merge_candidates(catalog.weighted(hits, searches), 1_000_000).select("library_id", "sources", "score")


@query(
    """WITH p AS (SELECT page_id, page_id % 4 AS k, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS host FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'url' WHEN 1 THEN 'repo' WHEN 2 THEN 'repo' END AS type, CASE WHEN k < 3 THEN 'o' || page_id END AS owner, CASE WHEN k < 3 THEN host END AS repo,
 CASE WHEN k = 0 THEN 'main' END AS branch, CASE WHEN k = 0 THEN 'skills/' || page_id || '/x' END AS path FROM p"""
)
def skill_arguments(spark, sf_dir):
    """Skill arguments as tree addresses, as owner/repo with and without a slash, and as neither."""
    i, host = F.col("page_id"), F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(1))
    value = F.when(i % 4 == 0, text_of("https://github.com/o", i, "/", host, "/tree/main/skills/", i, "/x")).when(
        i % 4 == 1, text_of("/o", i, "/", host)
    ).when(i % 4 == 2, text_of("o", i, "/", host)).otherwise(text_of("a/", host, "/", i))
    return read(spark, sf_dir, "pages").select("page_id", identifiers.parse_skill_input(value).alias("s")).select("page_id", "s.*")


# --- the event log as a source and a sink --------------------------------------------------------------------------


def event_lines(spark: SparkSession, sf_dir: str, at: str):
    """Events as lines of a log, written in two appends by type; a reader of the log."""
    use_event_log(spark)
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("skipped")
    e = read(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.col("user_id").cast("string").alias("libraryId"), status.alias("status"), "event_id")).alias("value"), "event_type"
    )
    for part in (e.where("event_type <> 'error'"), e.where("event_type = 'error'")):
        part.select("value").write.format("event_log").option("path", at).mode("append").save()
    return lambda r: r.format("event_log").option("path", at).option("rangeBytes", 65536).load()


@query(
    """SELECT user_id::VARCHAR AS library, arg_max(CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'skipped' END, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id)) AS status, count(*) AS lines FROM events GROUP BY user_id"""
)
def event_log_ranges(spark, sf_dir):
    """The last event of each library of a log in two appends, read in ranges of bytes: errors came last."""
    log = event_lines(spark, sf_dir, fresh_folder(spark, "log"))(spark.read)
    e = log.select("append", F.from_json("value", "libraryId string, status string, event_id bigint").alias("e")).select("append", "e.*")
    return e.groupBy(F.col("libraryId").alias("library")).agg(
        F.max_by("status", F.struct("append", "event_id")).alias("status"), F.count("*").alias("lines")
    )


@query(
    "SELECT CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status, count(*) AS n FROM events GROUP BY 1"
)
def event_log_stream(spark, sf_dir):
    """The same log followed as a stream: its lines by status."""
    log = event_lines(spark, sf_dir, fresh_folder(spark, "log"))(spark.readStream)
    rows = all_there_is(spark, log.select(F.from_json("value", "status string").alias("e")).select("e.*"))
    return rows.groupBy("status").agg(F.count("*").alias("n"))
