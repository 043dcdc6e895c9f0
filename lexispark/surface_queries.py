"""Registered queries over files, settings, registries, stores, the service and streams, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import service
from lexispark.functions import formats, identifiers, labels, paths, text, vectors
from lexispark.operators import catalog, chunks, index, rerank, search, selection
from lexispark.pool import Pool, first_that_works
from lexispark.queries import (
    QUERY_VECTOR, SQL_COSINE, SQL_DOCS, SQL_PATH, TOPIC, documents, page_paths, query, read, sql_collapse, sql_fused, sql_priority,
    sql_search, sql_terms
)
from lexispark.plans.planner import terms
from lexispark.scratch import fresh_folder, put
from lexispark.sources import files, stores
from lexispark.streaming import sessions

SHA = "0123456789abcdef0123456789abcdef01234567"


def nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 rows of the smallest table, from which small files are written."""
    return read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def text_of(*parts) -> F.Column:
    """A text of constants and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- trees and settings --------------------------------------------------------------------------------------------


@query(
    "SELECT 'docs/' || lower(n_name) || '.md' AS path, 'text of ' || n_name AS content FROM nation UNION ALL SELECT 'README.md', 'root'"
)
def tree_walk(spark, sf_dir):
    """A documentation tree: other kinds, hidden, excluded and too large files are left out."""
    at = fresh_folder(spark, "tree")
    for n in nations(spark, sf_dir):
        put(spark, f"{at}/docs/{n['n_name'].lower()}.md", f"text of {n['n_name']}")
    for name, content in (
        ("README.md", "root"), ("node_modules/a.md", "x"), ("docs/.hidden.md", "x"), ("docs/notes.txt", "x"),
        ("docs/large.md", "x" * 2000), ("build/b.md", "x")
    ):
        put(spark, f"{at}/{name}", content)
    return files.read_bounded(spark, at, 100, 1000, 100_000)


@query(
    "SELECT 'v4' AS ref, md5('peeled NATION_4') AS sha UNION ALL SELECT 'v5', md5('NATION_5') UNION ALL SELECT 'main', md5('main')"
)
def peeled_refs(spark, sf_dir):
    """Commits of refs: what a tag points to, where it is listed."""
    n = read(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    lines = n.select(text_of(F.md5(name), "\trefs/tags/v", k).alias("value")).unionByName(
        n.where(k % 2 == 0).select(
            text_of(F.md5(F.concat(F.lit("peeled "), name)), "\trefs/tags/v", k, "^{}").alias("value")
        )
    ).unionByName(n.limit(1).select(text_of(F.md5(F.lit("main")), "\trefs/heads/main").alias("value")))
    out = None
    for ref in ("v4", "v5", "main"):
        one = files.preferred_commit(lines, ref).select(F.lit(ref).alias("ref"), "sha")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN 'docs,' || lower(p_type) END AS folders, CASE WHEN p_partkey % 10 > 0 THEN 'v' || p_size || ',next' ELSE '' END AS versions,
 CASE p_partkey % 3 WHEN 1 THEN 'x' END AS description, CASE WHEN p_partkey % 2 = 1 THEN p_size::DOUBLE END AS stars FROM part"""
)
def project_settings(spark, sf_dir):
    """Settings with comments, some unreadable; fields of the wanted type only."""
    k = F.col("p_partkey")
    config = F.when(k % 10 == 0, "nonsense").otherwise(
        text_of(
            "{ // settings of ", F.col("p_name"), '\n "folders": ["docs", "', F.lower("p_type"),
            '"], /* old */ "previousVersions": [{"tag": "v', F.col("p_size"), '"}], "branchVersions": [{"branch": "next"}]}'
        )
    )
    plain = text_of(
        '{"description": ', F.when(k % 3 == 0, "7").when(k % 3 == 1, '" x "').otherwise('" "'), ', "stars": ',
        F.when(k % 2 == 0, '"9"').otherwise(F.col("p_size").cast("string")), "}"
    )
    c = files.project_config(config)
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(c["folders"], ",").alias("folders"), F.array_join(files.versions(c), ",").alias("versions"),
        files.json_string(plain, "$.description").alias("description"), files.json_number(plain, "$.stars").alias("stars")
    )


@query(
    """WITH d AS (SELECT DISTINCT unnest(CASE p_partkey % 3 WHEN 0 THEN [replace(p_name, ' ', '-'), 'dev' || p_size] WHEN 1 THEN ['brand' || p_size, 'numpy'] ELSE ['httpx' || p_size, 'rich'] END) AS name FROM part)
SELECT name FROM d"""
)
def dependency_names(spark, sf_dir):
    """Distinct names that manifests of three kinds depend on."""
    k, size = F.col("p_partkey"), F.col("p_size")
    npm = text_of(
        '{"dependencies": {"', F.replace("p_name", F.lit(" "), F.lit("-")),
        '": "1"}, "devDependencies": {"@types/x": "1", "dev', size, '": "2"}}'
    )
    pip = text_of("# c\nbrand", size, "==1\n-r other\n\nnumpy>=2")
    poetry = text_of(
        '[project]\ndependencies = ["httpx', size, '>=1"]\n\n[tool.poetry.dependencies]\npython = "3"\nrich = "1"\n'
    )
    name = F.when(k % 3 == 0, "package.json").when(k % 3 == 1, "requirements.txt").otherwise("pyproject.toml")
    content = F.when(k % 3 == 0, npm).when(k % 3 == 1, pip).otherwise(poetry)
    return files.dependencies(
        read(spark, sf_dir, "part").select(text_of("a/", k, "/", name).alias("path"), content.alias("content"))
    )


@query(
    """SELECT path FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'skills/' || p_partkey || '/SKILL.md' WHEN 1 THEN 'skills/' || p_partkey WHEN 2 THEN 'other/' || p_partkey || '/skill.md' ELSE 'skills/x/' || p_partkey || '-Skill.MD' END AS path, p_partkey % 8 = 0 AS folder FROM part)
WHERE NOT folder AND ends_with(lower(path), 'skill.md') AND starts_with(path, 'skills/')"""
)
def skill_tree(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, text_of("skills/", k, "/SKILL.md")).when(k % 4 == 1, text_of("skills/", k)).when(
        k % 4 == 2, text_of("other/", k, "/skill.md")
    ).otherwise(text_of("skills/x/", k, "-Skill.MD"))
    kind = F.when(k % 8 == 0, "tree").otherwise("blob")
    tree = read(spark, sf_dir, "part").select(path.alias("path"), kind.alias("type"))
    return files.skill_files(tree, "skills/").select("path")


@query("SELECT lower(n_name) AS name FROM nation WHERE n_nationkey < 10")
def installed_skills(spark, sf_dir):
    """Skills in two locations, one of which isn't there."""
    at = fresh_folder(spark, "skills")
    for n in nations(spark, sf_dir):
        name = "SKILL.md" if n["n_nationkey"] < 10 else "README.md"
        put(spark, f"{at}/own/{n['n_name'].lower()}/{name}", "x")
    return files.installed_skills(spark, [f"{at}/own", f"{at}/none"]).select("name")


@query(
    f"""WITH p AS (SELECT regexp_replace(url, '#.*$', '') AS url, {SQL_PATH} AS path FROM pages), d AS (SELECT *, length(path) - length(replace(path, '/', '')) + 1 AS depth FROM p)
SELECT url, min(depth)::INTEGER AS depth FROM d WHERE depth <= 3 AND NOT list_contains(string_split(path, '/'), 'fr') AND NOT starts_with(path, 'fr/') AND NOT regexp_matches(path, '(?i)(^|/)en/1[^/]*(/|$)')
GROUP BY url ORDER BY 2, 1 LIMIT 100"""
)
def site_limits(spark, sf_dir):
    """The shallowest pages of a site, without excluded paths."""
    p = page_paths(spark, sf_dir)
    return files.site_pages(p.select("url", F.size(F.split("path", "/")).alias("depth")), ["fr", "en/1*"], 100, 3)


@query(
    """SELECT item_id, x.s AS section, x.t AS title, x.u AS url, x.d AS description FROM (SELECT item_id, unnest([
 {'s': NULL, 't': 'Home', 'u': 'https://x.y/h', 'd': NULL}, {'s': 'Docs', 't': 'Item ' || item_id, 'u': 'https://x.y/' || item_id, 'd': 'note ' || item_id}, {'s': 'Docs', 't': 'Raw', 'u': 'https://x.y/raw', 'd': NULL}]) AS x FROM benchmark)"""
)
def list_file_links(spark, sf_dir):
    """Links of llms.txt files, by section."""
    i = F.col("item_id")
    t = text_of(
        "# Title\n\n> about\n\n- [Home](https://x.y/h)\n\n## Docs\n\nsome words\n- [Item ", i, "](https://x.y/", i, "): note ", i,
        "\n* [Raw](https://x.y/raw)\n"
    )
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(files.list_links(t)).alias("x")).select(
        "item_id", "x.*"
    )


@query(
    """SELECT p_partkey, '/p/' || p_partkey AS path, unnest(['get', 'post']) AS method, unnest(['read ' || p_name, 'make']) AS summary, unnest([NULL, 'of ' || p_brand]) AS description FROM part"""
)
def api_operations(spark, sf_dir):
    """Operations of OpenAPI documents."""
    t = text_of(
        '{"openapi": "3.0.0", "paths": {"/p/', F.col("p_partkey"), '": {"post": {"summary": "make", "description": "of ',
        F.col("p_brand"), '"}, "x-note": {"summary": "n"}, "get": {"summary": "read ', F.col("p_name"), '"}}}}'
    )
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(files.api_operations(t)).alias("x")).select(
        "p_partkey", "x.*"
    )


@query(
    f"""SELECT item_id, 'Item ' || item_id AS title, trim({sql_collapse("' Item ' || item_id || '  ' || text || '  print(1) '")}) AS text FROM benchmark"""
)
def wiki_pages(spark, sf_dir):
    """Pages of a wiki in storage format."""
    t = text_of(
        "<h1>Item ", F.col("item_id"), "</h1><p>", F.col("text"),
        "</p><ac:plain-text-body><![CDATA[print(1)]]></ac:plain-text-body>"
    )
    return read(spark, sf_dir, "benchmark").select("item_id", files.wiki_page(t).alias("x")).select("item_id", "x.*")


@query(
    """WITH f AS (SELECT 'docs/' || lpad(item_id::VARCHAR, 6, '0') || '.md' AS path, 'Item ' || item_id AS title, trim(text, chr(10) || ' ') AS body, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark),
c AS (SELECT path, title, k, unnest([1, 2, 3]) AS n, unnest([title, 'Part A', 'Part B']) AS section, unnest(['intro', body, '```' || chr(10) || 'code' || chr(10) || '```']) AS content FROM f)
SELECT (3 * k + n)::BIGINT AS id, path AS doc_path, title AS doc_title, section AS section_title, content, ceil(length(content) / 4.0)::INTEGER AS tokens, n = 3 AS has_code FROM c"""
)
def markdown_sections(spark, sf_dir):
    """Markdown files as numbered chunks."""
    i = F.col("item_id")
    f = read(spark, sf_dir, "benchmark").select(
        text_of("docs/", F.lpad(i.cast("string"), 6, "0"), ".md").alias("path"),
        text_of(
            "# Item ", i, "\n\nintro\n\n## Part A\n\n", F.col("text"), "\n\n### Part B\n\n```\ncode\n```\n"
        ).alias("content")
    )
    return chunks.chunk_markdown(f).select(
        "id", "doc_path", "doc_title", "section_title", "content", "tokens", "has_code"
    )


# --- which files are indexed ---------------------------------------------------------------------------------------

MOST_FILES, MOST_FILE_BYTES, MOST_BYTES = 300, 20_000, 400_000
SQL_FILE = "CASE WHEN doc_id % 41 = 0 THEN lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '/license.md' ELSE (CASE doc_id % 5 WHEN 0 THEN 'docs/' WHEN 1 THEN 'examples/' WHEN 2 THEN 'test/' ELSE '' END) || lang || '/p' || lpad(doc_id::VARCHAR, 8, '0') || '.md' END"
SQL_SELECTION = f"""f AS (SELECT {SQL_FILE} AS path, regexp_extract({SQL_FILE}, '[^/]*$') AS name, text AS content, strlen(text) AS bytes FROM documents),
p AS (SELECT *, {sql_priority('lower(path)', 'lower(name)')} - least(25, bytes // 262144) AS priority, lower(name) = 'license.md' AS noise, bytes > {MOST_FILE_BYTES} OR contains(content, chr(0)) AS large FROM f),
u AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY priority DESC, path) = 1 AS first FROM p WHERE NOT noise AND NOT large),
l AS (SELECT content, bytes, row_number() OVER (ORDER BY priority DESC, path) AS n FROM u WHERE first),
walk AS (SELECT n, bytes <= {MOST_BYTES} AS taken, (bytes <= {MOST_BYTES})::INTEGER AS k, CASE WHEN bytes <= {MOST_BYTES} THEN bytes ELSE 0 END AS total FROM l WHERE n = 1
 UNION ALL SELECT l.n, k < {MOST_FILES} AND total + l.bytes <= {MOST_BYTES}, k + (k < {MOST_FILES} AND total + l.bytes <= {MOST_BYTES})::INTEGER, total + CASE WHEN k < {MOST_FILES} AND total + l.bytes <= {MOST_BYTES} THEN l.bytes ELSE 0 END FROM walk w JOIN l ON l.n = w.n + 1),
m AS (SELECT u.path, u.priority, CASE WHEN NOT taken THEN 'budget' WHEN first THEN 'selected' ELSE 'duplicate' END AS mark FROM u JOIN l USING (content) JOIN walk w ON w.n = l.n),
s AS (SELECT path, (row_number() OVER (ORDER BY priority DESC, path) - 1)::INTEGER AS position FROM m WHERE mark = 'selected'),
r AS (SELECT p.path, p.bytes, CASE WHEN noise THEN 'noise' WHEN large THEN 'oversized' ELSE mark END AS disposition, position FROM p LEFT JOIN m USING (path) LEFT JOIN s USING (path))"""


def selected_files(spark, sf_dir) -> DataFrame:
    i, lang = F.col("doc_id"), F.col("lang")
    number = F.lpad(i.cast("string"), 8, "0")
    folder = F.when(i % 5 == 0, "docs/").when(i % 5 == 1, "examples/").when(i % 5 == 2, "test/").otherwise("")
    path = F.when(i % 41 == 0, text_of(lang, "/", number, "/license.md")).otherwise(
        text_of(folder, lang, "/p", number, ".md")
    )
    d = read(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))
    return selection.select_files(d, MOST_FILES, MOST_FILE_BYTES, MOST_BYTES)


@query(f"WITH RECURSIVE {SQL_SELECTION} SELECT path, disposition, position FROM r")
def file_selection(spark, sf_dir):
    """What becomes of each document as a file: noise, oversized, duplicate, budget or selected."""
    return selected_files(spark, sf_dir).select("path", "disposition", "position")


@query(
    f"""WITH RECURSIVE {SQL_SELECTION} SELECT count(*) AS candidate_files, count(*) FILTER (WHERE disposition = 'selected') AS selected_files, count(*) FILTER (WHERE disposition = 'noise') AS noise_files,
 count(*) FILTER (WHERE disposition = 'duplicate') AS duplicate_files, count(*) FILTER (WHERE disposition = 'oversized') AS oversized_files, count(*) FILTER (WHERE disposition = 'budget') AS budget_skipped_files,
 coalesce(sum(bytes) FILTER (WHERE disposition = 'selected'), 0)::BIGINT AS total_bytes FROM r"""
)
def selection_statistics(spark, sf_dir):
    return selection.selection_counts(selected_files(spark, sf_dir))


def sql_glob(path: str, pattern: str) -> str:
    """Whether a path lies in an excluded folder: globs between segment ends, names as segments."""
    if "*" in pattern:
        return f"regexp_matches({path}, '(?i)(^|/){pattern.replace('*', '[^/]*')}(/|$)')"
    return f"(list_contains(string_split({path}, '/'), '{pattern}') OR starts_with({path}, '{pattern}/'))"


SQL_VARIED = "list_value('', 'old/', 'my-archive-1/', 'i18n/de-AT/', 'zh-cn/', 'docs/')[p_partkey % 6 + 1] || lower(p_type) || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'Changelog.md' ELSE p_partkey || '.md' END"


@query(
    f"SELECT p_partkey, lower(regexp_extract(path, '[^/]*$')) NOT IN ({', '.join(repr(f.lower()) for f in paths.DEFAULT_EXCLUDED_FILES)}) AND NOT ({' OR '.join(sql_glob('path', p) for p in paths.DEFAULT_EXCLUDED_FOLDERS)}) AS kept FROM (SELECT p_partkey, {SQL_VARIED} AS path FROM part)"
)
def default_exclusions(spark, sf_dir):
    """What a project without settings keeps."""
    k = F.col("p_partkey")
    folders = F.array(*map(F.lit, ["", "old/", "my-archive-1/", "i18n/de-AT/", "zh-cn/", "docs/"]))
    name = F.when(k % 7 == 0, "Changelog.md").otherwise(text_of(k, ".md"))
    path = text_of(F.get(folders, (k % 6).cast("int")), F.lower("p_type"), "/", name)
    return read(spark, sf_dir, "part").select("p_partkey", paths.wanted_by_default(path).alias("kept"))


# --- manifests, logs, stores ---------------------------------------------------------------------------------------


def manifests(spark, sf_dir) -> DataFrame:
    at = fresh_folder(spark, "manifests")
    for n in nations(spark, sf_dir):
        made = {
            "schemaVersion": 2 if n["n_nationkey"] % 5 == 0 else 1, "id": f"/Nations/{n['n_name']}", "commitSha": SHA,
            "sectionCount": n["n_regionkey"]
        }
        put(spark, f"{at}/{n['n_nationkey']}.json", json.dumps(made, indent=1))
    put(spark, f"{at}/bad.json", "{")
    return stores.read_manifests(spark, at)


@query(
    "SELECT '/Nations/' || n_name AS id, sha256(lower('/Nations/' || n_name)) AS key, n_regionkey::BIGINT AS sections FROM nation WHERE n_nationkey % 5 > 0"
)
def manifest_scan(spark, sf_dir):
    """The valid manifests of a folder."""
    return manifests(spark, sf_dir).select("id", "key", F.col("sectionCount").alias("sections"))


@query("SELECT '/Nations/' || n_name AS id FROM nation WHERE n_name IN ('NATION_3', 'NATION_4')")
def manifest_lookup(spark, sf_dir):
    """Manifests by ids in other cases; an invalid one is not found."""
    m = manifests(spark, sf_dir)
    out = None
    for ident in ("/nations/nation_3", "/NATIONS/Nation_4", "/nations/nation_5"):
        one = stores.find_manifest(m, ident).select("id")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "SELECT lower(n_name) AS library, CASE WHEN n_nationkey % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS status FROM nation"
)
def event_log_scan(spark, sf_dir):
    """A log of JSON lines: the last line of an id in any case counts; blank and partial lines don't."""
    at, lines = fresh_folder(spark, "log"), []
    for n in nations(spark, sf_dir):
        lines += [json.dumps({"libraryId": n["n_name"], "status": "failed"}), ""]
    for n in nations(spark, sf_dir):
        if n["n_nationkey"] % 2 == 0:
            lines.append(json.dumps({"libraryId": n["n_name"].lower(), "status": "succeeded"}))
    put(spark, f"{at}/log.jsonl", "\n".join([*lines, '{"libraryId": "x", "sta']))
    return stores.read_event_log(spark, f"{at}/log.jsonl").select(F.lower("libraryId").alias("library"), "status")


@query("SELECT n_name AS library, 'succeeded' AS status FROM nation")
def event_log_append(spark, sf_dir):
    """Events appended in two batches."""
    at = f"{fresh_folder(spark, 'log')}/events"
    e = read(spark, sf_dir, "nation").select(F.col("n_name").alias("libraryId"), F.lit("succeeded").alias("status"))
    stores.append_events(e.where("libraryId < 'NATION_2'"), at)
    stores.append_events(e.where("libraryId >= 'NATION_2'"), at)
    return stores.read_event_log(spark, at).select(F.col("libraryId").alias("library"), "status")


@query(
    "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS name FROM nation UNION ALL SELECT 99, 'added'"
)
def published_table(spark, sf_dir):
    """A table that is published, then published again with new rows in place of old ones."""
    at = fresh_folder(spark, "store")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    stores.publish(spark, n, at, "nations")
    new = n.where("id % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")).unionByName(
        spark.createDataFrame([(99, "added")], "id int, name string")
    )
    stores.upsert_published(spark, new, at, "nations", ["id"])
    return stores.published(spark, at, "nations")


@query(
    """SELECT n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN n_name ELSE 'b ' || n_name END AS name, false AS forced FROM nation WHERE n_nationkey < 15
UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name ELSE 'b ' || n_name END, true FROM nation WHERE n_nationkey < 15"""
)
def library_import(spark, sf_dir):
    """A bundle imported beside existing libraries, without and with force."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    bundle = n.where("id BETWEEN 5 AND 14").withColumn("name", F.concat(F.lit("b "), "name"))
    of = lambda force: stores.import_libraries(n.where("id < 10"), bundle, force=force).withColumn(
        "forced", F.lit(force)
    )
    return of(False).unionByName(of(True))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 = 1")
def vector_validity(spark, sf_dir):
    """Cached vectors of one commit and model."""
    v = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), text_of("c", F.col("vec_id") % 2).alias("commit"),
        text_of("m", F.col("vec_id") % 3).alias("model")
    )
    return stores.valid_vectors(v, "c0", "m1")


@query(
    "SELECT '/n/' || n_name AS library_id, n_name AS title, (n_regionkey * 10)::BIGINT AS stars, (n_nationkey + 1) AS rank FROM nation"
)
def catalog_file(spark, sf_dir):
    """A catalog file; one of another version has no libraries."""
    at = fresh_folder(spark, "catalog")
    own = [
        {"libraryId": f"/n/{n['n_name']}", "title": n["n_name"], "stars": n["n_regionkey"] * 10, "rank": n["n_nationkey"] + 1}
        for n in nations(spark, sf_dir)
    ]
    put(spark, f"{at}/a.json", json.dumps({"schemaVersion": 1, "libraries": own}, indent=1))
    put(spark, f"{at}/b.json", json.dumps({"schemaVersion": 2, "libraries": own[:3]}))
    both = stores.read_catalog(spark, f"{at}/a.json").unionByName(stores.read_catalog(spark, f"{at}/b.json"))
    return both.select(F.col("libraryId").alias("library_id"), "title", "stars", "rank")


@query("SELECT count(*) AS n, 'second' AS run FROM nation")
def report_files(spark, sf_dir):
    """Reports of two runs; the latest is the second, and a run's name can't be used again."""
    at = f"{fresh_folder(spark, 'reports')}/r"
    n = read(spark, sf_dir, "nation").agg(F.count("*").alias("n"))
    stores.write_report(n.withColumn("run", F.lit("first")), at, "1")
    stores.write_report(n.withColumn("run", F.lit("second")), at, "2")
    return spark.read.schema("n bigint, run string").json(f"{at}/latest")


@query(
    """WITH l AS (SELECT CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS s FROM events)
SELECT count(*) AS processed, count(*) FILTER (WHERE s = 'succeeded') AS succeeded, count(*) FILTER (WHERE s = 'failed') AS failed FROM l"""
)
def progress_file(spark, sf_dir):
    """A batch's counts, written in place of earlier ones and read back."""
    at = f"{fresh_folder(spark, 'progress')}/now"
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "succeeded").when(kind == "error", "failed").otherwise("skipped")
    counts = catalog.progress(read(spark, sf_dir, "events").select(status.alias("status")), 10)
    stores.write_progress(counts.withColumn("processed", F.lit(0)), at)
    stores.write_progress(counts, at)
    return spark.read.schema("processed bigint, succeeded bigint, failed bigint").json(at)


# --- registries and catalogs ---------------------------------------------------------------------------------------


@query(
    """SELECT CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'crates' END AS registry, 'lib' || p_partkey AS name, '/o' || p_partkey % 7 || '/r' || p_partkey AS id FROM part WHERE p_partkey % 3 < 2 OR p_partkey % 4 > 0"""
)
def registry_answers(spark, sf_dir):
    """Repositories that three registries name."""
    k = F.col("p_partkey")
    at = text_of("https://github.com/o", k % 7, "/r", k)
    answer = (
        F.when(k % 3 == 0, text_of('{"repository": {"type": "git", "url": "git+', at, '.git"}}'))
        .when(k % 3 == 1, text_of('{"info": {"project_urls": {"Source": "https://example.org/x/y", "Code": "', at, '/"}}}'))
        .when(k % 4 == 0, '{"crate": {"repository": null}}').otherwise(text_of('{"crate": {"repository": "', at, '"}}'))
    )
    kind = F.when(k % 3 == 0, "npm").when(k % 3 == 1, "pypi").otherwise("crates")
    rows = read(spark, sf_dir, "part").select(
        kind.alias("registry"), text_of("lib", k).alias("name"), answer.alias("json")
    )
    return stores.registry_repositories(rows).select("registry", "name", "id")


@query(
    "SELECT '/x/' || p_partkey AS library_id, floor(p_retailprice)::BIGINT AS stars FROM part WHERE regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') = 'redwidget' AND p_partkey % 5 > 0 AND p_size % 4 > 0 ORDER BY stars DESC, library_id LIMIT 3"
)
def repository_search(spark, sf_dir):
    """The three best usable repositories of a name."""
    k = F.col("p_partkey")
    hits = read(spark, sf_dir, "part").select(
        text_of("/x/", k).alias("library_id"), F.col("p_name").alias("name"), F.floor("p_retailprice").alias("stars"),
        (k % 5 == 0).alias("archived"), F.lit(False).alias("disabled"), (F.col("p_size") % 4).alias("size")
    )
    return catalog.best_repositories(hits, "Red-Widget").select("library_id", "stars")


@query(
    "SELECT '/S/' || s_suppkey AS library_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10 ELSE s_suppkey END AS stars, CASE WHEN s_suppkey % 4 = 0 THEN 'live' ELSE s_name END AS title FROM supplier"
)
def live_metadata(spark, sf_dir):
    """Live figures over those that a candidate came with."""
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select(
        text_of("/S/", k).alias("library_id"), k.alias("stars"), F.col("s_name").alias("title")
    )
    live = s.where("stars % 2 = 0").select(
        F.lower("library_id").alias("library_id"), (F.col("stars") * 10).alias("stars"),
        F.when(F.col("stars") % 4 == 0, "live").alias("title")
    )
    return catalog.decorated(s, live, "library_id", ["stars", "title"])


SQL_HITS = "SELECT o_custkey % 97 AS c, o_orderpriority AS source, floor(o_totalprice)::BIGINT AS stars, CASE WHEN starts_with(o_orderpriority, '1') THEN 130 END AS weight FROM orders"


def hits(spark, sf_dir) -> DataFrame:
    c = F.col("o_custkey") % 97
    return read(spark, sf_dir, "orders").select(
        text_of("/c", c, "/Lib", c).alias("library_id"), c.cast("string").alias("title"),
        F.lit(None).cast("string").alias("description"), F.floor("o_totalprice").cast("bigint").alias("stars"),
        F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderpriority").startswith("1"), 130).alias("weight"),
        F.col("o_orderkey").alias("arrival")
    )


SQL_SCORE = "round(log10(greatest(10.0, stars + 10.0)) * 1000000 + weight * 10000 + least(10, sources) * 100)::BIGINT"


@query(
    f"""WITH h AS ({SQL_HITS}), m AS (SELECT c, max(stars) AS stars, max(coalesce(weight, 100)) AS weight, count(DISTINCT source) AS sources FROM h GROUP BY c)
SELECT '/c' || c || '/Lib' || c AS library_id, {SQL_SCORE} AS score FROM m"""
)
def default_weights(spark, sf_dir):
    """A source without a weight has the usual one."""
    return catalog.merge_candidates(hits(spark, sf_dir), 1000).select("library_id", "score")


@query(
    f"""WITH h AS ({SQL_HITS}), m AS (SELECT c, max(stars) AS stars, max(coalesce(weight, 100)) AS weight, count(DISTINCT source) AS sources FROM h GROUP BY c),
s AS (SELECT CASE WHEN c < 5 THEN '/C' || c || '/lib' || c ELSE '/c' || c || '/Lib' || c END AS library_id, CASE WHEN c < 5 THEN 2000000000 - c ELSE {SQL_SCORE} END AS score, CASE WHEN c < 5 THEN sources + 1 ELSE sources END AS sources FROM m)
SELECT library_id, score, sources, row_number() OVER (ORDER BY score DESC, library_id)::INTEGER AS rank FROM s"""
)
def curated_catalog(spark, sf_dir):
    """Curated libraries come first, in their order."""
    n = F.col("n_nationkey")
    curated = read(spark, sf_dir, "nation").where(n < 5).select(
        text_of("/C", n, "/lib", n).alias("library_id"), n.alias("position")
    )
    return catalog.merge_candidates(hits(spark, sf_dir), 1000, curated).select("library_id", "score", "sources", "rank")


@query(
    r"""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '-') || list_value('', '-awesome', '-Interview-x', '.books', 'awesomeness')[p_partkey % 5 + 1] AS name, list_value('Roadmap', 'web', p_type)[p_partkey % 3 + 1] AS topic FROM part)
SELECT p_partkey FROM p WHERE p_partkey % 9 > 0 AND p_partkey % 11 > 0 AND NOT regexp_matches(name, '(?i)(^|[-_.])(awesome|interview|roadmap|cheatsheet|dotfiles|books?)([-_.]|$)')
 AND lower(topic) NOT IN ('awesome-list', 'books', 'cheatsheet', 'interview', 'interview-questions', 'learning-resources', 'roadmap')"""
)
def catalog_candidates(spark, sf_dir):
    """Which repositories are libraries at all."""
    k = F.col("p_partkey")
    of = lambda values, n: F.get(F.array(*values), (k % n).cast("int"))
    ends = [F.lit(x) for x in ("", "-awesome", "-Interview-x", ".books", "awesomeness")]
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), of(ends, 5))
    topics = F.array(of([F.lit("Roadmap"), F.lit("web"), F.col("p_type")], 3))
    return read(spark, sf_dir, "part").where(
        catalog.is_candidate(name, topics, k % 9 == 0, k % 11 == 0)
    ).select("p_partkey")


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS library, CASE event_type WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1)
SELECT c_custkey::VARCHAR AS library FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT library FROM e WHERE status = 'succeeded')"""
)
def pending_with_retries(spark, sf_dir):
    """What a batch still has to do if failures are tried again."""
    last = catalog.latest_events(read(spark, sf_dir, "events"), F.col("user_id"), "event_id")
    status = F.when(F.col("event_type") == "purchase", "succeeded").otherwise("failed")
    e = last.select(F.col("user_id").cast("string").alias("library"), status.alias("status"))
    work = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("library"))
    return catalog.pending(work, e, "library", retry_failed=True)


@query(
    """SELECT source, n AS want, n AS have, 'skipped' AS action FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
UNION ALL SELECT source, n, n, 'rejected' FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"""
)
def manifest_states(spark, sf_dir):
    """A manifest of the commit that was applied last, and one with an invalid row."""
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("v"))
    bad = d.withColumn("ok", F.col("source") != "src1")
    return catalog.reconcile(d, d, "source", "v", same_commit=True).unionByName(
        catalog.reconcile(bad, d, "source", "v", valid="ok")
    )


@query(
    "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey = 7 DESC, coalesce(CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END, 0) DESC, s_suppkey)::INTEGER AS place FROM supplier QUALIFY place <= 5"
)
def recommended_first(spark, sf_dir):
    """The recommended one first, the others by installs."""
    rows = read(spark, sf_dir, "supplier").withColumn("n", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")))
    return catalog.most_installed(rows, "n", "s_suppkey", 5, "7").select("s_suppkey", "place")


@query(
    "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1"
)
def best_results(spark, sf_dir):
    """The first of each ranked list."""
    p = read(spark, sf_dir, "part")
    return catalog.best(p, ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).select(
        "p_brand", "p_partkey", "p_retailprice"
    )


@query(
    "SELECT strftime(ts, '%Y-%m') AS period, event_type AS topic, CASE WHEN user_id % 3 = 0 THEN 'de' ELSE 'en' END AS country, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL"
)
def usage_by_topic(spark, sf_dir):
    """Requests by month, topic and country."""
    country = F.when(F.col("user_id") % 3 == 0, "de").otherwise("en").alias("country")
    return catalog.usage(
        read(spark, sf_dir, "events"), "ts", "user_id", [F.col("event_type").alias("topic"), country], "yyyy-MM"
    )


# --- planning, search, service -------------------------------------------------------------------------------------

SQL_TOPIC = """text || ' See "' || substr(text, 1, 30) || '", `x`, ''the_of Of'' and fooBar plus a.b/c #tag C# fooBar'"""


def sql_distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


@query(
    rf"""WITH t AS (SELECT item_id, {SQL_TOPIC} AS topic FROM benchmark), k AS (SELECT item_id, topic, {sql_terms('topic')} AS ts FROM t),
n AS (SELECT *, list_concat(list_filter(ts[1:18], lambda t: regexp_matches(t, '[._:$#/-]')), list_transform(list_filter(regexp_extract_all(topic, '[\p{{L}}\p{{N}}_.$#:@/-]+'), lambda t: regexp_matches(t, '[a-z][A-Z]')), lambda t: lower(t))) AS names,
 regexp_extract_all(topic, '["''`](.{{2,80}}?)["''`]', 1) AS quotes FROM k),
q AS (SELECT item_id, string_agg(array_to_string(ts, ' '), chr(1) ORDER BY pos) FILTER (WHERE len(ts) > 0) AS quoted FROM (SELECT item_id, pos, {sql_terms('quote')} AS ts FROM (SELECT item_id, generate_subscripts(quotes, 1) AS pos, unnest(quotes) AS quote FROM n)) GROUP BY item_id),
f AS (SELECT item_id, list_concat(list_concat([array_to_string(ts[1:18], ' OR '), array_to_string(ts[1:8], ' AND ')], ({sql_distinct('names')})[1:6]), coalesce(string_split(quoted, chr(1))[1:3], [])) AS l FROM n LEFT JOIN q USING (item_id))
SELECT item_id, array_to_string({sql_distinct('l')}, ' | ') AS facets FROM f"""
)
def facet_list(spark, sf_dir):
    """All facets of topics with identifiers, quotes and facets that occur twice."""
    t = F.col("text")
    topic = text_of(
        t, ' See "', F.substring(t, 1, 30), "\", `x`, 'the_of Of' and fooBar plus a.b/c #tag C# fooBar"
    )
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.facets(topic), " | ").alias("facets"))


NAMES_TOPIC = "the theOf \"of the\" 'of the' that.and history of.the"


@query(
    f"WITH {sql_fused(NAMES_TOPIC, SQL_DOCS)} SELECT id, matched_queries, round(score, 6) AS score FROM fused"
)
def identifier_search(spark, sf_dir):
    """Facets of identifiers and quotes, searched over all documents and fused."""
    ranked = search.candidates(documents(spark, sf_dir), NAMES_TOPIC)
    return search.fuse(ranked, terms(NAMES_TOPIC)).select("id", "matched_queries", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {sql_search(TOPIC, SQL_DOCS)} SELECT position, id FROM found")
def seen_fallback(spark, sf_dir):
    """A session that has seen all documents is answered as if it had seen none."""
    d = documents(spark, sf_dir)
    return search.search(d, TOPIC, seen=d.select("id")).select("position", "id")


@query(f"WITH RECURSIVE {sql_search(TOPIC, SQL_DOCS)} SELECT position, id FROM found")
def indexed_search(spark, sf_dir):
    """A search over an index that is written first: postings of the topic's terms, and the chunks that they name."""
    from lexispark.index_queries import written_index

    return index.search_index(spark, written_index(spark, sf_dir), TOPIC).select("position", "id")


@query(
    f"""WITH {sql_fused(TOPIC, SQL_DOCS, 24)}, top AS (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 24),
v AS (SELECT top.id, score, coalesce({SQL_COSINE}, -1.0) AS sim FROM top LEFT JOIN embeddings ON vec_id = top.id),
s AS (SELECT id, round(0.65 * CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END
 + 0.35 * CASE WHEN max(sim) OVER () = min(sim) OVER () THEN 1 ELSE (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) END, 9) AS score FROM v)
SELECT id, (row_number() OVER (ORDER BY score DESC, id) - 1)::INTEGER AS position FROM s QUALIFY position < 5"""
)
def reranked_slice(spark, sf_dir):
    """24 candidates reranked, then cut to five."""
    matches = search.fuse(search.candidates(documents(spark, sf_dir), TOPIC, 24), terms(TOPIC))
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rerank.sliced(rerank.rerank(matches, v, QUERY_VECTOR), 5).select("id", "position")


@query(
    "SELECT id, length(t)::DOUBLE AS chars, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS es FROM (SELECT doc_id AS id, lang || chr(10) || '' || chr(10) || substr(text, 1, 6000) AS t FROM documents)"
)
def embedded_texts(spark, sf_dir):
    """What of each chunk is embedded, in batches by a call that stands for a service."""
    d = documents(spark, sf_dir)
    t = vectors.embedding_text(F.col("doc_title"), F.col("section_title"), F.col("content"))
    got = service.embed(
        d.select("id", t.alias("text")), lambda batch: [[float(len(x)), float(x.count("e"))] for x in batch]
    )
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return got.select("id", at(0).alias("chars"), at(1).alias("es"))


ITEMS = "/bench/items"
SQL_ITEMS = """SELECT row_number() OVER (ORDER BY path) AS id, path AS doc_path, name AS doc_title, name AS section_title, trim(text, chr(10) || ' ') AS content, ceil(length(trim(text, chr(10) || ' ')) / 4.0)::INTEGER AS tokens
 FROM (SELECT 'docs/' || lpad(item_id::VARCHAR, 6, '0') || '.md' AS path, lpad(item_id::VARCHAR, 6, '0') || '.md' AS name, text FROM benchmark QUALIFY row_number() OVER (PARTITION BY text ORDER BY item_id) = 1)"""
ITEM_TOPIC = "onesen that thereisi"


_SERVICES: dict[tuple[str, str], service.Service] = {}


def items_service(spark, sf_dir) -> service.Service:
    """A service whose index holds the benchmark's texts as files; it is made once a session and table."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _SERVICES:
        s = service.Service(spark, fresh_folder(spark, "service"))
        f = read(spark, sf_dir, "benchmark").select(
            text_of("docs/", F.lpad(F.col("item_id").cast("string"), 6, "0"), ".md").alias("path"),
            F.col("text").alias("content")
        )
        s.index(ITEMS, f, SHA, "https://github.com/bench/items.git", n_rules=2)
        _SERVICES[at] = s
    _SERVICES[at].seen = service.Seen()
    return _SERVICES[at]


@query(
    f"""WITH RECURSIVE {sql_search(ITEM_TOPIC, SQL_ITEMS, 24)} SELECT position, f.id, doc_path, '{SHA}:' || f.id AS key, 'https://github.com/bench/items/blob/{SHA}/' || doc_path AS url FROM found f JOIN base b ON b.id = f.id WHERE position < 5"""
)
def service_search(spark, sf_dir):
    """The service's search over its written index: 24 candidates, cut to five."""
    return items_service(spark, sf_dir).search_docs(ITEMS, ITEM_TOPIC, 5, session="s").select(
        "position", "id", "doc_path", "key", "url"
    )


SQL_PROVENANCE = f"'Library: {ITEMS}' || chr(10) || 'Commit: {SHA}' || chr(10) || 'Project rules omitted: 2' || chr(10) || chr(10)"


def sql_truncated(x: str, most: int = 16_000) -> str:
    return f"CASE WHEN length({x}) > {most} THEN substr({x}, 1, {most}) || chr(10) || chr(10) || '[Result truncated]' ELSE {x} END"


@query(
    f"""WITH RECURSIVE {sql_search(ITEM_TOPIC, SQL_ITEMS, 24, 4000)},
a AS (SELECT {SQL_PROVENANCE} || string_agg('## ' || section_title || chr(10) || 'Source: https://github.com/bench/items/blob/{SHA}/' || doc_path || chr(10) || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS t FROM found f JOIN base b ON b.id = f.id)
SELECT {sql_truncated('t')} AS answer FROM a"""
)
def service_answer(spark, sf_dir):
    """An answer text with its provenance."""
    return spark.createDataFrame([(items_service(spark, sf_dir).query_docs(ITEMS, ITEM_TOPIC),)], "answer string")


@query(
    f"""SELECT id, {sql_truncated("t")} AS answer FROM (SELECT id, {SQL_PROVENANCE} || '## ' || section_title || chr(10) || chr(10) || content AS t FROM ({SQL_ITEMS}) WHERE id = 3)
UNION ALL SELECT 4, 'The result key is stale.' UNION ALL SELECT 5, 'The result key is invalid.'"""
)
def service_read(spark, sf_dir):
    """Results read by their keys: a good one, one of another commit, and nonsense."""
    s = items_service(spark, sf_dir)
    keys = [(3, f"{SHA}:3"), (4, "f" * 40 + ":4"), (5, "x")]
    return spark.createDataFrame([(i, s.read_docs(ITEMS, k)) for i, k in keys], "id bigint, answer string")


@query(
    "SELECT '/n/' || lower(n_name) AS library, 'made ' || n_nationkey AS result FROM nation WHERE length(n_name) > 7 ORDER BY n_nationkey LIMIT 1"
)
def index_attempts(spark, sf_dir):
    """The first of several candidates that can be indexed: here the first with a long name."""
    keys = {f"/n/{n['n_name'].lower()}": n["n_nationkey"] for n in nations(spark, sf_dir)}

    def attempt(library: str) -> str:
        if len(library) < 11:
            raise ValueError(library)
        return f"made {keys[library]}"

    found = first_that_works(list(keys), attempt, len(keys))
    return spark.createDataFrame([found], "library string, result string")


# --- evaluation ----------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, lang FROM documents)
SELECT source, coalesce(min(rank) FILTER (WHERE lang = 'de'), 0)::INTEGER AS rank FROM r GROUP BY source"""
)
def path_relevance(spark, sf_dir):
    """The rank of the first result whose path has the wanted part, in any case and with either slash."""
    d = read(spark, sf_dir, "documents")
    w = F.row_number().over(catalog.Window.partitionBy("source").orderBy("doc_id"))
    found = d.select("source", w.alias("rank"), text_of("docs/", F.col("lang"), "/", F.col("doc_id")).alias("path"))
    scenarios = d.select("source").distinct().withColumn("wanted", F.lit("Docs\\DE\\"))
    return catalog.first_relevant(scenarios, found, "source", catalog.path_relevant(F.col("path"), F.col("wanted")))


@query(
    "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"
)
def indexed_scenarios(spark, sf_dir):
    """Scenarios of libraries that are indexed."""
    s = read(spark, sf_dir, "customer").select("c_custkey", text_of("/N/", F.col("c_nationkey")).alias("library"))
    m = read(spark, sf_dir, "nation").where("n_regionkey < 3").select(text_of("/n/", F.col("n_nationkey")).alias("library"))
    return catalog.indexed_scenarios(s, m, "library").select("c_custkey")


@query(
    """WITH e AS (SELECT event_id % 13 AS legacy, event_id % 7 AS fused, value AS ms FROM events WHERE value IS NOT NULL), s AS (SELECT list_sort(list(ms)) AS v, count(*) AS n FROM e),
t AS (SELECT v[least(n - 1, floor(n * 0.5))::INTEGER + 1] AS p50, v[least(n - 1, floor(n * 0.95))::INTEGER + 1] AS p95 FROM s)
SELECT 'legacy' AS kind, count(*) AS scenarios, round(avg(CASE WHEN legacy > 0 THEN 1.0 / legacy ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN legacy BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 6) AS recall, any_value(p50) AS p50, any_value(p95) AS p95 FROM e, t
UNION ALL SELECT 'fused', count(*), round(avg(CASE WHEN fused > 0 THEN 1.0 / fused ELSE 0 END), 6), round(avg(CASE WHEN fused BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END), 6), any_value(p50), any_value(p95) FROM e, t"""
)
def evaluation_report(spark, sf_dir):
    """Metrics and times of two kinds of search."""
    i = F.col("event_id")
    rows = read(spark, sf_dir, "events").where("value IS NOT NULL").select(
        (i % 13).alias("legacy_rank"), (i % 7).alias("fused_rank"), F.col("value").alias("legacy_ms"),
        F.col("value").alias("fused_ms")
    )
    r = catalog.evaluation_report(rows)
    return r.select(
        "kind", "scenarios", F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"), "p50", "p95"
    )


# --- small functions -----------------------------------------------------------------------------------------------


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN p_partkey + 1 END AS chunk_id, CASE p_partkey % 5 WHEN 2 THEN 'stale' WHEN 4 THEN 'invalid' ELSE 'ok' END AS state FROM part"""
)
def result_keys(spark, sf_dir):
    """Keys of this commit in any case, of another one, plain numbers, and nonsense with a line end."""
    k = F.col("p_partkey")
    n = k + 1
    key = F.when(k % 5 == 0, text_of(SHA, ":", n)).when(k % 5 == 1, text_of(SHA.upper(), ":", n)).when(
        k % 5 == 2, text_of("f" * 40, ":", n)
    ).when(k % 5 == 3, n.cast("string")).otherwise(text_of(SHA, ":", n, "\n"))
    parsed = identifiers.parse_result_key(key, F.lit(SHA))
    return read(spark, sf_dir, "part").select(
        "p_partkey", parsed["chunk_id"].alias("chunk_id"), parsed["state"].alias("state")
    )


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN '/o' || p_size || '/r' END AS id, CASE WHEN p_partkey % 4 = 1 THEN 'v1/x' END AS version FROM part"
)
def ids_with_white_space(spark, sf_dir):
    """Ids between white space of any kind; a line end inside is no id."""
    k = F.col("p_partkey")
    own = text_of("/o", F.col("p_size"), "/r")
    value = F.when(k % 4 == 0, text_of("\t\u00a0", own, "/\n")).when(k % 4 == 1, text_of(" ", own, "/v1/x\r\n")).when(
        k % 4 == 2, text_of(own, "\n/x")
    ).otherwise(text_of("/o/../", own))
    ref = identifiers.parse_library_id(value)
    name = F.concat(F.lit("/"), ref["owner"], F.lit("/"), ref["repo"])
    return read(spark, sf_dir, "part").select("p_partkey", name.alias("id"), ref["version"].alias("version"))


@query(
    r"SELECT p_partkey, '/' || regexp_replace(lower(split_part(trim(p_name), ' ', 1)), '[^a-z0-9_.-]', '', 'g') || '/docs' AS guess FROM part"
)
def docs_guesses(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.official_docs_repository(F.col("p_name")).alias("guess")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/o/r' || p_partkey ELSE 'x:' || p_partkey END AS recovered, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_size END AS branch, CASE p_partkey % 3 WHEN 0 THEN 'docs/a' END AS path FROM part"""
)
def recovered_ids(spark, sf_dir):
    """Ids that a shell has turned into paths, and parts of tree addresses."""
    k = F.col("p_partkey")
    value = F.when(k % 2 == 0, text_of("C:\\Program Files\\Git\\o\\r", k)).otherwise(text_of("x:", k))
    url = F.when(k % 3 == 0, text_of("https://github.com/o/r/tree/b", F.col("p_size"), "/docs/a")).otherwise(
        text_of("https://example.com/o/r/tree/b", F.col("p_size"), "/docs/a")
    )
    at = identifiers.tree_address(url)
    return read(spark, sf_dir, "part").select(
        "p_partkey", identifiers.recover_library_id(value).alias("recovered"), at["branch"].alias("branch"),
        at["path"].alias("path")
    )


@query(
    "SELECT item_id, 'item-' || item_id AS name, CASE item_id % 3 WHEN 0 THEN 'first line second ' || item_id WHEN 1 THEN 'quoted ' || item_id END AS description FROM benchmark"
)
def front_matters(spark, sf_dir):
    """Names and descriptions, plain and folded."""
    i = F.col("item_id")
    about = F.when(i % 3 == 0, text_of("description: >\n  first line\n  second ", i, "\n")).when(
        i % 3 == 1, text_of("description: \"quoted ", i, "\"\n")
    ).otherwise("license: x\n")
    made = identifiers.front_matter(text_of("---\nname: item-", i, "\n", about, "---\n# body\nname: no\n"))
    return read(spark, sf_dir, "benchmark").select("item_id", made["name"].alias("name"), made["description"].alias("description"))


@query(
    r"""WITH n AS (SELECT p_partkey, list_value('good-' || p_partkey, '.hidden', 'a/b', 'a..b', 'with space', '', repeat('x', 256), 'end' || chr(10))[p_partkey % 8 + 1] AS name FROM part)
SELECT p_partkey, regexp_full_match(name, '[A-Za-z0-9_-][A-Za-z0-9_. -]*') AND NOT contains(name, '..') AND length(name) <= 255 AS safe FROM n"""
)
def skill_names(spark, sf_dir):
    """Names that can be a folder's."""
    k = F.col("p_partkey")
    names = [text_of("good-", k), *[F.lit(x) for x in (".hidden", "a/b", "a..b", "with space", "", "x" * 256, "end\n")]]
    return read(spark, sf_dir, "part").select(
        "p_partkey", identifiers.safe_skill_name(F.get(F.array(*names), (k % 8).cast("int"))).alias("safe")
    )


@query("SELECT p_partkey, p_partkey % 4 < 2 AS repository FROM part")
def repository_kinds(spark, sf_dir):
    """Ids of repositories and of other kinds of sources."""
    k = F.col("p_partkey")
    ident = F.when(k % 4 == 0, text_of("/o/r", k)).when(k % 4 == 1, text_of("o/r", k)).when(
        k % 4 == 2, text_of("/Websites/r", k)
    ).otherwise(text_of("/o/r/", k))
    return read(spark, sf_dir, "part").select("p_partkey", identifiers.is_repository_id(ident).alias("repository"))


@query(
    rf"""SELECT item_id, list_reduce(string_split(substr(trim({sql_collapse('text')}), 1, 400), ' '), lambda s, w: CASE WHEN length(regexp_extract(s, '[^\n]*$')) + 1 + length(w) <= 84 THEN s || ' ' || w ELSE s || chr(10) || w END) AS wrapped FROM benchmark"""
)
def wrapped_lines(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", text.wrap(F.col("text")).alias("wrapped"))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'alias' END AS value, greatest(1, least(30, CASE WHEN p_partkey % 5 > 0 THEN p_size - 10 ELSE 12 END)) AS limited,
 CASE WHEN p_partkey % 4 = 0 THEN 7 WHEN p_partkey % 4 = 1 THEN p_size ELSE 7 END::BIGINT AS setting FROM part"""
)
def bounded_arguments(spark, sf_dir):
    """Arguments by their names and aliases, clamped and read as numbers."""
    k, size = F.col("p_partkey"), F.col("p_size")
    args = F.when(k % 3 == 0, F.create_map(F.lit("query"), F.lit("own"), F.lit("q"), F.lit("alias"))).when(
        k % 3 == 1, F.create_map(F.lit("q"), F.lit("alias"), F.lit("topic"), F.lit("no"))
    ).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    setting = F.when(k % 4 == 0, "-3").when(k % 4 == 1, size.cast("string")).when(k % 4 == 2, "x").otherwise(F.lit(None))
    return read(spark, sf_dir, "part").select(
        "p_partkey", labels.first_alias(args, "query", ["q", "topic"]).alias("value"),
        labels.clamp(F.when(k % 5 > 0, size - 10), 1, 30, 12).alias("limited"),
        labels.positive_number(setting, 7).cast("bigint").alias("setting")
    )


@query(
    "SELECT s_suppkey, s_suppkey % 2 = 0 AND coalesce(CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal / 1000 END >= 4, false) AND s_suppkey % 60 <= 30 AS passes FROM supplier"
)
def quality_filters(spark, sf_dir):
    """A policy's quality filters; an unknown figure fails."""
    k = F.col("s_suppkey")
    ok = labels.passes_quality(
        k % 2 == 0, F.when(k % 7 > 0, F.col("s_acctbal") / 1000), k % 60, F.lit(5), only_verified=True, least_trust=4,
        most_days=30, least_stars=1
    )
    return read(spark, sf_dir, "supplier").select("s_suppkey", ok.alias("passes"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS page, CASE WHEN p_partkey % 3 = 0 THEN 50 END AS total_pages, CASE WHEN p_partkey % 3 = 0 THEN p_size < 50 END AS has_more FROM part"
)
def paging_headers(spark, sf_dir):
    """Paging headers; all can be read, or none counts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    total = F.when(k % 3 == 1, "many").otherwise("50")
    more = F.when(k % 3 == 2, "maybe").when(size < 50, "True").otherwise("false")
    p = labels.paging(size.cast("string"), total, more)
    return read(spark, sf_dir, "part").select(
        "p_partkey", p["page"].alias("page"), p["total_pages"].alias("total_pages"), p["has_more"].alias("has_more")
    )


@query(
    """SELECT p_partkey, x.k AS key, x.v AS value FROM (SELECT p_partkey, unnest([{'k': 'name', 'v': '"' || p_name || '"'}, {'k': 'size', 'v': p_size::VARCHAR}, {'k': 'on', 'v': 'true'}]) AS x FROM part)"""
)
def toml_keys(spark, sf_dir):
    """Keys and values of a section of a TOML text."""
    t = text_of(
        "top = 1\n\n[other]\nsize = 0\n\n[servers.own]\nname = \"", F.col("p_name"), "\"\nsize = ", F.col("p_size"),
        "\n# note\non = true\n\n[last]\nx = 2\n"
    )
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(files.toml_section(t, "servers\\.own")))
    return rows.select("p_partkey", "key", "value")


@query(
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Sign in again.' WHEN 1 THEN 'Wait a little.' ELSE 'Try again.' END AS hint FROM part"
)
def error_hints(spark, sf_dir):
    code = F.get(F.array(F.lit("expired"), F.lit("slow_down"), F.lit("other")), (F.col("p_partkey") % 3).cast("int"))
    hints = {"expired": "Sign in again.", "slow_down": "Wait a little."}
    return read(spark, sf_dir, "part").select("p_partkey", labels.hint(code, hints, "Try again.").alias("hint"))


@query(
    """SELECT item_id, list_value('ok', 'redirect', 'error', 'error', 'error')[item_id % 5 + 1] AS kind,
 list_value('{"a": ' || item_id || '}', '/new/' || item_id, 'gone', 'Rate limited or quota exceeded. Create an API key for higher limits.', 'm ' || item_id)[item_id % 5 + 1] AS value FROM benchmark"""
)
def hosted_answers(spark, sf_dir):
    """Answers of a hosted service as typed rows."""
    i = F.col("item_id")
    of = lambda *values: F.get(F.array(*values), (i % 5).cast("int"))
    status = of(*map(F.lit, (200, 301, 404, 429, 500)))
    body = of(
        text_of('{"a": ', i, "}"), text_of('{"redirectUrl": "/new/', i, '"}'), F.lit('{"error": "gone"}'), F.lit("{}"),
        text_of('{"message": "m ', i, '"}')
    )
    got = labels.answer(status, body, F.lit(False))
    return read(spark, sf_dir, "benchmark").select("item_id", got["kind"].alias("kind"), got["value"].alias("value"))


@query(
    "SELECT s_suppkey, 'Library: /s/' || s_suppkey || chr(10) || 'Commit: ' || md5(s_name) || CASE WHEN s_nationkey > 0 THEN chr(10) || 'Project rules omitted: ' || s_nationkey ELSE '' END AS head FROM supplier"
)
def provenance_heads(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey",
        formats.provenance(text_of("/s/", F.col("s_suppkey")), F.md5("s_name"), F.col("s_nationkey")).alias("head")
    )


# --- sessions and batches ------------------------------------------------------------------------------------------

TTL_MS, RENEW_MS = 2 * 86_400_000, 86_400_000


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, at_ms, false AS alive, at_ms + {TTL_MS} AS expires_ms FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.at_ms, w.expires_ms > e.at_ms, CASE WHEN w.expires_ms > e.at_ms AND w.expires_ms - e.at_ms >= {RENEW_MS} THEN w.expires_ms ELSE e.at_ms + {TTL_MS} END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, at_ms, alive, expires_ms FROM w"""
)
def protocol_expiry(spark, sf_dir):
    """Protocol sessions over their requests: renewed only when little is left."""
    e = read(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return sessions.protocol_sessions(e, "user_id", TTL_MS, RENEW_MS)


@query(
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'progress' END AS type FROM events WHERE event_id % 17 > 0)
SELECT user_id, event_id, type, 'c' || event_id AS content FROM e WHERE type <> 'progress' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
)
def last_outcomes(spark, sf_dir):
    """The last complete or error event of each stream of JSON lines; broken lines are left out."""
    kind, i = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "purchase", "complete").when(kind == "error", "error").otherwise("progress")
    line = F.when(i % 17 == 0, '{"type": "comp').otherwise(text_of('{"type": "', status, '", "content": "c', i, '"}'))
    lines = read(spark, sf_dir, "events").select("user_id", "event_id", line.alias("value"))
    return sessions.last_outcome(sessions.parse_lines(lines), "user_id", "event_id").select(
        "user_id", "event_id", "type", "content"
    )


@query("SELECT DISTINCT lower(event_type) AS library FROM events")
def single_flights(spark, sf_dir):
    """One request for each library of a stream, in any case."""
    at = fresh_folder(spark, "flights")
    schema = read(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    first = sessions.single_flight(events.select(name.alias("library"), "ts"))
    first.select(F.lower("library").alias("library")).writeStream.format("parquet").option("path", f"{at}/rows").option(
        "checkpointLocation", f"{at}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@query(
    """WITH n AS (SELECT n_name AS library, n_nationkey AS k, CASE WHEN n_nationkey % 4 = 1 THEN 'failed' ELSE 'succeeded' END AS status FROM nation WHERE n_nationkey > 2),
r AS (SELECT *, count(*) FILTER (WHERE status = 'succeeded') OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM n)
SELECT library, status FROM r WHERE 2 + done < 10"""
)
def resumable_pool(spark, sf_dir):
    """A batch that goes on from its log and ends when enough libraries have succeeded."""
    names = [n["n_name"] for n in nations(spark, sf_dir)]
    past = [json.dumps({"libraryId": names[k].lower(), "status": s}) for k, s in enumerate(["succeeded", "succeeded", "failed"])]
    lines: list[str] = []

    def ensure(library: str) -> str:
        if names.index(library) % 4 == 1:
            raise ValueError("no such repository")
        return "succeeded"

    Pool(ensure, lines.append, target=10).run(names, [*past, "{"])
    rows = [json.loads(x) for x in lines]
    return spark.createDataFrame([(r["libraryId"], r["status"]) for r in rows], "library string, status string")
