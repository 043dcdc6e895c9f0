"""The queries of the training-data operators, with the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.ann_search import search
from lexispark.llm.chat_format import format_chats, read_back
from lexispark.llm.common import table
from lexispark.llm.embedding_dedup import embedding_duplicates
from lexispark.llm.fill_in_middle import fill_in_middle, restored
from lexispark.llm.fingerprints import fingerprint_edits
from lexispark.llm.lm_scoring import score_texts
from lexispark.llm.mixing import mix_sources
from lexispark.llm.near_dedup import near_duplicates
from lexispark.llm.packing import pack
from lexispark.llm.prefix_trie import conversation_trie
from lexispark.llm.quality import grade_documents
from lexispark.llm.token_counts import count_tokens
from lexispark.llm.url_filters import filter_urls

#: Host and path rules of op3.
URL_RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"
}

#: The most epochs of any source that op5 and the pipeline allow.
MIX_REPETITION = 2.0


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM words
), items AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON r.other = l.x)
SELECT doc_id, len(any_value(s)) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), rules(rh, rp, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC NULLS LAST, rh || rp) AS n
  FROM parts p LEFT JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return graded.select("doc_id", "expected_grade", "tail_probability", "keep")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), repetition=MIX_REPETITION).rows
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_rank", "mix_tokens")


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, numbered -7, whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_chats(turns, tokenizer_path("byte_bpe_50k.json")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256")
    )


OP11_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform(range(0, 4), lambda k:
    list_reduce(list_transform(range(1, 9), lambda c: strpos('0123456789abcdef', substr(h, 8 * k + c, 1)) - 1), lambda x, y: x * 16 + y)) AS r FROM units
), cuts AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
"""


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
valid AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM given
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95 END
), reach AS (SELECT vec_id, vec_id AS other FROM given UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach LEFT JOIN counts ON x = vec_id GROUP BY vec_id
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(sha256(length(r) || ':' || r || x) ORDER BY turn NULLS FIRST) AS ks, list(length(x) ORDER BY turn NULLS FIRST) AS ls FROM turns GROUP BY conv_id
), hashed AS (
  SELECT *, conv_id - ((conv_id % 100) + 100) % 100 AS base, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda k: CAST(0 AS BIGINT)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h FROM own
), made AS (
  SELECT a.conv_id, list_concat(coalesce(b.ks, [])[1:a.h], a.ks[a.h + 1:]) AS ks, list_concat(coalesce(b.ls, [])[1:a.h], a.ls[a.h + 1:]) AS ls FROM hashed a LEFT JOIN own b ON b.conv_id = a.base
), members AS (
  SELECT conv_id, d AS depth, ks[1:d] AS k, CASE WHEN d > 0 THEN ls[d] ELSE 0 END AS l, len(ks) = d AS ends FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM made)
), nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(l) AS l, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM members GROUP BY k, depth
), children AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
shown AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, p.conv_id AS parent FROM nodes n LEFT JOIN children c ON c.k = n.k LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.k = n.k[1:n.depth - 1]
), above AS (SELECT *, unnest(range(0, depth + 1)) AS d FROM shown),
below AS (SELECT k[1:d] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * l) AS saved FROM above GROUP BY 1)
SELECT conv_id, depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM shown JOIN below USING (k)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_url_filters": op3_url_filters,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_ann_search": op6_ann_search,
    "op7_packing": op7_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_chat_format": op9_chat_format,
    "op10_fingerprints": op10_fingerprints,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": OP1_SQL, "op3_url_filters": OP3_SQL, "op11_fill_in_middle": OP11_SQL,
    "op12_embedding_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL
}
