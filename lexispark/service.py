"""The engine's surface: libraries, searches, reading, status, as methods that return DataFrames or texts.

An index is a folder of chunks, postings and figures; everything else is composed from the operators.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import formats, identifiers
from lexispark.functions.labels import reputation
from lexispark.functions.text import preview
from lexispark.functions.vectors import embedding_text, query_text
from lexispark.operators import catalog, chunks, index, reading, rerank, search, selection
from lexispark.plans.planner import plan_query, terms, token_budget
from lexispark.pool import first_that_works
from lexispark.scratch import cut, exists, passing
from lexispark.sources.keyed import KeyedTable

MOST_RESULT_CHARS = 16_000
RERANKED = 24
PARSER = "lexispark-1"


def positive_int(text: str | None, default: int) -> int:
    """A positive whole number of a setting; else the default."""
    try:
        n = int(text or "")
    except ValueError:
        return default
    return n if n > 0 else default


@dataclass
class CircuitBreaker:
    """After a failure, no more tries for a while."""

    pause_s: float = 300.0
    clock: Callable[[], float] = time.monotonic
    until: float = 0.0

    def open(self) -> bool:
        return self.clock() < self.until

    def failed(self) -> None:
        self.until = self.clock() + self.pause_s


def with_retries(call: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call again after connection errors, a longer pause each time; other errors are raised at once."""
    for k in range(attempts + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if k == attempts:
                raise
            sleep(2.718281828 ** k * 0.05)
    raise AssertionError


def embed(
    texts: DataFrame, call: Callable[[list[str]], list[list[float]]], batch: int = 16, most_dims: int = 4096
) -> DataFrame:
    """Vectors of (id, text) by an embedding service's call, in batches on the executors.

    A batch whose vectors differ in number or length, or aren't finite, fails.
    """
    import math

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), batch):
                part = df.iloc[at : at + batch]
                got = call(part["text"].tolist())
                dims = {len(v) for v in got}
                if len(got) != len(part) or len(dims) != 1 or not 0 < max(dims) <= most_dims or not all(
                    math.isfinite(x) for v in got for x in v
                ):
                    raise ValueError("the embedding service gave other vectors than asked for")
                yield pd.DataFrame({"id": part["id"], "embedding": got})

    return texts.select("id", "text").mapInPandas(run, "id bigint, embedding array<float>")


@dataclass
class Library:
    """An indexed library: its manifest's figures, its chunks, and the folder of its index, if it has one.

    ``checked_at`` is when it was last known to be at its repository's commit, in seconds.
    """

    id: str
    commit: str
    repository_url: str
    chunks: DataFrame
    n_rules: int = 0
    root: str | None = None
    checked_at: float = 0.0
    parser: str = PARSER


@dataclass(frozen=True)
class Found:
    """A library that was discovered: its repository, the commit it is at, and its files (path, content) when asked for."""

    id: str
    repository_url: str
    commit: str
    files: Callable[[], DataFrame]
    n_rules: int = 0


@dataclass(frozen=True)
class Ready:
    """A library that can be searched, what was done for that (indexed, refreshed, cached, stale-fallback), a warning."""

    library: Library
    disposition: str
    warning: str = ""


class Seen:
    """The chunks that sessions have seen of libraries at their commits.

    A session has one time to live: it ends when nothing was asked of any library for more than ``ttl_s``. Of each library
    it keeps at most ``most`` ids, those seen first go first, and seeing one again doesn't renew it.
    """

    def __init__(self, ttl_s: float = 3600.0, most: int = 500, clock: Callable[[], float] = time.monotonic):
        self.ttl_s, self.most, self.clock = ttl_s, most, clock
        self.touched: dict[str, float] = {}
        self.kept: dict[str, dict[str, dict[int, None]]] = {}

    def _alive(self, session: str) -> bool:
        """Forget idle sessions; whether this one is left, which is touched then."""
        now = self.clock()
        for s in [s for s, at in self.touched.items() if now - at > self.ttl_s]:
            self.clear(s)
        if session in self.touched:
            self.touched[session] = now
        return session in self.touched

    def ids(self, session: str, library: str) -> list[int]:
        """What a session has seen; asking keeps it alive."""
        return list(self.kept[session].get(library.lower(), ())) if self._alive(session) else []

    def add(self, session: str, library: str, ids: list[int]) -> None:
        if not ids:
            return
        self._alive(session)
        self.touched[session] = self.clock()
        own = self.kept.setdefault(session, {}).setdefault(library.lower(), {})
        own.update(dict.fromkeys(i for i in ids if i not in own))
        while len(own) > self.most:
            del own[next(iter(own))]

    def clear(self, session: str, library: str | None = None) -> None:
        """Forget a session, or what it has seen of one library."""
        if library is None:
            self.touched.pop(session, None)
            self.kept.pop(session, None)
        else:
            self.kept.get(session, {}).pop(library.lower(), None)


@dataclass
class Service:
    """``root`` is a folder for indexes, which all executors share; without one, chunks are checkpointed and scanned.

    What lies outside is called through functions: ``discover`` finds a library by its id, ``remote_commit`` says where
    its repository is now, ``embed_texts`` gives the vectors of a few texts, ``query_vector`` that of a query.
    """

    spark: SparkSession
    root: str | None = None
    libraries: dict[str, Library] = field(default_factory=dict)
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    seen: Seen = field(default_factory=Seen)
    query_vector: Callable[[str], list[float]] | None = None
    breaker: CircuitBreaker = field(default_factory=CircuitBreaker)
    discover: Callable[[str], Found | None] | None = None
    remote_commit: Callable[[str], str] | None = None
    embed_texts: Callable[[list[str]], list[list[float]]] | None = None
    model: str = "local"
    clock: Callable[[], float] = time.time

    def index(
        self, ident: str, files: DataFrame, commit: str, repository_url: str, n_rules: int = 0, **limits: int
    ) -> DataFrame:
        """Select files, cut them into chunks, and make the library searchable; returns the selection's counts.

        The index is written below a folder of the library's key and commit before it takes the place of an older one.
        """
        selected = cut(selection.select_files(files, **limits))
        made = chunks.chunk_markdown(selected.where("disposition = 'selected'").select("path", "content"))
        root = None
        if self.root is None:
            made = cut(made)
        else:
            root = f"{self.root}/{hashlib.sha256(ident.lower().encode()).hexdigest()}/{commit}"
            index.write_index(made, root)
            made = index.index_chunks(self.spark, root)
        self.libraries[ident.lower()] = Library(ident, commit, repository_url, made, n_rules, root, self.clock())
        return selection.selection_counts(selected)

    def index_first(self, candidates: list[str], make: Callable[[str], object], most: int = 5) -> str | None:
        """The first of the candidates that can be indexed by ``make``; None if none of the first ``most`` can."""
        found = first_that_works(candidates, make, most)
        return found[0] if found else None

    def library(self, ident: str) -> Library:
        found = self.libraries.get(ident.lower())
        if found is None:
            raise KeyError(f"{ident} is not indexed")
        return found

    def _build(self, ident: str) -> Library:
        found = self.discover(ident) if self.discover else None
        if found is None:
            raise KeyError(f"{ident} is not indexed, and can't be discovered")
        self.index(found.id, found.files(), found.commit, found.repository_url, found.n_rules)
        self.libraries[ident.lower()] = self.libraries[found.id.lower()]
        return self.library(ident)

    def ready(self, ident: str, force: bool = False) -> Ready:
        """Make a library ready for a question: index it if it isn't, refresh it if its parser or its repository's commit
        is another, and go on with what there is, and a warning, where that can't be found out."""
        lib = self.libraries.get(ident.lower())
        if lib is None:
            return Ready(self._build(ident), "indexed")
        remote, failed, why = None, False, ""

        def state() -> str:
            moment = lambda t: F.timestamp_seconds(F.lit(float(t)))
            return self.spark.range(1).select(
                catalog.freshness_state(
                    F.lit(True), F.lit(lib.parser == PARSER), moment(lib.checked_at), moment(self.clock()), F.lit(lib.commit),
                    F.lit(remote).cast("string"), F.lit(failed), F.lit(force)
                )
            ).first()[0]

        wanted = state()
        if wanted == "refreshed" and lib.parser == PARSER and not force and self.remote_commit:
            try:
                remote = self.remote_commit(lib.id)
            except Exception as e:  # whatever fails outside, what is there can be searched
                failed, why = True, f"Freshness check failed; using commit {lib.commit}. {type(e).__name__}"
            wanted = state()
        if wanted == "refreshed" and self.discover:
            return Ready(self._build(ident), "refreshed")
        if wanted == "cached" and remote is not None:
            lib.checked_at = self.clock()
        if wanted == "refreshed":  # nothing to refresh it from
            return Ready(lib, "stale-fallback", f"No way to refresh it; using commit {lib.commit}.")
        return Ready(lib, wanted, why)

    def resolve(self, name: str, limit: int = 10) -> DataFrame:
        """Indexed libraries whose id fits a name, as text blocks."""
        rows = self.spark.createDataFrame(
            [(x.id, x.id.split("/")[-1], x.commit) for x in self.libraries.values()],
            "id string, title string, commit string"
        )
        source = F.concat(F.lit("index at commit "), F.col("commit"))
        block = formats.library_block(F.col("title"), F.col("id"), source, F.lit(-1), reputation(F.lit(8)))
        return rows.where(
            catalog.name_matches(rows, F.lit(name), ["id", "title"])
        ).orderBy("id").limit(limit).select("id", "title", block.alias("block"))

    def _search(
        self, lib: Library, query: str, limit: int, max_tokens: int | None, seen: DataFrame | None = None,
        again: int | None = None
    ) -> DataFrame:
        if lib.root is not None:
            return index.search_index(self.spark, lib.root, query, limit, max_tokens, seen, again)
        return search.search(lib.chunks, query, limit, max_tokens, seen, again=again)

    def _cached_vectors(self, lib: Library) -> KeyedTable | None:
        """The vectors of a library at its commit by one model, where they are kept in files."""
        if lib.root is None or self.embed_texts is None:
            return None
        table = KeyedTable(self.spark, f"{lib.root}/vectors/{self.model}", ("id",))
        if not exists(self.spark, f"{table.root}/log"):
            table.create(self.spark.createDataFrame([], "id bigint, embedding array<float>"))
        return table

    def _vectors(self, lib: Library, candidates: DataFrame) -> DataFrame | None:
        """Vectors of the candidates; those that are missing are embedded, if that is possible, and stored."""
        table = self._cached_vectors(lib)
        own = table.read() if table else self.vectors.get(lib.id.lower())
        if self.embed_texts is None:
            return own
        if own is None:
            own = self.spark.createDataFrame([], "id bigint, embedding array<float>")
        text = embedding_text(F.col("doc_title"), F.col("section_title"), F.col("content"))
        missing = rerank.missing_vectors(candidates, own).select("id", text.alias("text"))
        new = cut(embed(missing, self.embed_texts))
        if table:
            if not new.isEmpty():
                table.upsert(new)
            return table.read()
        self.vectors[lib.id.lower()] = own.unionByName(self.spark.createDataFrame(new.collect(), new.schema))  # a few rows
        return self.vectors[lib.id.lower()]

    def _reranked(self, lib: Library, query: str, found: DataFrame) -> DataFrame:
        """Results reranked where their vectors are known or can be made; after a failure they stay as they are for a while."""
        able = self.embed_texts is not None or lib.id.lower() in self.vectors
        if not able or not plan_query(query) or self.breaker.open():
            return found
        try:
            if self.query_vector is None and self.embed_texts is None:
                raise ValueError("no embedding of queries")
            top = cut(found.drop("position").orderBy(F.desc("score"), "id").limit(RERANKED))
            own = self._vectors(lib, top)
            text = query_text(query)
            vector = self.query_vector(text) if self.query_vector else self.embed_texts([text])[0]
        except Exception:  # whatever fails in a service outside, an answer without it is given
            self.breaker.failed()
            return found
        return rerank.rerank(top, own, vector, RERANKED)

    def search_docs(
        self, ident: str, query: str, limit: int = 12, max_tokens: int | None = None, session: str | None = None,
        include_seen: bool = False
    ) -> DataFrame:
        """Previews of the best chunks, without those that the session has seen at this commit.

        The library is made ready first. At least 24 candidates are searched and reranked, then cut to the limit. If all
        that matches was seen, it is searched again with nothing left out.
        """
        return self._found(self.ready(ident).library, query, limit, max_tokens, session, include_seen).drop("block")

    def _found(
        self, lib: Library, query: str, limit: int, max_tokens: int | None, session: str | None, include_seen: bool
    ) -> DataFrame:
        most = min(max(limit, 1), 30)
        at = f"{lib.id.lower()}@{lib.commit}"
        ids = [] if include_seen or session is None else self.seen.ids(session, at)
        seen = self.spark.createDataFrame([(i,) for i in ids], "id bigint") if ids else None
        key = identifiers.result_key(F.lit(lib.commit), F.col("id"))
        url = identifiers.source_url(F.lit(lib.repository_url), F.lit(lib.commit), F.col("doc_path"))
        block = formats.match_block(
            F.col("position") + 1, F.col("doc_title"), F.col("section_title"), key, url, F.col("doc_path"), F.col("score"),
            F.col("matched_queries"), F.col("content")
        )
        with passing(self.spark):
            found = self._search(lib, query, max(most, RERANKED), max_tokens, seen, again=most)
            rows = rerank.sliced(self._reranked(lib, query, found), most).select(
                "position", "id", "doc_path", "section_title", "score", "matched_queries", key.alias("key"), url.alias("url"),
                preview(F.col("content")).alias("preview"), block.alias("block")
            )
            answer = rows.orderBy("position").collect()  # at most 30
        if session is not None:
            self.seen.add(session, at, [r["id"] for r in answer])
        return self.spark.createDataFrame(answer, rows.schema)

    def search_text(
        self, ident: str, query: str, limit: int = 12, max_tokens: int | None = None, session: str | None = None,
        include_seen: bool = False
    ) -> str:
        """``search_docs`` as an answer text: what was done to make the library ready, and each match with its key."""
        ready = self.ready(ident)
        lib = ready.library
        matches = [
            r["block"] for r in self._found(lib, query, limit, max_tokens, session, include_seen).orderBy("position").collect()
        ]
        hybrid = self.embed_texts is not None or lib.id.lower() in self.vectors
        mode = f"local hybrid lexical + {self.model} reranking" if hybrid and not self.breaker.open() else "fused lexical retrieval"
        head = (
            f"{self._head(lib)}\n\nSearch returned {len(matches)} sections using {len(plan_query(query))} lexical facets and"
            f" {mode} (budget: {token_budget(query, max_tokens)} tokens)."
        )
        warning = f"Warning: {ready.warning}\n\n" if ready.warning else ""
        state = f"Local index {ready.disposition}: {lib.id} is ready.\n\n"
        return warning + state + "\n\n".join([head, *(matches or ["No indexed section matched the query."])])

    def query_docs(self, ident: str, query: str) -> str:
        """An answer text within 4,000 tokens; reranked where vectors are known or can be made."""
        lib = self.ready(ident).library
        url = identifiers.source_url(F.lit(lib.repository_url), F.lit(lib.commit), F.col("doc_path"))
        part = F.concat(F.lit("## "), F.col("section_title"), F.lit("\nSource: "), url, F.lit("\n\n"), F.col("content"))
        with passing(self.spark):
            found = self._reranked(lib, query, self._search(lib, query, RERANKED, 4_000))
            return self._text(lib, found.withColumn("part", part), "position", "part")

    def read_docs(self, ident: str, key: str, max_tokens: int | None = None) -> str:
        """A result with its neighbours; a key of another commit is stale."""
        lib = self.ready(ident).library
        found = self.spark.range(1).select(
            identifiers.parse_result_key(F.lit(key), F.lit(lib.commit)).alias("k")
        ).first()["k"]
        if found["state"] != "ok":
            return f"The result key is {found['state']}."
        near = reading.neighbours(
            lib.chunks, self.spark.createDataFrame([(found["chunk_id"],)], "anchor_id bigint"), max_tokens
        )
        part = F.concat(F.lit("## "), F.col("section_title"), F.lit("\n\n"), F.col("content"))
        return self._text(lib, near.withColumn("part", part), "id", "part")

    def grep_docs(self, ident: str, pattern: str, limit: int | None = None) -> DataFrame:
        """Chunks that hold a literal, with their keys and sources; by the index's trigrams where there is one."""
        lib = self.ready(ident).library
        if lib.root is None:
            hits = reading.grep(lib.chunks, pattern, limit)
        else:
            with passing(self.spark):
                hits = index.grep_index(index.open_index(self.spark, lib.root), pattern, limit)
        key = identifiers.result_key(F.lit(lib.commit), F.col("id"))
        url = identifiers.source_url(F.lit(lib.repository_url), F.lit(lib.commit), F.col("doc_path"))
        return hits.select(
            "id", "doc_path", "doc_title", "section_title", "snippet", key.alias("key"), url.alias("url")
        )

    def grep_text(self, ident: str, pattern: str, limit: int | None = None) -> str:
        """``grep_docs`` as an answer text."""
        block = formats.grep_block(F.col("key"), F.col("doc_title"), F.col("section_title"), F.col("url"), F.col("snippet"))
        found = [r["b"] for r in self.grep_docs(ident, pattern, limit).orderBy("id").select(block.alias("b")).collect()]
        body = "\n\n".join(found) or "No exact matches."
        return f"{self._head(self.library(ident))}\n\nExact literal matches: {len(found)}\n\n{body}"

    def _head(self, lib: Library) -> str:
        return self.spark.range(1).select(
            formats.provenance(F.lit(lib.id), F.lit(lib.commit), F.lit(lib.n_rules))
        ).first()[0]

    def status(self) -> DataFrame:
        """Health of all indexes: libraries, sections, tokens, outdated ones."""
        rows = None
        for lib in self.libraries.values():
            one = lib.chunks.agg(F.count("*").alias("sections"), F.sum("tokens").alias("tokens")).select(
                "*", F.lit(lib.commit).alias("checked_at"), F.lit(PARSER).alias("parser_version")
            )
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            rows = self.spark.createDataFrame(
                [], "sections bigint, tokens bigint, checked_at string, parser_version string"
            )
        return catalog.index_health(rows, PARSER)

    def evaluate(self, ident: str, qrels: list[tuple[str, str]]) -> DataFrame:
        """Rank of the relevant path for each (query, path), and the milliseconds: fused search and the baseline.

        Each scenario is searched and timed on its own; ``catalog.evaluation_report`` sums them up.
        """
        lib, out = self.library(ident), []

        def first(found: DataFrame, order: Column, path: str) -> int:
            ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(order)))  # at most ten rows
            hit = ranked.where(catalog.path_relevant(F.col("doc_path"), F.lit(path))).agg(F.min("rank")).first()[0]
            return hit or 0

        for query, path in qrels:
            t0 = time.perf_counter()
            legacy = first(search.legacy_top(lib.chunks, query), F.col("rank"), path) if terms(query) else 0
            t1 = time.perf_counter()
            fused = first(self._search(lib, query, 10, 5_000), F.col("position"), path)
            out.append((query, path, legacy, fused, (t1 - t0) * 1000, (time.perf_counter() - t1) * 1000))
        return self.spark.createDataFrame(
            out, "query string, path string, legacy_rank int, fused_rank int, legacy_ms double, fused_ms double"
        )

    def _text(self, lib: Library, rows: DataFrame, order: str, part: str) -> str:
        listed = F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("id"), F.col(part).alias("p")))),
                lambda x: x["p"]
            ),
            formats.BREAK
        )
        head = formats.provenance(F.lit(lib.id), F.lit(lib.commit), F.lit(lib.n_rules))
        return rows.agg(
            formats.truncate(F.concat(head, F.lit("\n\n"), listed), MOST_RESULT_CHARS).alias("t")
        ).first()["t"]
