"""Libraries: candidates, catalog, name search, freshness, health, policies, logs, sessions, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.labels import is_fresh, popularity_score
from lexispark.functions.text import search_name
from lexispark.scratch import cut

# Repositories that are no libraries, by name and by topic.
EXCLUDED_NAME = r"(^|[-_.])(awesome|interview|roadmap|cheatsheet|dotfiles|books?)([-_.]|$)"
EXCLUDED_TOPICS = [
    "awesome-list", "books", "cheatsheet", "interview", "interview-questions", "learning-resources", "roadmap"
]
# The searches whose hits make the popular catalog, with the weights of their hits.
SEARCHES = [
    ("framework", "topic:framework stars:>500", 100), ("library", "topic:library stars:>500", 98),
    ("sdk", "topic:sdk stars:>250", 96), ("web-framework", "topic:web-framework stars:>250", 96),
    ("database", "topic:database stars:>500", 94), ("machine-learning", "topic:machine-learning stars:>500", 92),
    ("testing", "topic:testing stars:>500", 90), ("devops", "topic:devops stars:>500", 88),
    ("api-client", "topic:api-client stars:>100", 88), ("orm", "topic:orm stars:>100", 88),
    ("authentication", "topic:authentication stars:>250", 86), ("observability", "topic:observability stars:>250", 84),
    ("javascript", "language:JavaScript stars:>5000", 82), ("typescript", "language:TypeScript stars:>5000", 84),
    ("python", "language:Python stars:>5000", 84), ("rust", "language:Rust stars:>2500", 82),
    ("go", "language:Go stars:>3000", 82), ("java", "language:Java stars:>3000", 80),
    ("dotnet", "language:C# stars:>1500", 80), ("cpp", "language:C++ stars:>3000", 76),
    ("php", "language:PHP stars:>1500", 76), ("ruby", "language:Ruby stars:>1500", 76),
    ("swift", "language:Swift stars:>1500", 76), ("kotlin", "language:Kotlin stars:>1000", 76),
    ("dart", "language:Dart stars:>1000", 74), ("elixir", "language:Elixir stars:>750", 72),
    ("scala", "language:Scala stars:>1000", 72)
]
ONLY = "archived:false fork:false"
CURATED = 2_000_000_000
DEFAULT_WEIGHT = 100


def usable_repository(archived: Column, disabled: Column, size: Column) -> Column:
    """Not archived, not disabled, not empty; an unknown size is fine."""
    return ~F.coalesce(archived, F.lit(False)) & ~F.coalesce(disabled, F.lit(False)) & (size.isNull() | (size > 0))


def is_candidate(name: Column, topics: Column, archived: Column, fork: Column) -> Column:
    return (
        ~F.coalesce(
            archived, F.lit(False)
        ) & ~F.coalesce(fork, F.lit(False)) & ~F.coalesce(name, F.lit("")).rlike(f"(?i){EXCLUDED_NAME}")
        & ~F.coalesce(
            F.arrays_overlap(F.transform(topics, F.lower), F.array(*map(F.lit, EXCLUDED_TOPICS))), F.lit(False)
        )
    )


def popular_searches(spark: SparkSession) -> DataFrame:
    """The searches of the popular catalog (source, query, weight); a hundred hits of each by stars are asked for."""
    rows = [(name, f"{query} {ONLY}", weight) for name, query, weight in SEARCHES]
    return spark.createDataFrame(rows, "source string, query string, weight int")


def weighted(hits: DataFrame, searches: DataFrame) -> DataFrame:
    """Hits (source, ...) with the weight of their search; those of no known search have none."""
    return hits.drop("weight").join(F.broadcast(searches.select("source", "weight")), "source", "left")  # a row a search


def merge_candidates(hits: DataFrame, limit: int, curated: DataFrame | None = None) -> DataFrame:
    """A ranked catalog of search hits (library_id, title, description, stars, source, weight, arrival).

    A source without a weight has DEFAULT_WEIGHT. Hits of an id in any case are one library: the first one's id and title, the first description there is, the most
    stars, the best weight, the number of sources. Curated ids (library_id, position) come first in their order.
    """
    key = F.lower("library_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival")))
    rows = hits
    if curated is not None:
        listed = curated.select(
            "library_id", F.split_part("library_id", F.lit("/"), F.lit(3)).alias("title"),
            F.lit(None).cast("string").alias("description"), F.lit(None).cast("bigint").alias("stars"),
            F.lit("curated").alias("source"), F.lit(100).alias("weight"),
            (F.col("position") - F.lit(1 << 40)).alias("arrival")
        )
        rows = hits.select(*listed.columns).unionByName(listed)
    merged = rows.groupBy(key.alias("key")).agg(
        first("library_id").alias("library_id"), first("title").alias("title"), first("description").alias("description"), F.max(
            F.coalesce("stars", F.lit(0))
        ).alias("stars"),
        F.max(F.coalesce("weight", F.lit(DEFAULT_WEIGHT))).alias("weight"), F.count_distinct("source").alias("sources"), F.min(
            F.when(F.col("source") == "curated", F.col("arrival") + F.lit(1 << 40))
        ).alias("position"),
    )
    score = F.when(F.col("position").isNotNull(), F.lit(CURATED) - F.col("position")).otherwise(
        popularity_score(F.col("stars"), F.col("weight"), F.col("sources"))
    )
    top = merged.withColumn("score", score.cast("bigint")).orderBy(F.desc("score"), "library_id").limit(limit)
    # The catalog has at most ``limit`` rows, so its ranks come from one partition.
    return top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("score"), "library_id"))
    ).drop("key", "weight", "position")


def best_repositories(hits: DataFrame, name: str, limit: int = 3) -> DataFrame:
    """Of repository search hits (name, stars, archived, disabled, size, ...) the usable ones whose name is the wanted one
    in letters and digits, the most stars first."""
    same = search_name(F.col("name")) == search_name(F.lit(name))
    usable = usable_repository(F.col("archived"), F.col("disabled"), F.col("size"))
    return hits.where(same & usable).orderBy(F.coalesce("stars", F.lit(0)).desc(), "library_id").limit(limit)


def decorated(candidates: DataFrame, live: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Candidates with what a live lookup says of them, where it says something; a lookup that failed has no row."""
    own = live.select(F.lower(key).alias("__key"), *[F.col(c).alias(f"__live_{c}") for c in columns])
    out = candidates.join(own.dropDuplicates(["__key"]), F.lower(candidates[key]) == own["__key"], "left")
    return out.withColumns({c: F.coalesce(f"__live_{c}", c) for c in columns}).drop(
        "__key", *[f"__live_{c}" for c in columns]
    )


def name_matches(rows: DataFrame, name: Column, columns: Sequence[str]) -> Column:
    """Whether a name, reduced to letters and digits, is part of one of the columns; an empty one is part of all."""
    needle = search_name(name)
    return F.exists(F.array(*[search_name(F.col(c)) for c in columns]), lambda c: F.contains(c, needle))


def freshness_state(
    stored: Column, parser_ok: Column, checked_at: Column, now: Column, commit: Column, remote: Column,
    remote_failed: Column, force: Column | None = None
) -> Column:
    """What becomes of an index that is asked for: indexed, refreshed, cached or stale-fallback."""
    forced = force if force is not None else F.lit(False)
    return (
        F.when(~stored, "indexed").when(~parser_ok, "refreshed").when(forced, "refreshed").when(
            is_fresh(checked_at, now), "cached"
        )
        .when(remote_failed, "stale-fallback").when(remote == commit, "cached").otherwise("refreshed")
    )


def index_health(manifests: DataFrame, parser: str) -> DataFrame:
    """Figures over all manifests (library, sections, tokens, checked_at, parser_version)."""
    return manifests.agg(
        F.count("*").alias("libraries"), F.coalesce(
            F.sum("sections"), F.lit(0)
        ).alias("sections"), F.coalesce(
            F.sum("tokens"), F.lit(0)
        ).alias("tokens"), F.min("checked_at").alias("oldest_check"),
        F.count_if(F.col("parser_version") != parser).alias("outdated"),
    )


def latest_events(events: DataFrame, key: Column, line: str) -> DataFrame:
    """The last event of each key by its place in the log."""
    return events.withColumn(
        "__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(line)))
    ).where("__n = 1").drop("__n")


def progress_counters(target: int) -> list[Column]:
    """Counts by status, and how many are still to be done."""
    of = lambda s: F.count_if(F.col("status") == s)
    return [
        F.count("*").alias("processed"), of("succeeded").alias("succeeded"), of("failed").alias("failed"),
        of("skipped").alias("skipped"), F.greatest(F.lit(0), F.lit(target) - of("succeeded")).alias("remaining")
    ]


def progress(events: DataFrame, target: int) -> DataFrame:
    """Counts by status of the last events, and how many are still to be done."""
    return events.agg(*progress_counters(target))


def policy_filter(
    rows: DataFrame, condition: Column, key: str, blocked: DataFrame | None = None, excepted: DataFrame | None = None
) -> DataFrame:
    """Rows that a policy lets through: blocked keys never, excepted keys always, others by the condition."""
    out = rows.join(blocked.select(key).distinct(), key, "left_anti") if blocked is not None else rows
    if excepted is None:
        return out.where(condition)
    marked = out.join(excepted.select(key).distinct().withColumn("__ok", F.lit(True)), key, "left")
    return marked.where(F.col("__ok").isNotNull() | condition).drop("__ok")


def reconcile(
    desired: DataFrame, actual: DataFrame, key: str, version: str, same_commit: bool = False, valid: str | None = None
) -> DataFrame:
    """What brings actual rows to the desired ones: created, updated, unchanged or pruned for each key.

    If the manifest is of the commit that was applied last, all is skipped. ``valid`` is a flag of the desired rows: one
    that isn't true, and all is rejected.
    """
    d, a = desired.select(key, F.col(version).alias("want")), actual.select(key, F.col(version).alias("have"))
    action = F.when(F.col("have").isNull(), "created").when(F.col("want").isNull(), "pruned").when(
        F.col("want") == F.col("have"), "unchanged"
    ).otherwise("updated")
    if same_commit:
        action = F.lit("skipped")
    elif valid is not None and not desired.where(~F.coalesce(F.col(valid), F.lit(False))).isEmpty():
        action = F.lit("rejected")
    return d.join(a, key, "full_outer").select(key, "want", "have", action.alias("action"))


def session_seen(
    events: DataFrame, session: str, library: str, item: str, ts: str, gap: str = "1 hour", most: int = 500
) -> DataFrame:
    """What each session has seen of each library, a session ending when it is idle for ``gap``; the newest ``most``.

    Items count from when they were first seen in the session; seeing one again doesn't renew it.
    """
    t = F.col(ts).cast("timestamp")
    idle = F.lag(t).over(Window.partitionBy(session).orderBy(t, item))
    begins = F.when(idle.isNull() | (t - F.expr(f"INTERVAL {gap}") > idle), 1).otherwise(0)
    marked = events.withColumn("__b", begins).withColumn(
        "session_no",
        F.sum("__b").over(Window.partitionBy(session).orderBy(t, item).rowsBetween(Window.unboundedPreceding, 0))
    )
    first = marked.groupBy(session, "session_no", library, item).agg(F.min(t).alias("first_seen"))
    w = Window.partitionBy(session, "session_no", library).orderBy(F.desc("first_seen"), F.desc(item))
    return first.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most)


def retrieval_metrics(ranks: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Mean reciprocal rank and recall at k of ranks from 1; 0 is a miss."""
    r = F.col(column)
    return ranks.agg(
        F.count("*").alias("scenarios"), F.avg(F.when(r > 0, F.lit(1.0) / r).otherwise(0.0)).alias("mrr"),
        F.avg(F.when((r > 0) & (r <= k), 1.0).otherwise(0.0)).alias("recall")
    )


def exact_percentiles(rows: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """The value at place floor(n * fraction) of the sorted values, the last at most, as ``p<percent>``; nulls are left out.

    Counts by value are dealt into ranges at their quantiles, so that each has about as many values however they are
    spread; a running count goes on inside the ranges that hold a wanted place. Only a count for each range is ordered as
    a whole.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(F.sum("n").alias("m"))
    bounds = cut(parts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"), "m"))
    n = bounds.agg(F.sum("m")).first()[0] or 0
    wanted = {f: min(n - 1, int(n * f)) for f in fractions}
    holds = reduce(lambda a, b: a | b, [F.lit(at).between(F.col("before"), F.col("before") + F.col("m") - 1) for at in wanted.values()])
    run = placed.join(F.broadcast(bounds.where(holds)), "part").withColumn(
        "until", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    )  # ``bounds`` has a row for each range
    return run.agg(
        *[F.min(F.when(F.col("until") > at, F.col("v"))).alias(f"p{round(f * 100)}") for f, at in wanted.items()]
    )


def migration_progress(events: DataFrame, failures: int = 100) -> DataFrame:
    """Counts of a migration and its last failures (library, at), newest last.

    Failures are cut before they are listed, so the list is bounded.
    """
    last = events.where("status = 'failed'").orderBy(F.desc("at"), "library").limit(failures)
    listed = last.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "library"))), lambda x: x["library"]).alias("failures")
    )
    counts = events.agg(
        F.count("*").alias("processed"), F.count_if(F.col("status") == "succeeded").alias("migrated"),
        F.count_if(F.col("status") == "failed").alias("failed")
    )
    return counts.crossJoin(F.broadcast(listed))  # one row each


def product_in_order(names: DataFrame, registries: list[str]) -> DataFrame:
    """Each name (name, ordinal) with each registry, by name and then registry: a short list exploded, no join."""
    return names.select(
        "name", "ordinal", F.posexplode(F.array(*map(F.lit, registries))).alias("registry_no", "registry")
    )


def union_keep_first(lists: list[DataFrame], key: str) -> DataFrame:
    """Rows of several candidate lists (with an ordinal in each), the first of each key in any case, in list order."""
    rows = None
    for k, df in enumerate(lists):
        one = df.withColumn("list_no", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy(F.lower(key)).orderBy("list_no", "ordinal")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def agent_modes(agents: DataFrame) -> DataFrame:
    """Which modes any of the agents has (cli, server), as flags and as a list."""
    flags = agents.agg(F.bool_or("cli").alias("cli"), F.bool_or("server").alias("server"))
    return flags.withColumn(
        "modes", F.array_compact(F.array(F.when(F.col("cli"), "cli"), F.when(F.col("server"), "server")))
    )


def pending(work: DataFrame, events: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """What a batch still has to do, by its last events (key in any case, status): not what succeeded, nor what failed
    unless failures are tried again."""
    done = F.col("status").isin(["succeeded"] if retry_failed else ["succeeded", "failed"])
    own = events.where(done).select(F.lower(F.col(key).cast("string")).alias("__done")).distinct()
    return work.join(own, F.lower(F.col(key).cast("string")) == F.col("__done"), "left_anti")


def usage(events: DataFrame, ts: str, user: str, by: Sequence[str | Column], period: str = "yyyy-MM-dd") -> DataFrame:
    """Requests and users by period and any kinds (event type, topic, country)."""
    return events.groupBy(F.date_format(ts, period).alias("period"), *by).agg(
        F.count("*").alias("n"), F.count_distinct(user).alias("users")
    )


#: Registers of a user sketch, as a power of two: a standard error of about 1.6 %.
SKETCH = 12


def usage_sketches(events: DataFrame, ts: str, user: str, by: Sequence[str], period: str = "yyyy-MM-dd") -> DataFrame:
    """Requests and a mergeable sketch of their users for each period and combination of kinds; a table to keep, in place
    of the events, from which coarser counts are merged."""
    return events.groupBy(F.date_format(ts, period).alias("period"), *by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(user, SKETCH).alias("sketch")
    )


def usage_trends(sketches: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Requests and estimated users over several sets of columns in one pass over sketches; a column that a set leaves
    out is null, and ``level`` is the set's place."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    merged = sketches.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"), F.grouping_id().alias("__g")
    )
    mask = lambda s: sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s)
    level = reduce(lambda w, x: F.when(F.col("__g") == mask(x[1]), x[0]).otherwise(w), enumerate(sets), F.lit(None).cast("int"))
    return merged.withColumn("level", level).drop("__g")


def snippets(code: DataFrame, info: DataFrame) -> DataFrame:
    """Code and information snippets in one list, with their kind."""
    return code.withColumn("kind", F.lit("code")).unionByName(info.withColumn("kind", F.lit("info")))


def snippet_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many snippets of each kind, and in all."""
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.groupBy(key).agg(of("code"), of("info"), F.count("*").alias("snippets"))


def most_installed(rows: DataFrame, installs: str, key: str, limit: int, recommended: str | None = None) -> DataFrame:
    """Rows by installs, unknown ones as none, then by key; a recommended key comes first, whatever its installs.

    place counts from 1.
    """
    first = (F.col(key).cast("string") == F.lit(recommended)) if recommended is not None else F.lit(False)
    order = [F.desc("__first"), F.desc("__n"), F.col(key)]
    top = rows.withColumns({"__first": first, "__n": F.coalesce(installs, F.lit(0.0))}).orderBy(*order).limit(limit)
    # ``limit`` rows, so their places come from one partition
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("__first", "__n")


def best(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first result of each group in an order; of a ranked list the best one."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def indexed_scenarios(scenarios: DataFrame, manifests: DataFrame, key: str) -> DataFrame:
    """Scenarios whose library is indexed, ids in any case; others are left out of an evaluation."""
    known = manifests.select(F.lower(key).alias("__known")).distinct()
    return scenarios.join(known, F.lower(key) == F.col("__known"), "left_semi")


def path_relevant(path: Column, wanted: Column) -> Column:
    """Whether a path contains the wanted one, in any case and with either slash."""
    unix = lambda p: F.lower(F.translate(p, "\\", "/"))
    return F.contains(unix(path), unix(wanted))


def first_relevant(scenarios: DataFrame, found: DataFrame, key: str, relevant: Column) -> DataFrame:
    """The rank (from 1) of the first relevant result of each scenario, 0 if there is none.

    ``found`` has the key and a rank; ``relevant`` may use the columns of both.
    """
    hits = scenarios.join(found, key).where(relevant).groupBy(key).agg(F.min("rank").alias("rank"))
    return scenarios.select(key).join(hits, key, "left").select(key, F.coalesce("rank", F.lit(0)).alias("rank"))


def evaluation_report(rows: DataFrame, kinds: Sequence[str] = ("legacy", "fused")) -> DataFrame:
    """One row for each kind of search from (<kind>_rank, <kind>_ms): scenarios, mrr, recall, p50 and p95 of the times."""
    out = None
    for kind in kinds:
        metrics = retrieval_metrics(rows, f"{kind}_rank")
        times = exact_percentiles(rows, f"{kind}_ms", [0.5, 0.95])
        one = metrics.select(F.lit(kind).alias("kind"), "*").join(
            F.broadcast(times), F.lit(True)
        )  # one row each
        out = one if out is None else out.unionByName(one)
    return out
