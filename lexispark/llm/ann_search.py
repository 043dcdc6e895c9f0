"""Nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance. They
are rotated at random and dealt to lists around centres fitted to a bounded sample; every vector is indexed. Lists lie
in groups of bounded size, neighbours together. A query probes its nearest lists, those of its nearest group first; the
distance of the best found there is carried to the others. In a group the rotated dimensions are read in column blocks:
after each block the partial distance, scaled to all dimensions, is held against the bound, and candidates that a
hypothesis test rejects are abandoned. What is left is scored exactly, in double precision, on the original vectors.

Equal vectors are indexed once, with as many of their smallest ids as a result can need, so a vector that a third of
the rows share costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import broadcast_if_small, cut, small_batches


def _valid(v: str) -> Column:
    return F.expr(
        f"{v} IS NOT NULL AND size({v}) > 0 AND forall({v}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({v}, x -> x <> 0)"
    )


def fit_centres(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means on a sample; empty lists keep their centre."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(x, centre, 1)[:, 0]
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        d = (centre**2).sum(1)[None, :] - 2 * x[lo : lo + 1024] @ centre.T
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(centre) else np.broadcast_to(np.arange(k), d.shape)
        order = np.take_along_axis(d, part, 1).argsort(1, kind="stable")
        out[lo : lo + 1024] = np.take_along_axis(part, order, 1)
    return out


def length(x: np.ndarray) -> np.ndarray:
    """The norms of rows, however large or small their components."""
    most = np.clip(np.abs(x).max(axis=1), 1e-300, 1e300 / np.sqrt(x.shape[1]))
    return most * np.linalg.norm(x / most[:, None], axis=1)


class Space:
    """How vectors of one length are mapped: in units of the longest, the added component, then the rotation."""

    def __init__(self, dims: int, longest: float, seed: int = 11):
        self.dims, self.longest = dims, longest
        self.turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims + 1, dims + 1)))[0]

    def stored(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        rest = np.sqrt(np.maximum(1 - (x**2).sum(1), 0))
        return np.column_stack([x, rest]) @ self.turn

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries have the stored vectors' norm; that changes no order."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.column_stack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros(len(q))]) @ self.turn


def scan(
    x: np.ndarray, q: np.ndarray, keep: int, bound: np.ndarray | None = None, allowed: np.ndarray | None = None,
    step: int = 16, slack: float = 2.6, share: int = 8
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, candidate) that the adaptive scan doesn't abandon, sorted, by tiles of queries; the ``keep`` nearest
    of each query are among them but for the test's error.

    ``bound`` is a squared distance within which ``keep`` candidates are known to be, infinite where none is; there the
    ``keep``-th smallest distance of every ``share``-th candidate is taken. ``allowed`` marks which candidates a query
    asks for.

    The test: of a vector at the bound, the share of the squared distance in k of d rotated dimensions scatters about
    k / d with a relative deviation of sqrt(2 / k - 2 / d). A candidate goes when its scaled partial distance exceeds
    the bound by more than ``slack`` such deviations; after all dimensions, when it exceeds the bound.
    """
    dims, n = x.shape[1], len(x)
    cuts = [*range(step, dims, step), dims]
    blocks = list(zip([0, *cuts], cuts, strict=False))
    squares = [(x[:, lo:hi] ** 2).sum(1) for lo, hi in blocks]
    room = [hi / dims * (1 + slack * np.sqrt(max(0.0, 2 / hi - 2 / dims))) * (1 + 1e-5) for hi in cuts]
    some = np.arange(0, n, share) if n >= share * keep else np.arange(n)
    some_squares = (x[some] ** 2).sum(1)
    tile = max(1, (1 << 19) // max(1, n))
    for at in range(0, len(q), tile):
        own = q[at : at + tile]
        asked = None if allowed is None else allowed[at : at + tile]

        def whole(k: int, own: np.ndarray = own) -> np.ndarray:
            """Distances over column block k, of all queries and candidates."""
            lo, hi = blocks[k]
            d = own[:, lo:hi] @ x[:, lo:hi].T
            d *= -2
            d += squares[k]
            d += (own[:, lo:hi] ** 2).sum(1)[:, None]
            return d

        limit = np.full(len(own), np.inf) if bound is None else bound[at : at + tile].astype(float)
        open_ = np.flatnonzero(np.isinf(limit))
        if len(open_) and n > keep:
            d = some_squares - 2 * own[open_] @ x[some].T + (own[open_] ** 2).sum(1)[:, None]
            if asked is not None:
                d[~asked[np.ix_(open_, some)]] = np.inf
            limit[open_] = np.partition(d, keep - 1, axis=1)[:, keep - 1] + 1e-5  # products in single precision
        part = whole(0)
        if asked is not None:
            part[~asked] = np.inf
        alive = part <= (limit * room[0])[:, None]
        k = 1
        while k < len(blocks) and alive.mean() > 0.15:  # many are left: a product over all is cheaper than picking them
            part += whole(k)
            alive &= part <= (limit * room[k])[:, None]
            k += 1
        if asked is not None:
            alive &= asked
        i, j = np.nonzero(alive)
        d = part[i, j]
        for k in range(k, len(blocks)):
            lo, hi = blocks[k]
            d = d + ((x[j, lo:hi] - own[i, lo:hi]) ** 2).sum(1)
            stay = d <= (limit * room[k])[i]
            i, j, d = i[stay], j[stay], d[stay]
        yield i + at, j


def best_of(
    v: np.ndarray, q: np.ndarray, need: int, known: np.ndarray, ids: np.ndarray, asks: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, inner product) of the ``need`` best candidates of each query, or fewer, ties to smaller ids.

    ``known`` is a product that ``need`` candidates elsewhere are known to reach, nan where there is none. Candidates are
    scanned by their length, the longest first, each band in units of its own longest: beside a far longer one, short
    vectors could not be told apart.
    """
    lengths, reach = length(v), length(q)
    band = np.floor(np.log2(lengths.max() / lengths))
    i, j, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    known = known.copy()

    def take(who: np.ndarray, what: np.ndarray) -> None:
        """Score pairs and keep the best so far."""
        nonlocal i, j, score
        got = np.empty(len(who))
        for lo in range(0, len(who), 50_000):
            got[lo : lo + 50_000] = (v[what[lo : lo + 50_000]] * q[who[lo : lo + 50_000]]).sum(1)
        order = np.lexsort((ids[what], -got, who))
        who, what, got = who[order], what[order], got[order]
        few = np.arange(len(who)) - np.searchsorted(who, who) < need  # from the first place of each query
        i, j, score = np.append(i, who[few]), np.append(j, what[few]), np.append(score, got[few])

    for b in np.unique(band):
        own = np.flatnonzero(band == b)
        space = Space(v.shape[1], float(lengths[own].max()))
        bound = 2 - 2 * (known / reach) / space.longest
        bound = np.where(np.isnan(bound), np.inf, np.maximum(bound + 1e-9, 0))
        asked = None if asks is None else asks[:, own]
        for who, what in scan(space.stored(v[own]).astype(np.float32), space.asked(q).astype(np.float32), need, bound, asked):
            take(who, own[what])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score, place = (x[place < need] for x in (i, j, score, place))
        full = place == need - 1
        known[i[full]] = np.fmax(known[i[full]], score[full])
    # The test may have rejected too many where no bound was known; such queries are scored against all.
    possible = np.full(len(q), len(v)) if asks is None else asks.sum(1)
    short = np.flatnonzero(np.isnan(known) & (np.bincount(i, minlength=len(q)) < np.minimum(need, possible)))
    if len(short):
        rest = ~np.isin(i, short)
        i, j, score = i[rest], j[rest], score[rest]
        for k in short:
            what = np.arange(len(v)) if asks is None else np.flatnonzero(asks[k])
            take(np.full(len(what), k), what)
    return i, j, score


def group_lists(centres: np.ndarray, sizes: np.ndarray, block: int) -> list[list[int]]:
    """The groups of each list. Small lists share a group of about ``block`` vectors with their neighbours; a list above
    ``block`` is dealt over groups of its own."""
    groups: list[list[int]] = [[] for _ in sizes]
    left, n = set(range(len(sizes))), 0
    for k in np.flatnonzero(sizes > block):
        left.discard(int(k))
        parts = -(-int(sizes[k]) // block)
        groups[k] = list(range(n, n + parts))
        n += parts
    rest = sorted(left)
    while rest:
        seed = max(rest, key=lambda k: ((centres[k] - centres[rest].mean(0)) ** 2).sum())
        near = sorted(rest, key=lambda k: ((centres[k] - centres[seed]) ** 2).sum())
        total, taken = 0, []
        for k in near:
            if taken and total + sizes[k] > block:
                break
            taken.append(k)
            total += int(sizes[k])
        for k in taken:
            groups[k] = [n]
        n += 1
        gone = set(taken)
        rest = [k for k in rest if k not in gone]
    return groups


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, probes: float = 0.8, sample_rows: int = 20_000,
    block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of ``queries``, its own id left out.

    Returns query_id, rank (from 1), vec_id and score (the inner product of the original vectors in double precision);
    ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no part
    on either side, nor do null ids and vectors of another length than most. Repeated rows count once; an id with
    several vectors is indexed with each, asked with each, and each has ranks. Fewer than k candidates are all
    returned; without candidates or queries there are no rows. Other columns are ignored.

    Centres are fitted to at most ``sample_rows`` distinct vectors; all vectors are indexed. ``probes`` is the share of
    lists that a query reads, and as many more as it takes to meet enough candidates.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    of = lambda df: df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v")
    ).where(F.col("id").isNotNull() & _valid("v"))
    rows, asked = of(vectors), of(queries)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0]["d"]
    need = k + 1
    # The smallest ids of each distinct vector; the limit by group is applied before the shuffle as well.
    by_vec = Window.partitionBy("v").orderBy("id")
    few = rows.where(F.size("v") == dims).withColumn("r", F.dense_rank().over(by_vec)).where(F.col("r") <= need)
    index = cut(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    most_of = F.array_max(F.transform("v", F.abs))
    norm = most_of * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / most_of) * (x / most_of)))
    n, longest = index.agg(F.count("*"), F.max(norm)).first()
    space = Space(dims, float(longest))
    lists = max(1, min(4096, round(n**0.5 / 4)))
    picked = index.orderBy(F.xxhash64("v"), "v").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    centres = fit_centres(space.stored(picked.flatten().to_numpy().reshape(-1, dims)), lists)
    lists = len(centres)
    shared = spark.sparkContext.broadcast((space, centres))

    def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        return col.flatten().to_numpy().reshape(-1, dims)

    def assign(batches):
        sp, c = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(nearest(sp.stored(matrix(b.column(0))), c, 1)[:, 0].astype(np.int32))],
                    ["v", "ids", "list"]
                )

    placed = cut(index.mapInArrow(assign, "v array<double>, ids array<bigint>, list int"))
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # at most 4096 rows
        sizes[r["list"]] = r["count"]
    most = max(1, int(np.ceil(lists * probes)))
    groups = group_lists(centres, sizes, block)

    # Equal query vectors are asked once. A query goes once to each group in which it probes lists, nearest group first.
    wanted = cut(asked.where(F.size("v") == dims).distinct().withColumn("q", F.xxhash64("v")))
    distinct = wanted.groupBy("q").agg(F.first("v").alias("v"))

    def probe(batches):
        sp, c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            near = nearest(sp.asked(matrix(b.column(1))), c, lists)
            met = np.cumsum(sizes[near], axis=1)
            n_probes = np.maximum(most, (met < need).sum(1) + 1)
            who, which, first, own = [], [], [], []
            for i, (row, m) in enumerate(zip(near.tolist(), n_probes.tolist(), strict=True)):
                met_groups: dict[int, list[int]] = {}
                for x in row[:m]:
                    for g in groups[x]:
                        met_groups.setdefault(g, []).append(x)
                for no, (g, xs) in enumerate(met_groups.items()):
                    who.append(i)
                    which.append(g)
                    first.append(no == 0)
                    own.append(xs)
            taken = pa.array(np.array(who, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(taken), b.column(1).take(taken), pa.array(which, pa.int32()), pa.array(first),
                    pa.array(own, pa.list_(pa.int32()))
                ],
                ["q", "v", "group", "first", "lists"]
            )

    probing = cut(
        distinct.mapInArrow(probe, "q bigint, v array<double>, group int, first boolean, lists array<int>").withColumn(
            "bound", F.lit(None).cast("double")
        )
    )
    of_list = spark.createDataFrame(list(enumerate(groups)), "list int, groups array<int>")  # at most 4096 rows
    stored = placed.join(F.broadcast(of_list), "list").withColumn(
        "group", F.get("groups", F.pmod(F.xxhash64("v"), F.size("groups")).cast("int"))
    ).drop("groups")

    def find(key, x: pa.Table, y: pa.Table) -> pa.Table:
        names = ["q", "ids", "score"]
        if not x.num_rows or not y.num_rows:
            return pa.table(
                [pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.float64())], names
            )
        v, qv = matrix(x["v"]), matrix(y["v"])
        of, of_group = np.unique(x["list"].to_numpy(), return_inverse=True)
        asks = np.zeros((len(qv), len(of)), bool)
        probed = y["lists"].combine_chunks()
        who = np.repeat(np.arange(len(qv)), np.diff(probed.offsets.to_numpy()))
        at = np.searchsorted(of, probed.flatten().to_numpy())
        there = (at < len(of)) & (of[np.minimum(at, len(of) - 1)] == probed.flatten().to_numpy())
        asks[who[there], at[there]] = True
        known = np.array([np.nan if s is None else s for s in y["bound"].to_pylist()], float)
        ids = x["ids"].combine_chunks()
        smallest = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        i, j, score = best_of(v, qv, need, known, smallest, None if asks.all() else asks[:, of_group])
        return pa.table([pa.array(y["q"].to_numpy()[i]), ids.take(pa.array(j)), pa.array(score)], names)

    def searched(asks: DataFrame) -> DataFrame:
        """The best of each query in each of its groups. A group's queries are dealt into parts, so no task has more than
        about ``block`` vectors or queries."""
        parts = cut(
            asks.groupBy("group").count().select("group", F.ceil(F.col("count") / block).cast("int").alias("asks"))
        )
        small = broadcast_if_small(parts)
        left = stored.join(small, "group").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        right = asks.join(small, "group").withColumn("ask", F.pmod(F.hash("q"), F.col("asks")))
        return left.select("group", "ask", "v", "ids", "list").groupBy("group", "ask").cogroup(
            right.select("group", "ask", "q", "v", "lists", "bound").groupBy("group", "ask")
        ).applyInArrow(find, "q bigint, ids array<bigint>, score double")

    first = cut(searched(probing.where("first")))
    bounds = first.groupBy("q").agg(F.min("score").alias("own"), F.count("*").alias("n")).where(F.col("n") >= need)
    others = probing.where("NOT first").drop("bound").join(
        bounds.select("q", F.col("own").alias("bound")), "q", "left"
    )
    hits = first.unionByName(searched(others))
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    top = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= need)
    # The best of each query vector: at most need * need ids, cut to need.
    pairs = F.flatten(
        F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i"))))
    )
    answers = top.groupBy("q").agg(F.slice(F.array_sort(pairs), 1, need).alias("found"))
    own = wanted.select("q", F.col("id").alias("query_id")).join(answers, "q")
    kept = F.slice(F.filter("found", lambda x: x["i"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"),
        (-F.col("x.s")).alias("score")
    )
