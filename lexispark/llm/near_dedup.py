"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature takes
half the hash evaluations of plain min-hashing. Bands of the signature find candidates; each candidate pair is then
confirmed on the full shingle sets; confirmed links are closed into components.

Documents with equal shingle sets are one node from the start (one pre-aggregated shuffle), however many there are.
Within a bucket of nodes the smallest is compared with every other. Buckets that share nodes form clusters. Only where the links found so far leave
a cluster in several components are the pairs between these compared as well, inside blocks of bounded size, so no
link between components is lost and no pairs are sent around.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import broadcast_if_small, cut, small_batches

WORDS = 5
BANDS, MINS, MAXS = 28, 3, 3
_MOST_WORDS = 200_000
#: Shingles that are compared at once, and bytes of a batch on its way to Python: sets of long texts are large.
_VALUES, _BATCH_BYTES = 1 << 19, 8 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes; keeps the hashes of words seen lately."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.hash, self.words, self.at = xxhash.xxh3_64_intdigest, words, _constants(words, 17)
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode().lower().split()  # on bytes both know ASCII only
        if not found:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _MOST_WORDS:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = self.words
        if len(h) < k:
            return _mix(np.array([(h * self.at[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
        n = len(h) - k + 1
        out = h[:n] * self.at[0]
        for j in range(1, k):
            out += h[j : j + n] * self.at[j]
        return np.unique(_mix(out))


def signatures(sets: list[np.ndarray], bands: int = BANDS, mins: int = MINS, maxs: int = MAXS) -> np.ndarray:
    """Band hashes, a row per set. A band joins the minima of some permutations with the maxima of others."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), bands), np.uint64)
    if not len(full):
        return out
    every = np.concatenate([sets[k] for k in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    each = max(mins, maxs)
    flip, turn = _constants(bands * each, 101), _constants(bands * each, 202)
    weight = _constants(mins + maxs, 303)
    own = np.zeros((len(full), bands), np.uint64)
    for b in range(bands):
        for j in range(each):
            p = b * each + j
            v = (every ^ flip[p]) * turn[p]
            v = (v ^ (v >> np.uint64(31))) * turn[-1 - p]
            if j < mins:
                own[:, b] += np.minimum.reduceat(v, starts) * weight[j]
            if j < maxs:  # the maxima go to the next band, so no band holds both ends of one permutation
                own[:, (b + 1) % bands] += np.maximum.reduceat(v, starts) * weight[mins + j]
    out[full] = _mix(own ^ _constants(bands, 404)[None, :])
    return out


_FEATURES = "id {kind}, mark bigint, n_shingles bigint, node bigint, bands array<bigint>"


def features(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """Set size, node (a 64-bit digest of the shingle set) and band hashes of each (id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sets = [shingle(t) for t in part.column(1).to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                node = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
                sig = signatures(sets, n_bands).view(np.int64)
                bands = pa.FixedSizeListArray.from_arrays(
                    pa.array(sig.ravel()), sig.shape[1]
                ).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array(node), bands],
                    ["id", "mark", "n_shingles", "node", "bands"]
                )

    return docs.mapInArrow(run, _FEATURES.format(kind=docs.schema["id"].dataType.simpleString()))


def _digest(s: np.ndarray) -> int:
    return int(_mix(np.array([_mix(s * np.uint64(3)).sum() + np.uint64(len(s))], np.uint64))[0])


def _sets(docs: DataFrame) -> DataFrame:
    """(node, set) of each (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                sets = [shingle(t) for t in b.slice(at, 128).column(1).to_pylist()]
                node = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "set"]
                )

    return docs.mapInArrow(run, "node bigint, set array<bigint>")


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (a, block, whole, node, set) that come sorted: each (a, block) begins with the set of a itself."""
    at, centre = None, np.zeros(0, np.uint64)
    for b in batches:
        keys = np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
        lists, nodes = b.column(4), b.column(3).to_numpy()
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        values = lists.flatten().to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        found_a, found_b = [], []
        for i, j in zip([0, *starts], [*starts, len(keys)], strict=True):
            key = (int(keys[i, 0]), int(keys[i, 1]))
            if key != at:
                at, centre, i = key, values[ends[i] : ends[i + 1]], i + 1
            if i == j:
                continue
            own = values[ends[i] : ends[j]]
            hit = np.empty(len(own), bool)
            for lo in range(0, len(own), _VALUES):
                part = own[lo : lo + _VALUES]
                hit[lo : lo + _VALUES] = centre[np.minimum(np.searchsorted(centre, part), len(centre) - 1)] == part
            common = np.add.reduceat(hit, ends[i:j] - ends[i], dtype=np.int64)
            n = np.diff(ends[i : j + 1])
            ok = 100 * common >= percent * (len(centre) + n - common)
            found_b.append(nodes[i:j][ok])
            found_a.append(np.full(int(ok.sum()), key[0]))
        centre = centre.copy()  # the batch may go
        if found_a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"]
            )


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int, rows: int = 2048) -> DataFrame:
    """Those of the pairs (a, na, b, nb) whose full sets are similar enough, as (a, b).

    A centre's partners are dealt into blocks of about ``rows``. Its set goes to each block once, a partner's set to
    its place in each of its centres' blocks, and a task reads them as a stream that holds one centre's set.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    partners = pairs.select("a", "b").join(blocks, "a").select(
        "a", F.pmod(F.xxhash64("b", F.lit(6)), "blocks").cast("int").alias("block"), F.lit(0).alias("whole"),
        F.col("b").alias("node")
    )
    centres = blocks.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("whole"),
        F.col("a").alias("node")
    )
    dealt = partners.unionByName(centres).join(sets.select("node", "set"), "node")
    placed = dealt.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("whole"))
    return cut(
        placed.select("a", "block", "whole", "node", "set").mapInArrow(
            lambda batches: _alike(batches, percent), "a bigint, b bigint"
        )
    )


def linked(
    sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, percent: int, columns: int = 8192
) -> list[tuple[int, int]]:
    """Links that join different labels, between rows whose sides differ or are both 0; enough of them to join all that are linked.

    The intersections come from products of 0/1 matrices over the shingles that at least two rows share, a block of
    columns at a time.
    """
    n = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[at] > 1
    column = (np.cumsum(often > 1) - 1)[at[shared]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [lo, lo + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        common += m @ m.T
    ok = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    ok &= (labels[:, None] != labels[None, :]) & ((side[:, None] == 0) | (side[:, None] != side[None, :]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for a, b in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        x, y = find(int(labels[a])), find(int(labels[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a), int(b)))
    return out


def _block_links(members: DataFrame, percent: int, rows: int = 256, weight: int = 1_000_000) -> DataFrame:
    """Links between labels within clusters, of members (cluster, node, n, label, set).

    A cluster's commonest label is dealt into blocks, the other nodes into blocks of their own; each of these meets
    itself, the others and each block of the commonest label. A block has about ``rows`` nodes and ``weight`` shingles.
    """
    light = members.select("cluster", "node", "n", "label")
    by_label = light.groupBy("cluster", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    whole = by_label.groupBy("cluster").agg(
        F.max_by(
            "label", F.struct("rows", "label")
        ).alias("main"), F.max_by("rows", F.struct("rows", "label")).alias("mr"), F.max_by(
            "weight", F.struct("rows", "label")
        ).alias("mw"),
        F.sum("rows").alias("rows"), F.sum("weight").alias("weight"),
    )
    parts = lambda r, w: F.ceil(F.greatest(r / F.lit(rows), w / F.lit(weight), F.lit(1.0))).cast("int")
    # sizes of clusters with more than one label and more than the pair that the star has compared
    sizes = whole.where("rows > mr and rows > 2").select(
        "cluster", "main", parts(F.col("mr"), F.col("mw")).alias("of_main"),
        parts(F.col("rows") - F.col("mr"), F.col("weight") - F.col("mw")).alias("of_rest")
    )
    dealt = members.join(broadcast_if_small(cut(sizes)), "cluster").withColumns(
        {"in_main": F.col("label") == F.col("main"), "h": F.xxhash64("node", F.lit(5))}
    )
    dealt = dealt.withColumn(
        "block", F.pmod("h", F.when(F.col("in_main"), F.col("of_main")).otherwise(F.col("of_rest"))).cast("int")
    )
    rest = F.sequence(F.lit(0), F.col("of_rest") - 1)
    meets = F.when(
        F.col("in_main"),
        F.transform(rest, lambda k: F.struct(k.alias("i"), (-1 - F.col("block")).alias("j"), F.lit(2).alias("side")))
    ).otherwise(
        F.concat(
            F.transform(
                F.sequence(F.lit(0), F.col("of_main") - 1),
                lambda k: F.struct(F.col("block").alias("i"), (-1 - k).alias("j"), F.lit(1).alias("side"))
            ),
            F.transform(
                rest,
                lambda k: F.struct(
                    F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"),
                    F.when(k == F.col("block"), 0).when(k < F.col("block"), 2).otherwise(1).alias("side")
                )
            ),
        )
    )
    tasks = dealt.select(
        "cluster", "node", "label", "set", F.explode(meets).alias("m")
    ).select("cluster", "m.i", "m.j", "m.side", "node", "label", "set")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node = t["node"].to_numpy()
        found = linked([s.values.to_numpy() for s in t["set"]], t["label"].to_numpy(), t["side"].to_numpy(), percent)
        return pa.table(
            {
                "a": pa.array([int(node[i]) for i, _ in found], pa.int64()),
                "b": pa.array([int(node[j]) for _, j in found], pa.int64())
            }
        )

    return cut(tasks.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint"))


def components(edges: DataFrame, rows_a_part: int = 100_000) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the smallest node reachable.

    Alternates the large-star and small-star steps; each halves the depth or better and keeps no more edges than there
    were. What stays is a star around each smallest node. The edges are few against the documents, so what a step
    shuffles is gathered into as many parts as ``rows_a_part`` asks for.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    n = now.count()
    parts = n // rows_a_part + 1
    now = now.coalesce(parts)
    while True:
        both = now.select("u", "v").unionByName(
            now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        ).coalesce(parts)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts)
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u != v").coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        joined = large.join(low, "u").coalesce(parts)
        small = joined.select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").coalesce(parts).distinct()
        nxt = cut(small.coalesce(parts))
        size = nxt.count()
        if size == n and nxt.exceptAll(now).isEmpty():
            ends = F.array(
                F.struct(F.col("u").alias("node"), F.col("v").alias("label")),
                F.struct(F.col("v").alias("node"), F.col("v").alias("label"))
            )
            return nxt.select(F.explode(ends).alias("e")).select("e.node", "e.label").distinct()
        now, n = nxt, size


def bands_for(percent: int) -> int:
    """Enough bands to miss a pair at the threshold with a probability of about 2e-6: 28 at 85, 44 at 80."""
    agree = min(percent / 100, 0.999) ** (MINS + MAXS)
    return max(BANDS, math.ceil(math.log(2e-6) / math.log(1 - agree)))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark): mark is a digest of the text, which tells rows of one id apart."""
    small_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def classify(own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, mark, n_shingles, node) of documents (id, text, mark), and (node, label) of linked nodes.

    Nodes without a label are linked with no other node.
    """
    rows = cut(features(own, bands_for(percent)))
    nodes = cut(
        rows.where("n_shingles > 0").groupBy("node").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        )
    )
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1")
    # The bucket's members, once: 16 bytes and the centre for each band in which a node is not alone.
    members = cut(banded.join(shared, "band"))
    size_ok = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = cut(
        members.where("node != centre")
        .select(F.col("centre").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb"))
        .distinct()
        .join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
    )
    clusters = cut(components(star.select("a", "b"))).withColumnRenamed("label", "cluster")
    wanted = cut(clusters.join(nodes, "node").select(F.col("id").alias("wanted")).distinct())
    texts = own.join(broadcast_if_small(wanted), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = cut(
        _sets(texts).join(clusters, "node").groupBy("node").agg(
            F.first("set").alias("set"), F.first("cluster").alias("cluster")
        )
    )
    links = _star_links(star.where(size_ok(F.col("na"), F.col("nb"))), sets, percent)
    labels = cut(components(links))
    # Clusters of candidates that these links leave in several components: the other pairs between components.
    labelled = sets.join(labels, "node", "left").select(
        "cluster", "node", F.size("set").alias("n"), F.coalesce("label", "node").alias("label"), "set"
    )
    more = _block_links(labelled, percent)
    if not more.isEmpty():
        labels = cut(components(links.unionByName(more)))
    return rows, labels


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose sets of 5-word shingles are linked by a Jaccard similarity of ``percent`` or more.

    A row per input row: id, n_shingles, component_id (the smallest id reachable over links, its own included), kept
    (id = component_id). Words are ASCII-lower-cased runs without ASCII white space; a text of fewer than five words
    is one shingle. Null texts and texts without words have no shingles, stand alone and are kept. Rows with equal ids
    and texts share one fate; a null id is kept only if all ids of its component are null. Texts of any length are
    read whole; a text's set has to fit in a worker's memory. No rows give no rows. Other columns are left out.

    Candidates come from bands, more of them for a lower ``percent``, so a pair at the threshold itself is missed with
    a probability of about 2e-6 and more similar ones with less; what is linked is confirmed on full sets. Nodes are
    64-bit digests of sets.
    """
    rows, labels = classify(_marked(docs, id_col, text_col), percent)
    placed = rows.where("n_shingles > 0").select("node", "id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    least = placed.groupBy("label").agg(F.min("id").alias("component_id"))
    by_node = labels.join(least, "label", "right").select(F.coalesce("node", "label").alias("node"), "component_id")
    out = rows.select("id", "n_shingles", "node").join(by_node, "node", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    )
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate class, with all its columns.

    It is the row with the smallest id, null ids last, then the smallest digest of the text; of rows that have both in
    common any one stays. Rows without words stand alone and all stay.
    """
    rows, labels = classify(_marked(docs, id_col, text_col), percent)
    keyed = rows.where("n_shingles > 0").groupBy("id", "mark", "node").agg(F.count("*").alias("copies"))
    placed = keyed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark"))
    winners = placed.groupBy("label").agg(first.alias("w"), F.count("*").alias("rivals"), F.sum("copies").alias("all"))
    several = winners.where("all > 1")
    lost = cut(
        placed.join(several.where("rivals > 1"), "label").where(
            ~(F.col("id").eqNullSafe(F.col("w.id")) & (F.col("mark") == F.col("w.mark")))
        ).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
    )
    repeated = cut(
        placed.where("copies > 1").join(several, "label").where(
            F.col("id").eqNullSafe(F.col("w.id")) & (F.col("mark") == F.col("w.mark"))
        ).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
    )
    # The row travels in one column, so that its names can't meet those used here.
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__own"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__hash")
    )
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__mark"))
    left = whole.join(broadcast_if_small(lost), same, "left_anti")
    if repeated.isEmpty():
        return left.select("__row.*")
    twice = broadcast_if_small(repeated)
    one = left.join(twice, same, "left_semi").groupBy("__own", "__hash").agg(F.first("__row").alias("__row"))
    return left.join(twice, same, "left_anti").select("__row").unionByName(one.select("__row")).select("__row.*")
