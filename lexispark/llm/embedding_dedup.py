"""Near-duplicate embeddings by small-world graphs.

Distinct vectors are dealt to shards by hash, and a hierarchical navigable small-world graph is built over each shard in
one task. Every pair of shards meets in one task, where the vectors of the one are searched in the graph of the other (a
shard meets itself as well), so each pair of vectors is decided by one search and a link counts alike at both ends. The
beam of a shard is widened until an audit against all its vectors passes. What a search finds is verified by cosine in
double precision; tasks give counts and local components, never pairs, and components are united over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.ann_search import _valid
from lexispark.llm.common import broadcast_if_small, cut, small_batches
from lexispark.llm.hnsw import Graph, audited_beam, build
from lexispark.llm.near_dedup import components


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, whatever their size."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(1))[:, None]


def shard_rows(t: pa.Table, least: float, recall: float) -> pa.Table:
    """A shard's vectors with their places, links (a list for each layer, from the ground) and the shard's beam."""
    dims = t["d"][0].as_py()
    t = t.sort_by("node")
    graph = build(unit(_matrix(t["v"], dims)).astype(np.float32))
    beam = audited_beam(graph, least, recall)
    links: list[list[list[int]]] = [[] for _ in range(t.num_rows)]
    for rows, near in zip(graph.members, graph.links, strict=True):
        for r, own in zip(rows.tolist(), near, strict=True):
            links[r].append(rows[own[own >= 0]].tolist())
    n = t.num_rows
    return t.append_column("place", pa.array(np.arange(n, dtype=np.int32))).append_column(
        "beam", pa.array(np.full(n, beam, np.int32))
    ).append_column("links", pa.array(links, pa.list_(pa.list_(pa.int32()))))


def _graph(t: pa.Table, x: np.ndarray) -> Graph:
    """The graph that ``shard_rows`` has written, of rows in their places."""
    per_row = t["links"].combine_chunks()
    depth = np.diff(per_row.offsets.to_numpy())
    per_layer = per_row.flatten()
    lengths = np.diff(per_layer.offsets.to_numpy())
    values, ends = per_layer.flatten().to_numpy(), np.cumsum(lengths)
    first = np.cumsum(depth) - depth
    members, links = [], []
    for layer in range(int(depth.max())):
        rows = np.flatnonzero(depth > layer).astype(np.int32)
        at = first[rows] + layer
        n = lengths[at]
        own = np.full((len(rows), max(1, int(n.max()))), -1, np.int32)
        line = np.repeat(np.arange(len(rows)), n)
        slot = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.full(len(x), -1, np.int32)
        place[rows] = np.arange(len(rows), dtype=np.int32)
        own[line, slot] = place[values[np.repeat(ends[at] - n, n) + slot]]
        members.append(rows)
        links.append(own)
    return Graph(x, members, links)


class _Local:
    """Components of what one task has linked."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            while True:
                further = new[new]
                if (further == new).all():
                    break
                new = further
            self.label = label = new[label]
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]


def link_shards(t: pa.Table, least: float) -> pa.Table:
    """(node, links, root) of the vectors that are linked between two shards, or inside one: how many vectors a node is
    linked with here, copies counted, and the smallest place of its component as a node."""
    dims = t["d"][0].as_py()
    t = t.sort_by([("shard", "ascending"), ("place", "ascending")])
    shard = t["shard"].to_numpy()
    node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
    exact = unit(_matrix(t["v"], dims))
    x = exact.astype(np.float32)
    cut_at = int(np.searchsorted(shard, shard[0], side="right"))
    one = cut_at == len(shard)
    # Which side asks alternates, so that no shard's graph is read more than the others.
    low_asks = one or (int(shard[0]) + int(shard[-1])) % 2 == 0
    asked, base = (slice(0, cut_at), 0) if one or not low_asks else (slice(cut_at, len(shard)), cut_at)
    asks, first = (slice(0, cut_at), 0) if low_asks else (slice(cut_at, len(shard)), cut_at)
    graph, beam = _graph(t.slice(base, asked.stop - asked.start), x[asked]), t["beam"][base].as_py()
    links, local = np.zeros(len(node), np.int64), _Local(len(node))
    for lo in range(first, asks.stop, 1024):
        own = slice(lo, min(lo + 1024, asks.stop))
        for i, j in graph.near(x[own], beam, least - 1e-4):
            i, j = i + lo, j + base
            if one:  # each pair once
                i, j = i[j < i], j[j < i]
            ok = np.zeros(len(i), bool)
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                ok[at : at + (1 << 16)] = np.einsum("ij,ij->i", exact[a], exact[b]) >= least
            i, j = i[ok], j[ok]
            links += np.bincount(i, copies[j], len(node)).astype(np.int64)
            links += np.bincount(j, copies[i], len(node)).astype(np.int64)
            local.join(i, j)
    met = np.flatnonzero(links)
    return pa.table({"node": node[met], "links": links[met], "root": node[local.label[met]]})


def embedding_duplicates(
    vectors: DataFrame, least: float = 0.95, recall: float = 0.99, shard: int = 1 << 18, shards: int = 8,
    id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Classes of vectors linked by a cosine of ``least`` or more, in double precision.

    A row per input row: id, n_links (other rows linked with it directly), component_id (the smallest id reachable by
    links, its own included), kept (id = component_id). Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing and are kept, as are vectors of another length for each other. Repeated rows and equal
    vectors are rows of their own, linked with each other; null ids give way to others, and are kept only if all ids of
    their component are null. No rows give no rows. Other columns are ignored.

    ``shards`` is the least number of shards of each length, ``shard`` the most vectors of one; ``recall`` is what a
    shard's audit has to reach. The work is that of searching every vector in half of the shards.
    """
    small_batches(vectors.sparkSession, 4096)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), _valid(vec_col).alias("ok"))
    kind = vectors.schema[vec_col].dataType.simpleString()
    grouped = rows.where("ok").groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    # Numbered once, then written: what reads them again sees the same numbers.
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")))
    sizes = nodes.groupBy("d").agg(
        F.greatest(F.lit(shards), F.ceil(F.count("*") / shard)).cast("int").alias("shards")
    )
    placed = nodes.join(broadcast_if_small(cut(sizes), 1000), "d").withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    )
    own = f"d int, shard int, shards int, node bigint, copies bigint, v {kind}"
    names = [f.split()[0] for f in own.split(", ")]
    built = cut(
        placed.select(*names).groupBy("d", "shard").applyInArrow(
            lambda t: shard_rows(t, least, recall), f"{own}, place int, beam int, links array<array<int>>"
        )
    )

    def ends(f: Column, other: Column) -> Column:
        return f(F.col("shard"), other).cast("int")

    pairs = built.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumns(
        {"low": ends(F.least, F.col("other")), "high": ends(F.greatest, F.col("other"))}
    )
    found = cut(
        pairs.select("d", "low", "high", "shard", "place", "node", "copies", "v", "beam", "links")
        .groupBy("d", "low", "high").applyInArrow(
            lambda t: link_shards(t, least), "node bigint, links bigint, root bigint"
        )
    )
    labels = cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_label = nodes.select("node", "least").join(labels, "node").groupBy("label").agg(F.min("least").alias("component"))
    placed_in = labels.join(broadcast_if_small(cut(of_label)), "label").select("node", "component")
    known = nodes.join(counted, "node", "left").join(placed_in, "node", "left").where("copies > 1 OR links > 0").select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.coalesce("component", "least").alias("component")
    )
    known = broadcast_if_small(cut(known.withColumn("known", F.lit(True))), 20_000)
    out = rows.withColumn("v", F.when(F.col("ok"), F.col("v"))).join(known, "v", "left")
    component = F.when(F.col("known"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
