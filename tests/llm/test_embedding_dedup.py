"""Embedding near-duplicates against all pairs, and the graph's recall."""

import numpy as np
import pytest

from lexispark.llm import hnsw
from lexispark.llm.embedding_dedup import embedding_duplicates, unit


def brute(rows, least=0.95):
    """(id, n_links, component_id, kept) of (id, vector) rows by all pairs."""
    ok = [
        k for k, (_, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            if len(rows[a][1]) == len(rows[b][1]):
                x, y = (unit(np.array([rows[k][1]], np.float64))[0] for k in (a, b))
                if float(x @ y) >= least:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        first = min(ids, default=None)
        out.append((i, links[k], first, i == first))
    return sorted(out, key=repr)


def clustered(n, dims, groups, size, noise, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for g in range(groups):
        centre = rng.normal(size=dims)
        at = rng.choice(n, size, replace=False)
        x[at] = centre + noise * rng.normal(size=(size, dims))
    return x.astype(np.float32)


@pytest.mark.parametrize("dims,noise,shards", [(64, 0.1, 3), (8, 0.2, 2), (2, 0.3, 1)])
def test_against_all_pairs(spark, dims, noise, shards):
    x = clustered(260, dims, 6, 25, noise, dims)
    x[200:210] = x[3]  # copies
    x[210] = 7 * x[3]  # the same direction
    rows = [(int(k) * 3 % 263, [float(c) for c in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = embedding_duplicates(df, shards=shards)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1e200, 1e199]), (3, [1e-200, 1e-201]), (4, [0.0, 0.0]), (5, None), (6, []),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [0.0, 1.0]), (10, [-0.0, 2.0]), (11, [1.0, 0.0, 0.0]),
        (12, [2.0, 0.0, 0.1]), (None, [-1.0, 0.0]), (0, [0.3]), (13, [-1.0, -1.0]), (13, [1.0, -1.0])
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr(
        "*", "1 AS node", "2 AS v", "3 AS id", "true AS ok", "4 AS links", "5 AS component"
    )
    got = sorted(map(tuple, embedding_duplicates(df, shards=2).collect()), key=repr)
    assert got == brute(rows)
    assert embedding_duplicates(df.where("false")).count() == 0


def test_one_large_group(spark):
    """Hundreds of near copies and of equal vectors: every link counts, nothing is capped."""
    x = clustered(700, 16, 1, 400, 0.05, 5)
    x[500:560] = x[499]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_duplicates(df, shards=3).collect()}
    u = unit(x)
    links = (u @ u.T >= 0.95).sum(1) - 1
    assert [got[k]["n_links"] for k in range(700)] == links.tolist()
    assert max(links) > 300


def test_recall_of_a_shard():
    x = clustered(3000, 32, 20, 30, 0.15, 1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.build(x)
    beam = hnsw.audited_beam(graph, 0.95)
    assert hnsw.audit(graph, beam, 0.95) >= 0.99
    found = {(int(i), int(j)) for a, b in graph.near(x, beam, 0.95) for i, j in zip(a, b, strict=True)}
    s = x @ x.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.95), strict=True)}
    assert len(found & want) >= 0.99 * len(want) and all(s[i, j] >= 0.9499 for i, j in found)


def test_beam_widens_until_it_passes():
    """A graph with hardly any links fails its audit with a small beam; the last resort is the whole ground."""
    x = clustered(400, 16, 0, 0, 0, 3)
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.build(x, links=2, beam=2)
    beam = hnsw.audited_beam(graph, 0.95, recall=1.1, start=4)
    assert beam == 400


def test_small_graphs():
    for n in (1, 2, 3, 17):
        x = unit(np.random.default_rng(n).normal(size=(n, 5))).astype(np.float32)
        graph = hnsw.build(x)
        pairs = [(int(i), int(j)) for a, b in graph.near(x, 32, -2.0) for i, j in zip(a, b, strict=True)]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(n)]
