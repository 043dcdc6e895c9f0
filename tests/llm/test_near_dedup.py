from itertools import pairwise

import numpy as np

from lexispark.llm.near_dedup import Shingler, _star_links, components, keep_one, linked, near_duplicates, signatures


def sets_of(rows):
    out = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        out[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def brute(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = sets_of(rows)
    want = brute(sets)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_whole_table_against_brute_force(docs):
    check(docs)


def test_chains_and_clusters_of_near_copies(spark):
    """Copies with a growing number of edits: a centre links few of them, so the rest is found inside the cluster."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.choice(300, rng.integers(0, 12), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r["doc_id"]: r for r in got}
    assert [
        (by[i]["component_id"], by[i]["kept"]) for i in (1, 2, 3, 4, 6)
    ] == [(1, True), (1, False), (3, True), (4, True), (6, True)]
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[6]["n_shingles"] == 0
    assert by[5]["component_id"] == 5 and by[5]["n_shingles"] == 1 and not by[None]["kept"]
    assert near_duplicates(none).count() == 0
    kept = keep_one(odd)
    # of two equal rows one stays, and a row without an id gives way to its copy with one
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_a_near_copy_without_an_id(spark):
    words = [f"w{k}" for k in range(100)]
    rows = [(None, " ".join(words)), (3, " ".join(words[:-1] + ["x"])), (3, "some other text of more than five words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_duplicates(df).collect()
    assert sorted((r["component_id"], r["kept"]) for r in got) == [(3, False), (3, True), (3, True)]
    assert sorted(r["text"][:4] for r in keep_one(df).collect()) == ["some", "w0 w"]


def test_one_row_of_each_class_stays(spark):
    """Copies that share ids, have none, or are the same row again."""
    text = " ".join(f"w{k}" for k in range(60))
    near, far = text + " x", "quite another text of seven words"
    rows = [(None, text), (None, text), (None, near), (4, near), (4, near), (4, text), (4, far), (9, far), (None, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, len(r["text"])) for r in keep_one(df).collect())
    assert [g for g in got if g[1]] in ([(4, len(far)), (4, len(text))], [(4, len(far)), (4, len(near))])
    assert sum(not g[1] for g in got) == 2
    assert keep_one(df.where("doc_id IS NULL AND text != ''")).count() == 1


def test_hot_centre_is_dealt_into_blocks(spark):
    """More partners of one centre than a block has, with small blocks."""
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 1 << 62, 200))
    sets = [(0, [int(x) for x in base])]
    for k in range(1, 300):
        own = base.copy()
        own[: k % 40] = rng.integers(0, 1 << 62, k % 40)
        sets.append((k, [int(x) for x in np.sort(own)]))
    df = spark.createDataFrame(sets, "node bigint, set array<bigint>")
    pairs = spark.createDataFrame([(0, 200, k, 200) for k in range(1, 300)], "a bigint, na bigint, b bigint, nb bigint")
    got = {(r["a"], r["b"]) for r in _star_links(pairs, df, 85, rows=16).collect()}
    alike = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    assert got == {(0, k) for k in range(1, 300) if alike(set(sets[0][1]), set(sets[k][1]))} and 100 < len(got) < 299


def test_components(spark):
    path = [(a, b) for a, b in pairwise([9, 4, 7, 1, 8, 30, 2])] + [(50, 51)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys([9, 4, 7, 1, 8, 30, 2], 1), 50: 50, 51: 50}


def test_signatures_estimate_similarity():
    """Bands of equal sets are equal; those of sets with similarity s agree about as often as s to the sixth."""
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        every = rng.integers(0, 1 << 63, 1100, dtype=np.uint64)
        a, b = signatures([np.sort(every[:1050]), np.sort(every[50:])])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - (1000 / 1100) ** 6) < 0.05
    x = Shingler()("a b c d e f g")
    assert (signatures([x])[0] == signatures([x])[0]).all() and len(x) == 3


def test_links_join_labels_once():
    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(50, 150, dtype=np.uint64)]
    found = linked(sets, np.array([0, 1, 2]), np.zeros(3, int), 85)
    assert found == [(0, 1)]
    assert linked(sets, np.array([0, 0, 2]), np.zeros(3, int), 85) == []
