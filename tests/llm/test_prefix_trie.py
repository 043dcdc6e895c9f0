"""The prefix trie against one made by plain loops."""

import collections
import hashlib
import random
import zlib

import pytest

from lexispark.llm.prefix_trie import Stitch, Sweep, common, conversation_trie, trie, turn_keys


def brute(rows):
    """Nodes of (conv_id, turn, role, text) rows."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append(((turn is not None, turn or 0, key), (role, text)))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    return nodes(made, lambda t: len(t[1]))


def nodes(made, length):
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(m) - 1) * (length(p[-1]) if p else 0) + sum(saved[k] for k in kids[p])
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out.append(
            (
                min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                hashlib.sha256(ends.encode()).hexdigest()
            )
        )
    return sorted(out, key=repr)


def key(t):
    return hashlib.md5(t.encode()).hexdigest()


def sweep_parts(made, cuts):
    """The sweep and the stitch over sequences cut into partitions at the given places."""
    rows = sorted(("".join(map(key, t)), c, [len(x) for x in t]) for c, t in made.items())
    out, border = [], []
    for p, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        sweep = Sweep(p)
        for k, c, lengths in rows[lo:hi]:
            sweep.add(c, k, lengths)
        sweep.end()
        out += [r for r in sweep.out if r[0] < 2]
        border += [r for r in sweep.out if r[0] >= 2]
    stitch = Stitch()
    for r in sorted(border, key=lambda r: (r[1], r[2], r[3], r[0], r[4])):
        stitch.add(r[0], r[1], r[2], r[3], [r[5], *r[8:12]], *r[13:16])
    stitch.pop(0)
    known = {tuple(r[1:4]): r[5] for r in stitch.out if r[0] == 4}
    found = [tuple(r[5:13]) for r in [*out, *stitch.out] if r[0] == 0]
    found += [(*r[5:7], known[tuple(r[1:4])], *r[8:13]) for r in out if r[0] == 1]
    return sorted(found, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_any_partitions(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(1, 14)
        made = {c: tuple(rng.choices("aab", k=rng.randrange(5))) for c in rng.sample(range(100), n)}
        cuts = sorted(rng.randrange(n + 1) for _ in range(rng.randrange(5)))
        assert sweep_parts(made, cuts) == nodes(made, len)


def test_common_turns():
    a, b = key("a"), key("b")
    assert [common(x, y) for x, y in ((a, a), (a, a + b), (a + b, a + a), (a, b), ("", a), (a * 9 + b, a * 10))] == [1, 1, 1, 0, 0, 9]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_whole_table(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    want = brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(map(tuple, conversation_trie(turns).collect()), key=repr) == want


def test_odd_rows(spark):
    long = "ü" * 200_000
    rows = [
        (0, 1, "user", "hi"), (0, None, "system", "be"), (0, 2, None, None), (0, 3, "user", long), (1, 1, "user", "own"),
        (1, 1, "user", "own"), (1, 1, "a", "tie"), (2, None, None, None), (None, 1, "user", "hi"), (-3, 0, "user", "neg"),
        (-100, 5, "user", "base"), (-100, 6, "user", "b2"), (300, 0, "user", ""), (301, 0, "us", "er"), (302, 0, "user", "er"),
        (407, 0, "user", "x"), (405, 0, "user", "x"), (405, 9, "user", "y")
    ]
    turns = conversations(spark, rows).selectExpr("*", "1 AS part", "2 AS depth", "3 AS keys", "4 AS n", "5 AS base", "6 AS h")
    assert sorted(map(tuple, conversation_trie(turns).collect()), key=repr) == brute(rows)
    assert conversation_trie(turns.where("false")).count() == 0
    assert turn_keys(turns.where("conv_id IS NULL")).count() == 0


def test_many_equal_conversations(spark):
    """A conversation that most share is spread over partitions and put together again."""
    rows = [(1000 * k, t, "user", f"t{t}") for k in range(400) for t in range(3)]
    rows += [(1000 * k + 500, 0, "user", f"own {k % 7}") for k in range(100)]
    turns = conversations(spark, rows)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(map(tuple, conversation_trie(turns).collect()), key=repr) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_turnless_sequences(spark):
    df = spark.createDataFrame([(5, [], []), (2, [], [])], "conv_id bigint, keys array<string>, lengths array<bigint>")
    ends = hashlib.sha256(b"2,5").hexdigest()
    assert [tuple(r) for r in trie(df).collect()] == [(2, 0, None, 2, 0, 1, 0, ends)]
