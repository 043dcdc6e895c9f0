import hashlib
import re

import numpy as np
import xxhash
from lexispark.llm.fingerprints import PARAGRAPH, as_text, fingerprint_edits, table, with_likeness, with_next
from pyspark.sql import functions as F


def share(a, b):
    a, b = set(re.findall(PARAGRAPH, a)), set(re.findall(PARAGRAPH, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def from_strings(a, b):
    """The likeness of two fingerprints by one who has nothing else: subtract, peel, and count."""

    def read(text):
        n, w, cells = text.split(":")
        rows = [c.split(",") for c in cells.split(".") if c]
        return int(n, 16), int(w, 16), [(int(c, 16), int(k, 16), int(x, 16)) for c, k, x in rows]

    def cell(x, j, w):
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)
        return j * w + (xxhash.xxh64_intdigest(j.to_bytes(4, "little"), h) & (w - 1))

    (na, wa, ca), (nb, wb, cb) = read(a), read(b)
    w = min(wa, wb)
    left = {}
    for sign, own, cells in ((1, wa, ca), (-1, wb, cb)):
        for c, k, x in cells:
            at = c // own * w + c % own % w
            n, y = left.get(at, (0, 0))
            left[at] = n + sign * k, y ^ x
    found, open_ = 0, list(left)
    while open_:
        c = open_.pop()
        n, x = left[c]
        if abs(n) == 1 and c in (own := [cell(x, j, w) for j in range(3)]):
            found += 1
            for at in own:
                m, y = left[at]
                left[at] = m - n, y ^ x
                open_.append(at)
    assert not any(any(v) for v in left.values())
    return (na + nb - found) / (na + nb + found) if na + nb else 1.0


def test_whole_table_against_sets_and_strings(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint_edits(docs).collect()}
    prints = {}
    for k, (i, text) in enumerate(rows):
        after, nxt = rows[(k + 1) % len(rows)]
        n, r = len(text), got[i]
        edited = text[: n - n // 3] + nxt[: n // 3]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - share(text, edited)) < 1e-9 and abs(r["near_next"] - share(text, nxt)) < 1e-9
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(
            edited, r["edited_fingerprint"]
        ) == r["edited_fingerprint"]
        assert abs(r["near_edited"] - from_strings(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
        assert abs(r["near_next"] - from_strings(r["fingerprint"], got[after]["fingerprint"])) < 1e-12
    assert len(got) == len(rows)


def test_next_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("id"), F.col("id").cast("string").alias("text"))
    got = {r["id"]: r["next"]["text"] for r in with_next(df, ["text"], bucket_chars=1).collect()}
    assert got == {i * i: str((i - 1) % 1000) for i in range(1000)}


def test_retries_until_all_is_recovered(spark):
    """Sketches of sets of any sizes: shares, differing digests, and those that a narrow table can't hold."""
    rng = np.random.default_rng(2)
    high = [int(x) << 16 for x in rng.integers(-(1 << 47), 1 << 47, 1200)]
    marked = [
        h | (xxhash.xxh64_intdigest((7).to_bytes(4, "little"), xxhash.xxh64_intdigest((h & (1 << 64) - 1).to_bytes(8, "little"), 42)) & 0xFFFF)
        for h in high
    ]
    pick = lambda i, j: marked[i:j]
    cases = [
        (pick(0, 400), pick(300, 900)), (pick(0, 30), pick(0, 30)), ([], []), ([], pick(300, 900)),
        (pick(0, 5), pick(0, 200)), (pick(0, 1), pick(1, 60)), (pick(0, 33), pick(10, 40)), (pick(0, 1200), pick(1, 1200))
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], "k int, a array<bigint>, b array<bigint>")
    made = df.select("k", table(F.col("a")).alias("a"), table(F.col("b")).alias("b"))
    rows = with_likeness(made, "a", "b", "near").select(
        "k", "near", as_text(F.col("a")).alias("ta"), as_text(F.col("b")).alias("tb")
    ).collect()
    for r in rows:
        a, b = map(set, cases[r["k"]])
        assert r["near"] == from_strings(r["ta"], r["tb"]) == (len(a & b) / len(a | b) if a | b else 1.0)
    # of very unequal sketches the least number that fits is taken
    df = spark.createDataFrame([(pick(0, 2), pick(2, 1200) * 1)], "a array<bigint>, b array<bigint>")
    near = with_likeness(df.select(table(F.col("a")).alias("a"), table(F.col("b")).alias("b")), "a", "b", "near")
    assert near.first()["near"] <= 2 / 1198


def test_odd_rows(spark, odd, none):
    got = fingerprint_edits(odd).collect()
    assert len(got) == 10 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_chars"] == by[4]["n_chars"] == 0 and by[3]["fingerprint"] == by[4]["fingerprint"]
    assert by[3]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    assert fingerprint_edits(none).count() == 0
    one = fingerprint_edits(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0


def test_a_very_long_text(spark):
    """A text of a million characters beside a short one."""
    rng = np.random.default_rng(4)
    long = " ".join(map(str, rng.integers(0, 10**6, 150_000)))
    df = spark.createDataFrame([(2, long), (1, "a short text")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fingerprint_edits(df).collect()}
    assert abs(got[2]["near_edited"] - share(long, long[: len(long) - len(long) // 3] + "a short text")) < 1e-9
    assert got[1]["near_next"] < 0.001
