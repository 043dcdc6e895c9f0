import math

import pytest

from lexispark.llm.mixing import mix_sources
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "big" if i % 3 else f"s{i % 9}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def totals(df):
    return {
        r["source"]: r["t"] for r in df.groupBy("source").agg({"mix_tokens": "sum"}).withColumnRenamed(
            "sum(mix_tokens)", "t"
        ).collect()
    }


def sizes(df):
    out = {}
    for r in df.collect():
        out[r["source"]] = out.get(r["source"], 0) + len(r["text"].split())
    return out


def test_repetition_limit(skewed):
    mix = mix_sources(skewed, repetition=2.0)
    own, got = sizes(skewed), totals(mix.rows)
    times = {s: got[s] / own[s] for s in own}
    assert abs(max(times.values()) - 2.0) < 0.01 and min(times.values()) == 1.0
    assert mix.rows.select("doc_id").distinct().count() == 3000
    top = max(own.values())
    want = 1 - math.log(2) / math.log(top / min(own.values()))
    assert abs(mix.exponent - want) < 1e-6


def test_entropy_and_budget(skewed):
    target = 0.95 * math.log(4)
    mix = mix_sources(skewed, entropy=target, budget=10_000, block_tokens=256)
    got = totals(mix.rows)
    all_ = sum(got.values())
    assert 0.97 * 10_000 < all_ <= 10_000
    assert abs(-sum(v / all_ * math.log(v / all_) for v in got.values()) - target) < 0.02
    own = sizes(skewed)
    w = {s: own[s] ** mix.exponent for s in own}
    for s in own:  # against the weights themselves
        assert 0 <= w[s] / sum(w.values()) * 10_000 - got[s] < 15


def test_epochs_are_block_permutations(skewed):
    rows = mix_sources(skewed, repetition=3.0, block_tokens=256).rows.collect()
    for source in {r["source"] for r in rows}:
        first = {r["mix_block"]: r["mix_rank"] for r in rows if r["source"] == source and r["mix_epoch"] == 1}
        ids = [r["doc_id"] for r in rows if r["source"] == source and r["mix_epoch"] == 1]
        assert len(ids) == len(set(ids)) and len(set(first.values())) == len(first)


def test_odd_rows(odd, none):
    rows = mix_sources(odd, repetition=2.0).rows
    got = rows.collect()
    assert rows.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "mix_epoch"]
    assert {(r["doc_id"], r["text"]) for r in got} == {(r["doc_id"], r["text"]) for r in odd.collect()}
    assert sum(r["doc_id"] in (3, 4, 6) for r in got) == 3
    assert mix_sources(none, repetition=2.0).rows.count() == 0
    assert mix_sources(odd.where("doc_id in (3, 4)"), entropy=1.0).rows.count() == 2


def plain_mix(rows, repetition, budget, block_tokens, seed=1):
    """The mix by bisection and loops over all rows (id, source, tokens, hash, places): which epochs use which row."""
    own = {}
    for r in rows:
        if r["tokens"]:
            own[r["source"]] = own.get(r["source"], 0) + r["tokens"]

    def quotas(a):
        w = {s: own[s] ** a for s in own}
        all_ = budget if budget is not None else max(own[s] / w[s] for s in own) * sum(w.values())
        return {s: w[s] / sum(w.values()) * all_ for s in own}

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if max(q / own[s] for s, q in quotas(mid).items()) > repetition:
            lo = mid
        else:
            hi = mid
    quota, used = quotas(hi), []
    for s in own:
        n = 1
        while n < min(4096, own[s] / block_tokens):
            n *= 2
        epochs = int(quota[s] / own[s] + 1e-9)
        left = quota[s] - epochs * own[s]
        mine = [r for r in rows if r["source"] == s and r["tokens"]]
        blocks = {}
        for r in mine:
            blocks.setdefault(r["hash"] % 4096 % n, []).append(r)
        for r in mine:
            used += [(r["id"], s, e, r["hash"] % 4096 % n) for e in range(1, epochs + 1)]
        place = lambda b: (b[1][0]["places"][epochs][b[0]], b[0])
        for b, inside in sorted(blocks.items(), key=place):
            for h in sorted({r["hash"] for r in inside}):
                same = [r for r in inside if r["hash"] == h]
                left -= sum(r["tokens"] for r in same)
                if left < 0:
                    break
                used += [(r["id"], s, epochs + 1, b) for r in same]
            if left < 0:
                break
    return sorted(used + [(r["id"], r["source"], 1, None) for r in rows if not r["tokens"]], key=repr)


@pytest.mark.parametrize(("repetition", "budget", "block_tokens"), [(2.0, None, 300), (3.0, 9_000, 256), (1.5, 40_000, 100)])
def test_rows_against_plain_loops(spark, skewed, repetition, budget, block_tokens):
    """Each row, as often as it is used, with its epoch and block."""
    extra = spark.createDataFrame([(9001, "", "s0"), (9002, None, "big")], "doc_id bigint, text string, source string")
    df = skewed.where("doc_id < 1200").unionByName(extra)
    places = F.transform(
        F.sequence(F.lit(1), F.lit(6)),
        lambda e: F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda b: F.xxhash64(F.lit(2), e, F.concat(F.lit("s"), F.col("source")), b)
        )
    )
    rows = [
        {"id": r["doc_id"], "source": r["source"], "tokens": len((r["text"] or "").split()), "hash": r["h"], "places": r["p"]}
        for r in df.withColumn("h", F.xxhash64(F.lit(1), "doc_id", "text")).withColumn("p", places).collect()
    ]
    got = mix_sources(df, repetition=repetition, budget=budget, block_tokens=block_tokens).rows.collect()
    mine = sorted(
        ((r["doc_id"], r["source"], r["mix_epoch"], r["mix_block"] if r["mix_tokens"] else None) for r in got), key=repr
    )
    assert mine == plain_mix(rows, repetition, budget, block_tokens) and len(mine) > 300
    by = {r["id"]: r for r in rows}
    assert all(
        r["mix_rank"] == by[r["doc_id"]]["places"][r["mix_epoch"] - 1][r["mix_block"]] for r in got if r["mix_tokens"]
    )
