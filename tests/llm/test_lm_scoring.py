import math
import zlib
from collections import Counter

import numpy as np
import pytest
from lexispark.llm.lm_scoring import (
    CLASSES, END, KINDS, SHAPES, START, WIDTH, Level, Model, _hashed_rows, _shape, contexts, levels_of, log_probabilities, score_texts,
    train, train_step
)

SMALL = {"rounds": 2, "classes": 5, "vocabulary": 90, "rate": 0.5, "most_vocabulary": 90, "most_buckets": 1 << 11}
MASK = (1 << 64) - 1


def check(df, got):
    rows = df.select("doc_id", "text").collect()
    words = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), None]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)

    def row(i, ws):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        return str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 4)

    want = sorted(row(i, ws) for i, ws in words)
    assert sorted(
        (
            str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)
        ) for r in got
    ) == want


def test_whole_table(docs):
    got = score_texts(docs).collect()
    check(docs, got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def plain_log(model, two, one, word):
    """The natural logarithm of a word number's probability after two others, in whole numbers and loops."""
    m = 0x9E3779B97F4A7C15
    bits = model.buckets.bit_length() - 1

    def row(h, kind):
        h &= MASK
        return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & MASK) >> (64 - bits), kind

    def chosen(scores, k):
        return scores[k] - math.log(sum(math.exp(min(60.0, s)) for s in scores))

    one, two = one & MASK, two & MASK
    at = [
        row(one * m, 0), row((two + 0x51ED270B) * 0xDAA66D2C7DDF743F, 1)
    ]
    w = lambda b, j: float(model.weights[b[1] * model.buckets + b[0], j])
    out = chosen(
        [sum(w(b, j) for b in at) + float(model.bias[j]) for j in range(WIDTH)], int(model.class_of[word])
    )
    out += float(model.given[word])
    for k, level in enumerate(model.levels):
        node = int(level.node[word])
        if node >= 0:
            h = one * 0xD6E8FEB86659FD93 + node * 0xA24BAED4963EE407 + KINDS + k
            b = row((h & MASK) * m, KINDS + k)
            out += chosen([w(b, j) + float(level.bias[node][j]) for j in range(WIDTH)], int(level.digit[word]))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(120)] + ["é", "long-word-x!", "q"]
    share = 1 / np.arange(1, len(words) + 1)
    rows = [
        (i, " ".join(words[k] for k in rng.choice(len(words), rng.integers(0, 60), p=share / share.sum())))
        for i in range(150)
    ]
    return spark.createDataFrame([*rows, (1000, "w1 never-seen W2"), (None, None)], "doc_id bigint, text string")


def test_score_against_plain_softmaxes(texts):
    """Every text's score by a softmax over all places in plain loops, from the same weights."""
    trained, _ = train(_hashed_rows(texts, "doc_id", "text"), **SMALL, shard_steps=1, per_root=4.0)
    got = {str(r["doc_id"]): r["score"] for r in score_texts(texts, **SMALL, shard_steps=1).collect()}
    trained.model.weights = trained.model.weights.astype(np.float16).astype(np.float32)
    assert np.abs(trained.model.weights).max() > 0.1 and len(trained.model.levels) >= 1
    c = {bytes(r["word"]): r["n"] for r in trained.words.collect()}
    number = trained.vocabulary.number
    rare = {s: [n for w, n in c.items() if w not in number and _shape(w) == s] for s in range(SHAPES)}
    for r in texts.collect():
        want, two, one = 0.0, START, START
        for w in [*(r["text"] or "").encode().lower().split(), None]:
            k = END if w is None else number.get(w, -1 - _shape(w))
            want += plain_log(trained.model, two, one, k) / math.log(10)
            if k < 0:
                s = _shape(w)
                want += math.log10((c.get(w, 0) + 0.5) / (sum(rare[s]) + 0.5 * (len(rare[s]) + 1)))
            two, one = one, k
        assert abs(got[str(r["doc_id"])] - want) < 1e-3 * max(1, abs(want)) ** 0.5, r


def test_probabilities_add_up_to_one(texts):
    """After any two words, over the end, all words of the vocabulary, all others and one unknown word of each shape."""
    trained, _ = train(_hashed_rows(texts, "doc_id", "text"), **SMALL, shard_steps=1, per_root=4.0)
    c = {bytes(r["word"]): r["n"] for r in trained.words.collect()}
    number = trained.vocabulary.number
    every = [END, *range(2, trained.vocabulary.size), *range(-SHAPES, 0)]
    for before in ([START, START], [START, 5], [3, 2], [-1, 4], [7, -3]):
        asked = [np.array([*before, k], np.int32) for k in every]
        rows, one = contexts(asked, trained.model.buckets)
        last = np.arange(len(every)) * 3 + 2
        logs = log_probabilities(trained.model, rows[:, last], one[last], np.array(every))
        assert abs(np.exp(logs).sum() - 1) < 1e-5
    for s in range(SHAPES):  # a shape's words and one unknown word share its class
        rare = [n for w, n in c.items() if w not in number and _shape(w) == s]
        mass = trained.shape_mass[s]
        assert abs(sum((n + 0.5) / mass for n in rare) + 0.5 / mass - 1) < 1e-12


def test_steps_reach_every_word_of_large_classes():
    """Classes of one word up to several blocks: the steps and shares of a class add up to one, each word has its own."""
    rng = np.random.default_rng(8)
    sizes = [1, 2, 31, 33, 1024, 1030, 3000]
    class_of = np.concatenate([[0, 0], *[np.full(n, k + 1) for k, n in enumerate(sizes)]]).astype(np.int64)
    levels, given = levels_of(class_of, rng.integers(0, 99, len(class_of)).astype(float))
    for k, n in enumerate(sizes):
        total, paths = 0.0, set()
        for w in np.flatnonzero(class_of == k + 1):
            p, path = given[w], [round(float(given[w]), 9)]
            for level in levels:
                if level.node[w] >= 0:
                    p += level.bias[level.node[w], level.digit[w]]
                    path += [int(level.node[w]), int(level.digit[w])]
            total += np.exp(p)
            paths.add(tuple(path))
        assert abs(total - 1) < 1e-4 and len(paths) == n


def test_same_scores_however_the_table_is_split(texts):
    """Also with several shards a round."""
    seen = []
    for n in (2, 7, 32):
        got = score_texts(texts.repartition(n), **SMALL, shard_steps=1, per_root=0.01).collect()
        seen.append({str(r["doc_id"]): (r["score"], r["base_score"]) for r in got})
    for other in seen[1:]:
        assert all(
            abs(other[i][k] - v[k]) < 1e-9 * max(1.0, abs(v[k])) for i, v in seen[0].items() for k in (0, 1)
        ) and set(other) == set(seen[0])


def test_a_step_follows_the_gradient():
    """The step of one batch against the numeric gradient of its log-likelihood."""
    rng = np.random.default_rng(1)
    class_of = np.array([0, 0, 1, 1, 2, 2, *range(3, 3 + SHAPES)])
    bias = np.full(WIDTH, -1e4, np.float32)
    bias[: 3 + SHAPES] = 0
    inner = np.full((2, WIDTH), -1e4, np.float32)
    inner[:, :2] = np.log(0.5)
    node = np.array([-1, -1, 0, 0, 1, 1, *[-1] * SHAPES], np.int32)
    digit = np.array([0, 0, 0, 1, 0, 1, *[0] * SHAPES], np.int32)
    model = Model(1 << 10, bias, class_of, [Level(node, digit, inner)], np.zeros((3 << 10, WIDTH), np.float32), np.zeros(6 + SHAPES))
    model.weights += rng.normal(size=model.weights.shape).astype(np.float32) * 0.1
    ids = [np.array([2, 3, 4, 3, 0]), np.array([5, -2, 2, 0])]
    rows, one = contexts(ids, model.buckets)
    every = np.concatenate(ids)
    likely = lambda: log_probabilities(model, rows, one, every).sum()
    before = model.weights.copy()
    met = np.zeros((2, len(before)), np.float32)
    train_step(model, met, rows, one, every, 1.0)
    step = (model.weights - before) * np.sqrt(1 + met[1])[:, None]  # the gradient, up to each row's own rate
    model.weights = before.copy()
    i, j = np.nonzero(np.abs(step) > 0.05)
    assert len(i) > 20
    for a, b in list(zip(i, j, strict=True))[:40]:
        model.weights[a, b] = before[a, b] + 0.02
        up = likely()
        model.weights[a, b] = before[a, b] - 0.02
        assert abs((up - likely()) / 0.04 - step[a, b]) < 2e-2
        model.weights[a, b] = before[a, b]
    assert likely() < (setattr(model, "weights", before + 0.1 * step) or likely())


def test_a_pattern_is_learned(spark):
    """Two tongues with the same word counts: the words before tell which one comes next."""
    rows = [(i, " ".join((["a1", "b1", "c1"] if i % 2 else ["a2", "b2", "c2"]) * 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [r for r in score_texts(df, classes=6).collect() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > 0.6 * sum(r["base_score"] for r in out)


def test_a_word_inside_its_class_is_learned(spark):
    """With one class, only the steps inside it can tell which word follows which."""
    rows = [(i, " ".join((["a1", "b1", "c1"] if i % 2 else ["a2", "b2", "c2"]) * 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [r for r in score_texts(df, classes=1).collect() if r["held_out"]]
    assert out and sum(r["score"] for r in out) > 0.6 * sum(r["base_score"] for r in out)


def test_odd_rows(odd, none):
    got = score_texts(odd, rounds=2, classes=5).collect()
    check(odd, got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert score_texts(none, rounds=1, classes=3).count() == 0
    nothing = score_texts(odd.where("doc_id = 4"), rounds=1).collect()  # held out or not, there is hardly anything
    assert len(nothing) == 1 and math.isfinite(nothing[0]["score"])
    assert CLASSES + SHAPES + 1 == WIDTH
