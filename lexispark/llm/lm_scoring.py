"""Language-model scoring with a hashed maximum-entropy model.

The next word is chosen in steps, each a softmax over at most 32 places: first its class, then, digit by digit, its place
in the class. The class depends on hashed features of the words before it: the last one, and the last but one (a skip).
Each step inside the class depends on a hashed feature of the last word and of the steps so far (in a
class of more than 32 squared words a block of them is chosen by its share first). Frequent
words are clustered into classes by the company they keep; all others fall into classes by their shape and follow their
smoothed frequency there, with a place for words never seen. So the model is a probability over all words.

Training goes over every training text once, in rounds. Texts are dealt into shards by a hash of id and text, and the
shards' number follows the corpus alone: each takes gradient steps on its texts, in the order of their hash, from the
shared weights, and the shards' steps are averaged row by row, in a tree. The result does not depend on how the table is
split. Scoring works on batches of feature rows in numpy.

Counts come from all training texts. Those of words outside the vocabulary stay on the executors; they are dealt by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut, fresh_folder, small_batches

END, START = 0, 1  # word numbers: END is a token, START only a context
SHAPES = 8
WIDTH = 32  # places of one softmax
CLASSES = WIDTH - SHAPES - 1
KINDS = 2  # features of the class
BATCH = 16_384
NEVER = np.float32(-1e4)


def split_words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # on bytes both know ASCII only


def _shape(word: bytes) -> int:
    """Three yes-or-no marks of a word: other than ASCII, other than letters and digits at its end, long."""
    return (not word.isascii()) * 4 + (word[-1] < 128 and not word[-1:].isalnum()) * 2 + (len(word) > 8)


class Vocabulary:
    """Numbers of the frequent words; other words are a negative number by their shape, and a 64-bit hash."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i + 2 for i, w in enumerate(words)}
        self.size = len(words) + 2

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's words as numbers, the end included; the distinct hashes of those that have none, and their counts."""
        import xxhash

        words = split_words(text)
        out = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        rare = np.flatnonzero(out == -1)
        seldom = [words[k] for k in rare.tolist()]
        out[rare] = [-1 - _shape(w) for w in seldom]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in seldom), np.uint64, len(seldom))  # Spark's xxhash64
        distinct, times = np.unique(hashes.view(np.int64), return_counts=True)
        return np.append(out, np.int32(END)), distinct, times.astype(np.int32)


@dataclass(frozen=True)
class Level:
    """One step inside the classes. node: for each word number the softmax that chooses on the way to it, -1 if there is
    no choice; digit: the place that it chooses; bias: a row for each softmax, the logarithm of its places' shares."""

    node: np.ndarray
    digit: np.ndarray
    bias: np.ndarray


def levels_of(class_of: np.ndarray, counts: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """The steps to each word number: its rank by frequency within its class, in digits of base WIDTH.

    The last two digits are steps. Where a class has more words, its blocks of WIDTH squared words are chosen by their
    share alone; the second result is the logarithm of the share of each number's block. Negative numbers (words by
    shape) have no steps; they index the arrays from the end.
    """
    size = len(class_of)
    order = np.lexsort((np.arange(size), -counts, class_of))
    rank = np.empty(size, np.int64)
    first = np.flatnonzero(np.concatenate([[True], class_of[order][1:] != class_of[order][:-1]]))
    rank[order] = np.arange(size) - np.repeat(first, np.diff(np.append(first, size)))
    mass = counts + 0.5
    mass[START] = 0  # START is no token
    block = class_of * size + rank // WIDTH**2
    _, of = np.unique(block, return_inverse=True)
    held = np.bincount(of, mass)
    whole = np.bincount(class_of, mass)
    with np.errstate(divide="ignore", invalid="ignore"):
        given = np.where(mass > 0, np.log(held[of] / whole[class_of]), 0.0)
    depth = 2 if rank.max(initial=0) >= WIDTH else 1
    out = []
    for k in range(depth):
        below = WIDTH ** (depth - 1 - k)
        digit = rank // below % WIDTH
        _, node = np.unique(class_of * size + rank // (below * WIDTH), return_inverse=True)
        share = np.zeros((node.max() + 1, WIDTH))
        np.add.at(share, (node, digit), mass)
        choice = (share > 0).sum(1) > 1
        with np.errstate(divide="ignore", invalid="ignore"):
            bias = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        bias[share == 0] = NEVER
        new = np.cumsum(choice) - 1
        node = np.where(choice[node], new[node], -1)
        node[START] = -1
        pad = np.full(SHAPES, -1)
        out.append(
            Level(
                np.append(node, pad).astype(np.int32), np.append(digit, pad * 0).astype(np.int32), bias[choice]
            )
        )
    return out, np.append(given, np.zeros(SHAPES))


@dataclass
class Model:
    """weights: a row of WIDTH places for each bucket of each kind of feature, the classes' kinds first; given: what of a
    word number's log probability does not depend on the words before it."""

    buckets: int
    bias: np.ndarray
    class_of: np.ndarray
    levels: list[Level]
    weights: np.ndarray
    given: np.ndarray

    @property
    def kinds(self) -> int:
        return KINDS + len(self.levels)


def _packed(model: Model) -> Model:
    """With weights of half precision, as it is broadcast."""
    return replace(model, weights=model.weights.astype(np.float16))


def _unpacked(model: Model) -> Model:
    return replace(model, weights=model.weights.astype(np.float32))


def _mix(h: np.ndarray, buckets: int) -> np.ndarray:
    return (
        (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - buckets.bit_length() + 1)
    ).astype(np.int64)


def contexts(texts: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the class (KINDS a token) and the last word of each token of some texts, one after the other."""
    n = np.array([len(t) for t in texts])
    ids = np.concatenate(texts)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    one, two = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[starts] = two[starts] = two[(starts + 1)[n > 1]] = START
    one, two = one.view(np.uint64), two.view(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    hashes = one * m, (two + np.uint64(0x51ED270B)) * np.uint64(0xDAA66D2C7DDF743F)
    return np.stack([_mix(h, buckets) + k * buckets for k, h in enumerate(hashes)]), one


def _inside(one: np.ndarray, node: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Feature rows of a step inside a class."""
    h = one * np.uint64(0xD6E8FEB86659FD93) + node.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(kind)
    return _mix(h * np.uint64(0x9E3779B97F4A7C15), buckets) + kind * buckets


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp in place, and its sums; a row's don't depend on the rows beside it, as they might in a product."""
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return z, z.sum(1)


def log_probabilities(model: Model, rows: np.ndarray, one: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The natural logarithm of each token's probability; a word by shape has that of its class alone."""
    w, out = model.weights, np.empty(len(ids))
    for lo in range(0, len(ids), BATCH):
        own, at = ids[lo : lo + BATCH], rows[:, lo : lo + BATCH]
        z = np.take(w, at[0], axis=0)
        for k in range(1, KINDS):
            z += np.take(w, at[k], axis=0)
        z += model.bias
        picked = z[np.arange(len(own)), model.class_of[own]]
        total = picked - np.log(_exp(z)[1]) + model.given[own]
        for k, level in enumerate(model.levels):
            node = level.node[own]
            some = np.flatnonzero(node >= 0)
            if not len(some):
                continue
            node = node[some]
            z = np.take(w, _inside(one[lo : lo + BATCH][some], node, KINDS + k, model.buckets), axis=0)
            z += level.bias[node]
            picked = z[np.arange(len(some)), level.digit[own[some]]]
            total[some] += picked - np.log(_exp(z)[1])
        out[lo : lo + BATCH] = total
    return out


def _sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of groups of rows that follow each other: neighbours in pairs, then pairs of pairs, until one row is left."""
    while len(rows) > len(sizes):
        at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        odd = np.flatnonzero(at & 1)
        even = np.flatnonzero(~at & 1)
        out = rows[even]
        out[np.cumsum(~at & 1)[odd] - 1] += rows[odd]
        rows, sizes = out, (sizes + 1) >> 1
    return rows


def _scatter(
    weights: np.ndarray, met: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float, many: np.ndarray | None = None
) -> None:
    """Take the gradient rows g from the weights' rows ``at``; ``many`` is how many tokens each stands for.

    A row's steps shorten with the root of 1 and the squares of its gradients so far (AdaGrad by row). met has these
    sums beside the number of times that the row was met.
    """
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    u, sizes = own[first], np.diff(np.append(first, len(own)))
    total = _sums(np.take(g, order, axis=0), sizes)
    met[0][u] += sizes if many is None else np.add.reduceat(many[order], first)
    met[1][u] += np.einsum("ij,ij->i", total, total)
    total *= (rate / np.sqrt(1 + met[1][u]))[:, None]
    weights[u] -= total


def _class_step(model: Model, met: np.ndarray, rows: np.ndarray, ids: np.ndarray, rate: float) -> None:
    """One gradient step of the classes over a batch of tokens."""
    w = model.weights
    g = np.take(w, rows[0], axis=0)
    for k in range(1, KINDS):
        g += np.take(w, rows[k], axis=0)
    g += model.bias
    g, total = _exp(g)
    g /= total[:, None]
    g[np.arange(len(ids)), model.class_of[ids]] -= 1
    for k in range(KINDS):
        _scatter(w, met, rows[k], g, rate)


def _level_step(model: Model, met: np.ndarray, one: np.ndarray, ids: np.ndarray, rate: float) -> None:
    """One gradient step of each step inside the classes.

    Tokens with the same softmax and the same feature have the same probabilities, so these are taken once, times the
    number of tokens.
    """
    for k, level in enumerate(model.levels):
        node = level.node[ids]
        some = np.flatnonzero(node >= 0)
        if not len(some):
            continue
        at = _inside(one[some], node[some], KINDS + k, model.buckets)
        pairs, of, many = np.unique(at * len(level.bias) + node[some], return_inverse=True, return_counts=True)
        at, node = np.divmod(pairs, len(level.bias))
        g, total = _exp(np.take(model.weights, at, axis=0) + level.bias[node])
        g *= (many / total).astype(np.float32)[:, None]
        g -= np.bincount(of * WIDTH + level.digit[ids[some]], minlength=len(pairs) * WIDTH).reshape(-1, WIDTH)
        _scatter(model.weights, met, at, g, rate, many)


def train_step(model: Model, met: np.ndarray, rows: np.ndarray, one: np.ndarray, ids: np.ndarray, rate: float) -> None:
    """One gradient step over a batch of tokens, on the model's weights in place; ``met`` is that of ``_scatter``."""
    _class_step(model, met, rows, ids, rate)
    _level_step(model, met, one, ids, rate)


def _train_texts(model: Model, met: np.ndarray, texts: list[np.ndarray], rate: float) -> None:
    """Steps over the tokens of some texts: the classes' in batches of BATCH tokens, the others' in one."""
    ids = np.concatenate(texts)
    rows, one = contexts(texts, model.buckets)
    for lo in range(0, len(ids), BATCH):
        _class_step(model, met, rows[:, lo : lo + BATCH], ids[lo : lo + BATCH], rate)
    _level_step(model, met, one, ids, rate)


def _counts(texts: DataFrame, held: int = 200_000) -> DataFrame:
    """(word, shape, n) over all texts. A task gives its counts away whenever it holds about ``held`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def given() -> pa.RecordBatch:
            words = list(c)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()), pa.array([_shape(w) for w in words], pa.int32()),
                    pa.array(list(c.values()), pa.int64())
                ],
                ["word", "shape", "n"]
            )

        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(split_words(t))
                if len(c) > held:
                    yield given()
                    c.clear()
        yield given()

    return cut(
        texts.select("text").mapInArrow(run, "word binary, shape int, n bigint").groupBy("word", "shape").agg(
            F.sum("n").alias("n")
        )
    )


def vocabulary_size(words: int, least: int, most: int) -> int:
    """``least``, or four times the root of the number of training words if that is more; ``most`` at most."""
    return min(most, max(least, int(4 * words**0.5)))


def _classes(train: DataFrame, size: int, classes: int, company: int = 48, seed: int = 3) -> np.ndarray:
    """A class for each of ``size`` word numbers, by k-means over the frequent words beside it in all texts' ``ids``.

    END has class 0; 1 to ``classes`` are clusters.
    """
    top, width = company, 2 * company

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).flatten().to_numpy().astype(np.int64)
            a, c = ids[:-1], ids[1:]  # a text's last number is END, which stands before nothing
            keys = [a[k] * width + c[k] for k in [(a >= 2) & (c >= 0) & (c < top)]] + [
                c[k] * width + top + a[k] for k in [(c >= 2) & (a >= 2) & (a < top)]
            ]
            u, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["key", "n"])

    out = np.zeros(size, np.int64)
    if size <= 2:
        return out
    got = train.select("ids").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(
        F.sqrt(F.sum("n")).cast("float").alias("x")
    ).select(F.col("key").cast("int"), "x").toArrow()  # at most ``width`` numbers for each word of the vocabulary
    key, x = got["key"].to_numpy().astype(np.int32), got["x"].to_numpy().astype(np.float32)
    del got
    order = np.argsort(key)  # one order, however the tasks came in
    key, x = key[order], x[order]
    del order
    column = (key % width).astype(np.int16)
    ends = np.searchsorted(key, np.arange(size + 1) * width)
    rows = np.repeat(np.arange(size, dtype=np.int32), np.diff(ends))
    x /= np.sqrt(np.maximum(np.bincount(column, x, width), 1)).astype(np.float32)[column]
    x /= np.maximum(np.sqrt(np.bincount(rows, x * x, size)), 1e-6).astype(np.float32)[rows]

    def dense(lo: int, hi: int) -> np.ndarray:
        own = slice(ends[lo], ends[hi])
        block = np.zeros((hi - lo, width), np.float32)
        block[rows[own] - lo, column[own]] = x[own]
        return block

    first = 2 + np.random.default_rng(seed).permutation(size - 2)[:classes]
    centre = np.concatenate([dense(k, k + 1) for k in first])
    step = 1 << 14
    for _ in range(10):
        total, many = np.zeros(centre.shape, np.float64), np.zeros(len(centre), np.int64)
        for lo in range(2, size, step):
            block = dense(lo, min(lo + step, size))
            near = (block @ centre.T).argmax(1)
            out[lo : lo + len(near)] = near + 1
            for k in np.unique(near):
                total[k] += block[near == k].sum(0)
            many += np.bincount(near, minlength=len(centre))
        some = many > 0
        centre[some] = total[some] / many[some, None]
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
    return out


def _learn(
    train: DataFrame, model: Model, tokens: int, rounds: int, rate: float, shard_tokens: int, parts: int = 64
) -> None:
    """Train the model's weights on the texts (round, h, ids), in place."""
    spark, shape = train.sparkSession, model.weights.shape
    shards = max(1, math.ceil(tokens / rounds / shard_tokens))
    width = shape[0] // parts  # kinds times a power of two
    kinds = "part int, shard bigint, step binary, met binary"

    def total_of(t: pa.Table) -> pa.Table:
        order = np.argsort(t["shard"].to_numpy(), kind="stable")
        step, met = np.zeros((width, WIDTH), np.float32), np.zeros(width, np.float32)
        for i in order:
            own = np.frombuffer(t["met"][int(i)].as_py(), np.float32)
            step += np.frombuffer(t["step"][int(i)].as_py(), np.float16).reshape(width, WIDTH) * own[:, None]
            met += own
        step = (step / np.maximum(met, 1)[:, None]).astype(np.float16)
        return pa.table(
            {
                "part": pa.array([t["part"][0].as_py()], pa.int32()),
                "shard": pa.array([int(t["shard"][0].as_py()) // 64], pa.int64()),
                "step": pa.array([step.tobytes()]), "met": pa.array([met.tobytes()])
            }
        )

    for k in range(rounds):
        model.weights = model.weights.astype(np.float16).astype(np.float32)  # what the executors get
        now = spark.sparkContext.broadcast(_packed(model))

        def learn(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:  # noqa: B008
            base = now.value

            def given(own: Model, met: np.ndarray, shard: int) -> Iterator[pa.RecordBatch]:
                for p in range(parts):
                    at = slice(p * width, (p + 1) * width)
                    if met[0, at].any():
                        step = (own.weights[at] - base.weights[at].astype(np.float32)).astype(np.float16)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([p], pa.int32()), pa.array([shard], pa.int64()), pa.array([step.tobytes()]),
                                pa.array([met[0, at].tobytes()])
                            ], ["part", "shard", "step", "met"]
                        )

            def fresh() -> tuple[Model, np.ndarray, list, int]:
                return _unpacked(base), np.zeros((2, shape[0]), np.float32), [], 0

            at = None
            for b in batches:
                of = b.column(0).to_numpy()
                lists = b.column(1)
                for i in range(b.num_rows):
                    if of[i] != at:
                        if at is not None:
                            if waiting:  # noqa: F821
                                _train_texts(own, met, waiting, rate)  # noqa: F821
                            yield from given(own, met, at)  # noqa: F821
                        at = int(of[i])
                        own, met, waiting, n = fresh()
                    text = lists[i].values.to_numpy()
                    waiting.append(text)
                    n += len(text)
                    if n >= 8 * BATCH:
                        _train_texts(own, met, waiting, rate)
                        waiting, n = [], 0
                waiting = [t.copy() for t in waiting] if b.num_rows else waiting if at is not None else []
            if at is not None:
                if waiting:
                    _train_texts(own, met, waiting, rate)
                yield from given(own, met, at)

        dealt = train.where(F.col("round") == k).select(
            F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "h", "ids"
        )
        # Few shards, each whole in one task: many more partitions than shards, so that hardly any two meet.
        placed = dealt.repartition(8 * shards, "shard").sortWithinPartitions("shard", "h").select("shard", "ids")
        steps = placed.mapInArrow(learn, kinds)
        some = steps.groupBy("part", F.floor(F.col("shard") / 64).alias("g")).applyInArrow(total_of, kinds)
        if shards > 64:
            some = some.groupBy("part", F.floor(F.col("shard") / 64).alias("g")).applyInArrow(total_of, kinds)
            some = some.groupBy("part").applyInArrow(total_of, kinds)
        for r in some.collect():  # the weights' size, whatever the corpus
            at = slice(r["part"] * width, (r["part"] + 1) * width)
            model.weights[at] += np.frombuffer(r["step"], np.float16).reshape(width, WIDTH)
        now.destroy()


@dataclass
class Trained:
    """What a corpus has given: the model, counts of the vocabulary, and what words outside it share by shape."""

    vocabulary: Vocabulary
    model: Model
    counts: np.ndarray
    total: int
    distinct: int
    shape_mass: np.ndarray
    words: DataFrame


def _hashed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), held.alias("held"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"),
        text.alias("text")
    )


def train(
    rows: DataFrame, rounds: int, classes: int, vocabulary: int, rate: float, most_vocabulary: int, most_buckets: int,
    shard_steps: int, per_root: float
) -> tuple[Trained, DataFrame]:
    """Train on those of the rows (id, held, h, text) that aren't held out; returns the rows as word numbers as well."""
    spark = rows.sparkSession
    learned = rows.where("not held")
    words = _counts(learned)
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_docs = learned.count()
    size = vocabulary_size(sums["n"] or 0, vocabulary, most_vocabulary)
    top = [
        (bytes(r["word"]), r["n"]) for r in words.where("n > 2").orderBy(F.desc("n"), "word").limit(size).collect()
    ]  # bounded by most_vocabulary
    vocab = Vocabulary([w for w, _ in top])
    counts = np.array([n_docs, 0, *[n for _, n in top]], np.int64)
    known, seen = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in words.groupBy("shape").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect():  # a row a shape
        known[r["shape"]], seen[r["shape"]] = r["v"], r["n"]
    for w, n in top:
        known[_shape(w)] -= 1
        seen[_shape(w)] -= n
    total, distinct = int(sums["n"] or 0) + n_docs, sums["v"] + (n_docs > 0)
    shared_vocab = spark.sparkContext.broadcast(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = shared_vocab.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                read = [own.read(t) for t in part.column(3).to_pylist()]
                keys = pa.array(np.arange(at, at + part.num_rows, dtype=np.int64))
                at += part.num_rows
                h = part.column(2).to_numpy()
                held = part.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys, part.column(0), part.column(1), part.column(2),
                        pa.array(np.where(held, rounds, (h >> 7) % rounds).astype(np.int32)),
                        pa.array([i for i, _, _ in read], pa.list_(pa.int32())),
                        pa.array([r for _, r, _ in read], pa.list_(pa.int64())),
                        pa.array([t for _, _, t in read], pa.list_(pa.int32()))
                    ],
                    ["key", "id", "held", "h", "round", "ids", "rare", "times"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    at = f"{fresh_folder(spark, 'lm')}/words"
    rows.mapInArrow(
        encode,
        f"key bigint, id {kind}, held boolean, h bigint, round int, ids array<int>, rare array<bigint>, times array<int>"
    ).write.partitionBy("round").option("compression", "zstd").parquet(at)
    coded = spark.read.schema(
        f"key bigint, id {kind}, held boolean, h bigint, ids array<int>, rare array<bigint>, times array<int>, round int"
    ).parquet(at)
    class_of = _classes(coded.where(F.col("round") < rounds), vocab.size, classes)
    prior = np.bincount(class_of, np.where(np.arange(vocab.size) == START, 0, counts), WIDTH).astype(np.float64)
    prior[1 + classes : 1 + classes + SHAPES] += seen[::-1]
    bias = np.log((prior + 1) / (prior + 1).sum()).astype(np.float32)
    own = np.bincount(class_of[2:], minlength=1 + classes)[: 1 + classes]
    bias[1 : 1 + classes][own[1:] == 0] = NEVER  # a class without words gets no probability
    bias[1 + classes + SHAPES :] = NEVER
    levels, given = levels_of(class_of, counts.astype(np.float64))
    buckets = 1 << max(10, min(most_buckets.bit_length() - 1, math.ceil(math.log2(per_root * max(total, 1) ** 0.5))))
    by_number = np.concatenate([class_of, 1 + classes + np.arange(SHAPES)])  # negative numbers index from the end
    weights = np.zeros(((KINDS + len(levels)) * buckets, WIDTH), np.float32)
    model = Model(buckets, bias, by_number, levels, weights, given)
    _learn(coded, model, total, rounds, rate, shard_steps * buckets)
    return Trained(vocab, model, counts, total, distinct, seen + 0.5 * (known + 1), words), coded


def score_texts(
    docs: DataFrame, rounds: int = 4, classes: int = CLASSES, vocabulary: int = 131_072, rate: float = 0.5, most_vocabulary: int = 1 << 20,
    most_buckets: int = 1 << 17, shard_steps: int = 160, per_root: float = 2.0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Score every whole text with a model learned from the texts that are not held out.

    Held out are ids whose crc32 as text is 1 modulo 5. Returns for each row: id, held_out, n_tokens (words and one
    end), n_known (tokens seen in training), train_tokens, base_score (smoothed unigram) and score (the model), both
    log10. Words are ASCII-lower-cased runs without ASCII white space. A null or empty text is its end alone; a null id
    is trained on; rows with equal ids or texts are texts of their own. A long text is read whole, as one row. If
    nothing is left to train on, counts are 0 and all classes are equally likely; no rows give no rows. Other columns
    are left out.

    Counts, classes and training cover every training text. The vocabulary has the words that occur more than twice,
    the most frequent ``vocabulary`` of them or four times the root of the number of training words if that is more;
    each kind of feature has twice (``per_root``) the root of the number of training tokens as buckets, rounded up
    to a power of two, and a shard has ``shard_steps`` tokens for each bucket. ``most_vocabulary`` and
    ``most_buckets`` bound what is broadcast (the model has ``most_buckets`` rows of 32 numbers for each kind); words
    beyond them are counted all the same, and scored by their shape and frequency.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    trained, coded = train(
        _hashed_rows(docs, id_col, text_col), rounds, classes, vocabulary, rate, most_vocabulary, most_buckets,
        shard_steps, per_root
    )
    base_mass = math.log10(trained.total + 0.5 * (trained.distinct + 1))
    shared = spark.sparkContext.broadcast(
        (
            _packed(trained.model), np.append(np.log10(trained.counts + 0.5), np.zeros(SHAPES)),
            np.append(trained.counts > 0, np.zeros(SHAPES, bool)),
            np.append(np.zeros(len(trained.counts)), np.log10(trained.shape_mass[::-1]))
        )
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, logs, seen, by_shape = shared.value
        model = _unpacked(packed)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = [x.values.to_numpy() for x in part.column(3)]
                ids, n = np.concatenate(texts), np.array([len(t) for t in texts])
                rows, one = contexts(texts, model.buckets)
                own = log_probabilities(model, rows, one, ids) / math.log(10) - by_shape[ids]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                made = [np.add.reduceat(x, starts) for x in (seen[ids].astype(np.int64), logs[ids] - base_mass, own)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2), pa.array(n.astype(np.int64)),
                        *map(pa.array, made)
                    ],
                    ["key", "id", "held_out", "n_tokens", "known", "base", "model"]
                )

    scored = coded.select("key", "id", "held", "ids").mapInArrow(
        score, f"key bigint, id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double"
    )
    # Words outside the vocabulary, once a text: their training counts are met in a join, and summed by text.
    seldom = coded.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "key", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    c = trained.words.select(F.xxhash64("word").alias("word"), F.col("n").alias("c"))
    rare = seldom.join(c, "word", "left").groupBy("key").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")).alias("logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rare, "key", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + zero("also")).cast("bigint").alias("n_known"),
        F.lit(trained.total).cast("bigint").alias("train_tokens"), (F.col("base") + zero("logs")).alias("base_score"),
        (F.col("model") + zero("logs")).alias("score"),
    )
