"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score f into grades:
P(grade <= k) = sigmoid(threshold_k - f). The model gives each text's expected grade and the tail probability that
it reaches the grade to keep.

Training takes a bounded sample of the rated rows (``train_rows``), as features; scoring reads every whole text once, in
Arrow batches, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut, small_batches

BUCKETS = 1 << 20
_EDGE = re.compile(r"^\W+|\W+$")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) & (BUCKETS - 1)


def _step(x: float, n: int = 10) -> int:
    return min(n, int(x * n + 1e-9))


def features(text: str) -> tuple[list[int], list[float]]:
    """Hashed features of a whole text: its distinct words, what clings to them, and bands of overall shape."""
    words = text.split()
    counts = Counter(words)
    seen: Counter = Counter()
    clung = 0
    for w, n in counts.items():
        core = _EDGE.sub("", w) if not w.isalnum() else w
        if len(w) - len(core) > 1:
            clung += n
        seen[core.lower()] += n
    total = max(1, len(words))
    upper = sum(n for w, n in counts.items() if len(w) > 1 and w.isupper())
    top = max(counts.values(), default=0)
    long = sum(len(w) * n for w, n in counts.items()) / total
    letters = sum((len(w) if w.isalpha() else sum(map(str.isalpha, w))) * n for w, n in counts.items())
    lines = text.split("\n")
    shape = [
        f"# words {min(12, int(math.log2(total)))}",
        f"# upper {_step(upper / total)}",
        f"# clung {_step(clung / total)}",
        f"# top {_step(top / total)}",
        f"# distinct {min(12, int(math.log2(total)))} {_step(len(counts) / total)}",
        f"# length {min(20, int(long))}",
        f"# lines {_step(len(set(lines)) / len(lines))}",
        f"# letters {_step(letters / max(1, len(text)))}",
    ]
    names = [w for w in seen if w]
    return [*map(_bucket, names), *map(_bucket, shape)], [
        *(1.0 + math.log(seen[w]) for w in names), *[4.0] * len(shape)
    ]


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def fitted(self) -> bool:
        """Whether anything tells texts apart."""
        return bool(self.weights.any())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, passes: int = 30, rate: float = 0.1, least: int = 20,
    decay: float = 1e-2, seed: int = 7
) -> OrdinalModel:
    """Fit weights and ordered thresholds by AdaGrad over small batches; buckets in fewer than ``least`` rows stay 0.

    Each grade weighs the same in the loss. With one grade only, or no rows, the weights are 0.
    """
    w, theta = np.zeros(BUCKETS), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    if not rows:
        return OrdinalModel(w.astype(np.float32), theta)
    often = np.zeros(BUCKETS, np.int32)
    for i, _, _ in rows:
        often[np.unique(i)] += 1
    rows = [(i[k], v[k], y) for i, v, y in rows for k in [often[i] >= least]]
    share = np.bincount([y for *_, y in rows], minlength=grades)
    cost = np.sqrt(len(rows) / (np.maximum(share, 1) * (share > 0).sum()))
    if (share > 0).sum() < 2:
        return OrdinalModel(w.astype(np.float32), theta)
    g2, t2, rng = np.full(BUCKETS, 1e-6), np.full(grades - 1, 1e-6), np.random.default_rng(seed)
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 32):
            part = [rows[k] for k in order[at : at + 32]]
            i, v = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            row = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            y = np.array([p[2] for p in part])
            f = np.bincount(row, w[i] * v, len(part))
            above = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
            # d loss / d f of the cumulative logits, each threshold a binary split
            miss = (
                1 / (1 + np.exp(np.clip(theta[None, :] - f[:, None], -60, 60))) - above
            ) * cost[y][:, None] / len(part)
            g = miss.sum(1)
            u, inv = np.unique(i, return_inverse=True)
            grad = np.bincount(inv, v * g[row]) + decay * w[u]
            g2[u] += grad**2
            w[u] -= rate * grad / np.sqrt(g2[u])
            gt = -miss.sum(0)
            t2 += gt**2
            theta = np.sort(theta - rate * gt / np.sqrt(t2))
    return OrdinalModel(w.astype(np.float32), theta)


def train(
    docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, train_rows: int = 12_000,
    train_values: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> OrdinalModel:
    """Fit on at most ``train_rows`` of the rated rows, those with the smallest hash of their id.

    Ratings without a grade are left out, as are ids that the documents lack; a document with several ratings counts
    once for each. The sample's features, not its texts, go to the driver: ``train_values`` of them at most (128 MB), so
    where the sample's texts have more distinct words than that, its last rows are left out.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rated = ratings.select(
        F.col(id_col).cast(kind).alias("id"), grade.cast("int").alias("grade")
    ).where("id is not null and grade is not null")
    sample = rated.withColumn("at", F.xxhash64("id")).orderBy("at", "id", "grade").limit(train_rows)
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")
    ).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [features(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1), part.column(2), pa.array([np.array(i, np.int32) for i, _ in made], pa.list_(pa.int32())),
                        pa.array([np.array(v, np.float32) for _, v in made], pa.list_(pa.float32()))
                    ],
                    ["grade", "at", "i", "v"],
                )

    sized = texts.join(
        F.broadcast(sample), "id"
    ).select("text", "grade", "at")  # the sample has train_rows rows of three numbers
    made = cut(sized.mapInArrow(run, "grade int, at bigint, i array<int>, v array<float>"))
    if made.count() > train_rows:  # an id may stand in several documents, each of which is rated then
        made = cut(made.orderBy("at", "grade", F.xxhash64("i", "v")).limit(train_rows))
    sizes = sorted((r["at"], r["n"]) for r in made.select("at", F.size("i").alias("n")).collect())  # train_rows rows
    total = np.cumsum([n for _, n in sizes])
    if len(total) and total[-1] > train_values:
        made = made.where(F.col("at") < sizes[int(np.searchsorted(total, train_values, "right"))][0])
    got = made.drop("at").toArrow().combine_chunks()
    rows = [
        (i.values.to_numpy(), v.values.to_numpy(), y) for i, v,
        y in zip(got["i"], got["v"], got["grade"].to_pylist(), strict=True)
    ]
    rows.sort(key=lambda r: (r[2], zlib.crc32(r[0].tobytes()), r[1].tobytes()))  # one order, however the tasks came in
    return fit(rows, grades, least=max(3, len(rows) // 600))


def score(
    docs: DataFrame, model: OrdinalModel, keep_grade: int, least: float = 0.4, text_col: str = "text"
) -> DataFrame:
    """Add expected_grade, tail_probability (of reaching ``keep_grade``) and keep (tail at least ``least``) to every row.

    A null text counts as empty; a text without words has only its shape to speak for it. All rows and columns stay;
    columns of these names are replaced. Equal texts have equal scores, and repeated rows are scored each. An empty table
    gives no rows. Long texts are read whole, with as much memory as their distinct words take. Only the texts go to
    Python.
    """
    small_batches(docs.sparkSession)
    names = ["expected_grade", "tail_probability", "keep"]
    kept = [c for c in docs.columns if c not in names]
    some = np.flatnonzero(model.weights)
    # The model's non-zero weights travel with the task as a broadcast: at most BUCKETS numbers of four bytes.
    shared = docs.sparkSession.sparkContext.broadcast((some.astype(np.int32), model.weights[some], model.thresholds))

    @F.arrow_udf("expected_grade double, tail_probability double, keep boolean")
    def graded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, theta = shared.value
        weights = np.zeros(BUCKETS, np.float32)
        weights[at] = w
        own = OrdinalModel(weights, theta)
        for texts in parts:
            f = []
            for text in texts:
                i, v = features(text.as_py() or "")
                f.append(float(weights[i] @ np.array(v, np.float32)))
            tails = own.tails(np.array(f, float))
            tail = tails[:, keep_grade - 1]
            yield pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= least)], names)

    new = "graded"
    while new in docs.columns:
        new += "_"
    # Marked as not deterministic, so that it runs once a row, whatever is filtered by its result.
    scored = docs.select(*[f"`{c}`" for c in kept], graded.asNondeterministic()(F.col(text_col)).alias(new))
    return scored.select(*[f"`{c}`" for c in kept], *[F.col(new)[c].alias(c) for c in names])


# Ratings of the labels table as grades: 0 toxic, 1 of low quality, 2 good.
def label_grade() -> Column:
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with the grades of a model fitted to the labels table; keep asks for a good one.

    The results for odd rows are those of ``score``. Where fewer than two grades are known (no labels, none of these
    documents, or all alike), nothing tells documents apart: all get the same tail, and all are kept.
    """
    model = train(docs, labels, label_grade(), 3)
    graded = score(docs, model, keep_grade=2)
    return graded if model.fitted else graded.withColumn("keep", F.lit(True))
