import math
import zlib

import numpy as np

from lexispark.llm.quality import OrdinalModel, features, fit, grade_documents, label_grade, score, train


def test_held_out_accuracy(spark, data):
    """Fitted on a part of the ratings, the model tells good documents from the others."""
    at = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = train(docs, labels.where("doc_id % 4 != 0"), label_grade(), 3)
    got = score(
        docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model, 2
    ).select("quality", "toxic", "keep", "expected_grade").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert got[good].keep.mean() > 0.95 and got[got.toxic == 1].keep.mean() < 0.15 and got[got.quality == 0].keep.mean() < 0.2
    assert got[good].expected_grade.mean() > got[~good].expected_grade.mean() + 0.5


def plain_features(text):
    """The features of a text by counting: name to value."""
    words = text.split()
    counts = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    core = lambda w: w.strip("".join({c for c in w if not (c.isalnum() or c == "_")})) if not w.isalnum() else w
    named = {}
    for w in words:
        k = core(w).lower()
        named[k] = named.get(k, 0) + 1
    total = max(1, len(words))
    tenth = lambda x: min(10, int(x * 10 + 1e-9))
    lines = text.split("\n")
    out = [(k, 1 + math.log(n)) for k, n in named.items() if k]
    shape = {
        "words": min(12, int(math.log2(total))), "upper": tenth(sum(len(w) > 1 and w.isupper() for w in words) / total),
        "clung": tenth(sum(len(w) - len(core(w)) > 1 for w in words) / total),
        "top": tenth(max(counts.values(), default=0) / total),
        "distinct": f"{min(12, int(math.log2(total)))} {tenth(len(counts) / total)}",
        "length": min(20, int(sum(map(len, words)) / total)), "lines": tenth(len(set(lines)) / len(lines)),
        "letters": tenth(sum(c.isalpha() for w in words for c in w) / max(1, len(text)))
    }
    return out + [(f"# {k} {v}", 4.0) for k, v in shape.items()]


def test_scores_against_plain_sums(spark, docs, data):
    """Every document's grade and tail from its features, counted and summed one by one."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = train(docs, labels, label_grade(), 3)
    got = {r["doc_id"]: r for r in grade_documents(docs, labels).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and np.count_nonzero(model.weights) > 10
    for r in rows:
        f = sum(float(model.weights[zlib.crc32(k.encode()) % 2**20]) * v for k, v in plain_features(r["text"] or ""))
        tails = [1 / (1 + math.exp(t - f)) for t in model.thresholds]
        own = got[r["doc_id"]]
        assert abs(own["expected_grade"] - sum(tails)) < 1e-4 and abs(own["tail_probability"] - tails[1]) < 1e-4
        assert own["keep"] == (own["tail_probability"] >= 0.4)


def test_fit_against_plain_steps():
    """The batches' steps, weight by weight."""
    rng = np.random.default_rng(3)
    rows = [(np.array(sorted(rng.choice(6, 2, replace=False))), rng.random(2), int(y)) for y in rng.integers(0, 3, 70)]
    m = fit(rows, 3, passes=2, least=1)
    w, g2, theta, t2 = [0.0] * 6, [1e-6] * 6, [-1.0, 1.0], [1e-6] * 2
    share = [sum(r[2] == k for r in rows) for k in range(3)]
    order_of = np.random.default_rng(7)
    for _ in range(2):
        order = order_of.permutation(70)
        for lo in range(0, 70, 32):
            part = [rows[k] for k in order[lo : lo + 32]]
            grad, up = {}, [0.0, 0.0]
            for i, v, y in part:
                f = sum(w[a] * x for a, x in zip(i, v, strict=True))
                for k in range(2):
                    miss = (1 / (1 + math.exp(theta[k] - f)) - (y > k)) * math.sqrt(70 / (share[y] * 3)) / len(part)
                    up[k] -= miss
                    for a, x in zip(i, v, strict=True):
                        grad[a] = grad.get(a, 0.0) + miss * x
            for a in grad:
                g = grad[a] + 1e-2 * w[a]
                g2[a] += g * g
                w[a] -= 0.1 * g / math.sqrt(g2[a])
            for k in range(2):
                t2[k] += up[k] ** 2
                theta[k] -= 0.1 * up[k] / math.sqrt(t2[k])
            theta.sort()
    assert np.allclose(m.weights[:6], w, atol=1e-5) and np.allclose(m.thresholds, theta, atol=1e-9)


def test_the_sample_is_bounded_in_rows_and_values(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    whole = train(docs, labels, label_grade(), 3)
    few = train(docs, labels, label_grade(), 3, train_values=4000)
    none = train(docs, labels, label_grade(), 3, train_values=1)
    assert np.count_nonzero(whole.weights) > np.count_nonzero(few.weights) > 0 == np.count_nonzero(none.weights)


def test_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{k % 5000}" for k in range(300_000))
    df = spark.createDataFrame([(1, long), (1, long), (2, "x" * 1_000_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = grade_documents(df.selectExpr("*", "1 AS graded", "2 AS at", "3 AS i"), labels).collect()
    assert len(got) == 3 and len({r["expected_grade"] for r in got if r["doc_id"] == 1}) == 1


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    rows = [(np.array([int(y), 10 + int(rng.integers(5))]), np.ones(2), int(y)) for y in rng.integers(0, 3, 600)]
    m = fit(rows, 3)
    assert (np.diff(m.thresholds) >= 0).all()
    f = np.array([m.weights[k] for k in range(3)])
    assert f[0] < f[1] < f[2]
    tails = m.tails(f)
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, None, 1), (3, 0, 0), (None, 1, 0), (99, 1, 0), (7, None, None)],
        "doc_id bigint, quality int, toxic int"
    )
    got = grade_documents(odd, labels)
    assert got.count() == 10 and got.columns.count("keep") == 1
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.collect())
    assert grade_documents(none, labels).count() == 0
    assert grade_documents(odd, labels.where("false")).count() == 10
    assert len(features("")[0]) == len(features("")[1])


def test_without_labels_nothing_is_dropped(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "three")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id bigint, quality int, toxic int")
    for known in (labels.where("false"), labels, labels.selectExpr("1L AS doc_id", "quality", "toxic")):
        assert [r["keep"] for r in grade_documents(docs, known).collect()] == [True] * 3


def test_ids_that_many_documents_share(spark):
    """A rated id that stands in many rows adds no more than the sample's bound."""
    docs = spark.range(400).selectExpr("id % 4 AS doc_id", "concat('word ', id) AS text")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(4)], "doc_id bigint, quality int, toxic int")
    model = train(docs, labels, label_grade(), 3, train_rows=50)
    assert isinstance(model, OrdinalModel)
