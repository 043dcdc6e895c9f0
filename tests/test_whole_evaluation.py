"""The evaluation over all documents against a brute-force search."""

import math
from collections import Counter

import regex

from lexispark.functions.text import TOKEN
from lexispark.queries import QUERIES


def test_every_document_is_searched_for_every_passage(spark, data):
    at = data.replace("sf0.001", "sf0.01")
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    asked = [r["text"] for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    counts = {i: Counter(regex.findall(TOKEN, t.lower())) for i, t in docs}
    texts, n = dict(docs), len(docs)
    mean = sum(sum(c.values()) for c in counts.values()) / n
    df = Counter(w for c in counts.values() for w in c)

    def score(c, words):
        size = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
        return round(
            sum(
                max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + size)
                for w in words if w in c
            ), 9
        )

    ranks = []
    for passage in asked:
        words = set(regex.findall(TOKEN, passage.lower()))
        best = sorted(((-score(c, words), i) for i, c in counts.items() if words & c.keys()))[:10]
        ranks.append(next((k for k, (_, i) in enumerate(best, 1) if passage in texts[i]), 0))
    got = QUERIES["eval_mrr_recall"](spark, at).first()
    assert got["scenarios"] == len(asked)
    assert abs(got["mrr"] - sum(1 / r for r in ranks if r) / len(ranks)) < 1e-5
    assert abs(got["recall"] - sum(0 < r <= 5 for r in ranks) / len(ranks)) < 1e-5
