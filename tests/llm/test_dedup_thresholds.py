import numpy as np
from lexispark.llm.near_dedup import bands_for, features, keep_one


def test_a_lower_threshold_gets_more_bands_and_all_links(spark):
    """Copies whose similarity lies about 0.8, against the similarity of the sets."""
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for changed in range(1, 10):
        for _ in range(6):
            words = [f"w{k}" for k in rng.integers(0, 10**9, 300)]
            copy = list(words)
            for j in range(changed):
                copy[10 + 30 * j] = f"x{at}_{j}"
            rows += [(at, " ".join(words)), (at + 1, " ".join(copy))]
            at += 2
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    like = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, at, 2)}
    want = {i for i in range(at) if i % 2 == 0 or like[i - 1] < 0.8}
    assert any(0.8 <= s < 0.85 for s in like.values()) and any(0.75 < s < 0.8 for s in like.values())
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in keep_one(df, percent=80).collect()} == want
    assert bands_for(85) == 28 and (1 - 0.8**6) ** bands_for(80) < 2.1e-6
    ids = df.selectExpr("doc_id AS id", "text", "xxhash64(text) AS mark").limit(1)
    assert len(features(ids, bands_for(80)).first()["bands"]) == 44
