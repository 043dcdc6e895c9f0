import re

import numpy as np
from lexispark.llm.fingerprints import PARAGRAPH, digests
from pyspark.sql import functions as F


def test_a_line_without_sentence_ends_keeps_digests(spark):
    """A long line whose last third or some first words change keeps most of its pieces; all characters are in one."""
    rng = np.random.default_rng(5)
    line = " ".join("".join(map(chr, 97 + rng.integers(0, 26, rng.integers(2, 10)))) for _ in range(800))
    for other in (line[: 2 * len(line) // 3] + "z" * (len(line) // 3), "some words more " + line):
        df = spark.createDataFrame([(line, other)], "a string, b string").select(
            digests(F.col("a")).alias("a"), digests(F.col("b")).alias("b")
        )
        r = df.first()
        assert len(set(r["a"]) & set(r["b"])) > 0.5 * len(r["a"])
    for text in (line, "日" * 3000, "a. " * 400, "x" * 61 + "!!! next"):
        pieces = re.findall(PARAGRAPH, text)
        assert "".join(pieces) == text and max(map(len, pieces)) <= 242
