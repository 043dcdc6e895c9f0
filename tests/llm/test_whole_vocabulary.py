import inspect

from lexispark.llm.lm_scoring import Vocabulary, _classes, _counts, score_texts, vocabulary_size


def test_words_and_neighbours_of_all_texts(spark):
    """Each word occurs in three texts of 9,000: a sample of 8,000 texts misses some of them."""
    rows = [(f"w{i // 3} the",) for i in range(9000)]
    df = spark.createDataFrame(rows, "text string")
    words = [bytes(r["word"]) for r in _counts(df, held=500).where("n > 2").orderBy("n", "word", ascending=False).collect()]
    assert len(words) == 3001 and words[0] == b"the"
    assert vocabulary_size(18_000, 10, 1 << 20) == int(4 * 18_000**0.5) and vocabulary_size(18_000, 9000, 1 << 20) == 9000
    vocab = Vocabulary(words)
    coded = spark.createDataFrame([(vocab.read(t)[0].tolist(),) for t, in rows], "ids array<int>")
    got = _classes(coded, vocab.size, 2)
    assert len(set(got[3:].tolist())) == 1 and got[0] == 0
    assert "sample_docs" not in inspect.signature(score_texts).parameters
