import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm.queries import tokenizer_path
from lexispark.llm.token_counts import compiled, count_tokens

PATH = tokenizer_path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_whole_table(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = count_tokens(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(LIB.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.integers(1, 20))
def test_any_text_in_any_chunks(text, chunk):
    text = text.encode("utf-8", "ignore").decode()
    assert compiled(PATH).count(text, chunk) == len(LIB.encode(text))


@pytest.mark.parametrize("seed", range(3))
def test_pieces_and_spaces(seed):
    rng = random.Random(seed)
    pieces = list(compiled(PATH).pieces.score)
    for _ in range(1000):
        text = "".join(
            rng.choice(pieces) if rng.random() < 0.7 else " " * rng.randint(1, 20) for _ in range(rng.randint(1, 8))
        )
        assert compiled(PATH).count(text, rng.choice([3, 1000])) == len(LIB.encode(text)), repr(text)


def test_maps_compose_in_any_grouping():
    """The map of a whole text is that of its chunks, joined from the left, the right or in pairs; totals are equal."""
    t = compiled(PATH)
    rng = random.Random(5)
    pieces = list(t.pieces.score)
    for text in ["a bc\u2581\u2581 d日\ne  f g", "  ", "日 本", "a", " a ", "\u2581", "x" * 9] + [
        "".join(rng.choice(["  ", " ", "日", "\n", "😀", *rng.sample(pieces, 3)]) for _ in range(12)) for _ in range(150)
    ]:
        text = text.replace(" ", "\u2581")
        size = rng.choice([1, 2, 3, 7])
        parts = [t.map_of(text[i : i + size]) for i in range(0, len(text), size)]
        left = parts[0]
        for p in parts[1:]:
            left = t.joined(left, p)
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = t.joined(p, right)
        tree = parts
        while len(tree) > 1:
            tree = [t.joined(*tree[i : i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
        want = len(LIB.encode(text.replace("\u2581", " ")))
        assert t.total(parts) == t.total([left]) == t.total([right]) == t.total(tree) == want, repr(text)


def test_long_words_agree_after_their_beginning():
    """Texts without any boundary: a chunk's own count is used from the place where the states agree."""
    t = compiled(PATH)
    rng = random.Random(6)
    pieces = [p for p in t.pieces.score if "\u2581" not in p and not t.outside.search(p)]
    for _ in range(6):
        text = "".join(rng.choice(pieces) for _ in range(4000))
        assert t.count(text, rng.choice([700, 2000, 5000])) == len(LIB.encode(text))
        assert t.count("   " + text, 900) == len(LIB.encode("   " + text))


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 300_001 + "b", "\n" * 400_000, ("ab " * 5 + " " * 999) * 300])
def test_long_runs_of_spaces(text):
    for chunk in (1 << 16, 1 << 20):
        assert compiled(PATH).count(text, chunk) == len(LIB.encode(text))


def test_long_texts_as_rows(spark):
    """Texts that are cut into chunks, composed over several levels, beside short ones and equal rows."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)] + ["日本語", "   ", "naïve", "\n\n", "x" * 300]
    texts = [" ".join(rng.choices(words, k=k)) for k in (3, 2000, 900, 900)] + ["y" * 3000, "", None, " " * 5000]
    rows = [(k if k % 3 else None, t) for k, t in enumerate([*texts, texts[1]])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = count_tokens(df, PATH, limit=100, chunk=50, fan=4).collect()
    want = sorted((str(i), len((t or "").encode()), len(LIB.encode(t or ""))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)


def test_odd_rows(odd, none):
    got = count_tokens(odd, PATH).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted(r["n_tokens"] for r in got) == sorted(len(LIB.encode(t)) for t in texts)
    assert count_tokens(none, PATH).count() == 0
