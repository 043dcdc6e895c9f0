from lexispark.llm.quality import _bucket, features


def test_letters_are_counted_over_the_whole_text():
    """A text of two characters in turn, one of them a letter: a stride of two sees only one of them."""
    for text in ("a1" * 5000, "1a" * 5000, "ab 1" * 5000):
        share = sum(map(str.isalpha, text)) / len(text)
        assert _bucket(f"# letters {int(share * 10)}") in features(text)[0]
