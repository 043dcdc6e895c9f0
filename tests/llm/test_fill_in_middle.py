"""Fill-in-middle against plain string slicing, and the rope's own laws."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexispark.llm.fill_in_middle import (
    arrange, concat, draws, fill_in_middle, find, restore, restored, rope, split_chars, split_units, transform
)

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PIECES = ["ab", "Z", " ", "é", "日", "😀", "<", "P", ">", "<P", "\n", "x" * 50, "\x00", "9"]


def plain(text, doc_id, seed=1):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 8192])
def test_against_slices(leaf):
    for k, text in enumerate(texts(400)):
        got = transform(text, k, leaf=leaf)
        assert got == plain(text, k)
        assert restore(got[4], got[1], leaf) == text


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_every_cut(leaf):
    for text in texts(30, 8):
        units, whole = UNIT.findall(text), rope(text, leaf)
        assert (whole.units, whole.chars, str(whole)) == (len(units), len(text), text)
        for k in range(len(units) + 1):
            a, b = split_units(whole, k)
            assert (str(a), str(b)) == ("".join(units[:k]), "".join(units[k:]))
            assert (a.units, b.units) == (k, len(units) - k)
            assert str(concat(a, b)) == text and concat(a, b).units == len(units)
        for k in range(len(text) + 1):
            assert tuple(map(str, split_chars(whole, k))) == (text[:k], text[k:])


def balanced(node):
    if node.left is None:
        return True
    return abs(node.left.height - node.right.height) <= 1 and balanced(node.left) and balanced(node.right)


def test_trees_stay_flat():
    rng, whole = random.Random(2), rope("ab, " * 5000, 4)
    for _ in range(200):
        a, b = split_units(whole, rng.randrange(whole.units))
        whole = concat(b, a)
        assert balanced(whole)
    assert whole.height <= 18 and whole.chars == 20_000


def test_sentinels_over_borders():
    for leaf in (1, 2, 3):
        assert find(rope("ab<<S>c<S>", leaf), "<S>") == 3
        assert find(rope("ab", leaf), "<S>") == -1


def test_all_ranks_of_one_text():
    text = "One two, <three>: vier <P é"
    units = UNIT.findall(text)
    for a in range(len(units) + 1):
        for b in range(a, len(units) + 1):
            for form in ("psm", "spm"):
                out, prefix, middle = arrange(rope(text, 3), form, a, b)
                assert prefix == len("".join(units[:a])) and middle == len("".join(units[a:b]))
                assert restore(str(out), form, 3) == text


def test_odd_rows(odd, none):
    got = fill_in_middle(odd)
    rows = {(r["doc_id"], r["output"]): r for r in got.collect()}
    want = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert got.count() == len(want)
    for r in want:
        n, form, prefix, middle, out = plain(r["t"], "" if r["doc_id"] is None else r["doc_id"])
        own = rows[r["doc_id"], out]
        assert (own["n"], own["form"], own["prefix_chars"], own["middle_chars"]) == (n, form, prefix, middle)
    back = restored(got.withColumn("more", F.lit(1)))
    assert back.columns == [*got.columns, "more", "restored"]
    assert sorted(r["restored"] for r in back.collect()) == sorted(r["t"] for r in want)
    assert fill_in_middle(none).count() == 0 and restored(fill_in_middle(none)).count() == 0


def test_whole_table(docs):
    got = {r["doc_id"]: r for r in restored(fill_in_middle(docs)).collect()}
    forms = [r["form"] for r in got.values()]
    assert {"plain", "psm", "spm"} == set(forms)
    for r in docs.select("doc_id", "text").collect():
        own = got[r["doc_id"]]
        assert (own["n"], own["form"], own["prefix_chars"], own["middle_chars"], own["output"]) == plain(r["text"], r["doc_id"])
        assert own["restored"] == r["text"]


def test_shares_of_forms():
    forms = [transform("a b", k)[1] for k in range(4000)]
    assert 0.08 < forms.count("plain") / 4000 < 0.12 and 0.15 < forms.count("spm") / 4000 < 0.21
    assert draws(7, 1) != draws(7, 2)
