"""Fill-in-middle over ropes.

A text becomes a balanced tree of leaves. Each node caches its units (tokens of ``[A-Za-z]+|[^A-Za-z]``), its code points
and whether it begins and ends in a letter, so counts compose over any cut: a run of letters that goes on across a
border is one unit. A document is split at two unit ranks, the three subtrees are concatenated in another order with
sentinels between them, and the inverse splits the tree of the output at the sentinels. Leaves are never copied but where
a cut goes through one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexispark.llm.common import small_batches

#: Code points of a leaf.
LEAF = 8192
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)


def _letters(text: str) -> np.ndarray:
    """Whether each code point is an ASCII letter."""
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((codes | 32) - 97).astype(codes.dtype) < 26


def _begins(letters: np.ndarray) -> np.ndarray:
    """Where units begin."""
    out = np.ones(len(letters), bool)
    out[1:] = ~(letters[1:] & letters[:-1])
    return out


class Rope:
    """A node: a leaf with a text, or the concatenation of two nodes."""

    __slots__ = ("chars", "height", "left", "right", "text", "units", "head", "tail")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.height, self.chars = 0, len(text)
            letters = _letters(text)
            self.units = int(_begins(letters).sum())
            self.head, self.tail = (bool(letters[0]), bool(letters[-1])) if text else (False, False)
        else:
            self.height = 1 + max(left.height, right.height)
            self.chars = left.chars + right.chars
            self.units = left.units + right.units - (left.tail and right.head)
            self.head, self.tail = left.head, right.tail

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope()


def rope(text: str, leaf: int = LEAF) -> Rope:
    """A balanced tree over the text."""

    def over(lo: int, hi: int) -> Rope:
        if hi - lo <= 1:
            return Rope(text[lo * leaf : hi * leaf])
        mid = (lo + hi) // 2
        return Rope("", over(lo, mid), over(mid, hi))

    return over(0, -(-len(text) // leaf)) if text else EMPTY


def concat(a: Rope, b: Rope) -> Rope:
    """Both one after the other; the heights of siblings differ by one at most, if they do in what is given."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _node(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _node(concat(a, b.left), b.right)
    return Rope("", a, b)


def _node(a: Rope, b: Rope) -> Rope:
    """Two trees as one, rotated where one is higher by two."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Rope("", a.left, Rope("", a.right, b))
        return Rope("", Rope("", a.left, a.right.left), Rope("", a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Rope("", Rope("", a, b.left), b.right)
        return Rope("", Rope("", a, b.left.left), Rope("", b.left.right, b.right))
    return Rope("", a, b)


def split_units(node: Rope, k: int) -> tuple[Rope, Rope]:
    """The first k units, and the rest; a unit that goes on over a border of leaves stays whole."""
    if k <= 0:
        return EMPTY, node
    if k >= node.units:
        return node, EMPTY
    if node.left is None:
        at = int(np.flatnonzero(_begins(_letters(node.text)))[k])
        return Rope(node.text[:at]), Rope(node.text[at:])
    if k < node.left.units:
        a, b = split_units(node.left, k)
        return a, concat(b, node.right)
    a, b = split_units(node.right, k - node.left.units + (node.left.tail and node.right.head))
    return concat(node.left, a), b


def split_chars(node: Rope, k: int) -> tuple[Rope, Rope]:
    """The first k code points, and the rest."""
    if k <= 0:
        return EMPTY, node
    if k >= node.chars:
        return node, EMPTY
    if node.left is None:
        return Rope(node.text[:k]), Rope(node.text[k:])
    if k < node.left.chars:
        a, b = split_chars(node.left, k)
        return a, concat(b, node.right)
    a, b = split_chars(node.right, k - node.left.chars)
    return concat(node.left, a), b


def find(node: Rope, mark: str) -> int:
    """The code point at which ``mark`` first begins, -1 if nowhere; it may lie over a border of leaves."""
    at, carry = 0, ""
    for text in node.leaves():
        hit = (carry + text).find(mark)
        if hit >= 0:
            return at - len(carry) + hit
        at += len(text)
        carry = (carry + text)[-(len(mark) - 1) :]
    return -1


def arrange(doc: Rope, form: str, first: int, last: int) -> tuple[Rope, int, int]:
    """The document in its form, with the code points of prefix and middle, cut after ``first`` and ``last`` units."""
    rest, suffix = split_units(doc, last)
    prefix, middle = split_units(rest, first)
    if form == "psm":
        parts = [Rope(PREFIX), prefix, Rope(SUFFIX), suffix, Rope(MIDDLE), middle]
    else:
        parts = [Rope(SUFFIX), suffix, Rope(PREFIX), prefix, Rope(MIDDLE), middle]
    out = EMPTY
    for p in parts:
        out = concat(out, p)
    return out, prefix.chars, middle.chars


def restore(output: str, form: str, leaf: int = LEAF) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    rest, parts = rope(output, leaf), []
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        before, rest = split_chars(rest, find(rest, mark))
        parts.append(before)
        rest = split_chars(rest, len(mark))[1]
    _, a, b = parts
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return str(concat(concat(prefix, rest), suffix))


def draws(doc_id: object, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(
    text: str, doc_id: object, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, leaf: int = LEAF
) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (none if plain), and the output of one text."""
    doc = rope(text, leaf)
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = doc.units
    if not text or h3 % 100 >= fim_percent or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm_percent else "psm"
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    out, prefix, middle = arrange(doc, form, *cuts)
    return n, form, prefix, middle, str(out)


def fill_in_middle(
    docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """Each document rearranged for filling in its middle: id, n (units), form, prefix_chars, middle_chars, output.

    Units are runs of A-Z and a-z, and every other code point by itself. Two ranks drawn from the id and ``seed`` cut a
    text into prefix, middle and suffix. Forms: psm is ``<P>``prefix``<S>``suffix``<M>``middle, spm
    ``<S>``suffix``<P>``prefix``<M>``middle; plain, the text itself, takes those beyond ``fim_percent``, empty texts and
    texts that contain a sentinel. Null texts are empty; a null id is drawn as an empty one; repeated rows get one result
    each, and rows that share an id share its draws. No rows give no rows. Other columns are ignored. No shuffle; a batch
    of texts and one text's tree are in memory, whole texts of any length.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(
        f"`{id_col}` AS id", f"cast(`{id_col}` AS string) AS seeded", f"coalesce(`{text_col}`, '') AS text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [
                    transform(text, own, seed, fim_percent, spm_percent)
                    for own, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
                ]
                n, form, prefix, middle, out = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()), pa.array(out, pa.string())
                    ],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
                )

    return rows.mapInArrow(
        run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    ).withColumnRenamed("id", id_col)


def restored(formed: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``formed`` with a column ``restored``: the exact text, rebuilt from output and form alone.

    Its other columns stay; a null output or form gives null. An output without its sentinels is an error of the caller.
    """
    small_batches(formed.sparkSession)
    from pyspark.sql import types as T

    at, form_at = formed.columns.index(output_col), formed.columns.index(form_col)
    schema = T.StructType([*formed.schema.fields, T.StructField("restored", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = [
                    None if out is None or form is None else restore(out, form)
                    for out, form in zip(b.column(at).to_pylist(), b.column(form_at).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    return formed.mapInArrow(run, schema)
