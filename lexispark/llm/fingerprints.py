"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines, long ones cut at the ends of sentences, long sentences at word ends) are hashed. A sketch is
a table of cells; each digest goes to one cell in each of three parts, and a cell keeps how many digests it has and their
xor. A digest carries a check of itself, so a cell with one digest is told from one with several. Tables of the same
width subtract cell by cell, so what two versions share vanishes. Peeling recovers the rest: a cell with one digest names
it, and taking the digest out of its other cells opens more.

Widths are powers of two, and the cells of a table are those of any wider one with the same digests, added up; so a
fingerprint holds one wide table, cells without digests left out, and narrower ones fold out of it. Two fingerprints are
compared in a narrow table first; where that can't be peeled empty, in the widest that both have.

Everything here is DataFrame and SQL functions on arrays within a row: no shuffle but the one that brings each text its
successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import broadcast_if_small, cut

PARTS = 3
LEAST, STEP = 1024, 16  # widths are LEAST times a power of STEP, and at least ROOM times the digests
ROOM = 32
ROUNDS = 24
#: After 60 characters up to a sentence end or the line's; where that is over 180 more away, up to a space after one of
#: four letters (a place that the words choose, so it is found again after an edit), or else 180 more.
PARAGRAPH = r"[^\n]{1,60}(?:[^\n.!?]{0,180}(?:[.!?]+|(?![^\n]))|[^\n.!?]{0,180}?[aest] |[^\n.!?]{0,180})"
COARSE = 255
CELLS = "array<struct<c:bigint,n:bigint,x:bigint>>"


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _marked(high: Column) -> Column:
    """A digest: 48 bits, and 16 bits that check them."""
    return high.bitwiseOR(F.xxhash64(high, F.lit(7)).bitwiseAND(F.lit(0xFFFF)))


def _valid(x: Column) -> Column:
    return _marked(x.bitwiseAND(_long(~0xFFFF))) == x


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for a text of line ends only."""
    high = F.transform(
        F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)),
        lambda p: F.xxhash64(p).bitwiseAND(_long(~0xFFFF))
    )
    return F.array_distinct(F.transform(high, _marked))


def width_for(n: Column) -> Column:
    """The width of the table for n digests."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(12)), _long(LEAST), lambda w, _: F.when(w < n * ROOM, w * STEP).otherwise(w)
    )


def _cell(x: Column, part: int, w: Column) -> Column:
    return w * part + F.xxhash64(x, F.lit(part)).bitwiseAND(w - 1)


def _spread(xs: Column, w: Column, n: int) -> Column:
    """Entries of digests for all parts, each with the count n."""
    one = lambda x, j: F.struct(_cell(x, j, w).alias("c"), _long(n).alias("n"), x.alias("x"))
    return F.flatten(F.transform(xs, lambda x: F.array(*[one(x, j) for j in range(PARTS)])))


def _added(entries: Column) -> Column:
    """Entries of the same cell added up; cells that have become empty go. Sorted by cell."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["c"] != F.get(s, i - 1)["c"])
        )

        def cell(begin: Column, end: Column) -> Column:
            first = F.get(s, begin)
            more = F.aggregate(
                F.sequence(begin + 1, end - 1), first,
                lambda a, i: F.struct(
                    a["c"].alias("c"), (a["n"] + F.get(s, i)["n"]).alias("n"),
                    a["x"].bitwiseXOR(F.get(s, i)["x"]).alias("x")
                )
            )
            return F.when(end == begin + 1, first).otherwise(more)

        made = _bound(starts, lambda st: F.transform(st, lambda b, k: cell(b, F.coalesce(F.get(st, k + 1), F.size(s)))))
        return F.filter(made, lambda t: (t["n"] != 0) | (t["x"] != 0))

    none = F.array().cast(CELLS)
    return _bound(F.sort_array(entries), lambda s: F.when(F.size(s) == 0, none).otherwise(runs(s)))


def table(xs: Column) -> Column:
    """The sketch of an array of digests: how many they are, the width, and the cells that aren't empty."""
    return _bound(
        xs,
        lambda d: _bound(
            width_for(F.size(d)),
            lambda w: F.struct(F.size(d).cast("bigint").alias("n"), w.alias("w"), _added(_spread(d, w, 1)).alias("cells"))
        )
    )


def as_text(sketch: Column) -> Column:
    """A sketch as text: digests:width:cells, all in hex, a cell as place,count,xor."""
    cells = F.transform(sketch["cells"], lambda t: F.concat_ws(",", F.hex(t["c"]), F.hex(t["n"]), F.hex(t["x"])))
    return F.concat_ws(":", F.hex(sketch["n"]), F.hex(sketch["w"]), F.array_join(cells, "."))


def _folded(sketch: Column, w: Column, sign: int) -> Column:
    """Entries of a sketch in a narrower table, each cell's count times the sign."""
    own = sketch["w"]
    part = lambda c: F.floor(c / own).cast("bigint")
    return F.transform(
        sketch["cells"],
        lambda t: F.struct(
            (part(t["c"]) * w + t["c"].bitwiseAND(w - 1)).alias("c"), (t["n"] * sign).alias("n"), t["x"].alias("x")
        )
    )


def _peeled(cells: Column, w: Column) -> Column:
    """What is left of a subtracted table after peeling (``cells``), and how many digests came off (``found``).

    Steps take turns: one names the digests of cells that have a single one, the next takes them out.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), _long(0).alias("found"), none.alias("plus"), none.alias("minus"))

    def of(s: Column, sign: int) -> Column:
        own = lambda t: F.array(*[_cell(t["x"], j, w) for j in range(PARTS)])
        pure = F.filter(
            s["cells"], lambda t: (t["n"] == sign) & _valid(t["x"]) & F.array_contains(own(t), t["c"])
        )
        return F.array_distinct(F.transform(pure, lambda t: t["x"]))

    def step(s: Column) -> Column:
        named = F.size(s["plus"]) + F.size(s["minus"])
        name = F.struct(
            s["cells"].alias("cells"), s["found"].alias("found"), of(s, 1).alias("plus"), of(s, -1).alias("minus")
        )
        take = F.struct(
            _added(F.concat(s["cells"], _spread(s["plus"], w, -1), _spread(s["minus"], w, 1))).alias("cells"),
            (s["found"] + named).cast("bigint").alias("found"), none.alias("plus"), none.alias("minus")
        )
        return F.when(named == 0, name).otherwise(take)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * ROUNDS)), start,
        lambda s, _: F.when(F.size(s["cells"]) == 0, s).otherwise(step(s))
    )


def _left(cells: Column, w: Column) -> Column:
    """The least number of digests that a table which can't be peeled still holds: the fullest part's counts, two for
    a cell in which they cancel out."""
    held = lambda t: F.when(t["n"] == 0, _long(2)).otherwise(F.abs(t["n"]))
    of = lambda j: F.aggregate(
        F.filter(cells, lambda t: F.floor(t["c"] / w) == j), _long(0), lambda a, t: a + held(t)
    )
    return F.greatest(*[of(j) for j in range(PARTS)])


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Rows with ``name``: the digests that two sketches share over all that they have, 1 if neither has any.

    It takes the sketches alone. They are subtracted and peeled in a table of a sixteenth of the smaller width, then, if
    that fails, in one of the smaller width. The latter holds 32 times the digests of the smaller sketch at least, so it
    can fail only where the other has some 70 times as many; then the least number of differing digests that the rest
    can hold counts, which is off by less than the smaller sketch's.
    """
    x, y, kept = F.col(a), F.col(b), rows.columns
    widest = F.least(x["w"], y["w"])
    w, cells, peeled, left = (F.col(f"__{c}") for c in ("w", "cells", "peeled", "left"))
    out = rows.withColumns({"__n": x["n"] + y["n"], "__d": _long(0), "__left": _long(1)})
    for width in ((widest / STEP).cast("bigint"), widest):
        out = out.withColumn("__w", width)
        out = out.withColumn(
            "__cells",
            F.when(left > 0, _added(F.concat(_folded(x, w, 1), _folded(y, w, -1)))).otherwise(F.array().cast(CELLS))
        )
        out = out.withColumn("__peeled", F.when(left > 0, _peeled(cells, w)))
        out = out.withColumns(
            {
                "__d": F.when(left > 0, peeled["found"]).otherwise(F.col("__d")),
                "__left": F.when(left > 0, _left(peeled["cells"], w)).otherwise(left)
            }
        )
    n, d = F.col("__n"), F.col("__d") + left
    return out.withColumn(name, F.when(n == 0, 1.0).otherwise((n - d) / (n + d))).select(*kept, name)


def with_next(docs: DataFrame, columns: list[str], bucket_chars: int = 1_000_000) -> DataFrame:
    """Rows (id, text, ...) with ``next``, a struct of ``columns`` of the row that follows by descending id.

    After the last comes the first; null ids are last; rows of equal ids go by the hash of their text. Ids are dealt
    into ranges of about ``bucket_chars`` characters, and each range's first row is given to the range before as well,
    so there is no order over all rows in one task.
    """
    marks = [(i + 1) / (COARSE + 1) for i in range(COARSE)]
    got = docs.agg(
        F.sum(F.length("text")).alias("chars"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.percentile_approx("id", marks, 10_000).alias("edges")
    ).first()
    edges = sorted({int(e) for e in got["edges"] or []} | ({int(got["lo"])} if got["lo"] is not None else set()))
    fine = max(1, (got["chars"] or 0) // (bucket_chars * (COARSE + 1)) + 1)
    if edges:
        ends = [*edges[1:], int(got["hi"]) + 1]
        k = F.size(F.filter(F.lit(edges).cast("array<bigint>"), lambda e: e <= F.col("id"))) - 1
        lo, hi = F.get(F.lit(edges).cast("array<bigint>"), k), F.get(F.lit(ends).cast("array<bigint>"), k)
        inner = F.floor((F.col("id") - lo) / (hi - lo) * fine) if fine > 1 else F.lit(0)
        bucket = F.coalesce((k * F.lit(fine) + inner).cast("bigint"), F.lit(-1).cast("bigint"))
    else:
        bucket = F.lit(-1).cast("bigint")
    placed = docs.withColumn("bucket", bucket)
    # A row for each range. Ranges follow each other within the 256 coarse parts, and these in a list on the driver.
    firsts = cut(
        placed.groupBy("bucket").agg(F.max("id").alias("first_id")).withColumn(
            "coarse", F.floor(F.col("bucket") / fine)
        )
    )
    parts = firsts.groupBy("coarse").agg(F.min("bucket").alias("lo")).orderBy(F.desc("coarse")).collect()
    above = {r["coarse"]: parts[k - 1]["lo"] for k, r in enumerate(parts)}  # of the first part, the last
    from_above = F.element_at(
        F.create_map(*[F.lit(x) for kv in above.items() for x in kv]), F.col("coarse")
    ) if above else F.lit(None).cast("bigint")
    order = Window.partitionBy("coarse").orderBy(F.desc("bucket"))
    before = broadcast_if_small(
        cut(firsts.withColumn("before", F.coalesce(F.lag("bucket").over(order), from_above)).drop("coarse"))
    )
    also = placed.join(before, "bucket")
    is_first = F.col("id").eqNullSafe(F.col("first_id"))
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    there = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    both = also.withColumn(
        "at", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here)))
    ).drop("bucket", "first_id", "before").select("*", "at.bucket", "at.guest").drop("at")
    w = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    return both.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("NOT guest").drop("bucket", "guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited version, and their likeness.

    The edited text has the last third of its code points (rounded down) replaced by as many first ones of the next
    document, or all if it has fewer; next is by descending id, and the first follows the last. Returns for each row:
    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: the share of paragraph
    digests that two texts have in common, found from the two fingerprints alone. Null texts are empty; two texts
    without paragraphs have likeness 1, one with and one without 0. Repeated paragraphs count once. Null ids come last;
    of rows that share an id, the smaller hash of the text comes first, and repeated rows are documents of their own. No
    rows give no rows. Other columns are left out. A text is handled within its row: one of n paragraphs takes memory
    for some ten cells each.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("a", digests(F.col("text"))), ["text", "a"])
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.col("next.text"), F.lit(1), k))
    rows = rows.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "a", F.col("next.a").alias("f"))
    rows = rows.select(
        "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), table(F.col("a")).alias("a"),
        table(digests(F.col("edited"))).alias("e"), table(F.col("f")).alias("f")
    )
    rows = with_likeness(with_likeness(rows, "a", "e", "near_edited"), "a", "f", "near_next")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next"
    )
