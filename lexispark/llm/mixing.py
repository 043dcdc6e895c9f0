"""Mixing sources to target weights by temperature.

A source's share of tokens is raised to an exponent: 1 keeps the shares, 0 makes them equal. The exponent is bisected
until the weights have the target entropy, or until no source is repeated more often than a limit. The weights are then
realised under a token budget: a source's rows lie in blocks, each epoch is a keyed permutation of the blocks, whole
epochs come first and the last one ends inside one block, at one row.

Only DataFrame and SQL functions run here. Sources never sit in one task: what is summed is dealt by source and block
and pre-aggregated; a running sum of rows is needed only inside the one block where a source's budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import broadcast_if_small, cut

BLOCKS = 4096


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: float
    rows: DataFrame


def _tokens(text: Column) -> Column:
    """Runs of other characters than white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def find_exponent(
    sums: DataFrame, entropy: float | None, repetition: float | None, budget: float | None, steps: int = 31,
    passes: int = 7
) -> tuple[float, float]:
    """The exponent and the budget for a table of source sums (column ``tokens``, all above 0).

    Entropy and repetition fall as the exponent rises, so each pass keeps the one of ``steps`` + 1 intervals in which
    the target is crossed: several bisections at once. A pass is one aggregate over the sources and returns one row.
    Without a budget, the least repeated source is used exactly once.
    """
    top = sums.agg(F.max("tokens").alias("t"), F.sum("tokens").alias("all"), F.count("*").alias("n")).first()
    if not top["n"]:
        return 1.0, 0.0
    ratio = F.col("tokens") / F.lit(float(top["t"]))

    def measured(exponents: list[float]) -> list[dict]:
        aggs = []
        for k, a in enumerate(exponents):
            p = F.pow(ratio, F.lit(a))
            aggs += [
                F.sum(p).alias(f"z{k}"), F.sum(p * F.log(p)).alias(f"e{k}"), F.max(p / ratio).alias(f"hi{k}"),
                F.min(p / ratio).alias(f"lo{k}")
            ]
        r = sums.agg(*aggs).first()
        out = []
        for k in range(len(exponents)):
            z, e, hi, lo = (r[f"{x}{k}"] for x in ("z", "e", "hi", "lo"))
            used = budget if budget is not None else z / lo * top["t"]
            out.append({"entropy": math.log(z) - e / z, "repetition": used / top["t"] * hi / z, "budget": used})
        return out

    key, target = ("entropy", entropy) if entropy is not None else ("repetition", repetition)
    lo, hi = 0.0, (4.0 if entropy is not None else 1.0)
    if target is None:
        return 1.0, measured([1.0])[0]["budget"]
    ends = measured([lo, hi])
    if ends[0][key] <= target:
        hi = lo
    elif ends[1][key] >= target:
        lo = hi
    for _ in range(passes if lo < hi else 0):
        grid = [lo + (hi - lo) * (k + 1) / (steps + 1) for k in range(steps)]
        over = [m[key] > target for m in measured(grid)]
        at = over.index(False) if False in over else steps
        lo, hi = (grid[at - 1] if at else lo), (grid[at] if at < steps else hi)
    return hi, measured([hi])[0]["budget"]


def mix_sources(
    docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: float | None = None, block_tokens: int = 1 << 20, seed: int = 1,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Mix the rows' sources; give a target entropy (in nats) or a limit to repetition (epochs of any source).

    The rows of the result are input rows with all their columns and mix_epoch, mix_block, mix_rank and mix_tokens,
    once for each time they are used; reading them by (mix_epoch, mix_rank) gives each source's block permutation.
    Columns of these names are replaced. Without a budget, the least repeated source is used once, so every row
    appears. With one, a source's last epoch ends at the row with which it would go beyond. A null source is a source
    of its own. Rows without tokens cost nothing and appear once. Rows equal in id and text share one place, so they
    are used equally often. An empty table gives no rows; targets out of reach give the nearest exponent in 0 to 1 (4
    for an entropy).
    """
    new = ["mix_epoch", "mix_block", "mix_rank", "mix_tokens"]
    rows = docs.drop(*new)
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    source = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    # The row travels in one column, so that its names can't meet those used here.
    keyed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), source.alias("__source"),
        hashed.alias("__hash"), F.col(text_col).alias("__text")
    )
    fine = F.pmod("__hash", F.lit(BLOCKS)).cast("int")
    counted = keyed.select("__source", "__hash", fine.alias("fine"), _tokens(F.col("__text")).alias("tokens"))
    cells = cut(counted.where("tokens > 0").groupBy("__source", "fine").agg(F.sum("tokens").alias("tokens")))
    sums = cut(cells.groupBy("__source").agg(F.sum("tokens").alias("tokens")))
    exponent, total = find_exponent(sums, entropy, repetition, budget)
    top = sums.agg(F.max("tokens")).first()[0] or 1
    weighed = sums.withColumn("p", F.pow(F.col("tokens") / F.lit(float(top)), F.lit(exponent)))
    z = weighed.agg(F.sum("p")).first()[0] or 1.0
    # Blocks: a power of two for each source, so that a fine cell lies in one block.
    blocks = F.pow(
        F.lit(2.0),
        F.ceil(F.log2(F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCKS)), F.col("tokens") / block_tokens))))
    ).cast("int")
    plan = weighed.select(
        "__source", F.col("tokens").alias("own"), (F.col("p") / F.lit(z) * F.lit(total)).alias("quota"),
        blocks.alias("blocks")
    )
    plan = plan.withColumn("epochs", F.floor(F.col("quota") / F.col("own") + F.lit(1e-9)).cast("int"))
    plan = cut(plan.withColumn("left", F.greatest(F.lit(0.0), F.col("quota") - F.col("epochs") * F.col("own"))))
    by_block = cells.join(plan, "__source").withColumn("block", F.pmod("fine", "blocks")).groupBy(
        "__source", "block", "blocks", "epochs", "left"
    ).agg(F.sum("tokens").alias("tokens"))
    place = lambda epoch: F.xxhash64(F.lit(seed + 1), epoch, F.col("__source"), F.col("block"))
    # At most BLOCKS rows for a source.
    w = Window.partitionBy("__source").orderBy(place(F.col("epochs") + 1), "block")
    placed = by_block.withColumn("until", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.col("left") - (F.col("until") - F.col("tokens"))
    placed = cut(
        placed.select(
            "__source", "block", "epochs",
            F.when(
                room >= F.col("tokens"), F.lit(None).cast("double")
            ).otherwise(F.greatest(room, F.lit(0.0))).alias("room")
        )
    )
    # The blocks in which a budget ends: one for each source. Rows there, in the order of their hash, up to the budget.
    ends = broadcast_if_small(placed.where("room > 0").select("__source", "block", "room"))
    n_sources = broadcast_if_small(plan.select("__source", "blocks"))
    inside = keyed.withColumn("__fine", fine).join(n_sources, "__source").withColumn(
        "block", F.pmod("__fine", "blocks")
    )
    inside = inside.join(ends, ["__source", "block"]).select(
        "__source", "block", "room", "__hash", _tokens(F.col("__text")).alias("tokens")
    )
    run = Window.partitionBy("__source", "block").orderBy("__hash").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn(
        "sum", F.sum("tokens").over(run)
    ).where("sum <= room").groupBy("__source", "block").agg(F.max("__hash").alias("last"))
    # What each block gives, in one small table: blocks of all sources, BLOCKS at most for each.
    gives = broadcast_if_small(
        cut(
            placed.join(last, ["__source", "block"], "left").select(
                "__source", "block", "epochs", F.col("room").isNull().alias("whole"), "last"
            )
        )
    )
    out = keyed.withColumn("__fine", fine).join(n_sources, "__source", "left").withColumn(
        "block", F.coalesce(F.pmod("__fine", "blocks"), F.lit(0))
    )
    out = out.join(gives, ["__source", "block"], "left").withColumn("mix_tokens", _tokens(F.col("__text")))
    extra = F.coalesce(F.col("whole") | (F.col("__hash") <= F.col("last")), F.lit(False)).cast("int")
    times = F.when(F.col("mix_tokens") == 0, 1).otherwise(F.coalesce("epochs", F.lit(0)) + extra)
    out = out.withColumn("__times", times).where("__times > 0").withColumn(
        "mix_epoch", F.explode(F.sequence(F.lit(1), F.col("__times")))
    )
    out = out.withColumns({"mix_rank": place(F.col("mix_epoch")), "mix_block": F.col("block")})
    return Mix(exponent, total, out.select("__row.*", *new))
