"""Which files are read and indexed: priority, exact duplicates, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexispark.functions.paths import is_noise, priority
from lexispark.operators.folds import Budget, sorted_fold
from lexispark.scratch import cut


def keep_first(rows: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return rows.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    ).where("__n = 1").drop("__n")


def exact_duplicates(rows: DataFrame, text: str, id_col: str) -> DataFrame:
    """Each row's digest, the smallest id with the same text, and whether it is that one."""
    digest = F.sha2(F.col(text).cast("binary"), 256)
    keyed = rows.withColumn("digest", digest)
    first = keyed.groupBy("digest").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
    return keyed.join(first, "digest").withColumn("is_first", F.col(id_col) == F.col("first_id"))


#: Rows that are folded in one pass, a group at a time; more are taken in rounds.
FEW = 10_000


def _budgeted(
    rows: DataFrame, keys: list[str], order: list[str | Column], size: str, most_rows: int, most_size: int,
    few: int = FEW
) -> DataFrame:
    """Rows with ``taken``: in order, each that fits into what its group has left of two budgets; others are passed over.

    In a round the running sum of sizes goes through all of a group's rows that are undecided, in ranges side by side, and
    the longest run that fits is taken. The next row is larger than the room that is left, and so are all that will not
    be looked at again; the others go into the next round. Once at most ``few`` rows are left they are folded as a
    stream, with what their groups have left.
    """
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(ranged.withColumns({"__n": F.monotonically_increasing_id(), "__p": F.spark_partition_id()}))
    open_ = placed.where(F.col(size) <= most_size).select(*keys, "__n", "__p", F.col(size).alias("__s"))
    left = open_.select(*keys).distinct().withColumns(
        {"__room": F.lit(most_size).cast("bigint"), "__rows": F.lit(most_rows).cast("bigint")}
    )
    left, taken = cut(left), []
    while open_.limit(few + 1).count() > few:
        sums = open_.groupBy(*keys, "__p").agg(F.sum("__s").alias("s"), F.count("*").alias("c"))
        before = Window.partitionBy(*keys).orderBy("__p")  # a row for each range
        starts = sums.select(
            *keys, "__p", (F.sum("s").over(before) - F.col("s")).alias("__s0"), (F.sum("c").over(before) - F.col("c")).alias("__c0")
        )
        run = Window.partitionBy(*keys, "__p").orderBy("__n")
        state = left.join(starts, keys)
        held = open_.withColumns({"__s1": F.sum("__s").over(run), "__c1": F.row_number().over(run)}).join(state, [*keys, "__p"])
        fits = (F.col("__s0") + F.col("__s1") <= F.col("__room")) & (F.col("__c0") + F.col("__c1") <= F.col("__rows"))
        marked = cut(held.select(*keys, "__n", "__p", "__s", fits.alias("fits")))
        won = marked.where("fits")
        taken.append(won.select("__n"))
        spent = won.groupBy(*keys).agg(F.sum("__s").alias("s"), F.count("*").alias("c"))
        left = cut(
            left.join(spent, keys, "left").select(
                *keys, (F.col("__room") - F.coalesce("s", F.lit(0))).alias("__room"),
                (F.col("__rows") - F.coalesce("c", F.lit(0))).alias("__rows")
            ).where("__rows > 0")
        )
        open_ = cut(marked.where("NOT fits").join(left, keys).where("__s <= __room").select(*keys, "__n", "__p", "__s"))
    rest = open_.join(left, keys)
    names = rest.columns
    fold = sorted_fold(
        rest, keys, ["__n"], lambda: Budget(*(names.index(c) for c in ("__s", "__room", "__rows"))), "taken boolean"
    ).where("taken").select("__n")
    all_taken = reduce(DataFrame.unionByName, [*taken, fold])
    return placed.join(all_taken.withColumn("__t", F.lit(True)), "__n", "left").select(
        *rows.columns, F.coalesce("__t", F.lit(False)).alias("taken")
    )


def budget_fold(
    rows: DataFrame, group: list[str], order: list[str], size: str, most_rows: int, most_size: int, few: int = FEW
) -> DataFrame:
    """Take rows of each group in order while budgets last; a row that is too large is passed over, not the end.

    Rows: the group's columns, the order's columns, size, taken. A null size is not taken.
    """
    return _budgeted(rows.select(*group, *order, size), group, [*order, size], size, most_rows, most_size, few)


def select_files(
    files: DataFrame, max_files: int = 5000, max_file_bytes: int = 2_097_152, max_index_bytes: int = 209_715_200,
    folders_given: bool = False, few: int = FEW
) -> DataFrame:
    """The disposition of each file (path, content): noise, oversized, duplicate, budget or selected.

    Files go by priority, then path in the order of a dictionary. Too large files and such with NUL are oversized; a file
    with the content of a selected one is a duplicate; what is passed over for its size is not remembered. position
    counts the selected files from 0.

    Of equal contents only the first can be selected: where it is passed over, the others, of the same size, are as well.
    So the budget runs over one file of each content, by names and sizes.
    """
    size = F.octet_length("content").cast("bigint")
    rows = files.withColumns(
        {
            "bytes": size, "digest": F.sha2(F.col("content").cast("binary"), 256),
            "priority": priority(F.col("path"), size)
        }
    )
    noise = F.lit(False) if folders_given else is_noise(F.col("path"))
    large = (F.col("bytes") > max_file_bytes) | F.contains("content", F.lit("\u0000"))
    rows = rows.withColumns({"noise": noise, "large": large})
    order = [F.desc("priority"), F.collate(F.col("path"), "UNICODE"), "path"]
    usable = rows.where("not noise and not large").select("path", "digest", "bytes", "priority")
    firsts = keep_first(usable, ["digest"], order).withColumn("g", F.lit(1))
    chosen = _budgeted(firsts, ["g"], order, "bytes", max_files, max_index_bytes, few).select(
        "digest", F.col("path").alias("first_path"), "taken"
    )
    mark = F.when(~F.col("taken"), "budget").when(F.col("path") == F.col("first_path"), "selected").otherwise("duplicate")
    marks = usable.join(chosen, "digest").select("path", "priority", mark.alias("mark"))
    selected = marks.where("mark = 'selected'")  # at most max_files, so their places come from one partition
    places = selected.select("path", (F.row_number().over(Window.orderBy(*order)) - 1).alias("position"))
    out = rows.join(marks.select("path", "mark"), "path", "left").join(places, "path", "left")
    return out.select(
        "path", "content", "bytes", "priority", "position",
        F.when(F.col("noise"), "noise").when(F.col("large"), "oversized").otherwise(F.col("mark")).alias("disposition")
    )


def _counters() -> list[Column]:
    of = lambda d: F.count_if(F.col("disposition") == d)
    return [
        F.count("*").alias("candidate_files"), of("selected").alias("selected_files"), of("noise").alias("noise_files"),
        of("duplicate").alias("duplicate_files"), of("oversized").alias("oversized_files"),
        of("budget").alias("budget_skipped_files"),
        F.coalesce(F.sum(F.when(F.col("disposition") == "selected", F.col("bytes"))), F.lit(0)).alias("total_bytes")
    ]


def selection_counts(selected: DataFrame) -> DataFrame:
    """How many files came, and what became of them."""
    return selected.agg(*_counters())


def write_selected(selected: DataFrame, path: str) -> DataFrame:
    """Write the selected files and return ``selection_counts``, counted in the pass that writes: one scan in all."""
    seen = Observation("selection")
    selected.observe(seen, *_counters()).where("disposition = 'selected'").write.mode("overwrite").parquet(path)
    counts = seen.get
    names = ", ".join(f"{c} bigint" for c in counts)
    return selected.sparkSession.createDataFrame([tuple(counts.values())], names)
