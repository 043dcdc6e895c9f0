"""A keyed table that takes new rows as small files, and is read as if they had replaced the old ones."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "version bigint, kind string, at string"


@dataclass(frozen=True)
class KeyedTable:
    """Rows by key below a folder: a base and the batches that came after it, each in a folder of its own.

    A batch is written whole before the log names it, so readers see all of it or nothing. One writer at a time.
    """

    spark: SparkSession
    root: str
    key: tuple[str, ...]

    def log(self) -> list:
        """What has been written, in order: a row a batch since the last base at least."""
        rows = self.spark.read.schema(LOG).json(f"{self.root}/log").orderBy("version").collect()
        bases = [i for i, r in enumerate(rows) if r["kind"] == "base"]
        return rows[bases[-1] :] if bases else rows

    def _commit(self, rows: DataFrame, kind: str, version: int) -> None:
        at = f"{self.root}/{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        self.spark.createDataFrame([(version, kind, at)], LOG).coalesce(1).write.mode("append").json(f"{self.root}/log")

    def create(self, rows: DataFrame) -> None:
        """The first base."""
        self._commit(self._last(rows.withColumn("__version", F.lit(0))), "base", 0)

    def upsert(self, rows: DataFrame) -> None:
        """Rows that replace those of their keys; what is written is this batch. Of rows with one key any one counts."""
        self._commit(rows.dropDuplicates(list(self.key)), "delta", self.log()[-1]["version"] + 1)

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of the latest version."""
        w = Window.partitionBy(*self.key).orderBy(F.desc("__version"))
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__version")

    def read(self) -> DataFrame:
        """The table as it is now: base and batches, merged by key."""
        every = None
        for r in self.log():
            part = self.spark.read.parquet(r["at"]).withColumn("__version", F.lit(r["version"]))
            every = part if every is None else every.unionByName(part, allowMissingColumns=True)
        return self._last(every)

    def compact(self) -> None:
        """Write what ``read`` gives as a new base; batches before it are not read again."""
        self._commit(self.read(), "base", self.log()[-1]["version"] + 1)
