"""Manifests, logs, catalogs and indexes as files: reading, appending, replacing, publishing."""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.identifiers import parse_repository, storage_key
from lexispark.operators.catalog import latest_events, progress_counters
from lexispark.operators.rerank import upsert

MANIFEST = (
    "schemaVersion int, id string, owner string, repo string, version string, repositoryUrl string, branch string, commitSha string, title string, description string, indexedAt string, checkedAt string, "
    "parserVersion string, sectionCount bigint, totalTokens bigint, rules array<string>, versions array<string>, "
    "selection struct<candidateFiles int, selectedFiles int, noiseFiles int, duplicateFiles int, oversizedFiles int, budgetSkippedFiles int>"
)
EVENT = "libraryId string, status string, error string, elapsedMs bigint, finishedAt string"


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All valid manifests of a folder, one JSON object in a file, with their storage key."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return rows.where(
        "schemaVersion = 1 AND id IS NOT NULL AND commitSha IS NOT NULL"
    ).withColumn("key", storage_key(F.col("id")))


def find_manifest(manifests: DataFrame, ident: str) -> DataFrame:
    """The manifest of a library id in any case."""
    return manifests.where(F.col("key") == storage_key(F.lit(ident)))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """The last event of each library in a log of JSON lines; blank and partial lines are left out."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")
    )
    parsed = lines.select(
        "file", "line", F.from_json("value", EVENT).alias("e")
    ).where("e.libraryId IS NOT NULL AND e.status IS NOT NULL").select("line", "e.*")
    return latest_events(parsed, F.lower("libraryId"), "line").drop("line")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def append_counted(events: DataFrame, path: str, target: int) -> DataFrame:
    """Append events and return their ``catalog.progress``, counted in the pass that writes them."""
    seen = Observation("progress")
    append_events(events.observe(seen, *progress_counters(target)), path)
    counts = seen.get
    return events.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The libraries of a catalog file; none if it is of another version."""
    rows = spark.read.option("multiLine", True).schema(
        "schemaVersion int, libraries array<struct<libraryId string, title string, description string, stars bigint, sources array<string>, score bigint, rank int>>"
    ).json(path)
    return rows.where("schemaVersion = 1").select(F.explode("libraries").alias("l")).select("l.*")


def write_report(report: DataFrame, folder: str, run: str) -> None:
    """A report under its run's name, which must be new, and as the latest."""
    report.write.mode("errorifexists").json(f"{folder}/run={run}")
    report.write.mode("overwrite").json(f"{folder}/latest")


def write_progress(snapshot: DataFrame, path: str) -> None:
    """The latest counts of a batch, in place of those before."""
    snapshot.coalesce(1).write.mode("overwrite").json(path)  # a row


def publish(spark: SparkSession, table: DataFrame, root: str, name: str) -> str:
    """Write a table as a new version and then point to it; readers see the old version or the new one, whole.

    A failed write leaves the pointer as it was.
    """
    at = f"{root}/{name}/versions/{uuid.uuid4().hex}"
    table.write.parquet(at)
    spark.createDataFrame(
        [(name, at)], "name string, at string"
    ).withColumn("published", F.current_timestamp()).write.mode("append").json(f"{root}/{name}/pointer")
    return at


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version of a table that was published last."""
    at = spark.read.schema(
        "name string, at string, published timestamp"
    ).json(f"{root}/{name}/pointer").orderBy(F.desc("published"), "at").first()["at"]
    return spark.read.parquet(at)


def upsert_published(spark: SparkSession, rows: DataFrame, root: str, name: str, key: list[str]) -> str:
    """Publish a table in which new rows replace those of their keys."""
    return publish(spark, upsert(published(spark, root, name), rows, key), root, name)


def import_libraries(current: DataFrame, bundle: DataFrame, key: str = "id", force: bool = False) -> DataFrame:
    """Libraries after an import: existing ones stay unless the import is forced."""
    return upsert(current, bundle, [key]) if force else current.unionByName(
        bundle.join(current.select(key), key, "left_anti")
    )


def valid_vectors(cache: DataFrame, commit: str, model: str) -> DataFrame:
    """Cached vectors of one commit and model; others are as good as deleted."""
    return cache.where((F.col("commit") == commit) & (F.col("model") == model)).drop("commit", "model")


def registry_repositories(packages: DataFrame) -> DataFrame:
    """Repositories that registry answers (registry, name, json) name: the first address that is one."""
    j = F.col("json")
    of = lambda *paths: F.coalesce(*[parse_repository(F.get_json_object(j, p)) for p in paths])
    ref = (
        F.when(F.col("registry") == "npm", of("$.repository.url", "$.repository"))
        .when(
            F.col("registry") == "pypi",
            of(
                "$.info.project_urls.Source", "$.info.project_urls.Repository", "$.info.project_urls.Code",
                "$.info.home_page"
            )
        )
        .when(F.col("registry") == "crates", of("$.crate.repository"))
    )
    return packages.select(
        "registry", "name", ref.alias("ref")
    ).where("ref IS NOT NULL").select("registry", "name", "ref.*")


class BuildLock:
    """One build of a library at a time over all processes of a machine: a file that is made only if it is not there.

    A lock whose process is gone, that can't be read, or that is older than an hour is taken over.
    """

    def __init__(self, path: str, wait_s: float = 600.0, poll_s: float = 0.25, stale_s: float = 3600.0):
        self.path, self.wait_s, self.poll_s, self.stale_s = path, wait_s, poll_s, stale_s

    def _stale(self) -> bool:
        try:
            with open(self.path) as f:
                pid, at = json.load(f)
            os.kill(int(pid), 0)
            return time.time() - float(at) > self.stale_s
        except FileNotFoundError:
            return False
        except PermissionError:  # another user's process lives
            return False
        except (ValueError, TypeError, OSError):
            return True

    def __enter__(self) -> BuildLock:
        end = time.monotonic() + self.wait_s
        while True:
            try:
                with open(self.path, "x") as f:
                    json.dump([os.getpid(), time.time()], f)
                return self
            except FileExistsError:
                if self._stale():
                    with contextlib.suppress(FileNotFoundError):
                        os.remove(self.path)
                elif time.monotonic() >= end:
                    raise TimeoutError(f"{self.path} is locked") from None
                else:
                    time.sleep(self.poll_s)

    def __exit__(self, *error: object) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(self.path)


class TtlCache:
    """Values that are good for a while."""

    def __init__(self, ttl_s: float = 86_400.0, clock=time.monotonic):
        self.ttl_s, self.clock, self.kept = ttl_s, clock, {}

    def get(self, key: str, make):
        at, value = self.kept.get(key, (None, None))
        if at is None or self.clock() - at >= self.ttl_s:
            at, value = self.clock(), make()
            self.kept[key] = (at, value)
        return value
