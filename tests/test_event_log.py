"""The event log as a data source: byte ranges, streams, appends that happen once."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F


from lexispark.sources.event_log import Range, _Writer, marks, ranges, read_range, use_event_log


def values(path, size):
    return [v for p in ranges(path, -1, 10**9, size) for b in read_range(path, p) for v in b.column(3).to_pylist()]


def test_any_ranges_give_every_line_once(tmp_path):
    rng = random.Random(4)
    lines = ["é" * rng.randrange(9) + str(k) for k in range(60)] + ["", "a\nb\rc", None]
    writer = _Writer(str(tmp_path))
    writer.commit([writer.write(iter([Row(value=x) for x in lines[k::3]])) for k in range(3)] + [None])
    want = sorted("a b c" if x == "a\nb\rc" else x for x in lines if x is not None)
    for size in (1, 2, 3, 7, 50, 10**6):
        assert sorted(values(str(tmp_path), size)) == want


def test_a_task_that_is_tried_again_adds_nothing(tmp_path):
    writer = _Writer(str(tmp_path))
    first = writer.write(iter([Row(value="x")]))
    again = writer.write(iter([Row(value="x")]))
    assert first.file != again.file and values(str(tmp_path), 9) == []
    writer.commit([again])
    assert values(str(tmp_path), 9) == ["x"]
    lost = writer.write(iter([Row(value="y")]))
    writer.abort([lost, None])
    assert values(str(tmp_path), 9) == ["x"] and not (tmp_path / "lines" / lost.file).exists()
    assert list(read_range(str(tmp_path), Range(0, again.file, 2, 2))) == []


def test_batches_and_streams_over_one_log(spark, tmp_path):
    use_event_log(spark)
    at = str(tmp_path / "log")
    read = lambda **o: spark.read.format("event_log").option("path", at).options(**o).load()
    assert read().count() == 0
    lines = spark.range(1000).select(F.to_json(F.struct("id", F.lit("é").alias("v"))).alias("value"))
    lines.repartition(4).write.format("event_log").option("path", at).mode("append").save()
    spark.createDataFrame([("{bad",)], "value string").write.format("event_log").option("path", at).mode("append").save()
    assert marks(at) == [0, 1]
    got = read(rangeBytes=512)
    assert got.rdd.getNumPartitions() > 20 and got.count() == 1001
    assert got.select(F.from_json("value", "id bigint").alias("e")).agg(F.sum("e.id")).first()[0] == 499_500
    assert got.select("append", "file", "start").distinct().count() == 1001

    def follow():
        spark.readStream.format("event_log").option("path", at).load().select("value").writeStream.format("json").option(
            "path", str(tmp_path / "out")
        ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema("value string").json(str(tmp_path / "out")).count()

    assert follow() == 1001
    spark.createDataFrame([(json.dumps({"id": -1}),)], "value string").write.format("event_log").option("path", at).mode("append").save()
    assert follow() == 1002 and follow() == 1002
    with pytest.raises(Exception, match="appended to"):
        lines.write.format("event_log").option("path", at).mode("overwrite").save()
