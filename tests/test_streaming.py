from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import tuples
from tidemill.streaming import runs

SCHEMA = "tuple_id long, key string, value string"


def put(spark, path, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ids_are_remembered_across_restarts(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    pipeline = runs.Pipeline(lambda df: tuples.filter_literal(df, "a"))
    read = lambda: spark.readStream.schema(SCHEMA).parquet(src)
    put(spark, src, (1, "k", "a"), (2, "k", "b"), (1, "k", "a"))
    pipeline.stream(read(), out, state, "tuple_id")
    put(spark, src, (1, "k", "a"), (3, "k", "xa"))
    done = pipeline.stream(read(), out, state, "tuple_id")
    assert sorted(r["tuple_id"] for r in done.collect()) == [1, 3]


def test_pipelines_from_texts(spark):
    df = spark.createDataFrame([("k", "a,b,c,d"), ("k", "x,y")], "key string, value string")
    done = runs.Pipeline.parse("filter:a", "transform", stages=2).apply(df)
    assert [r["value"] for r in done.collect()] == ["a,b,c"]
    with pytest.raises(ValueError):
        runs.Pipeline.parse("identity", stages=2)
    assert runs.active(spark) == [] and not runs.stop(spark, "none")


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(3):
        put(spark, src, *[(i * 10 + j, "k", f"x,{j % 3}") for j in range(10)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    counted = runs.run_to_end(tuples.final_count(stream, 1), "complete")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, tuples.final_count(spark.read.parquet(src), 1).collect()))
    running = runs.run_to_end(runs.running_counts(tuples.grouped_by_field(stream, 1), order="tuple_id"))
    for grp, n in counted.collect():
        assert sorted(r["n"] for r in running.where(F.col("grp") == grp).collect()) == list(range(1, n + 1))


def test_silent_hosts_are_suspected_then_failed(spark, tmp_path):
    src, start = str(tmp_path / "src"), datetime(2024, 1, 1)
    kind = "host string, ts timestamp"
    for at, hosts in enumerate([["a", "b"], ["a"], ["a"], ["a"], ["a"]]):
        spark.createDataFrame([(h, start + timedelta(minutes=10 * at)) for h in hosts], kind).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    told = runs.run_to_end(runs.suspicions(stream, silence=900, expiry=600)).where("host = 'b'").orderBy("ts").collect()
    assert [r["status"] for r in told] == ["SUSPECTED", "FAILED"]
    assert told[0]["ts"] == start + timedelta(seconds=900)
