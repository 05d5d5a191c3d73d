from pyspark.sql import functions as F

from tidemill.functions import ordering


def numbers(df, *order, **options):
    return sorted(tuple(r) for r in ordering.in_order(df, *order, **options).collect())


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"), F.lit("x").alias("_c0"), F.lit(2).alias("_number"))
    assert numbers(df, "id", first=1) == [(i, "x", 2, i + 1) for i in range(1000)]
    assert numbers(df, -F.col("id"))[0] == (0, "x", 2, 999)


def test_numbers_in_groups_with_nulls_and_copies(spark):
    rows = [("a", 2), ("a", None), ("a", 2), ("b", 1), (None, 5), (None, 4), ("a", 1)]
    found = ordering.in_order(spark.createDataFrame(rows, "g string, v int"), "v", name="n", by=("g",)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("a", None, 0), ("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 0), (None, 4, 0), (None, 5, 1)], key=str)
    assert numbers(spark.createDataFrame([], "g string, v int"), "v") == []


def test_one_time_fills_many_partitions(spark, monkeypatch):
    """A tenth of the rows share one time, and a tenth are equal in all columns; no partition holds more than its share."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        ts = F.when(F.col("id") % 10 == 0, F.lit(7)).otherwise(F.col("id"))
        df = spark.range(40_000).repartition(8, "id").select(ts.alias("ts"), F.when(F.col("id") % 10 == 1, -1).otherwise(F.col("id")).alias("id"))
        df = df.withColumn("ts", F.when(F.col("id") == -1, 9).otherwise(F.col("ts")))
        sizes = []
        write = ordering.scratch
        monkeypatch.setattr(ordering, "scratch", lambda s, tag: sizes.append(write(s, tag)) or sizes[-1])
        found = ordering.in_order(df, "ts", "id", name="n").orderBy("n").collect()
        assert [r["n"] for r in found] == list(range(40_000))
        assert [(r["ts"], r["id"]) for r in found] == sorted((r["ts"], r["id"]) for r in found)
        parts = spark.read.parquet(sizes[0]).groupBy(F.shiftright("_place", 33).alias("p")).count().collect()
        assert len(parts) > 30 and max(r["count"] for r in parts) < 4 * 40_000 / 40
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
