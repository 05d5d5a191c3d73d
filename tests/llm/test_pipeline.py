import corpus_pipeline as pipeline
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    kept = {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, DIR).write.parquet(path)
        docs = kept[name] = spark.read.parquet(path)
        if name != names[-1]:
            assert docs.columns == list(pipeline.COLUMNS)
    good = labels.where("quality = 1 and toxic = 0")
    filtered, unique, masked, mixed, packed = (kept[n] for n in names)
    assert filtered.join(labels.where("quality = 0"), "doc_id").count() <= 2
    assert filtered.join(good, "doc_id").count() >= 0.98 * good.count()
    assert unique.count() < filtered.count() and unique.select("text").distinct().count() == unique.count()
    assert masked.count() == unique.count() and masked.where(F.col("text").contains("[SECRET]")).count() > 0
    assert masked.where(F.col("text").rlike("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")).count() == 0
    clean = unique.join(good, "doc_id").select("doc_id")
    assert mixed.join(clean, "doc_id").select("doc_id").distinct().count() >= 0.95 * clean.count()
    assert mixed.join(labels.where("toxic = 1"), "doc_id").count() < 0.6 * unique.join(labels.where("toxic = 1"), "doc_id").count()
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d"))
    assert whole.where("n % d <> 0").count() == 0 and whole.count() == mixed.select("doc_id").distinct().count()


def test_stages_take_odd_rows(spark, odd, empty):
    for name, stage in pipeline.STAGES:
        for df in (odd, empty):
            held = df.toDF(*[c if c in ("doc_id", "text") else f"{c}_{i}" for i, c in enumerate(df.columns)])
            held = held.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
            found = stage(spark, held, "/root/testdata/sf0.001")
            assert found.count() >= 0, name
