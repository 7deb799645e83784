import pyarrow as pa
from pyspark.sql import functions as F

from quernel.functions.arrow import text_parts
from quernel.plans.shape import only_scans, spread
from quernel.sources.parquet import read_parquet


def test_scans_and_shuffles_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert only_scans(df.where("id > 3").select(F.explode(F.array("id", "id"))).union(df))
    assert not any(map(only_scans, (df.repartition(2), df.groupBy("id").count(), df.limit(3), spark.range(3), spark.createDataFrame([(1,)], "x int"), df.join(df.select("id"), "id"))))
    assert not only_scans(df.where(F.rand() < 0.5)) and not only_scans(df.select(F.monotonically_increasing_id()))
    cores = spark.sparkContext.defaultParallelism
    assert spread(df).rdd.getNumPartitions() == cores and sorted(r.id for r in spread(df).collect()) == list(range(100))
    spark.range(100).repartition(3 * cores).write.mode("overwrite").option("compression", "none").parquet(path)
    many = spark.read.option("mode", "x").parquet(path)
    assert only_scans(many)
    stream = spark.readStream.schema("id long").parquet(path)
    assert spread(stream) is stream


def test_schema_is_read_again_after_a_change(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert read_parquet(spark, path).columns == ["id"] == read_parquet(spark, path).columns
    assert read_parquet(spark, path).count() == 3
    spark.range(4).withColumn("x", F.lit("a")).write.mode("overwrite").parquet(path)
    assert read_parquet(spark, path).columns == ["id", "x"] and read_parquet(spark, path).count() == 4


def test_text_parts_keep_rows_whole():
    texts = [None, "a" * 10, "", "b" * 100, "c", None, "é" * 6]
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": texts})
    for most in (1, 11, 50, 1000):
        parts = list(text_parts(batch, 1, most))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert len(list(text_parts(batch, 1, 1000))) == 1 and list(text_parts(batch.slice(0, 0), 1, 5)) == []
