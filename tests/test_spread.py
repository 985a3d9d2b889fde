"""Tables of few files over all cores."""

from pyspark.sql import functions as F

from checks import base, corpus  # noqa: F401
from versewright.session import spread


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    path = str(tmp_path / "customer.parquet")
    spark.range(20_000).select(F.col("id").alias("c_custkey"), F.sha2(F.col("id").cast("string"), 256).alias("c_name")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        # Spark makes many pieces of the file, and the one with its row group has all rows.
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 8
        for d in (spread(spark.read.parquet(path), "c_custkey"), base.table(spark, str(tmp_path), "customer")):
            sizes = d.groupBy(F.spark_partition_id()).count().collect()
            assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 20_000 / 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_table_of_many_files_is_not_moved(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 8).write.parquet(path)
    d = spark.read.parquet(path)
    assert spread(d, "id") is d


def test_settings_are_read_once(spark):
    plan = base.QUERIES["metadata_settings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1
