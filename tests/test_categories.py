"""Categories over all cells, where a stride sample would miss some."""

from pyspark.sql import functions as F

from gridloom.operators import reduce
from gridloom.plans.registry import QUERIES


def test_rare_and_strided_categories(spark, tmp_path):
    # 9,000 parts: a stride of 4 sees one value alone, and another value has one row only.
    i = F.col("p_partkey")
    size = F.when(i == 4321, 5).when(i % 4 == 1, 3).otherwise(1)
    spark.range(1, 9001).withColumnRenamed("id", "p_partkey").withColumn("p_size", size).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.v: r.n for r in QUERIES["categories"](spark, str(tmp_path)).collect()}
    assert got == {1.0: 6750, 3.0: 2249, 5.0: 1}


def test_category_list(spark):
    cells = spark.range(0, 10000).select(F.when(F.col("id") == 7777, 9.0).when(F.col("id") % 5 == 0, 1.0).otherwise(F.when(F.col("id") % 5 == 1, float("nan"))).alias("v"))
    assert reduce.categories(cells) == [1.0, 9.0]
    assert reduce.categories(cells.where("v = 1")) == []
    assert reduce.categories(spark.range(21).select(F.col("id").cast("double").alias("v"))) == []
    assert len(reduce.categories(spark.range(20).select(F.col("id").cast("double").alias("v")))) == 20
