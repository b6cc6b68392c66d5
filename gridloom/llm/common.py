"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import shared_dir, ship

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Rows that go to Python at once, where the session does not say otherwise: whole texts are long.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Make this package known to the executors and keep batches of whole texts small."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later jobs neither recompute it nor need the executors that made it.
    ``parts``: files at most, for tables known to be small."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of tables from ``cut`` that no later plan reads."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.cut_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more than one row in so many are joined by broadcast; there can be no more keys of this kind than that.
HOT_SHARE = 200


def join_hot(rows: DataFrame, side: DataFrame, on: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) with ``side``, a written table with one row a key and its number of rows in ``count``.
    The few keys with a large share of all rows go by broadcast, so that their rows stay where they are; the rest by shuffle."""
    bound = (side.agg(F.sum(count)).first()[0] or 0) // HOT_SHARE
    cold = rows.join(side.where(F.col(count) <= bound), on, how)
    if side.where(F.col(count) > bound).isEmpty():
        return cold
    return cold.unionByName(rows.join(F.broadcast(side.where(F.col(count) > bound)), on, how))


def finite_vector(name: str) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    return F.col(name).isNotNull() & F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session; the number of salts follows the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salt(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def bin_starts(counts: DataFrame, keys: list[str], count: str = "n", bin_col: str = "__gl_salt", out: str = "__gl_start") -> DataFrame:
    """Running total of ``count`` before each bin of a key.  ``counts`` has one row per key and bin."""
    before = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(count).over(before), F.lit(0).cast("long")))
