"""Whitening of vectors by MLlib block matrices.

Components become integers, floor(64 * c) + 1000000.  Each distinct vector is fitted once: their centred rows, indexed without gaps, are cut
into distributed blocks, the transposed matrix times the matrix is the scatter, its eigenvectors are found locally (the
scatter has one row and one column a dimension), and the centred rows of the whole table times the whitening matrix are
the projections.  Rows are centred exactly, (n*x - S)/n from integers, before anything is multiplied.

The scatter has few blocks, so its products are split along the rows' dimension (``splits``) and only then added up.

Defined results: vectors that are null or hold null or non-finite components are dropped; shorter vectors are filled with zeros to the
longest; rows without an id stay, as do repeated rows, each projected; directions without variance (less than NO_VARIANCE of the
largest) are no components; a table whose vectors are all equal, and an empty one, give an empty result; other columns do not take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, discard, finite_vector

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLS = 1024, 512
#: Blocks of rows whose products are added up in one task.
BLOCKS_A_SPLIT = 4
NO_VARIANCE = 1e-12


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the components, falling
    matrix: np.ndarray  # dimensions x components
    trace: float


def whole(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and x, the integer components of usable rows."""
    usable = rows.where(finite_vector(vector))
    most = usable.agg(F.max(F.size(vector))).first()[0] or 0
    x = F.transform(vector, lambda c: F.floor(SCALE * c.cast("double")) + SHIFT)
    fill = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(most) - F.size(vector))
    return usable.select(F.col(vec_id).alias("vec_id"), F.concat(x, fill).alias("x"))


def indexed(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``df`` written, with a gapless row index ``at``; the written table and the number of rows.

    A row's partition and place in it are written with it, so that they stay what they are; the driver only sees one count a partition."""
    placed = df.withColumn("__gl_part", F.spark_partition_id()).withColumn("__gl_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    written = cut(placed)
    counts = sorted(map(tuple, written.groupBy("__gl_part").agg(F.count("*")).collect()))
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    first = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts[:-1], strict=True)], "__gl_part int, __gl_first long")
    table = written.join(F.broadcast(first), "__gl_part").withColumn("at", F.col("__gl_first") + F.col("__gl_place"))
    return table.drop("__gl_part", "__gl_place", "__gl_first"), written, starts[-1]


def numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def blocks(table: DataFrame, rows: int, n: int, sums: list[int]) -> BlockMatrix:
    """The centred rows of a table with ``at`` and x, in blocks."""
    centred = F.zip_with("x", numbers(sums), lambda x, s: (n * x - s).cast("double") / n)
    vectors = MLUtils.convertVectorColumnsFromML(table.select("at", array_to_vector(centred).alias("v")), "v")
    return IndexedRowMatrix(vectors, rows, len(sums)).toBlockMatrix(BLOCK_ROWS, min(BLOCK_COLS, len(sums)))


def gram(a: BlockMatrix) -> np.ndarray:
    """Transposed matrix times matrix, as a local array."""
    splits = max(1, -(-a.numRows() // (a.rowsPerBlock * BLOCKS_A_SPLIT)))
    # The Python method takes no number of splits; the one of the JVM does.
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def project(sc: SparkContext, a: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    size, k = a.colsPerBlock, matrix.shape[1]
    pieces = [((i // size, 0), DenseMatrix(len(m), k, m.ravel(order="F"))) for i in range(0, len(matrix), size) for m in [matrix[i : i + size]]]
    return a.multiply(BlockMatrix(sc.parallelize(pieces, 1), size, k, len(matrix), k))


def rows_of(a: BlockMatrix) -> DataFrame:
    """at and z, one row of the matrix each."""
    found = callMLlibFunc("getIndexedRows", a.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("at"), vector_to_array("vector").alias("z"))


def fit(table: DataFrame, rows: int, most: int = COMPONENTS) -> tuple[Fit | None, float]:
    """Components of a table of distinct vectors (``at``, x), and the largest difference of the whitened covariance from the identity."""
    totals = table.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("s")).collect()
    sums = [s for _, s in sorted(map(tuple, totals))]
    if not sums:
        return None, 0.0
    a = blocks(table, rows, rows, sums).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cov = gram(a) / rows
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = int((values[:most] > NO_VARIANCE * max(values[0], 0)).sum())
        if not k:
            return None, 0.0
        found = Fit(rows, sums, values[:k], vectors[:, :k] / np.sqrt(values[:k]), float(np.trace(cov)))
        white = gram(project(table.sparkSession.sparkContext, a, found.matrix)) / rows
        return found, float(np.abs(white - np.eye(k)).max())
    finally:
        a._java_matrix_wrapper._java_model.blocks().unpersist(False)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per usable row: vec_id, n, deviation (decimal, exact), whitened (an array, one number a component), explained (likewise) and
    identity_error."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[vec_id]
    own = whole(rows, vec_id, vector)
    table, written, count = indexed(own)
    distinct, distinct_written, n = indexed(written.select("x").distinct())
    found, error = fit(distinct, n, most)
    if found is None:
        discard(written, distinct_written)
        return spark.createDataFrame([], f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    projected = rows_of(project(spark.sparkContext, blocks(table, count, n, found.sums), found.matrix))
    apart = F.zip_with("x", numbers(found.sums), lambda x, s: (n * x - s).cast("decimal(19,0)"))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + d * d).cast("decimal(38,0)"))
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    out = table.select("at", "vec_id", deviation.alias("deviation")).join(projected, "at")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.col("z").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))
