"""Embedding whitening with Spark MLlib's BlockMatrix.

Each vector's entries are first made whole numbers, ``x = floor(SCALE * c) + SHIFT``, so counts and
sums are exact. The rows ``n * x - S`` (n vectors with the sums S, exact) over n are the centred rows; they get dense
indices and become a ``BlockMatrix`` A of row blocks. The transposed matrix times A is the scatter matrix, whose
product is split along the rows (``multiply`` with middle splits) so that no task sees all blocks; it has the size of
one vector squared and is decomposed locally (``eigh``). A times the whitening matrix (unit eigenvectors over the
square roots of their eigenvalues) projects the rows, again block by block. Mean and covariance of the projected rows
are then measured by two aggregates, for ``identity_error``.

Driver and closures hold what has the size of a vector, or of its square. Tables between steps are written
under ``spark.checkpoint.dir``; the blocks are made from them again where an executor is lost.

Edge cases: rows whose vector is null or empty, or holds null or non-finite entries, are dropped, as are those of
another length than the most frequent (of equally frequent ones the longest). Rows with equal or null ids are rows of
their own and all get results. No remaining row: an empty result. There are as many components as the
vectors have entries, ``components`` at most. One whose eigenvalue is zero (to rounding: constant or dependent
entries, a single row) has null ``whitened`` and stays out of ``identity_error``, which is null if none is left;
``explained`` is 0 where the trace is 0. ``deviation`` is null beyond the range of a long, ``deviation_decimal`` has it then.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canonry.session import cut_lineage

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Rows of a block: as many as give a few blocks per core, within these bounds.
BLOCK_ROWS = (256, 16_384)
BLOCKS_PER_CORE = 4
#: Columns of a block.
BLOCK_COLS = 256

_OUT = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_decimal")


def whole_numbers(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): the usable vectors as arrays of longs."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    return rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & finite).select(
        "vec_id", F.transform(v, lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x"))


def _indexed(rows: DataFrame) -> DataFrame:
    """Adds ``idx``, dense from 0: each written partition's rows in their order after those of the partitions before it."""
    tagged = cut_lineage(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
                         name="whitening-rows")
    sizes = tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    in_part = F.col("place") - F.shiftleft(F.col("part").cast("long"), 33)
    # The window and the broadcast side have a row per partition.
    return tagged.join(F.broadcast(begins), "part").withColumn("idx", F.col("begin") + in_part).drop("part", "place", "begin")


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """Product whose middle dimension is dealt over ``splits`` tasks and summed, not gathered in one."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _local_block(sc, values: np.ndarray) -> BlockMatrix:
    """A small local matrix as a BlockMatrix whose row blocks match ``BLOCK_COLS``."""
    blocks = [((k // BLOCK_COLS, 0), DenseMatrix(len(part), part.shape[1], part.ravel(order="F").tolist()))
              for k in range(0, len(values), BLOCK_COLS) for part in [values[k:k + BLOCK_COLS]]]
    return BlockMatrix(sc.parallelize(blocks, len(blocks)), min(BLOCK_COLS, len(values)), values.shape[1], *values.shape)


def components_of(scatter: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, share of the trace, whitening matrix) of the ``count`` largest, by falling value; a column of
    zeros for an eigenvalue that is zero to rounding."""
    v = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    # One sign for all runs: a vector's entry of the largest size is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    trace = float(np.trace(v))
    least = max(trace, 0.0) * len(v) * np.finfo(float).eps
    real = values > least
    matrix = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    return np.where(real, values, 0.0), (np.maximum(values, 0) / trace if trace > 0 else np.zeros(len(values))), matrix


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_decimal) per row and component."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    kind = rows.schema[id_col].dataType.simpleString()
    clean = whole_numbers(rows, id_col, vec_col)
    lengths = clean.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double, deviation_decimal decimal(38,0)")
    d, n = lengths["d"], lengths["n"]
    count = min(components, d)
    table = _indexed(clean.where(F.size("x") == d))
    sums = [r["s"] for r in table.select(F.posexplode("x").alias("p", "c")).groupBy("p").agg(F.sum("c").alias("s")).orderBy("p").collect()]
    away = F.zip_with("x", F.lit(sums).cast("array<long>"), lambda c, s: c * n - s)
    centred = table.select(F.col("idx").alias("index"), array_to_vector(F.transform(away, lambda y: y / F.lit(float(n)))).alias("vector"))
    per_block = min(max(-(-n // (BLOCKS_PER_CORE * sc.defaultParallelism)), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    a = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, d).toBlockMatrix(per_block, min(BLOCK_COLS, d))
    splits = max(1, min(sc.defaultParallelism, -(-n // per_block)))
    scatter = _times(a.transpose(), a, splits).toLocalMatrix().toArray()
    values, explained, matrix = components_of(scatter, n, count)
    projected = _times(a, _local_block(sc, matrix), 1).toIndexedRowMatrix()
    z = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    z = MLUtils.convertVectorColumnsToML(z, "vector")
    z = cut_lineage(z.select(F.col("index").alias("idx"), vector_to_array("vector").alias("z")), name="whitening-projected")
    real = [k for k in range(count) if values[k] > 0]
    error = F.lit(None).cast("double")
    if real:
        means = z.agg(*[F.avg(F.col("z")[k]).alias(f"m{k}") for k in real]).first()
        off = {k: F.col("z")[k] - F.lit(means[f"m{k}"]) for k in real}
        cov = z.agg(*[(F.sum(off[i] * off[j]) / F.lit(float(n))).alias(f"c{i}_{j}") for i in real for j in real if i <= j]).first()
        error = F.lit(max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in real for j in real if i <= j))
    exact = F.aggregate(away, F.lit(0).cast("decimal(38,0)"), lambda t, y: (
        t + y.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)"))
    each = table.select("idx", "vec_id", exact.alias("deviation_decimal")).join(z, "idx")
    part = F.create_map(*[F.lit(v) for k in range(count) for v in (k, float(explained[k]))])
    is_real = F.lit([bool(values[k] > 0) for k in range(count)])
    out = each.select("*", F.posexplode(F.slice("z", 1, count)).alias("k", "w"))
    return out.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation_decimal AS bigint)").alias("deviation"),
        F.when(is_real[F.col("k")], F.col("w")).alias("whitened"), part[F.col("k")].alias("explained"),
        error.alias("identity_error"), "deviation_decimal").select(*_OUT)
