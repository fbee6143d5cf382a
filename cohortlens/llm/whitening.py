"""Whitening of embeddings with distributed block matrices (``pyspark.mllib``)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix, RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stage

#: Bytes of one block, and row blocks that one task multiplies before the sums of the tasks are added.
BLOCK_BYTES = 8_000_000
BLOCKS_A_TASK = 16
#: Columns of one block at most.
BLOCK_COLUMNS = 1024
#: 2**62: entries of this size and more, scaled, have no place in a long.
_TOO_LARGE = 4.611686018427388e18


@dataclass
class Whitening:
    """Fitted state: counts and sums are exact, the rest is in double precision."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(column: str = "embedding", scale: float = 64.0) -> Column:
    """Whether a vector is there and every entry is a finite number that fits a long once scaled."""
    return F.coalesce(F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double") * F.lit(scale)) < F.lit(_TOO_LARGE), F.lit(False))
                               & ~F.coalesce(F.isnan(c.cast("double")), F.lit(True))), F.lit(False))


def integer_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(index, vec_id, y) of the usable rows, staged: y = floor(scale * entry), index gapless from 0.

    Rows keep the order of the staged files: each partition numbers its own, and the counts of the partitions,
    one small row for each, say where it begins. Vectors of another length than most (ties: the longer) are left out.
    """
    kept = vectors.filter(usable("embedding", scale)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long")).alias("y"))
    kept = stage(kept, "whitening-rows")
    length = kept.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = kept.filter(F.size("y") == (length["d"] if length else 0))
    numbered = stage(kept.select("vec_id", "y", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")), "whitening-numbered")
    low = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["count"]) for r in numbered.groupBy("part").count().collect())
    starts, at = [], 0
    for part, count in counts:
        starts.append((part, at))
        at += count
    begin = vectors.sparkSession.createDataFrame(starts, "part int, begin long")
    return numbered.join(F.broadcast(begin), "part").select((F.col("begin") + low).alias("index"), "vec_id", "y")


def _centred(rows: DataFrame, means: list[float], column: str) -> DataFrame:
    """(index, vector) with ``means`` taken off, as MLlib vectors."""
    mean = F.array(*[F.lit(m) for m in means])
    df = rows.select("index", array_to_vector(F.zip_with(column, mean, lambda x, m: x.cast("double") - m)).alias("vector"))
    return MLUtils.convertVectorColumnsFromML(df, "vector")


def _blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    columns = min(d, BLOCK_COLUMNS)
    return IndexedRowMatrix(rows, n, d).toBlockMatrix(max(1, min(n, BLOCK_BYTES // (8 * columns))), columns)


def _multiply_split(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with its inner dimension dealt over ``splits`` tasks, whose partial sums are then added.

    The second parameter of MLlib's ``multiply``, which its Python class leaves out: without it one task would
    take all row blocks, as the scatter matrix is a single block.
    """
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def fit(rows: DataFrame) -> tuple[Whitening, BlockMatrix] | None:
    """Whitening of all rows (index, vec_id, y), and the blocks of the centred rows; None if no direction varies.

    Directions whose eigenvalue is below rounding (dimensions * 2^-52 of the largest) have no whitened form and are left out.
    """
    sums = sorted((r["j"], int(r["s"]), r["n"]) for r in rows.select(F.posexplode("y").alias("j", "v")).groupBy("j").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect())  # one row per dimension
    if not sums:
        return None
    n, d = sums[0][2], len(sums)
    total = [s for _, s, _ in sums]
    blocks = _blocks(_centred(rows, [s / n for s in total], "y"), n, d)
    splits = max(1, -(-blocks.numRowBlocks // BLOCKS_A_TASK))
    scatter = _multiply_split(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()  # dimensions squared
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(float(values[0]), 0.0) * d * 2.0 ** -52
    if not real.any():
        return None
    return Whitening(n, total, values[real], vectors[:, real], float(np.trace(covariance))), blocks


def project(blocks: BlockMatrix, matrix: np.ndarray, spark) -> DataFrame:
    """(index, projected array<double>): the blocks times a small local matrix."""
    rows = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(matrix)], "index long, row array<double>")
    small = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    right = IndexedRowMatrix(small, *matrix.shape).toBlockMatrix(blocks.colsPerBlock, matrix.shape[1])
    product = blocks.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("projected"))


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``projected``, less the identity; partial sums are added in a tree."""
    means = {r["j"]: r["m"] for r in rows.select(F.posexplode("projected").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).collect()}
    gram = RowMatrix(_centred(rows, [means[j] for j in range(k)], "projected").select("vector"), n, k).computeGramianMatrix().toArray()
    return float(np.abs(gram / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of all usable vectors (vec_id, embedding), one row per vector and component.

    Vectors that are null, or hold null or non-finite entries, are dropped, and so are those whose scaled entries do not
    fit a long; so are vectors of another length than most. Others become integers x = floor(scale * entry) + shift.
    Components are unit eigenvectors of the covariance of all x (divisor n, centred first), numbered from 1 by falling
    eigenvalue e. Columns: vec_id, component, n, deviation (sum of (n * x - S)^2 over dimensions, exact; null beyond a
    long), whitened, explained (e / trace), identity_error (measured on all projected rows), deviation_decimal (the
    deviation as decimal(38,0); null beyond that).

    Null and repeated vec_ids and repeated vectors are kept row by row; other columns are ignored. Components without
    variance have no rows: none at all for an empty table, a single vector or equal vectors.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    fitted = fit(rows)
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_decimal decimal(38,0)")
    state, blocks = fitted
    k = min(components, len(state.values))
    projected = stage(project(blocks, state.projection[:, :k], spark), "whitening-projected")
    error = identity_error(projected, state.n, k)
    # n * x - S is free of the shift, which would only make the numbers longer
    sums = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in state.sums])
    apart = F.zip_with("y", sums, lambda y, s: F.try_subtract((y.cast("decimal(19,0)") * F.lit(state.n).cast("decimal(18,0)")).cast("decimal(38,0)"), s).cast("decimal(38,0)"))
    square = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda total, a: F.try_add(total, F.try_multiply(a, a).cast("decimal(38,0)")).cast("decimal(38,0)"))
    ready = rows.select("index", "vec_id", square.alias("deviation_decimal")).join(projected, "index")
    explained = F.array(*[F.lit(float(v / state.trace)) for v in state.values[:k]])
    return ready.select("vec_id", "deviation_decimal", F.posexplode("projected").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(state.n).cast("long").alias("n"),
        F.col("deviation_decimal").try_cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_decimal")
