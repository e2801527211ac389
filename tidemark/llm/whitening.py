"""Whitening of vectors on distributed block matrices.

Entries become whole numbers, ``x = floor(1024 * c) + 100000``.  Rows get a number each and are centred; the centred rows are
an ``IndexedRowMatrix``, cut into a ``BlockMatrix`` B of blocks of ``BLOCK_ROWS`` rows.  B transposed times B is the scatter
matrix: its middle dimension, the rows, is split, so each task multiplies the blocks of a stretch of rows, adds them up and
passes on one small matrix.  Its eigenvectors are found on the driver (as many numbers as the square of the dimension);
B times the matrix of whitening vectors projects all rows.

Counts, sums and deviations are whole numbers, computed exactly in decimals, whatever the order of the rows.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; zero vectors stay.  Entries beyond
2^53 / 1024 count as if they were there (their floor is not exact).  Vectors of different lengths are fitted each with those of
their own length, which ``n`` counts; vectors without entries have no components and give no row.  Vectors of fewer entries
than ``components`` have as many components as entries.  A component whose variance is not above the rounding of the largest one
(a single row, repeated rows, vectors within a plane) whitens to 0.0 and explains its share of 0.0 or next to it; the
identity error is then 1.  A deviation that does not fit in 64 bits is null.  Rows that repeat, and rows with one vec_id or
none, count and come each; an empty table gives an empty result; columns besides vec_id and the vector are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import partitions, stored, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows and columns of a block; at 64 entries a block of 1,024 rows is half a megabyte.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 256
#: Shares of the largest variance that are no more than rounding.
NOTHING = 1e-12
EDGE = 2**53 // SCALE
WHOLE = "decimal(38,0)"


def fit_list(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """``(vec_id, x, d, place)`` of the rows that take part: whole numbers, their count, and row numbers from 0 within each ``d``.

    The order of the scan is stored with the rows, so the numbers stay as they are when a task runs again.
    """
    real = F.forall(name, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    rows = vectors.where(F.col(name).isNotNull()).where(real).where(F.size(name) > 0)
    inside = lambda c: F.greatest(F.lit(-float(EDGE)), F.least(F.lit(float(EDGE)), c.cast("double")))
    x = F.transform(name, lambda c: F.floor(inside(c) * SCALE) + SHIFT)
    own = rows.select("vec_id", x.alias("x"), F.size(name).alias("d"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seen"))
    own = stored(own, "whole")
    counts = stored(own.groupBy("d", "part").count(), "counts")  # a row per partition and length
    before = Window.partitionBy("d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("d", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    if counts.select("d").distinct().count() > 1:
        nth = F.row_number().over(Window.partitionBy("d", "part").orderBy("seen")) - 1
    else:  # the place in its partition is in the lower bits, so nothing is shuffled
        nth = F.col("seen").bitwiseAND(F.lit(2**33 - 1))
    numbered = own.withColumn("nth", nth).join(F.broadcast(offset), ["d", "part"])
    return numbered.select("vec_id", "x", "d", (F.col("offset") + F.col("nth")).alias("place"))


def block_matrix(rows: DataFrame, n: int, d: int, mean: np.ndarray) -> BlockMatrix:
    """Centred rows ``(place, x)`` as blocks."""
    mid = F.array(*[F.lit(float(m)) for m in mean])
    centred = rows.select("place", array_to_vector(F.zip_with("x", mid, lambda a, m: a.cast("double") - m)).alias("v"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, d).toBlockMatrix(BLOCK_ROWS, min(d, BLOCK_COLUMNS))


def scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix, with the rows in ``splits`` stretches that are multiplied apart and added."""
    turned, own = (m._java_matrix_wrapper for m in (blocks.transpose(), blocks))
    product = BlockMatrix(turned.call("multiply", own._java_model, splits), blocks.colsPerBlock, blocks.colsPerBlock)
    whole = product.toLocalMatrix().toArray()
    return (whole + whole.T) / 2


def whitening_vectors(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors of the largest eigenvalues over the roots of these, as columns, and shares of the trace, largest first."""
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value, kind="stable")[:components]
    value, vector = np.maximum(value[order], 0.0), vector[:, order]
    some = value > NOTHING * max(float(value[0]), np.finfo(float).tiny)
    trace = float(np.trace(v))
    return np.where(some, vector / np.sqrt(np.where(some, value, 1.0)), 0.0), value / trace if trace > 0 else np.zeros(len(order))


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of ``white`` minus the identity."""
    w = [F.col("white")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = white.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(w)], *[F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs])
    gap = lambda i, j: F.abs(F.col(f"p{i}_{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n - float(i == j))
    return sums.select(F.array_max(F.array(*[gap(i, j) for i, j in pairs]))).first()[0]


def _whitened(rows: DataFrame, n: int, d: int, components: int) -> DataFrame:
    """All rows of one length."""
    spark, k = rows.sparkSession, min(components, d)
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast(WHOLE)).alias("s")).collect()  # a row per entry
    s = [int(r.s) for r in sorted(sums)]
    mean = np.array([v / n for v in s])
    blocks = block_matrix(rows, n, d, mean)
    parts = partitions(spark)
    vectors, shares = whitening_vectors(scatter(blocks, max(1, min(2 * parts, -(-n // BLOCK_ROWS)))) / n, components)
    width = min(d, BLOCK_COLUMNS)
    stripes = [((i, 0), DenseMatrix(len(part), k, part.ravel(order="F"))) for i, part in enumerate(np.split(vectors, range(width, d, width)))]
    turn = BlockMatrix(spark.sparkContext.parallelize(stripes, len(stripes)), width, k, d, k)
    projected = blocks.multiply(turn).toIndexedRowMatrix().rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
    white = stored(spark.createDataFrame(projected, "place long, white array<double>"), "white")
    total = F.array(*[F.lit(v).cast(WHOLE) for v in s])
    apart = F.zip_with("x", total, lambda x, t: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)") - t).cast(WHOLE))
    deviation = F.aggregate(apart, F.lit(0).cast(WHOLE), lambda a, y: (a + (y * y).cast(WHOLE)).cast(WHOLE))
    fits = F.when(deviation <= F.lit(2**63 - 1).cast(WHOLE), deviation.cast("long"))
    one = F.posexplode(F.zip_with("white", F.array(*[F.lit(float(e)) for e in shares]), lambda w, e: F.struct(w.alias("whitened"), e.alias("explained"))))
    out = rows.join(white, "place").select("vec_id", F.lit(n).cast("long").alias("n"), fits.alias("deviation"), one.alias("at", "c"))
    out = out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained")
    return out.withColumn("identity_error", F.lit(identity_error(white, k, n)))


def whitened(vectors: DataFrame, name: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    ``n`` vectors were fitted; ``deviation`` is the sum over entries of (n * x - sum of x)^2.
    """
    rows = fit_list(vectors, name)
    lengths = rows.groupBy("d").count().orderBy("d").collect()
    parts = [_whitened(rows.where(F.col("d") == r.d), r["count"], r.d, components) for r in lengths]
    if not parts:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
