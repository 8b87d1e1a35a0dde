"""Whitening of embeddings: centred exactly, covariance by MLlib's RowMatrix, whitened by a broadcast basis.

Entries are first put on a grid: c becomes the long x = floor(scale * c) + shift. So the sums of each dimension are exact
integers, and n * x - S is exact before anything is rounded: its square sum is the ``deviation``, and divided by n it is the
centred row. Centred rows go to ``RowMatrix.computeGramianMatrix``, which adds up d x d matrices over the
executors as a tree; divided by n that is the covariance. It alone (d x d numbers, whatever the number of rows) comes to the
driver, where ``eigh`` gives the components. Sums and basis are broadcast, and each batch of rows is projected and scaled in
``mapInPandas``. The whitened rows are stored, and their own covariance is worked out from them in the same way for
``identity_error``. Nothing is shuffled but one row a dimension and task.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite entry take no part, nor do those with an entry of
``LARGEST`` or more, which has no place among the longs. A zero vector, a null id, repeated ids and repeated rows count like any others.
Vectors of different lengths are fitted each with those of their own length (``MOST_LENGTHS`` lengths at most, else an error: each is a
fit). Components without variance (below ``FLAT`` of the largest) cannot be whitened and are left out, so a
single row, or rows all alike, give no result, nor does an empty table. ``deviation`` is null where it
exceeds a decimal of 38 digits. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import BATCH_BYTES, in_arrow, stored
from gleanery.session import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**56
#: A component with less than this part of the largest variance has none.
FLAT = 1e-12
MOST_LENGTHS = 256
#: Below this bound sums of two longs cannot overflow.
SAFE = 1 << 62
DECIMAL = 10**38


def on_grid(v: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of each entry, as longs."""
    return np.floor(SCALE * v.astype(np.float64)).astype(np.int64) + SHIFT


def largest(x: np.ndarray) -> int:
    return int(max(x.max(initial=0), -x.min(initial=0)))


def centred_times_n(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they hold it, else Python's integers."""
    if n * largest(x) + max(map(abs, sums), default=0) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(y: np.ndarray) -> list[int]:
    most = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    wide = y if y.dtype == object or y.shape[1] * most * most < SAFE else y.astype(object)
    return [int(s) for s in (wide * wide).sum(axis=1)]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def column_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of x in each dimension; a task gives one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = on_grid(_matrix(batch.column(0), d))
            own = x.sum(axis=0) if largest(x) * len(x) < SAFE else x.astype(object).sum(axis=0)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, own, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["pos", "n", "total"])

    parts = in_arrow(vectors.select("v"), run, "pos int, n bigint, total decimal(38,0)")
    rows = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("pos").collect()
    return rows[0]["n"], [int(r["total"]) for r in rows]


def gramian(rows: DataFrame, column: str, n: int, d: int) -> np.ndarray:
    """The Gramian of an array<double> column over n, by MLlib; rows stay on the executors."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("y")), "y")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray() / n


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of v that are not zero, falling, and their unit eigenvectors as columns."""
    e, q = np.linalg.eigh((v + v.T) / 2)
    e, q = e[::-1], q[:, ::-1]
    keep = (e > FLAT * max(e[0], 0)) & (np.arange(len(e)) < most)
    return e[keep], q[:, keep]


def _centre(n: int, sums: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (centred_times_n(on_grid(_matrix(batch.column(0), len(sums))), n, sums) / n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), len(sums)).cast(pa.list_(pa.float64()))], names=["y"])

    return run


def _whiten(known) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, basis = known.value
        for frame in frames:
            if not len(frame):
                continue
            y = centred_times_n(on_grid(np.stack(frame["v"].to_numpy())), n, sums)
            deviation = [Decimal(s) if s < DECIMAL else None for s in square_sums(y)]
            yield pd.DataFrame({"id": frame["id"], "deviation": deviation, "whitened": list((y / n).astype(np.float64) @ basis)})

    return run


def _of_length(clean: DataFrame, d: int, components: int) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of the vectors of one length."""
    spark = clean.sparkSession
    n, sums = column_sums(clean, d)
    v = gramian(in_arrow(clean.select("v"), _centre(n, sums), "y array<double>"), "y", n, d)
    e, q = principal(v, components)
    known = spark.sparkContext.broadcast((n, sums, q / np.sqrt(e)))
    kind = clean.schema["id"].dataType.simpleString()
    rows = clean.select("id", "v").mapInPandas(_whiten(known), f"id {kind}, deviation decimal(38,0), whitened array<double>")
    rows = stored(rows, "whitened") if len(e) else rows.limit(0)
    explained, error = (e / np.trace(v)).tolist(), 0.0
    if len(e):
        means = rows.agg(*(F.avg(F.col("whitened")[i]) for i in range(len(e)))).first()
        own = gramian(rows.select(F.zip_with("whitened", F.array(*map(F.lit, means)), lambda a, b: a - b).alias("y")), "y", n, len(e))
        error = float(np.abs(own - np.eye(len(e))).max())
    return rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, explained or [0.0])), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


RESULT = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: (id_col, component, n, deviation, whitened, explained, identity_error)."""
    spark = vectors.sparkSession
    v = F.col("v")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    clean = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0)).where(good)
    # The setting is the session's; mapInPandas takes its batches by it, too.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    lengths = [r["d"] for r in clean.groupBy(F.size(v).alias("d")).count().orderBy("d").limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    out = spark.createDataFrame([], f"id {clean.schema['id'].dataType.simpleString()}, {RESULT}")
    for d in lengths:
        out = out.unionByName(_of_length(clean.where(F.size(v) == d), d, components))
    return out.withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {"op13_whitening": op13_whitening}
