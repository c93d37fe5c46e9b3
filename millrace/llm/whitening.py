"""Whitening of embeddings: MLlib's Gramian of exactly centred rows, its eigenvectors, and whitened rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

if TYPE_CHECKING:
    import pandas as pd

#: Steps of an entry, and what is added so that whole numbers are positive; components that are given out.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Eigenvalues up to this share of the largest count as zero: nothing can be scaled by them.
FLAT = 1e-12


def whole(embedding: Column) -> Column:
    """An array of entries as whole numbers, floor(64 c) + 1,000,000."""
    return F.transform(embedding.cast("array<double>"), lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))


def fit_list(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of rows whose vector is there, not empty, and has finite entries only; x: its entries as whole numbers.

    Vectors of another length than most (of lengths as frequent the longest) fit no covariance and are left out too.
    """
    vectors = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = vectors.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    own = written(sound.select("vec_id", whole(F.col("v")).alias("x")))
    length = own.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    return own.where(F.size("x") == (length.d if length else 0))


def gramian(rows: DataFrame, column: Column, d: int) -> np.ndarray:
    """The sum over rows of the outer product of a vector column with itself, by MLlib in the JVM: tasks add up d * d numbers each."""
    # Imported here: other queries of this subpackage have no need of what these take of the driver's memory.
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    got = RowMatrix(vectors, 0, d).computeGramianMatrix().toArray()
    return (got + got.T) / 2


def whitened(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray, float]:
    """(vec_id, n, deviation, whitened array<double>) of each sound row; the components' shares of the trace; and how far the covariance of
    the whitened rows is from the identity.

    Sums of entries and their distance n x - S from the mean, times n, are exact whole numbers, and deviation the sum of their squares; a sum beyond
    64 bits is an error of the session in ANSI mode. Only centred rows are multiplied. The covariance, its eigenvectors and the means are of a vector's
    length squared, whatever the rows are, and so what the driver and a broadcast hold. Of a vector and its opposite the one whose largest
    entry (of entries as large the first) is positive is taken. A component without variance is 0 in every row, and doesn't count in the
    distance from the identity. One row, equal rows and repeated rows are whitened like others. Of an empty table there are no rows.
    """
    spark = rows.sparkSession
    own = fit_list(rows, vec_id, embedding)
    sums = own.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    d, n = len(sums), sums[0].n if sums else 0
    k = min(components, d)
    if not n:
        return own.select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), np.zeros(0), 0.0
    total = spark.createDataFrame([([r.s for r in sums],)], "s array<long>")
    centred = own.crossJoin(F.broadcast(total)).select("vec_id", F.zip_with("x", "s", lambda x, s: F.lit(n).cast("long") * x - s).alias("far"))
    centred = written(centred.select("vec_id", "far", F.aggregate("far", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("deviation")))
    covariance = gramian(centred, F.transform("far", lambda x: x.cast("double") / float(n)), d) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    largest = vectors[np.argmax(np.abs(vectors).round(12), axis=0), np.arange(k)]
    vectors = vectors * np.where(largest < 0, -1.0, 1.0)
    there = values > FLAT * max(values[0], np.finfo(float).tiny)
    scale = np.where(there, 1 / np.sqrt(np.where(there, values, 1.0)), 0.0)
    trace = float(np.trace(covariance))
    sent = spark.sparkContext.broadcast(vectors * scale)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            far = np.stack(batch["far"].to_list()).astype(np.float64) / n if len(batch) else np.zeros((0, d))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "n": n, "deviation": batch["deviation"], "whitened": list(far @ sent.value)})

    out = written(centred.mapInPandas(project, "vec_id long, n long, deviation long, whitened array<double>"))
    means = out.select(*(F.avg(F.col("whitened")[i]) for i in range(k))).first()
    middle = spark.createDataFrame([([float(m) for m in means],)], "m array<double>")
    again = gramian(out.crossJoin(F.broadcast(middle)), F.zip_with("whitened", "m", lambda w, m: w - m), k) / n
    error = float(np.abs(again - np.eye(k))[np.ix_(there, there)].max()) if there.any() else 0.0
    return out, values / trace if trace > 0 else np.zeros(k), error


def components(rows: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each sound vector and component, as whitened() has them."""
    out, explained, error = whitened(rows, count)
    shares = F.array(*[F.lit(float(x)) for x in explained]).cast("array<double>")
    each = out.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
