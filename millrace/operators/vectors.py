"""Nearest vectors by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, about; of 384 numbers a row it has 30 MB.
BLOCK = 10_000


def unit(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v) with v of length 1; vectors of length 0 have no direction and stay out."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.select(F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), length.alias("length")).where("length > 0").select("id", F.transform("v", lambda x: x / F.col("length")).alias("v"))


def best_matches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(id, other, cosine): for each query the vector of the index that is nearest, itself aside; the smaller id of two as near.

    Both tables are dealt into blocks of about BLOCK rows; each block of queries meets each of the index in a task of its own, and the best of
    a query's matches stays. Both are (id, v) of unit(). Without another vector in the index there is no row.
    """
    q, p = (max(1, -(-df.count() // BLOCK)) for df in (queries, index))

    def dealt(df: DataFrame, parts: int, others: int, side: str) -> DataFrame:
        own, other = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select(F.col("id").alias(f"{side}_id"), F.col("v").alias(f"{side}_v"), own.alias(f"{side}_own"), other.alias(f"{side}_other"))

    def matrix(t: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column(f"{side}_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        return ids[order], t.column(f"{side}_v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        (mine, a), (ids, b) = matrix(left, "a"), matrix(right, "b")
        found = []
        for start in range(0, len(mine), 1000):
            own = mine[start : start + 1000]
            cosine = a[start : start + 1000] @ b.T
            cosine[own[:, None] == ids] = -np.inf
            best = cosine.argmax(axis=1)
            value = cosine[np.arange(len(own)), best]
            there = value > -np.inf
            found.append((own[there], ids[best][there], value[there]))
        own, other, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"id": own, "other": other, "cosine": value})

    left, right = dealt(queries, q, p, "a"), dealt(index, p, q, "b")
    found = left.groupBy("a_own", "a_other").cogroup(right.groupBy("b_other", "b_own")).applyInArrow(cell, "id long, other long, cosine double")
    best = found.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("other")).alias("m"))).alias("b"))
    return best.select("id", (-F.col("b.m")).alias("other"), F.col("b.cosine").alias("cosine"))
