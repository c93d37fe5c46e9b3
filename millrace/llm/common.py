"""What several operators share: tables, cut lineage, row keys, Arrow text buffers, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import scratch, shuffled, sized, written  # noqa: F401  (for the operators of this subpackage)
from ..sources.tables import stored, table  # noqa: F401  (for its queries)

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 16 << 20


def row_key(*columns: str) -> list[Column]:
    """k1 and k2, 96 bits that stand for a row's values: joins on them treat nulls and repeated rows as equal values."""
    return [F.xxhash64(*columns).alias("k1"), F.hash(*reversed(columns)).alias("k2")]


def batched(df: DataFrame) -> DataFrame:
    """df, whose batches for Python have BATCH_BYTES at most from now on: 10,000 long texts at a time would take a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with each row as one struct, row, so that no name of its columns meets one of the given columns; `select("row.*")` undoes it."""
    return df.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in columns.items()))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on: then Python gets and gives back columns of any name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and offsets (one more than rows). A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int):
    """Slices (first row, rows) of a string column with about max_bytes each; a longer text is a slice of its own."""
    _, offsets = text_buffers(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1)
        yield start, stop - start
        start = stop


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node that edges (a, b) reach from node, in either direction.

    Labels fall to the least of the neighbours' labels, then to their label's label, until none falls.
    Each round is a join on equal keys and a minimum that is partly taken before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    linked = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = written(linked)
    while True:
        near = both.join(shuffled(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(shuffled(near), "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("root"))
        after = written(lower.join(shuffled(jump), "new", "left").select("node", F.coalesce(F.least("new", "root"), "new").alias("label"), "old"))
        if after.where("label <> old").isEmpty():
            break
        labels = after.select("node", "label")
    return nodes.join(shuffled(labels), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
