"""Shards of rows as a data source: texts are packed into files of a target size with an index, which are there whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, INDEX = "shards", "index.json"
#: Bytes of a shard, about.
TARGET = 64 << 20


@dataclass
class Part(WriterCommitMessage):
    """What one task has written: (file, rows, bytes) of each shard, under a name that no other attempt has."""

    shards: list[tuple[str, int, int]] = field(default_factory=list)


class ShardWriter(DataSourceArrowWriter):
    """Each task writes JSON lines into shards of its own in a hidden folder of the attempt; the commit on the driver moves those of tasks that
    have ended well to their place and then writes the index, which alone tells what belongs to the table. A task that fails, or that is done
    twice, leaves nothing that the index names. Paths are of a file system that the driver and all executors share."""

    def __init__(self, path: str, target: int, schema: StructType, overwrite: bool) -> None:
        self.path, self.target, self.names, self.overwrite = path, target, schema.fieldNames(), overwrite
        self.attempt = uuid.uuid4().hex

    @property
    def hidden(self) -> str:
        return os.path.join(self.path, f".{self.attempt}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        part, out = Part(), None
        os.makedirs(self.hidden, exist_ok=True)
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    line = (json.dumps(row, ensure_ascii=False, default=str) + "\n").encode()
                    if out is None or (size and size + len(line) > self.target):
                        if out is not None:
                            out.close()
                            part.shards.append((name, rows, size))
                        name, rows, size = f"{uuid.uuid4().hex}.jsonl", 0, 0
                        out = open(os.path.join(self.hidden, name), "wb")  # noqa: SIM115
                    out.write(line)
                    rows, size = rows + 1, size + len(line)
            if out is not None:
                part.shards.append((name, rows, size))
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        index = [] if self.overwrite else entries(self.path)
        for k, (name, rows, size) in enumerate(s for m in messages if m is not None for s in m.shards):
            place = f"shard-{self.attempt[:8]}-{k:06d}.jsonl"
            os.replace(os.path.join(self.hidden, name), os.path.join(self.path, place))
            index.append({"file": place, "rows": rows, "bytes": size})
        fresh = os.path.join(self.path, f".{INDEX}.{self.attempt}")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump({"columns": self.names, "shards": index}, f)
        os.replace(fresh, os.path.join(self.path, INDEX))
        self.clear()

    def abort(self, messages: list[Part | None]) -> None:
        self.clear()

    def clear(self) -> None:
        if os.path.isdir(self.hidden):
            for name in os.listdir(self.hidden):
                os.remove(os.path.join(self.hidden, name))
            os.rmdir(self.hidden)


def entries(path: str) -> list[dict]:
    """The shards that the index names; none without an index."""
    try:
        with open(os.path.join(path, INDEX), encoding="utf-8") as f:
            return json.load(f)["shards"]
    except FileNotFoundError:
        return []


@dataclass
class Shard(InputPartition):
    file: str


class ShardReader(DataSourceReader):
    """A partition a shard of the index, in which rows come in the order in which they were written."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[Shard]:
        return [Shard(x["file"]) for x in entries(self.path)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, rows = to_arrow_schema(self.schema), []
        if partition is None:
            return
        with open(os.path.join(self.path, partition.file), encoding="utf-8") as f:
            for line in f:
                rows.append(json.loads(line))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class Shards(DataSource):
    """`shards`: spark.read.format("shards").schema(...).load(path); df.write.format("shards").option("target", bytes).mode(...).save(path)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("target", TARGET)), schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(Shards)
