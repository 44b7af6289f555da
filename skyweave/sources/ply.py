"""Binary point clouds as a Spark data source: ``spark.read.format("ply")`` and ``df.write.format("ply")``.

Records have a fixed size, so a file is read in ranges by many tasks. A written cloud is a folder of part files, each
a complete cloud with its own header.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Property types of the format.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
COLUMNS = ("x", "y", "z", "red", "green", "blue")
SCHEMA = "x float, y float, z float, red smallint, green smallint, blue smallint"
_WRITTEN = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])


def header(path: str) -> tuple[int, int, np.dtype]:
    """Where the records begin, how many there are, and their type."""
    fields, count, inside = [], None, False
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is not a point cloud")
        while True:
            words = f.readline().decode("ascii").split()
            if not words and f.tell() >= os.path.getsize(path):
                raise ValueError(f"{path} has no end of its header")
            if words[:1] == ["format"] and words[1] != "binary_little_endian":
                raise ValueError(f"{path}: {words[1]} is not supported")
            elif words[:1] == ["element"]:
                inside = words[1] == "vertex"
                if inside:
                    count = int(words[2])
                elif count is None:
                    raise ValueError(f"{path}: vertices must come first")
            elif words[:1] == ["property"] and inside:
                fields.append((words[2], TYPES[words[1]]))
            elif words[:1] == ["end_header"]:
                return f.tell(), count or 0, np.dtype(fields)


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".ply"))
    return [path]


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowsPerTask", 1_000_000))

    def partitions(self) -> list[_Range]:
        return [_Range(p, k, min(self.rows, n - k)) for p in _files(self.path) for n in [header(p)[1]] for k in range(0, n, self.rows)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        start, _, kind = header(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(start + partition.first * kind.itemsize)
            for k in range(0, partition.count, 100_000):
                rows = np.frombuffer(f.read(min(100_000, partition.count - k) * kind.itemsize), kind)
                columns = [pa.array(np.ascontiguousarray(rows[c]).astype("<f4" if c in "xyz" else "<i2")) if c in (kind.names or ()) else pa.nulls(len(rows), pa.int16()) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays(columns, list(COLUMNS))


@dataclass
class _Part(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        os.makedirs(self.path, exist_ok=True)
        body = os.path.join(self.path, f".{uuid.uuid4().hex}")
        count = 0
        with open(body, "wb") as f:
            for batch in iterator:
                rows = np.zeros(batch.num_rows, _WRITTEN)
                for c in COLUMNS:
                    rows[c] = np.asarray(batch.column(batch.schema.get_field_index(c)).cast(pa.float64())).astype(_WRITTEN[c])
                f.write(rows.tobytes())
                count += len(rows)
        if not count:
            os.remove(body)
            return _Part(None)
        whole = body + ".part"
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}"]
        lines += [f"property {'float' if c in 'xyz' else 'uchar'} {c}" for c in COLUMNS] + ["end_header\n"]
        with open(whole, "wb") as f, open(body, "rb") as g:
            f.write("\n".join(lines).encode())
            while chunk := g.read(1 << 20):
                f.write(chunk)
        os.remove(body)
        return _Part(whole)

    def commit(self, messages: list[_Part | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for old in _files(self.path):
                os.remove(old)
        for k, m in enumerate(messages):
            if m is not None and m.path:
                os.replace(m.path, os.path.join(self.path, f"part-{k:05d}-{uuid.uuid4().hex[:8]}.ply"))

    def abort(self, messages: list[_Part | None]) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class PlySource(DataSource):
    """Options: ``path`` (a file or a folder on a shared file system) and ``rowsPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)
