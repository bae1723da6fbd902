"""Row ranges of NumPy's array files, dealt to tasks by a Spark data source.

Headers are read once where the query is planned; a task opens the file, goes to its rows and reads them in batches. Array files
and stored members of ``.npz`` files are split; a compressed member is one stream, which one task reads in batches.
Files are opened by Arrow's file systems, so a store has to be one of these and be seen from all executors.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of one task's rows, and rows of one batch.
SPLIT = 64 << 20
ROWS = 4096


@dataclass
class Array:
    """Where an array lies: the file, its zip member if that is compressed, and what its header says."""

    path: str
    member: str | None
    offset: int
    shape: tuple[int, ...]
    dtype: str
    by_columns: bool

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=int))


@dataclass
class Rows(InputPartition):
    values: Array
    labels: Array | None
    first: int
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(self.start)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _head(stream, path: str, member: str | None, at: int) -> Array:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, dtype = read(stream)
    if dtype.hasobject or not shape:
        raise ValueError(f"{path} holds objects or a single value, not rows")
    return Array(path, member, at + stream.tell(), shape, dtype.str, by_columns and len(shape) > 1)


def arrays(path: str) -> tuple[Array, Array | None]:
    """The array of a ``.npy`` file, or X and perhaps y of an ``.npz`` file."""
    system, name = opened(path)
    with system.open_input_file(name) as file:
        if not name.endswith(".npz"):
            return _head(file, path, None, 0), None
        found = {}
        with zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if info.filename not in ("X.npy", "y.npy"):
                    continue
                stored = info.compress_type == zipfile.ZIP_STORED
                file.seek(info.header_offset + 26)  # the lengths of the local header's name and extra field
                begin = info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4)))
                with archive.open(info) as stream:
                    found[info.filename] = _head(stream, path, None if stored else info.filename, begin if stored else 0)
    if "X.npy" not in found:
        raise ValueError(f"{path} has no array X")
    return found["X.npy"], found.get("y.npy")


def _batches(array: Array, start: int, end: int) -> Iterator[np.ndarray]:
    """Rows from start to end, each flat, in batches."""
    kind, n, width = np.dtype(array.dtype), array.shape[0], array.width
    system, name = opened(array.path)
    with system.open_input_file(name) as file:
        if array.member:
            with zipfile.ZipFile(file) as archive, archive.open(array.member) as stream:
                stream.read(array.offset)
                if array.by_columns:  # a compressed stream by columns has no rows before its end
                    yield np.frombuffer(stream.read(), kind).reshape(array.shape, order="F").reshape(n, width)[start:end]
                    return
                stream.read(start * width * kind.itemsize)
                for at in range(start, end, ROWS):
                    rows = min(ROWS, end - at)
                    yield np.frombuffer(stream.read(rows * width * kind.itemsize), kind).reshape(rows, width)
            return
        for at in range(start, end, ROWS):
            rows = min(ROWS, end - at)
            if not array.by_columns:
                file.seek(array.offset + at * width * kind.itemsize)
                yield np.frombuffer(file.read(rows * width * kind.itemsize), kind).reshape(rows, width)
                continue
            columns = np.empty((width, rows), kind)
            for k in range(width):
                file.seek(array.offset + (k * n + at) * kind.itemsize)
                columns[k] = np.frombuffer(file.read(rows * kind.itemsize), kind)
            # The file's columns run through the trailing axes with the first of them fastest.
            yield columns.T.reshape(rows, *array.shape[1:], order="F").reshape(rows, width)


class ArrayReader(DataSourceReader):
    """Rows with ids, features and labels; with ``only_labels`` the array itself is the labels."""

    def __init__(self, path: str, split: int, only_labels: bool = False) -> None:
        self.path, self.split, self.only_labels = path, split, only_labels

    def partitions(self) -> list[Rows]:
        system, name = opened(self.path)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        info = system.get_file_info(name)
        files = [self.path]
        if info.type == fs.FileType.Directory:
            below = sorted(f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith((".npy", ".npz")))
            files = [prefix + f for f in below]
            if not files:
                raise ValueError(f"{self.path} holds no array files")
        parts, first = [], 0
        for file in files:
            x, y = arrays(file)
            y = x if self.only_labels else y
            n = x.shape[0]
            if y and y.shape[0] != n:
                raise ValueError(f"{file} has {n} rows and {y.shape[0]} labels")
            one = n if x.member else max(1, self.split // max(1, x.width * np.dtype(x.dtype).itemsize))
            parts += [Rows(x, y, first, at, min(at + one, n)) for at in range(0, max(n, 1), max(one, 1))]
            first += n
        return parts

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        labels = _batches(part.labels, part.start, part.end) if part.labels else None
        at = part.first + part.start
        for x in _batches(part.values, part.start, part.end):
            names = pa.nulls(len(x), pa.string()) if labels is None else pa.array([str(v) for v in next(labels)[:, 0]])
            if self.only_labels:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x), dtype=np.int64)), names], names=["id", "label"])
                at += len(x)
                continue
            values = np.ascontiguousarray(x, dtype=float).reshape(-1)
            features = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * part.values.width, pa.array(values))
            ids = pa.array(np.arange(at, at + len(x), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([ids, features, names], names=["id", "features", "label"])
            at += len(x)


class ArraySource(DataSource):
    """``spark.read.format("array_rows").load(path)``: id (dense over all files in order of their names), features, label."""

    @classmethod
    def name(cls) -> str:
        return "array_rows"

    def _labels(self) -> bool:
        return self.options.get("labels", "false") == "true"

    def schema(self) -> str:
        return "id long, label string" if self._labels() else "id long, features array<double>, label string"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("split", SPLIT)), self._labels())


def read_arrays(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """A file or a folder of files, ``split`` bytes of rows to a task. A file without rows gives none; one number
    in a row is one feature."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("array_rows").option("split", split).load(path)


def read_labels(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """id and label of a file that holds one label a row, numbers or strings."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("array_rows").option("labels", "true").option("split", split).load(path)
