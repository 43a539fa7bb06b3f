"""Binary column files: u64 rows, u64 columns, then each column's little-endian u64 values.

``spark.read.format("colbin").load(path)`` reads one file or a folder of them by row ranges, so a
large file is read by many tasks; ``df.write.format("colbin")`` writes a folder, each task its own
files of bounded size. Paths are local or any URI pyarrow's file systems open.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

#: Rows to a partition when reading and to a file when writing.
ROWS = 1 << 20
BATCH = 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _files(path: str) -> list[str]:
    fs, p = _open(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [p]
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(p)) if x.path.endswith(".colbin"))


def header(fs: pafs.FileSystem, path: str) -> tuple[int, int]:
    """(rows, columns), checked against the file's size."""
    size = fs.get_file_info(path).size
    if size < 16:
        raise ValueError(f"{path}: too short for a header")
    with fs.open_input_file(path) as f:
        rows, cols = (int(x) for x in np.frombuffer(f.read(16), "<u8"))
    if size < 16 + 8 * rows * cols:
        raise ValueError(f"{path}: {rows} x {cols} values announced, the file is cut short")
    return rows, cols


@dataclass
class RowRange(InputPartition):
    path: str
    rows: int
    cols: int
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        fs, _ = _open(self.path)
        out = []
        for f in _files(self.path):
            n, m = header(fs, f)
            out += [RowRange(f, n, m, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
        return out or [RowRange("", 0, 0, 0, 0)]

    def read(self, partition):
        fs, _ = _open(self.path)
        if partition.start >= partition.stop:
            return
        with fs.open_input_file(partition.path) as f:
            for a in range(partition.start, partition.stop, BATCH):
                b = min(partition.stop, a + BATCH)
                cols = [pa.array(np.frombuffer(f.read_at(8 * (b - a), 16 + 8 * (partition.rows * k + a)), "<i8")) for k in range(partition.cols)]
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{k}" for k in range(partition.cols)])


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    """Files get their names when they are whole; a failed attempt's are removed by ``abort``, and
    only the committed ones are listed to readers, under the ``.colbin`` ending."""

    def __init__(self, path: str, cols: int, overwrite: bool):
        self.path, self.cols, self.overwrite = path, cols, overwrite

    def write(self, iterator):
        fs, root = _open(self.path)
        fs.create_dir(root)
        files, held, n = [], [], 0

        def flush():
            name = f"{root}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(name) as f:
                f.write(np.array([n, self.cols], "<u8").tobytes())
                for k in range(self.cols):
                    for b in held:
                        if b.column(k).null_count:
                            raise ValueError(f"column {k} holds a null")
                        f.write(b.column(k).to_numpy(zero_copy_only=False).astype("<i8", copy=False).tobytes())
            files.append(name)

        for b in iterator:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                flush()
                held, n = [], 0
        if n or not files:
            flush()
        return _Written(files)

    def commit(self, messages):
        """New files come in before old ones go, so a crash between leaves rows twice, never none."""
        fs, root = _open(self.path)
        old = _files(self.path) if self.overwrite else []
        for i, f in enumerate(f for m in messages if m for f in m.files):
            fs.move(f, f"{root}/part-{i:06d}-{uuid.uuid4().hex[:8]}.colbin")
        for f in old:
            fs.delete_file(f)

    def abort(self, messages):
        fs, _ = _open(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f)


class ColbinSource(DataSource):
    @classmethod
    def name(cls):
        return "colbin"

    def schema(self):
        path = self.options["path"]
        fs, _ = _open(path)
        widths = {header(fs, f)[1] for f in _files(path)}
        if len(widths) != 1:
            raise ValueError(f"{path}: files of {sorted(widths)} columns")
        return StructType([StructField(f"c{i}", LongType(), False) for i in range(widths.pop())])

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], len(schema.fields), overwrite)


def read(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(ColbinSource)
    return spark.read.format("colbin").option("rows", rows).load(path)


def write(df: DataFrame, path: str) -> None:
    """BIGINT columns (unsigned bits) to a folder of column files; nulls are rejected."""
    df.sparkSession.dataSource.register(ColbinSource)
    df.write.format("colbin").mode("append").save(path)


def write_file(columns: list[list[int]], path: str) -> None:
    """One file from columns of unsigned values in memory."""
    data = [np.array(c, dtype=np.uint64) for c in columns]
    with open(path, "wb") as f:
        f.write(np.array([len(data[0]) if data else 0, len(data)], "<u8").tobytes())
        for c in data:
            f.write(c.astype("<u8").tobytes())
