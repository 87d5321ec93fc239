"""NumPy matrices as a data source: ``.npy`` files read in row ranges, a few columns if wanted, and written one a task.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").option("rows", 4096).option("columns", "0,3").load(folder)

A file is opened through pyarrow's file systems, so the path may be of any store they know. Its
header gives type and shape; a partition reads the bytes of its rows only. Rows come as
(file, row, values); 1-d arrays have one value a row. Two dimensions in C order only.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, row bigint, values array<double>"


def _opened(path: str):
    from pyarrow import fs

    if ":/" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def header(stream) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, where the data begins) of an open .npy file."""
    start = stream.read(12)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    size, at = (struct.unpack("<H", start[8:10])[0], 10) if start[6] == 1 else (struct.unpack("<I", start[8:12])[0], 12)
    stream.seek(0)
    head = io.BytesIO(stream.read(at + size))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran or len(shape) not in (1, 2) or dtype.hasobject:
        raise ValueError("a matrix of one or two dimensions in C order, and of numbers, is asked for")
    return dtype, shape, at + size


class Rows(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 100_000))
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None

    def partitions(self):
        from pyarrow import fs

        system, path = _opened(self.path)
        info = system.get_file_info(path)
        files = [path] if info.type == fs.FileType.File else sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".npy"))
        out = []
        for f in files:
            with system.open_input_file(f) as stream:
                n = header(stream)[1][0]
            out += [Rows(f, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out

    def read(self, partition):
        system, _ = _opened(self.path)
        with system.open_input_file(partition.path) as stream:
            dtype, shape, at = header(stream)
            width = shape[1] if len(shape) == 2 else 1
            stream.seek(at + partition.first * width * dtype.itemsize)
            raw = stream.read((partition.end - partition.first) * width * dtype.itemsize)
        x = np.frombuffer(raw, dtype).reshape(-1, width)
        if self.columns is not None:
            x = x[:, self.columns]
        n = len(x)
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x, np.float64).ravel()))
        name = posixpath.basename(partition.path)
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(partition.first, partition.end)), values], names=["file", "row", "values"])


class NpyWriter(DataSourceArrowWriter):
    """Every task writes its rows (a column ``values`` of equal lengths) as one file in the folder."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        parts = [np.stack([np.asarray(v, np.float64) for v in b.column("values").to_pylist()]) for b in iterator if b.num_rows]
        if parts:
            system, path = _opened(self.path)
            system.create_dir(path, recursive=True)
            body = io.BytesIO()
            np.save(body, np.concatenate(parts))
            with system.open_output_stream(posixpath.join(path, f"part-{uuid.uuid4().hex}.npy")) as out:
                out.write(body.getvalue())
        return WriterCommitMessage()

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NpyReader(self.options)

    def writer(self, schema, overwrite):
        return NpyWriter(self.options)
