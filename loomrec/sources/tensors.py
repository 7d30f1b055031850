"""Files of named tensors as a data source: a header of names, kinds, shapes and places, then the numbers.

``spark.read.format("tensors")`` after ``register``; options: ``path``; ``names``, a list parted by commas, of all
tensors if there is none; ``part_bytes``, the numbers of a partition, about. A partition is a range of rows of a tensor, so that a large one is read by many tasks.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of numbers in a partition, about.
PART_BYTES = 32 << 20
# fixed values: the format's names of kinds of numbers, little-endian
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}
SCHEMA = "name string, kind string, shape array<long>, row long, values array<double>"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pyarrow.fs.LocalFileSystem(), path


def header(path: str) -> tuple[dict[str, dict], int]:
    """The tensors of a file by name, and where their numbers begin."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        if size < 8:
            raise ValueError(f"{path} is no file of tensors")
        (n,) = struct.unpack("<Q", f.read_at(8, 0))
        if n + 8 > size:
            raise ValueError(f"{path} ends within its header")
        found = json.loads(f.read_at(n, 8))
    found.pop("__metadata__", None)
    for name, x in found.items():
        if x["dtype"] not in KINDS:
            raise ValueError(f"{name} holds {x['dtype']}, which isn't known")
        if x["data_offsets"][1] + 8 + n > size:
            raise ValueError(f"{path} ends within {name}")
    return found, 8 + n


def decoded(data: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(data, KINDS[kind])
    # half of a single-precision number's bits
    return (x.astype(np.uint32) << 16).view(np.float32).astype(np.float64) if kind == "BF16" else x.astype(np.float64)


@dataclass
class Rows(InputPartition):
    name: str
    kind: str
    shape: list[int]
    first: int
    last: int
    start: int
    width: int


class TensorReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], part_bytes: int = PART_BYTES) -> None:
        self.path, self.names, self.part_bytes = path, names, part_bytes

    def partitions(self) -> list[Rows]:
        found, base = header(self.path)
        missing = [x for x in self.names if x not in found]
        if missing:
            raise ValueError(f"{self.path} has no tensor {missing[0]}")
        out = []
        for name in self.names or sorted(found):
            x = found[name]
            rows = x["shape"][0] if len(x["shape"]) > 1 else 1  # a vector, or a number, is one row
            width = math.prod(x["shape"][1:]) if len(x["shape"]) > 1 else math.prod(x["shape"])
            each = max(1, self.part_bytes // max(1, width * np.dtype(KINDS[x["dtype"]]).itemsize))
            out += [Rows(name, x["dtype"], x["shape"], a, min(rows, a + each), base + x["data_offsets"][0], width) for a in range(0, rows, each)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        size = np.dtype(KINDS[part.kind]).itemsize * part.width
        fs, at = opened(self.path)
        with fs.open_input_file(at) as f:
            data = f.read_at((part.last - part.first) * size, part.start + part.first * size)
        values, n = decoded(data, part.kind), part.last - part.first
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(values))
        columns = [pa.array([part.name] * n), pa.array([part.kind] * n), pa.array([part.shape] * n, pa.list_(pa.int64())), pa.array(np.arange(part.first, part.last)), lists]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options["path"], [x.strip() for x in self.options.get("names", "").split(",") if x.strip()], int(self.options.get("part_bytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tensors)


def write_tensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    """A file of a few tensors, as models have them."""
    kinds = {np.dtype(v): k for k, v in KINDS.items() if k not in ("BF16", "BOOL")}
    head, at = {}, 0
    for name, x in tensors.items():
        head[name] = {"dtype": kinds[x.dtype.newbyteorder("<")], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    text = json.dumps(head).encode()
    fs, place = opened(path)
    with fs.open_output_stream(place) as f:
        f.write(struct.pack("<Q", len(text)) + text)
        for x in tensors.values():
            f.write(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes())
