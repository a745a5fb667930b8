"""Shape files as a data source: records are split by the index beside the file, with their row of the attribute table."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.geometry import SHAPE
from .rasters import filesystem

SCHEMA = f"file string, record long, shape {SHAPE}, properties map<string, string>"
_VERTICES = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
ARROW = pa.schema([("file", pa.string()), ("record", pa.int64()), ("shape", pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(_VERTICES)))])), ("properties", pa.map_(pa.string(), pa.string()))])
#: Shape types without, with and with only further measures.
POINTS, LINES, POLYGONS, CLOUDS = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)


@dataclass
class Records(InputPartition):
    path: str
    first: int
    many: int


def inside(p: np.ndarray, ring: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    cross = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[cross], b[cross]
    return bool((p[0] < (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings that run clockwise with the holes in them: a hole belongs to the smallest outer ring around it, and one without any
    is a polygon itself, so no ring is lost."""
    areas = [signed_area(r) for r in rings]
    out = {k: [rings[k]] for k, a in enumerate(areas) if a <= 0}
    for k, a in enumerate(areas):
        if a > 0:
            around = [j for j in out if areas[j] <= 0 and -areas[j] >= a and inside(rings[k][0], rings[j])]
            if around:
                out[min(around, key=lambda j: -areas[j])].append(rings[k])
            else:
                out[k] = [rings[k]]
    return [out[k] for k in sorted(out)]


def parse_record(data: bytes) -> tuple[str, list[list[np.ndarray]]] | None:
    """Kind and parts; None for a record without a shape."""
    kind = struct.unpack("<i", data[:4])[0]
    if kind == 0:
        return None
    if kind in POINTS:
        return "point", [[np.frombuffer(data, "<f8", 2, 4).reshape(1, 2)]]
    if kind in CLOUDS:
        n = struct.unpack("<i", data[36:40])[0]
        return "point", [[p[None]] for p in np.frombuffer(data, "<f8", 2 * n, 40).reshape(n, 2)]
    if kind in LINES + POLYGONS:
        parts, n = struct.unpack("<ii", data[36:44])
        first = [*np.frombuffer(data, "<i4", parts, 44).tolist(), n]
        points = np.frombuffer(data, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
        rings = [points[a:b] for a, b in zip(first, first[1:], strict=False) if b > a]
        return ("line", [[r] for r in rings]) if kind in LINES else ("polygon", polygons(rings))
    raise ValueError(f"shapes of type {kind} can't be read")


class Attributes:
    """Rows of a table of fixed-length records as maps of text; null where a field is blank."""

    def __init__(self, f: pa.NativeFile, encoding: str):
        head = f.read_at(32, 0)
        self.rows, self.begin, self.size = struct.unpack("<IHH", head[4:12])
        self.file, self.encoding, self.fields, at = f, encoding, [], 1
        block = f.read_at(self.begin - 32, 32)
        for k in range(0, len(block) - 31, 32):
            if block[k] == 0x0D:
                break
            name, width = block[k : k + 11].split(b"\0")[0].decode(encoding), block[k + 16]
            self.fields.append((name, at, at + width))
            at += width

    def read(self, first: int, many: int) -> list[dict[str, str | None]]:
        data = self.file.read_at(self.size * many, self.begin + first * self.size)
        rows = [data[k : k + self.size] for k in range(0, len(data), self.size)]
        return [{n: r[a:b].decode(self.encoding, "replace").strip(" \0") or None for n, a, b in self.fields} for r in rows]


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.each, self.encoding = options["path"], int(options.get("records_per_task", "20000")), options.get("encoding", "utf-8")

    def partitions(self) -> list[Records]:
        fs, at = filesystem(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        scheme = f"{self.path.split('://')[0]}://" if "://" in self.path else ""
        names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.path.lower().endswith(".shp")) if info.type == pafs.FileType.Directory else [at]
        out = []
        for n in names:
            many = (fs.get_file_info(f"{n[:-4]}.shx").size - 100) // 8  # the index has eight bytes a record
            out += [Records(f"{scheme}{n}", k, min(self.each, many - k)) for k in range(0, many, self.each)]
        return out or [Records("", 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.many:
            return
        fs, at = filesystem(part.path)
        stem = at[:-4]
        with fs.open_input_file(f"{stem}.shx") as f:
            index = np.frombuffer(f.read_at(8 * part.many, 100 + 8 * part.first), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows: list[dict[str, str | None] | None] = [None] * part.many
        if fs.get_file_info(f"{stem}.dbf").type == pafs.FileType.File:
            with fs.open_input_file(f"{stem}.dbf") as f:
                rows = Attributes(f, self.encoding).read(part.first, part.many)
        with fs.open_input_file(at) as f:
            for lo in range(0, part.many, 1000):
                shapes = []
                for begin, size in index[lo : lo + 1000].tolist():
                    got = parse_record(f.read_at(size, begin + 8))
                    shapes.append(got and {"kind": got[0], "parts": [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in p] for p in got[1]]})
                n = len(shapes)
                props = pa.array([r and list(r.items()) for r in rows[lo : lo + n]], ARROW.field("properties").type)
                yield pa.RecordBatch.from_arrays([pa.repeat(part.path, n), pa.array(range(part.first + lo, part.first + lo + n), pa.int64()), pa.array(shapes, ARROW.field("shape").type), props], schema=ARROW)


class ShapeFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shape_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShapeReader:
        return ShapeReader(dict(self.options))


def read_shapefile(spark: SparkSession, path: str, records_per_task: int = 20_000, encoding: str = "utf-8") -> DataFrame:
    """Records of a ``.shp`` file, or of all below a folder: ``file``, ``record`` (from 0), ``shape`` (with all parts and holes; null where there is none),
    ``properties`` (map of text, null without a table). Tasks read as many records as said, found by the ``.shx`` file."""
    spark.dataSource.register(ShapeFile)
    return spark.read.format("shape_file").option("path", path).option("records_per_task", records_per_task).option("encoding", encoding).load()
