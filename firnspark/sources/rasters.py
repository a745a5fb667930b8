"""Tiled rasters (TIFF and BigTIFF, with the tags that place them on the ground) as a data source: rows of cells by tile.

Spark plans one partition for some tiles or strips of a file; windows on ``x``, ``y``, ``row``, ``col`` and ``band`` skip files and tiles before any is opened.
Written rasters are blocks of tiles, one file each, made where their cells meet, and appear when the job commits.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Numbers of TIFF tags, and the keys of a coordinate system's code.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT = 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA, PHOTOMETRIC = 33550, 33922, 34264, 34735, 42113, 262
PROJECTED_KEY, GEOGRAPHIC_KEY, MODEL_KEY, RASTER_KEY = 3072, 2048, 1024, 1025
#: Numpy codes of TIFF's types, and how values are packed.
TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
NONE, LZW, DEFLATE, OLD_DEFLATE, ZSTD = 1, 5, 8, 32946, 50000
KINDS = {1: "u", 2: "i", 3: "f"}

SCHEMA = "file string, band int, row long, col long, x double, y double, z double, crs int"
ARROW = pa.schema([("file", pa.string()), ("band", pa.int32()), ("row", pa.int64()), ("col", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("crs", pa.int32())])


@dataclass
class Layout:
    """What a file's header says. ``affine``: x and y of (row, col) corners as x0, x by col, x by row, y0, y by col, y by row."""

    path: str
    width: int
    height: int
    tile: tuple[int, int]
    tiled: bool
    dtype: str
    bands: int
    chunky: bool
    compression: int
    predictor: int
    nodata: float | None
    affine: tuple[float, ...]
    crs: int | None
    offsets: np.ndarray
    sizes: np.ndarray

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.tile[0])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a URI or an absolute path; workers open it themselves."""
    return pafs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))


def read_header(path: str) -> Layout:
    """First image of a file. Later ones are overviews or masks."""
    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big = version == 43
        begin = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        many = int(np.frombuffer(f.read_at(8 if big else 2, begin), f"{order}{'u8' if big else 'u2'}")[0])
        size, inline = (20, 8) if big else (12, 4)
        entries = f.read_at(many * size, begin + (8 if big else 2))
        tags = {}
        for k in range(many):
            entry = entries[k * size : (k + 1) * size]
            tag, kind = struct.unpack(f"{order}HH", entry[:4])
            count = struct.unpack(f"{order}{'Q' if big else 'I'}", entry[4 : 4 + inline])[0]
            if kind in TYPES:
                dtype = np.dtype(f"{order}{TYPES[kind]}" if kind != 2 else "S1")
                held = entry[4 + inline :]
                if dtype.itemsize * count > inline:
                    held = f.read_at(dtype.itemsize * count, struct.unpack(f"{order}{'Q' if big else 'I'}", held)[0])
                tags[tag] = np.frombuffer(held[: dtype.itemsize * count], dtype)
    one = lambda tag, usual: int(tags[tag][0]) if tag in tags else usual
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    tiled = TILE_WIDTH in tags
    tile = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    text = lambda tag: tags[tag].tobytes().split(b"\0")[0].decode().strip()
    affine = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if TRANSFORM in tags:
        m = tags[TRANSFORM].tolist()
        affine = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif SCALE in tags and TIEPOINT in tags:
        (dx, dy), (col, row, _, x, y) = tags[SCALE].tolist()[:2], tags[TIEPOINT].tolist()[:5]
        affine = (x - col * dx, dx, 0.0, y + row * dy, 0.0, -dy)
    keys = {int(k[0]): int(k[3]) for k in tags.get(GEO_KEYS, np.zeros(4, "u2")).reshape(-1, 4)[1:] if not k[1]}
    return Layout(
        path, width, height, tile, tiled, f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}", bands, one(PLANAR, 1) == 1, one(COMPRESSION, NONE), one(PREDICTOR, 1),
        float(text(NODATA)) if NODATA in tags else None, affine, keys.get(PROJECTED_KEY, keys.get(GEOGRAPHIC_KEY)), tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES],
    )


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 begins anew and 257 ends."""
    table: list[bytes] = []
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        new = table[code] if code < len(table) else last + last[:1]
        out.append(new)
        if last:
            table.append(last + new[:1])
        last = new
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def unpack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if compression == LZW:
        return unpack_lzw(data)
    raise ValueError(f"tiles are packed in a way ({compression}) that isn't known")


def decode_tile(layout: Layout, data: bytes, rows: int) -> np.ndarray:
    """Values of a tile: (rows, columns, samples)."""
    dtype, samples, columns = np.dtype(layout.dtype), layout.bands if layout.chunky else 1, layout.tile[1]
    plain = memoryview(unpack(data, layout.compression))[: rows * columns * samples * dtype.itemsize]
    if layout.predictor == 3:  # differences of bytes, the most significant bytes of a row first
        planes = np.frombuffer(plain, "u1").reshape(rows, columns * samples * dtype.itemsize)
        planes = np.cumsum(planes.reshape(rows, -1, samples), axis=1, dtype="u1").reshape(rows, dtype.itemsize, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{dtype.itemsize}").reshape(rows, columns, samples)
    values = np.frombuffer(plain, dtype).reshape(rows, columns, samples)
    return np.cumsum(values, axis=1, dtype=dtype.newbyteorder("=")) if layout.predictor == 2 else values


@dataclass
class Tiles(InputPartition):
    """Some tiles of one file: (first row, first column, sample plane, offset, bytes); of each, what lies in the window is read."""

    layout: Layout | None
    tiles: list[tuple[int, int, int, int, int]]
    window: dict[str, tuple[float, float]]


def _index_range(lo: float, hi: float, begin: float, step: float, many: int) -> tuple[int, int]:
    """First and last cell whose centre is between lo and hi."""
    a, b = sorted(((lo - begin) / step - 0.5, (hi - begin) / step - 0.5))
    return max(0, math.floor(max(a, -1.0))), min(many - 1, math.ceil(min(b, many)))


def cell_window(layout: Layout, window: dict[str, tuple[float, float]]) -> tuple[int, int, int, int]:
    """Rows and columns (first, last) that a window can meet; for a rotated raster only what it says of rows and columns counts."""
    r0, r1, c0, c1 = 0, layout.height - 1, 0, layout.width - 1
    x0, dx, rx, y0, ry, dy = layout.affine
    if not rx and not ry:
        if "x" in window:
            c0, c1 = _index_range(*window["x"], x0, dx, layout.width)
        if "y" in window:
            r0, r1 = _index_range(*window["y"], y0, dy, layout.height)
    if "row" in window:
        r0, r1 = max(r0, math.ceil(max(window["row"][0], 0))), min(r1, math.floor(min(window["row"][1], layout.height)))
    if "col" in window:
        c0, c1 = max(c0, math.ceil(max(window["col"][0], 0))), min(c1, math.floor(min(window["col"][1], layout.width)))
    return r0, r1, c0, c1


def tiles_of(layout: Layout, window: dict[str, tuple[float, float]]) -> list[tuple[int, int, int, int, int]]:
    r0, r1, c0, c1 = cell_window(layout, window)
    (th, tw), each = layout.tile, layout.across * layout.down
    low, high = window.get("band", (-math.inf, math.inf))
    if r0 > r1 or c0 > c1 or high < 1 or low > layout.bands:
        return []
    planes = [0] if layout.chunky else [k for k in range(layout.bands) if low <= k + 1 <= high]
    at = lambda p, r, c: p * each + r * layout.across + c
    return [(r * th, c * tw, p, int(layout.offsets[at(p, r, c)]), int(layout.sizes[at(p, r, c)])) for p in planes for r in range(r0 // th, r1 // th + 1) for c in range(c0 // tw, c1 // tw + 1)]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.each, self.window = options["path"], int(options.get("tiles_per_task", "16")), {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of windows are kept for planning; all conditions are still applied to rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in ("x", "y", "row", "col", "band"):
                values = f.value if isinstance(f, In) else (f.value,)
                low, high = self.window.get(f.attribute[0], (-math.inf, math.inf))
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, float(min(values)))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = min(high, float(max(values)))
                self.window[f.attribute[0]] = (low, high)
            yield f

    def partitions(self) -> list[Tiles]:
        """Headers of all files are read side by side by the planner; tiles are read by tasks."""
        fs, at = filesystem(self.path)
        info = fs.get_file_info(at)
        scheme = f"{self.path.split('://')[0]}://" if "://" in self.path else ""
        if info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
            names = sorted(x.path for x in found if x.type == pafs.FileType.File and x.path.lower().endswith((".tif", ".tiff")) and "/_" not in x.path.removeprefix(at))
        elif info.type == pafs.FileType.File:
            names = [at]
        else:
            raise FileNotFoundError(self.path)
        with ThreadPoolExecutor(32) as pool:
            layouts = list(pool.map(read_header, [f"{scheme}{n}" for n in names]))
        out = []
        for layout in layouts:
            tiles = tiles_of(layout, self.window)
            layout.offsets = layout.sizes = np.zeros(0)
            out += [Tiles(layout, tiles[k : k + self.each], self.window) for k in range(0, len(tiles), self.each)]
        return out or [Tiles(None, [], {})]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        layout = partition.layout
        if layout is None:
            return
        fs, at = filesystem(layout.path)
        r0, r1, c0, c1 = cell_window(layout, partition.window)
        low, high = partition.window.get("band", (-math.inf, math.inf))
        x0, dx, rx, y0, ry, dy = layout.affine
        with fs.open_input_file(at) as f:
            for row, col, plane, offset, size in partition.tiles:
                rows = layout.tile[0] if layout.tiled else min(layout.tile[0], layout.height - row)
                a, b, c, d = max(r0, row), min(r1, row + layout.tile[0] - 1, layout.height - 1), max(c0, col), min(c1, col + layout.tile[1] - 1, layout.width - 1)
                if size:
                    values = decode_tile(layout, f.read_at(size, offset), rows)[a - row : b - row + 1, c - col : d - col + 1]
                else:  # a sparse file leaves out tiles without data
                    values = np.full((b - a + 1, d - c + 1, layout.bands if layout.chunky else 1), np.nan)
                r, q = (x.ravel() for x in np.meshgrid(np.arange(a, b + 1), np.arange(c, d + 1), indexing="ij"))
                x, y = x0 + (q + 0.5) * dx + (r + 0.5) * rx, y0 + (q + 0.5) * ry + (r + 0.5) * dy
                for sample in range(values.shape[2]):
                    band = (sample if layout.chunky else plane) + 1
                    if low <= band <= high and len(r):
                        z = values[:, :, sample].ravel().astype(np.float64)
                        gone = np.isnan(z) if layout.nodata is None else np.isnan(z) | (z == layout.nodata)
                        crs = pa.nulls(len(r), pa.int32()) if layout.crs is None else pa.repeat(pa.scalar(layout.crs, pa.int32()), len(r))
                        yield pa.RecordBatch.from_arrays([pa.repeat(layout.path, len(r)), pa.repeat(pa.scalar(band, pa.int32()), len(r)), pa.array(r, pa.int64()), pa.array(q, pa.int64()), pa.array(x), pa.array(y), pa.array(z, mask=gone), crs], schema=ARROW)


def tiff(tiles: list[bytes | None], width: int, height: int, tile: int, dtype: np.dtype, nodata: float, affine: tuple[float, float, float, float], crs: int | None, compression: int) -> bytes:
    """A file of one band: its tiles (None: without data) and then the header's entries, in the little-endian form for large files."""
    at, offsets = 16, []
    for t in tiles:
        offsets.append(at if t else 0)
        at += len(t or b"")
    x0, dx, y0, dy = affine
    keys = [1, 1, 0, 2, MODEL_KEY, 0, 1, 1, RASTER_KEY, 0, 1, 1]
    if crs is not None:
        geographic = 4000 <= crs < 5000
        keys = [1, 1, 0, 3, MODEL_KEY, 0, 1, 2 if geographic else 1, RASTER_KEY, 0, 1, 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, crs]
    text = f"{nodata!r}\0".encode()
    tags = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [dtype.itemsize * 8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]),
        (TILE_OFFSETS, 16, offsets), (TILE_BYTES, 16, [len(t or b"") for t in tiles]), (FORMAT, 3, ["_uif".index(dtype.kind)]), (SCALE, 12, [dx, dy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0]), (GEO_KEYS, 3, keys), (NODATA, 2, text),
    ]
    entries, beyond, free = [], [], at + 8 + 20 * len(tags) + 8
    for tag, kind, values in tags:
        held = values if kind == 2 else np.array(values, f"<{TYPES[kind]}").tobytes()
        if len(held) > 8:
            where = struct.pack("<Q", free)
            held += b"\0" * (-len(held) % 8)
            beyond.append(held)
            free += len(held)
        else:
            where = held.ljust(8, b"\0")
        entries.append(struct.pack("<HHQ", tag, kind, len(values)) + where)
    return b"".join([struct.pack("<2sHHHQ", b"II", 43, 8, 0, at), *(t for t in tiles if t), struct.pack("<Q", len(tags)), *entries, struct.pack("<Q", 0), *beyond])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RasterWriter(DataSourceArrowWriter):
    """Cells sorted by block and tile become a file for each block in a folder that readers pass over; the commit moves them into place."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite, self.path = options, overwrite, options["path"].rstrip("/")
        self.job = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        tile, side, dtype = int(o["tile"]), int(o["tile"]) * int(o["block_tiles"]), np.dtype(o["dtype"])
        x0, dx, y0, dy, nodata = (float(o[k]) for k in ("x0", "dx", "y0", "dy", "nodata"))
        crs, packed, many = int(o["crs"]) if "crs" in o else None, o["compression"] == "deflate", int(o["block_tiles"])
        fs, root = filesystem(self.job)
        fs.create_dir(root, recursive=True)
        names, block, tiles, last = [], None, {}, [0, 0]
        at, values = None, np.zeros(0)

        def close_tile() -> None:
            if at is not None:
                plain = values.astype(dtype.newbyteorder("<")).tobytes()
                tiles[at] = zlib.compress(plain) if packed else plain

        def close_block() -> None:
            close_tile()
            if tiles:
                high, wide = last[0] - block[0] * side + 1, last[1] - block[1] * side + 1
                down, across = -(-high // tile), -(-wide // tile)
                data = tiff([tiles.get((r, c)) for r in range(down) for c in range(across)], wide, high, tile, dtype, nodata, (x0 + block[1] * side * dx, dx, y0 - block[0] * side * dy, dy), crs, DEFLATE if packed else NONE)
                name = f"{block[0]}_{block[1]}-{uuid.uuid4().hex}.tif"
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(data)
                names.append(name)

        for batch in iterator:
            row, col, z = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "col", "z"))
            z = np.where(np.isnan(z.astype(np.float64)), nodata, z.astype(np.float64))
            spot = np.stack([row // side, col // side, row % side // tile, col % side // tile])
            cuts = [0, *(np.flatnonzero((np.diff(spot, axis=1) != 0).any(axis=0)) + 1).tolist(), len(row)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                own, here = tuple(spot[:2, lo].tolist()), tuple(spot[2:, lo].tolist())
                if own != block:
                    close_block()
                    block, tiles, last, at = own, {}, [own[0] * side, own[1] * side], None
                if here != at:
                    close_tile()
                    at, values = here, np.full((tile, tile), nodata)
                values[row[lo:hi] % side % tile, col[lo:hi] % side % tile] = z[lo:hi]
                last = [max(last[0], int(row[lo:hi].max())), max(last[1], int(col[lo:hi].max()))]
        close_block()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.path.endswith(".tif"):
                    fs.delete_file(old.path)
        job = filesystem(self.job)[1]
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{job}/{name}", f"{root}/{name}")
        self.abort(messages)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, job = filesystem(self.job)
        if fs.get_file_info(job).type == pafs.FileType.Directory:
            fs.delete_dir(job)


class TiledRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiled_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(dict(self.options), overwrite)


def read_rasters(spark: SparkSession, path: str, tiles_per_task: int = 16) -> DataFrame:
    """Cells of a file, or of all ``.tif`` files below a folder: ``file``, ``band`` (from 1), ``row``, ``col``, ``x``, ``y`` (centres), ``z``, ``crs``.

    No data is null. Strips and tiles are read, plain or packed by deflate, LZW or zstd, with differences of integers or floats, values of 1 to 8
    bytes, bands side by side or apart. Conditions on place and band that are on the result skip tiles. Workers open the
    path themselves, so it must be local to all of them or a store that pyarrow knows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiledRaster)
    return spark.read.format("tiled_raster").option("path", path).option("tiles_per_task", tiles_per_task).load()


def write_rasters(
    cells: DataFrame, path: str, tile: int = 256, block_tiles: int = 16, origin: tuple[float, float] = (0.0, 0.0), size: tuple[float, float] = (1.0, 1.0), crs: int | None = None, nodata: float = -9999.0, dtype: str = "float32", pack: bool = True, mode: str = "append"
) -> None:
    """Cells (``row``, ``col``, both from 0, ``z``) as tiled rasters, a file for each block of ``block_tiles`` by ``block_tiles`` tiles.

    ``origin`` is the upper left corner, ``size`` a cell's width and height. A null is no data; of several rows for one cell any one
    stays. Nothing is seen before the job commits, and a failed one leaves nothing; ``overwrite`` replaces what the folder holds.
    A block's cells meet in one task, which holds its packed tiles (64 MB for float32 as it is).
    """
    side = tile * block_tiles
    rows = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z"))
    block, spot = [F.floor(F.col(c) / side) for c in ("row", "col")], [F.floor(F.col(c) % side / tile) for c in ("row", "col")]
    options = {"path": path, "tile": tile, "block_tiles": block_tiles, "x0": origin[0], "y0": origin[1], "dx": size[0], "dy": size[1], "nodata": nodata, "dtype": dtype, "compression": "deflate" if pack else "none"}
    if crs is not None:
        options["crs"] = crs
    cells.sparkSession.dataSource.register(TiledRaster)
    rows.repartition(*block).sortWithinPartitions(*block, *spot).write.format("tiled_raster").options(**options).mode(mode).save()
