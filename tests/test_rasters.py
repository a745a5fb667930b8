"""Raster files of every supported kind against the arrays that they were made from, windows, and what a failed job leaves."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from firnspark.sources import rasters

KINDS = {"u": 1, "i": 2, "f": 3}


def pack_lzw(data: bytes) -> bytes:
    codes, table, width, now = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    free = 258
    for k in data:
        both = now + bytes([k])
        if both in table:
            now = both
            continue
        codes.append((table[now], width))
        table[both] = free
        free += 1
        width = min(12, max(9, free.bit_length()))
        if free == 4094:
            codes.append((256, width))
            table, width, free = {bytes([j]): j for j in range(256)}, 9, 258
        now = bytes([k])
    if now:
        codes.append((table[now], width))
        free += 1
        width = min(12, max(9, free.bit_length()))
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32946: zlib.compress, 50000: zstandard.ZstdCompressor().compress}


def predicted(a: np.ndarray, predictor: int, order: str) -> bytes:
    if predictor == 2:
        a = np.concatenate([a[:, :1], np.diff(a, axis=1)], axis=1)
    if predictor == 3:
        rows, columns, samples = a.shape
        planes = a.astype(f">f{a.itemsize}").view("u1").reshape(rows, columns * samples, a.itemsize).transpose(0, 2, 1).reshape(rows, -1, samples)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype("u1").tobytes()
    return a.astype(a.dtype.newbyteorder(order)).tobytes()


def write_tiff(path, a, order="<", tile=None, strip=None, compression=1, predictor=1, chunky=True, nodata=None, transform=None, skip=()):
    """A classic file of the array (rows, columns, bands), by the rules of the format and none of the reader's code."""
    high, wide, bands = a.shape
    planes = [a] if chunky else [a[:, :, k : k + 1] for k in range(bands)]
    blobs = []
    for p in planes:
        th, tw = tile or (strip, wide)
        for r in range(0, high, th):
            for c in range(0, wide, tw):
                part = p[r : r + th, c : c + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                blobs.append(b"" if len(blobs) in skip else PACK[compression](predicted(part, predictor, order)))
    at, offsets = 8, []
    for b in blobs:
        offsets.append(at if b else 0)
        at += len(b) + len(b) % 2
    tags = [(256, 4, [wide]), (257, 4, [high]), (258, 3, [a.itemsize * 8] * bands), (259, 3, [compression]), (277, 3, [bands]), (284, 3, [1 if chunky else 2]), (317, 3, [predictor]), (339, 3, [KINDS[a.dtype.kind]] * bands)]
    tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, 4, offsets), (325, 4, [len(b) for b in blobs])] if tile else [(273, 4, offsets), (278, 4, [strip]), (279, 4, [len(b) for b in blobs])]
    if transform:
        tags.append((34264, 12, transform))
    else:
        tags += [(33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 50.0, 0.0])]
    tags.append((34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32622]))
    if nodata is not None:
        tags.append((42113, 2, f"{nodata}\0".encode()))
    sizes = {2: "S1", 3: "u2", 4: "u4", 12: "f8"}
    entries, more, free = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags, key=lambda t: t[0]):
        held = values if kind == 2 else np.array(values, order + sizes[kind]).tobytes()
        if len(held) <= 4:
            where = held.ljust(4, b"\0")
        else:
            where = struct.pack(f"{order}I", free)
            more += held + b"\0" * (len(held) % 2)
            free += len(held) + len(held) % 2
        entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + where
    body = b"".join(b + b"\0" * (len(b) % 2) for b in blobs)
    with open(path, "wb") as f:
        f.write(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at) + body + struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", 0) + more)


def array(dtype, high=37, wide=29, bands=1):
    rng = np.random.default_rng(5)
    return (rng.integers(0, 200, (high, wide, bands)) if np.dtype(dtype).kind != "f" else rng.normal(0, 99, (high, wide, bands))).astype(dtype)


CASES = [
    dict(dtype="f4", tile=(16, 16)), dict(dtype="f4", tile=(16, 16), compression=8, predictor=3), dict(dtype="f8", strip=5, compression=8, predictor=3, order=">"), dict(dtype="i2", strip=8, compression=5, predictor=2),
    dict(dtype="u1", tile=(16, 32), compression=5), dict(dtype="u2", tile=(16, 16), compression=50000, predictor=2, bands=3), dict(dtype="i4", strip=37, order=">"), dict(dtype="f4", tile=(16, 16), bands=2, chunky=False, compression=32946), dict(dtype="u4", tile=(48, 32)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_kinds_of_files(spark, tmp_path, case):
    o = dict(CASES[case])
    a = array(o.pop("dtype"), bands=o.pop("bands", 1))
    write_tiff(tmp_path / "a.tif", a, **o)
    got = {(r.band, r.row, r.col): r for r in rasters.read_rasters(spark, f"file://{tmp_path}/a.tif").collect()}
    assert {k: v.z for k, v in got.items()} == {(b + 1, r, c): float(a[r, c, b]) for r in range(37) for c in range(29) for b in range(a.shape[2])}
    one = got[1, 3, 4]
    assert (one.x, one.y, one.crs) == (100 + 4.5 * 2, 50 - 3.5 * 3, 32622)


def test_windows_open_fewer_tiles(spark, tmp_path):
    a = array("f4", 64, 64)
    write_tiff(tmp_path / "a.tif", a, tile=(16, 16))
    write_tiff(tmp_path / "b.tif", a[:, :, [0, 0]], tile=(16, 16), chunky=False, transform=[2.0, 0, 0, 1000.0, 0, -3.0, 0, 50.0, 0, 0, 0, 0, 0, 0, 0, 1])
    whole = rasters.read_rasters(spark, str(tmp_path), tiles_per_task=1)
    assert whole.rdd.getNumPartitions() == 16 + 32
    rows = whole.collect()
    for condition, many in (("x < 130", 4), ("x between 131 and 133 and y > 5", 2), ("band = 2", 16), ("row = 20 and band in (1)", 8), ("x > 1e6", 1), ("col >= 60 and x < 500", 4)):
        part = whole.where(condition)
        assert part.rdd.getNumPartitions() == many
        names = ("file", "band", "row", "col")
        want = {tuple(r[n] for n in names) for r in spark.createDataFrame(rows, whole.schema).where(condition).collect()}
        assert {tuple(r[n] for n in names) for r in part.collect()} == want


def test_rotated_sparse_and_no_data(spark, tmp_path):
    a = array("f4", 20, 20)
    a[3, 4] = -9999
    a[5, 6] = np.nan
    write_tiff(tmp_path / "a.tif", a, tile=(16, 16), nodata=-9999, skip=(3,), transform=[1.0, 0.5, 0, 10.0, 0.5, -1.0, 0, 20.0, 0, 0, 0, 0, 0, 0, 0, 1])
    got = {(r.row, r.col): r for r in rasters.read_rasters(spark, str(tmp_path)).where("x > -1e9").collect()}
    assert len(got) == 400 and got[3, 4].z is None and got[5, 6].z is None and got[17, 18].z is None and got[0, 1].z == a[0, 1, 0]
    assert (got[2, 7].x, got[2, 7].y) == (10 + 7.5 + 0.5 * 2.5, 20 + 0.5 * 7.5 - 2.5)


def test_what_is_no_raster(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"nothing here at all")
    with pytest.raises(Exception, match="not a TIFF"):
        rasters.read_rasters(spark, str(tmp_path)).count()
    write_tiff(tmp_path / "a.tif", array("u1"), strip=10)
    layout = rasters.read_header(str(tmp_path / "a.tif"))
    layout.compression = 7
    with pytest.raises(ValueError, match="packed"):
        rasters.decode_tile(layout, b"", 1)


@pytest.mark.parametrize("pack", [True, False])
def test_writing_and_reading_again(spark, tmp_path, pack):
    path = f"{tmp_path}/out"
    cells = spark.range(90 * 75).selectExpr("id div 75 AS row", "id % 75 AS col", "cast(sin(id) AS float) AS z").where("row != 50").withColumn("z", F.when(F.col("col") % 9 != 0, F.col("z")))
    rasters.write_rasters(cells, path, tile=16, block_tiles=2, origin=(1000.0, 2000.0), size=(10.0, 5.0), crs=3413, pack=pack)
    back = rasters.read_rasters(spark, path).selectExpr("cast(round((2000 - y - 2.5) / 5) AS long) AS row", "cast(round((x - 1005) / 10) AS long) AS col", "z", "crs").where("z is not null")
    assert {(r.row, r.col): r.z for r in back.collect()} == {(r.row, r.col): r.z for r in cells.where("z is not null").collect()} and {r.crs for r in back.select("crs").distinct().collect()} == {3413}
    rasters.write_rasters(cells.where("row < 5"), path, tile=16, block_tiles=2, mode="overwrite", dtype="float64", pack=pack)
    assert rasters.read_rasters(spark, path).agg(F.max("row")).first()[0] == 4
    rasters.write_rasters(cells.where("row between 40 and 44"), path, tile=16, block_tiles=2, pack=pack)
    assert sorted({r.y for r in rasters.read_rasters(spark, path).where("z is not null").select("y").collect()}) == [-k - 0.5 for k in (44, 43, 42, 41, 40, 4, 3, 2, 1, 0)]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    cells = spark.range(400).selectExpr("id div 20 AS row", "id % 20 AS col", "if(id = 399, raise_error('no'), double(id)) AS z")
    with pytest.raises(Exception, match="no"):
        rasters.write_rasters(cells, f"{tmp_path}/out", tile=16, block_tiles=1)
    assert [n for n in os.listdir(tmp_path / "out")] == [] if (tmp_path / "out").exists() else True
    rasters.write_rasters(spark.range(0).selectExpr("id AS row", "id AS col", "0D AS z"), f"{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"] and rasters.read_rasters(spark, f"{tmp_path}/none").count() == 0
