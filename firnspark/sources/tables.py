"""Readers: tables, catalogues, vector files, notes, rasters and a site's outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import kind_of, parse_shape, parts_of
from ..functions.scalars import sibling_urls
from ..operators.grid import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def read_table(spark: SparkSession, folder: str, name: str, clean: tuple[str, ...] = ()) -> DataFrame:
    """``{folder}/{name}.parquet``; NaN becomes null in the columns named in ``clean``."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return nan_to_null(df, *clean) if clean else df


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Views of the tables that exist, for ``spark.sql``."""
    for name in names:
        if exists(spark, f"{folder}/{name}.parquet"):
            read_table(spark, folder, name).createOrReplaceTempView(name)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_catalog(df: DataFrame, months: tuple[int, ...] = (6, 7, 8, 9), first: str = "acqdate1", url: str = "s3url") -> DataFrame:
    """Surfaces acquired in the months given, with the addresses of raster and bit mask."""
    return df.where(F.month(first).isin(*months)).withColumns(sibling_urls(url))


def read_cube(spark: SparkSession, path: str, cubes: list, years: tuple[int, int], box: tuple[int, int, int, int] | None = None, cube: str = "cube_id") -> DataFrame:
    """Cells of some cubes and years (first, last) of a table by ``write_cube``, in a window (x0, x1, y0, y1): folders are pruned by cube and year, row groups by the window."""
    out = spark.read.parquet(path).where(F.col(cube).isin(cubes) & F.col("year").between(*years))
    if box is not None:
        out = out.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))
    return out


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time as it is written."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def search_items(items: DataFrame, box: tuple[float, float, float, float], start: str, end: str, cloud: float | None = None) -> DataFrame:
    """Image items whose box (``x0``, ``x1``, ``y0``, ``y1``) overlaps, taken in [start, end) and less cloudy than given. All conditions reach the scan; in
    a table by ``write_items`` the time also as a number, by which files and their parts are skipped."""
    x0, x1, y0, y1 = box
    out = items.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0) & (F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(end)))
    if "time_us" in items.columns:
        out = out.where((F.col("time_us") >= micros(F.lit(start))) & (F.col("time_us") < micros(F.lit(end))))
    return out if cloud is None else out.where(F.col("cloud_cover") < cloud)


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON files: ``file``, ``kind``, ``line`` (array of x, y; a polygon's outer ring, a point alone; null for kinds of many parts), ``shape``
    (all parts and holes; null for collections), ``properties`` (map of text). With ``lines`` each line is a feature, as ``write_geojson`` leaves them,
    and files are split; else a file, one collection, is one task's."""
    feature = "struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value")
    if lines:
        rows = raw.where(F.trim("value") != "").select("file", F.from_json(F.translate("value", "\x1e", ""), feature).alias("f"))
    else:
        rows = raw.select("file", F.explode(F.from_json("value", f"features array<{feature}>").features).alias("f"))
    name, text = F.upper("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = parts_of(name, text, "double")
    shape = F.when(parts.isNotNull(), F.struct(kind_of(name).alias("kind"), parts.alias("parts")))
    rows = rows.select("file", F.col("f.geometry.type").alias("kind"), shape.alias("shape"), F.col("f.properties").alias("properties"))
    line = F.when(~F.startswith("kind", F.lit("Multi")), F.get(F.get("shape.parts", F.lit(0)), F.lit(0)))
    return rows.select("file", "kind", line.alias("line"), "shape", "properties")


def read_old_metadata(spark: SparkSession, path: str, schema: str | StructType, times: tuple[str, ...]) -> DataFrame:
    """CSV with a header; the columns named become timestamps without a zone."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.withColumns({t: F.to_timestamp_ntz(F.col(t)) for t in times})


def read_notes(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One field of JSON notes, one file each: ``file``, ``value``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", f"$.{field}").alias("value"))


def parse_wkt(c: str) -> Column:
    """Vertices of a LINESTRING, of a POLYGON without holes, or of a POINT as an array of (x, y). Null for shapes of more parts or
    rings, which would lose them: ``parse_shape`` has all."""
    parts = parse_shape(c)["parts"]
    only = F.get(parts, F.lit(0))
    return F.when((F.size(parts) == 1) & (F.size(only) == 1), F.get(only, F.lit(0)))


def to_wkt(line: str) -> Column:
    """LINESTRING text of an array of (x, y)."""
    return F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", F.transform(line, lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string")))), F.lit(")"))


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """Cells of ESRI ASCII grids: ``file``, ``y`` (row from the top), ``x``, ``z``; no data is null. Lines are split where they are read."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s*\n\s*").alias("l"))
    head = lambda name: F.expr(f"filter(l, v -> lower(v) like '{name}%')[0]")
    number = lambda name: F.element_at(F.split(head(name), r"\s+"), 2)
    rows = raw.select("file", number("nodata").cast("double").alias("fill"), F.posexplode(F.filter("l", lambda v: v.rlike(r"^[-+0-9.]"))).alias("y", "v"))
    cells = rows.select("file", "fill", F.col("y").cast("long").alias("y"), F.posexplode(F.split("v", r"\s+")).alias("x", "v"))
    return cells.select("file", "y", "x", F.nullif(F.col("v").try_cast("double"), F.col("fill")).alias("z"))


def site_of_path(path: str = "file") -> Column:
    """Number of the site in a path with ``id{n}_``."""
    return F.regexp_extract(path, r"id(\d+)_", 1).try_cast("int")


class Site:
    """The tables of one site's folder that exist, by name; read when asked for."""

    FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "geojson": "geojson", "asc": "ascii"}

    def __init__(self, spark: SparkSession, folder: str, names: dict[str, str]):
        self.spark = spark
        self.paths = {k: f"{folder}/{v}" for k, v in names.items() if exists(spark, f"{folder}/{v}")}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.__dict__.get("paths", {}):
            raise AttributeError(name)
        path = self.paths[name]
        kind = self.FORMATS[path.rsplit(".", 1)[-1]]
        if kind == "geojson":
            return read_geojson(self.spark, path)
        if kind == "ascii":
            return read_ascii_grids(self.spark, path)
        return self.spark.read.format(kind).option("header", True).load(path)
