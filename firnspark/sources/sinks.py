"""Writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists, micros


def write_once(df: DataFrame, path: str) -> bool:
    """Write unless there is something already; whether it wrote. Spark's commit protocol makes locks needless."""
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return False
    return True


def write_with_meta(df: DataFrame, path: str, meta: dict[str, object]) -> None:
    """Overwrite the table and, beside it, a small table of its attributes as text."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    rows = spark.createDataFrame([(str(k), str(v)) for k, v in meta.items()], "key string, value string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}.meta")


def read_meta(df_path: str, spark) -> dict[str, str]:
    return {r.key: r.value for r in spark.read.parquet(f"{df_path.rstrip('/')}.meta").collect()}


def write_if_folder(df: DataFrame, folder: str, name: str) -> str | None:
    """Write into a folder that is there; a message, and no table, if it isn't."""
    if not exists(df.sparkSession, folder):
        return f"{folder} does not exist: {name} was not written"
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return None


def write_cube(cells: DataFrame, path: str, cube: str = "cube_id", time: str = "time", files_of: int = 1_000_000) -> None:
    """Cells as a table laid out by cube and year, in files of about ``files_of`` rows that are sorted by place, so that a reader of a
    cube, some years and a window opens only what it needs. A cube's year may be many files; none is written by a single task for its size."""
    own = cells.withColumn("year", F.year(time))
    own = own.repartitionByRange(cube, "year", F.floor(F.col("y") / 64), "x").sortWithinPartitions(cube, "year", "y", "x")
    own.write.option("maxRecordsPerFile", files_of).partitionBy(cube, "year").mode("overwrite").parquet(path)


def write_items(items: DataFrame, path: str, files: int | None = None, time: str = "time", group_rows: int = 20_000) -> None:
    """Image items (boxes ``x0``, ``x1``, ``y0``, ``y1`` and a time) along a curve through place and time, so that the statistics of each file and
    group of rows are narrow in all three and a search opens few. Ranges are equal in rows, so dense places get more files.

    ``time_us`` is added, the time as a number: files have statistics of that, not of times without a zone. The curve interleaves the ranks, to 1 in 1024, of the boxes' centres and of the time; the driver sees those quantiles alone. Items without a box or time come first.
    """
    spark = items.sparkSession
    centre = {"__x": (F.col("x0") + F.col("x1")) / 2, "__y": (F.col("y0") + F.col("y1")) / 2, "__t": F.col("time_us").cast("double")}
    own = items.withColumn("time_us", micros(F.col(time))).withColumns(centre)
    steps = [k / 1024 for k in range(1, 1024)]
    cuts = own.agg(*[F.percentile_approx(c, steps, 20_000).alias(c) for c in centre]).first()
    place = F.lit(0).cast("long")
    for k, c in enumerate(centre):
        bounds = sorted(set(cuts[c] or []))
        # the rank by halving, ten steps for 1023 bounds
        rank = F.lit(0)
        held = F.lit(bounds) if bounds else F.array().cast("array<double>")
        for bit in range(9, -1, -1):
            rank = F.when(F.coalesce(F.get(held, rank + (1 << bit) - 1) < F.col(c), F.lit(False)), rank + (1 << bit)).otherwise(rank)
            own = own.withColumn(f"__r{k}", rank)
            rank = F.col(f"__r{k}")
        for bit in range(10):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"__r{k}").cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + k))
    own = own.withColumn("__z", F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull() & F.col("__t").isNotNull(), place).otherwise(-1))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.repartitionByRange(n, "__z").sortWithinPartitions("__z").select(*items.columns, "time_us").write.option("parquet.block.row.count.limit", group_rows).mode("overwrite").parquet(path)


def write_by_site(df: DataFrame, path: str, site: str = "site") -> None:
    """One folder for each site."""
    df.write.mode("overwrite").partitionBy(site).parquet(path)


def write_geojson(lines: DataFrame, path: str, line: str = "line", properties: list[str] | None = None) -> None:
    """Features as lines of GeoJSON text, as many files as partitions."""
    names = properties if properties is not None else [c for c in lines.columns if c != line]
    coordinates = F.transform(line, lambda v: F.array(v["x"], v["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*names).alias("properties"))
    lines.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset and Spark runs in this process alone, in a temporary folder. Else an error:
    the machines of a cluster wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="firn-scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
