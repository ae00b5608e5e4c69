"""Label, candidate and prediction files, listings of tiles and rounds."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header, its columns matched to the schema by name; empty where the path is missing."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return raw.select(*[(F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV whose header may be missing: lines of another arity, headers and lines with bad whole numbers are skipped."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("_p")).where(F.size("_p") == len(schema))
    return valid_rows(parts.select(*[F.trim(F.col("_p")[i]).alias(f.name) for i, f in enumerate(schema)]), schema)


def valid_rows(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of text whose whole-number fields hold, cast to the schema."""
    whole = [f.name for f in schema if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    cast = raw.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in schema])
    return cast.dropna(subset=whole) if whole else cast


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def append_by_name(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Append with the columns of the schema, whatever their order in the rows."""
    write_csv(rows.select(*schema.names), path, "append")


def create_if_missing(spark: SparkSession, path: str, schema: T.StructType) -> None:
    write_csv(spark.createDataFrame([], schema), path, "ignore")


def list_tiles(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, tile) of raster files, the tile being the lower-case stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", tile_of(F.col("path")).alias("tile"))


def tile_of(path):
    return F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))


def round_of(name):
    """Number of a round's folder, null for names of another form."""
    return F.regexp_extract(name, r"^round_([0-9]+)$", 1).try_cast("int")


_roots: set[str] = set()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path that driver and executors share, gone when the driver ends: below ``spark.checkpoint.dir``, or on one machine
    below a folder of its own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    root = f"{base.rstrip('/')}/acreframe-core-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_at_exit, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _at_exit(jvm, conf, root: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may have gone first; nothing is left to tell then
        pass


def kept(rows: DataFrame, label: str) -> DataFrame:
    """Rows as a table in the shared folder: what is read from it stays the same however often, and outlives executors."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file of a task to a folder of any file system, whole or not at all; a repeated task replaces it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:")) if ":" in folder else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        system.delete_file(f"{path}/{name}")  # some file systems do not move onto a file
    system.move(part, f"{path}/{name}")
    return f"{folder.rstrip('/')}/{name}"
