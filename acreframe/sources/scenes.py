"""Scene collections as a data source of Spark: files of scenes with a manifest of what each can hold.

``write.format("acreframe_scenes")`` writes a Parquet file for each scene of a task, that is for each tile and day. Files lie in
the folder at once, but only the manifest makes them part of the collection: ``commit`` writes it when all tasks have ended, from
the names that the tasks which counted have told, and then deletes files that it does not name; ``abort`` deletes what the tasks
have written. So a task that ran twice leaves one file for each scene, and readers see all scenes of a write or none.

``read.format("acreframe_scenes")`` takes comparisons of columns that the manifest bounds (tile, row, column, time, cloud) and
gives a partition for each scene file that may hold such rows; other files are not opened. The comparisons stay with Spark, too,
as a file's bounds only tell what it can hold.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

FORMAT = "acreframe_scenes"
SCHEMA = "tile bigint, r bigint, c bigint, ts timestamp, season int, qa bigint, cloud_pct double, B2 double, B3 double, B4 double, B8 double, B11 double, B12 double"
BOUNDED = ("tile", "r", "c", "ts", "cloud_pct")  # columns whose least and greatest value the manifest has
MANIFEST = "_manifest"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _plain(value):
    """A bound as a number: times are microseconds of UTC."""
    if isinstance(value, datetime.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=datetime.timezone.utc)
        return int((value - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) / datetime.timedelta(microseconds=1))
    return value


@dataclass
class SceneFile(InputPartition):
    """A file of the collection and the bounds of its columns."""

    name: str
    rows: int
    bounds: dict[str, tuple]


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    files: list[SceneFile]


def may_hold(bounds: dict[str, tuple], f: Filter) -> bool:
    """Can a file of these bounds hold a row that the filter lets through?"""
    low, high = bounds[f.attribute[0]]
    if low is None:
        return False  # no row has a value, and no comparison holds for null
    if isinstance(f, In):
        return any(low <= _plain(v) <= high for v in f.value)
    v = _plain(f.value)
    return {EqualTo: lambda: low <= v <= high, GreaterThan: lambda: high > v, GreaterThanOrEqual: lambda: high >= v, LessThan: lambda: low < v, LessThanOrEqual: lambda: low <= v}[type(f)]()


class SceneReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.filters = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in BOUNDED:
                self.filters.append(f)
            yield f

    def partitions(self) -> list[SceneFile]:
        """The scene files of all manifests that may hold rows; the driver reads a line for each file."""
        found = [f for f in listed(self.path) if all(may_hold(f.bounds, x) for x in self.filters)]
        return found or [SceneFile("", 0, {})]

    def read(self, partition: SceneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = file_system(self.path)
        kind = to_arrow_schema(self.schema)
        with system.open_input_file(f"{root}/{partition.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=kind.names):
                yield batch.select(kind.names).cast(kind)


def listed(path: str) -> list[SceneFile]:
    """The files that the manifests of a collection name."""
    from pyarrow import fs

    system, root = file_system(path)
    if system.get_file_info(root).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    out = []
    for info in system.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith(MANIFEST):
            with system.open_input_stream(info.path) as f:
                out += [SceneFile(x["name"], x["rows"], {k: tuple(v) for k, v in x["bounds"].items()}) for x in map(json.loads, f.read().decode().splitlines())]
    return sorted(out, key=lambda f: f.name)


class SceneWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.token = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file for each scene of the task's rows, a scene being a tile's day; rows come scene by scene where they are sorted so."""
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files: list[SceneFile] = []
        held: list[pa.Table] = []
        of: tuple | None = None

        def put() -> None:
            if held:
                table = pa.concat_tables(held)
                name = f"scene-{of[0]}-{of[1]}-{self.token}-{uuid.uuid4().hex}.parquet"
                with system.open_output_stream(f"{root}/{name}") as f:
                    pq.write_table(table, f)
                files.append(SceneFile(name, table.num_rows, {c: tuple(_plain(pc.min_max(table[c])[k].as_py()) for k in ("min", "max")) for c in BOUNDED}))
                held.clear()

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            day = pc.strftime(pc.cast(table["ts"], pa.timestamp("us", "UTC")), "%Y%m%d")
            keys = list(zip(table["tile"].to_pylist(), day.to_pylist(), strict=True))
            begin = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[begin]:
                    if keys[begin] != of:
                        put()
                        of = keys[begin]
                    held.append(table.slice(begin, k - begin))
                    begin = k
        put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Name the files in a manifest, then delete what it replaces and what tasks that did not count have left."""
        from pyarrow import fs

        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        named = [f for m in messages if m is not None for f in m.files]
        before = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(MANIFEST)] if self.overwrite else []
        old = {f.name for f in listed(self.path)} if self.overwrite else set()
        part = f"{root}/.{MANIFEST}-{self.token}"
        with system.open_output_stream(part) as f:
            f.write("".join(json.dumps({"name": x.name, "rows": x.rows, "bounds": x.bounds}) + "\n" for x in named).encode())
        system.move(part, f"{root}/{MANIFEST}-{self.token}")
        for path in before:
            system.delete_file(path)
        keep = {f.name for f in named}
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name in old or (self.token in info.base_name and info.base_name.startswith("scene-") and info.base_name not in keep):
                system.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Delete every file of this write, whether its task has told of it or not."""
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            return
        for info in system.get_file_info(fs.FileSelector(root)):
            if self.token in info.base_name:
                system.delete_file(info.path)


class SceneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SceneReader:
        return SceneReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> SceneWriter:
        return SceneWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark hand filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneSource)


def write_scenes(scenes: DataFrame, path: str, mode: str = "append") -> None:
    """Scenes (SCHEMA) as files of a tile's day each; a tile's rows are written by one task."""
    register(scenes.sparkSession)
    kinds = _parse_datatype_string(SCHEMA)
    rows = scenes.select(*[scenes[f.name].cast(f.dataType).alias(f.name) for f in kinds])
    rows.repartition("tile").sortWithinPartitions("tile", "ts").write.format(FORMAT).mode(mode).option("path", path).save()


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("path", path).load()
