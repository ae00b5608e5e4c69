"""What the operators of this subpackage have in common: shared folder, salted joins, bounded samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage (fixed values).
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Salts for a join on a key that may hold a large part of all rows.
SALTS = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine an own one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="acreframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_roots: set[str] = set()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the application's own part of the shared folder, which goes when the driver ends."""
    root = f"{shared_dir(spark)}/acreframe-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        context = spark.sparkContext
        atexit.register(_at_exit, context._jvm, context._jsc.hadoopConfiguration(), root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _at_exit(jvm, conf, root: str) -> None:
    try:
        _delete(jvm, conf, root)
    except Exception:  # the JVM may have gone first; nothing is left to tell then
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan reads any more; what is not given here goes when the driver ends."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            context = t.sparkSession.sparkContext
            _delete(context._jvm, context._jsc.hadoopConfiguration(), path)


def trim() -> None:
    """Give memory that was freed back to the system: a driver or worker that has done a large step goes on for long."""
    gc.collect()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def unused(rows: DataFrame, *stems: str) -> list[str]:
    """Column names that no column of ``rows`` has, whatever its case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def file_system(path: str):
    """(pyarrow file system, path inside it) of a path or URI, for tasks that write or read files of their own."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


_shipped: set[str] = set()


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)``, with this package sent to the executors once for each application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="acreframe-"), "acreframe.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(run, schema)


_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # odd numbers that mix bits


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each pair of them; the order of the two counts."""
    x = (left ^ (left >> np.uint64(31))) * _ODD[0] + right
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return (x ^ (x >> np.uint64(32))) * _ODD[2]


def id_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as empty text."""
    return F.crc32(id_text(key).cast("binary")) % of


def salt_of(by: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")


def group_whole(rows: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[Column, Column]], by: Column) -> DataFrame:
    """(_key_<key>, the aggregates, _salts) of each group: pre-aggregated by (keys, salt), with the salts that occur.

    aggregates: output name -> (aggregate of rows, aggregate of those partial results, which stand in a column of
    the output's name).
    """
    names = [f"_key_{k}" for k in keys]
    partial = rows.withColumn("_salt", salt_of(by)).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_salt").agg(*[a.alias(n) for n, (a, _) in aggregates.items()])
    return partial.groupBy(*names).agg(*[b.alias(n) for n, (_, b) in aggregates.items()], F.collect_set("_salt").alias("_salts"))


def whole_attach(rows: DataFrame, whole: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """``rows`` with the columns of their group from ``group_whole``; keys are compared null-safe.

    A group's row goes to each salt that the group has, and rows join it on (keys, salt): no task holds more than a
    salt's part of a group.
    """
    facts = [c for c in whole.columns if c != "_salts" and not c.startswith("_key_")]
    spread = whole.select(*[c for c in whole.columns if c != "_salts"], F.explode("_salts").alias("_salt_of"))
    salted = rows.withColumn("_salt", salt_of(by))
    on = F.col("_salt") == F.col("_salt_of")
    for k in keys:
        on = on & salted[k].eqNullSafe(F.col(f"_key_{k}"))
    return salted.join(spread, on, "left").select(*[salted[c] for c in rows.columns], *facts)


def group_attach(rows: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[Column, Column]], by: Column) -> DataFrame:
    """``rows`` with aggregates of their group, however large a group is."""
    return whole_attach(rows, group_whole(rows, keys, aggregates, by), keys, by)


#: Texts of more characters are not drawn for a fit, so that what the driver gathers is bounded.
SAMPLE_CHARS = 200_000


def class_sample(rows: DataFrame, key: str, label: str, per_class: int, text: str | None = None, most_chars: int = SAMPLE_CHARS) -> list:
    """A bounded sample of labelled rows: about ``per_class`` of each label, chosen by a hash of the key.

    Rows whose ``text`` has more than ``most_chars`` characters are left out; of a key and label that repeat, the least text
    counts once. The same rows are chosen whatever the partitioning. Returned in the order of that hash.
    """
    if text:
        rows = rows.where(F.length(text) <= most_chars)
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("string")).count().collect() if r[0] is not None}
    if not counts:
        return []
    scale = 1 << 24
    drawn, wanted = unused(rows, "_drawn", "_wanted")
    of = F.map_from_arrays(F.lit(list(counts)), F.lit([min(scale, per_class * scale // n + 1) for n in counts.values()]))
    hashed = F.pmod(F.xxhash64(id_text(F.col(key)), F.lit(17)), F.lit(scale))
    some = rows.withColumn(drawn, hashed).withColumn(wanted, F.try_element_at(of, F.col(label).cast("string"))).where(F.col(drawn) < F.col(wanted))
    found = (some.groupBy(key, label, drawn).agg(F.min(text).alias(text)) if text else some.select(key, label, drawn).distinct()).collect()
    return sorted(found, key=lambda r: (r[drawn], str(r[key])))


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int, most_chars: int = SAMPLE_CHARS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """((text, label) of about ``per_class`` documents of each label, the number of keys of each label).

    The sample is chosen from the labels alone, so of the texts only those of the sample move. A key with several labels
    has the largest one, a key with several texts the least one; rows without key, text or label, and texts of more than
    ``most_chars`` characters, are left out.
    """
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label is not null").groupBy("key").agg(F.max("label").alias("label"))
    share = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    chosen = class_sample(marked, "key", "label", per_class)
    if not chosen:
        return [], share
    wanted = documents.sparkSession.createDataFrame([(r["key"], r["label"]) for r in chosen], marked.schema)  # per_class rows of each label
    own = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") <= most_chars)
    found = own.join(F.broadcast(wanted), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: str(r["key"]))], share


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded size."""
    for batch in batches:
        size = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, chars // size))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
