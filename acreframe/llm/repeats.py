"""Removal of passages that documents share, by windows of words whose lengths double.

A window is ``window`` consecutive words of one document; every word goes that lies in a window whose words also start earlier
(a smaller key, or the same document and an earlier start). Of each window a shorter run inside it stands for it: the run of
``first`` words with the least hash, which equal windows have at one and the same place. Runs that occur once in all documents
cannot belong to a window that repeats. Only the others are lengthened to twice as many words, still inside their window,
until runs are as long as the window or none is left. At full length the first place of each window is found, and all its
other places are cut. Neighbouring windows mostly share their run, so of the shortest runs a sixth as many as words travel.

Places never meet the text in a shuffle of texts. The documents are written once, bucketed by the task that wrote them, so that a
join with places moves the places alone. A run that occurs once tells its own place, and a window's first place is a
minimum, so both are aggregations that are combined before the shuffle: a passage that a third of all documents have
sends one row a task, and no list of a run's places is ever made. Hashes have 64 bits while runs only rule windows out, and
96 bits at full length.

Defined results: a null text counts as empty; a null key counts as the smallest; rows that share a key are ordered as they
are read. Words are parted by blanks, tabs and line ends; what is kept is joined by one blank.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from acreframe.llm._shared import discard, mapped, mixed, scratch, slices, unused, written

WINDOW, FIRST = 20, 10


def lengths(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """``first`` doubled up to ``window``."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Words:
    """The words of several texts one behind the other, with the windows that lie inside one text."""

    def __init__(self, texts: pa.Array, window: int):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
        full = pc.not_equal(flat, "")
        self.owner = owner[full.to_numpy(zero_copy_only=False)].astype(np.int64)
        self.words = flat.filter(full)
        self.count = np.bincount(self.owner, minlength=len(texts))
        self.begin = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.window = window
        last = np.arange(len(self.words) - window + 1)
        self.starts = last[self.owner[window - 1 :] == self.owner[: len(last)]] if len(last) else np.zeros(0, np.int64)

    def hashes(self) -> list[np.ndarray]:
        """Two numbers of 64 bits for each word."""
        import xxhash

        coded = self.words.dictionary_encode()
        at = coded.indices.to_numpy()
        whole = [xxhash.xxh3_128_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
        return [np.array([x >> shift & 0xFFFFFFFFFFFFFFFF for x in whole], np.uint64)[at] if len(at) else np.zeros(0, np.uint64) for shift in (0, 64)]


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, each made of two runs of half its length."""
    if length == 1 or len(words) < length:
        return words[: max(0, len(words) - length + 1)]
    half, n = (length + 1) // 2, len(words) - length + 1
    part = runs(words, half)
    return mixed(part[:n], part[length - half : length - half + n])


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` numbers, the place of the first least one."""
    place, value, done = np.arange(len(h)), h, 1
    while done < width and len(value):
        step = min(done, width - done)
        n = max(0, len(value) - step)
        less = value[step:] < value[:n]
        place, value, done = np.where(less, place[step:], place[:n]), np.where(less, value[step:], value[:n]), done + step
    return place


def standing(words: Words, hashes: np.ndarray, first: int) -> np.ndarray:
    """For each window, where its run of ``first`` words with the least hash begins."""
    return least_places(runs(hashes, first), words.window - first + 1)[words.starts] if len(words.starts) else words.starts


def alive(words: Words, least: np.ndarray, levels: list[int], lone: list[pa.Array]) -> np.ndarray:
    """Which windows have no run, at any of the levels, that is alone in all documents; ``lone``: places of such runs by text."""
    out = np.ones(len(words.starts), bool)
    for length, places in zip(levels, lone, strict=True):
        alone = _marked(words, places)
        out &= ~alone[np.minimum(least, words.starts + words.window - length)]
    return out


def _marked(words: Words, places: pa.Array) -> np.ndarray:
    """A flag for each word, set at the places (an array of lists, null: none) counted from the start of their text."""
    out = np.zeros(len(words.words) + 1, bool)
    of = pc.list_parent_indices(places).to_numpy()
    out[words.begin[of] + places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = True
    return out


def covered(words: Words, windows: np.ndarray) -> np.ndarray:
    """A flag for each word that lies in one of the windows."""
    edge = np.zeros(len(words.words) + 1, np.int64)
    np.add.at(edge, words.starts[windows], 1)
    np.add.at(edge, words.starts[windows] + words.window, -1)
    return np.cumsum(edge)[:-1] > 0


class Layout:
    """The rows, written once, in a bucket for each task that wrote them: ``table`` has the columns given and (_task, _row)."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        part, number, self.task, self.row = unused(rows, "_part", "_number", "_task", "_row")
        count = rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
        self.buckets = (count or 0) + 1
        known = F.broadcast(_bucket_values(spark, self.buckets).toDF(part, number))  # a row for each task
        numbered = rows.withColumn(part, F.spark_partition_id()).withColumn(self.row, F.monotonically_increasing_id())
        numbered = numbered.join(known, part, "left").withColumn(self.task, F.coalesce(number, part)).drop(part, number)
        self.path, self.name = scratch(spark, "texts"), f"acreframe_{uuid.uuid4().hex}"
        numbered.write.bucketBy(self.buckets, self.task).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.table = spark.table(self.name)
        self.table._scratch = self.path

    def with_places(self, tables: list[DataFrame]) -> DataFrame:
        """The rows with, for each table (_task, _row, place), the list ``_places_<k>`` of their places, or null."""
        if not tables:
            return self.table
        moved = tables[0].withColumn("_kind", F.lit(0))
        for k, t in enumerate(tables[1:], 1):
            moved = moved.unionByName(t.withColumn("_kind", F.lit(k)))
        lists = moved.repartition(self.buckets, self.task).groupBy(self.task, self.row).agg(*[F.collect_list(F.when(F.col("_kind") == k, F.col("place"))).alias(f"_places_{k}") for k in range(len(tables))])
        return self.table.join(lists.hint("shuffle_hash"), [self.task, self.row], "left")

    def drop(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.table)


@contextmanager
def _buckets_hold(spark: SparkSession) -> Iterator[None]:
    """Rows of one task and number lie in one bucket of the task, so that joins on both need not move what is bucketed by one."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucket_values(spark: SparkSession, buckets: int) -> DataFrame:
    """(bucket, value) with a value that falls into each bucket, so that buckets are as even as the tasks that write them."""
    tries = spark.range(int(buckets * (np.log(buckets) + 20))).select(F.col("id").cast("int").alias("value"))
    return tries.groupBy(F.pmod(F.hash("value"), F.lit(buckets)).alias("bucket")).agg(F.min("value").alias("value"))


def _sent(layout: Layout, found: DataFrame, text: str, key: str, window: int, levels: list[int], length: int) -> DataFrame:
    """The runs of ``length`` words that stand for windows still alive: (h, [h2, _key at full length], _task, _row, place)."""
    whole, before = length == window, levels[: levels.index(length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column(0), window)
            one, two = words.hashes()
            least = standing(words, one, levels[0])
            left = alive(words, least, before, [part.column(4 + k) for k in range(len(before))])
            begin = np.minimum(least, words.starts + window - length)[left]
            begin = begin[np.concatenate([[True], begin[1:] != begin[:-1]])] if len(begin) else begin
            of = pa.array(words.owner[begin])
            out = [pa.array(runs(one, length)[begin].view(np.int64))]
            if whole:
                out += [pa.array((runs(two, length)[begin] >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column(3).take(of)]
            yield pa.RecordBatch.from_arrays([*out, part.column(1).take(of), part.column(2).take(of), pa.array((begin - words.begin[words.owner[begin]]).astype(np.int32))], names=names)

    kind = found.schema[key].dataType.simpleString()
    schema = "h bigint" + (f", h2 int, _key {kind}" if whole else "") + f", {layout.task} int, {layout.row} bigint, place int"
    names = [c.strip().split(" ")[0] for c in ("h", "h2", "_key") if whole or c == "h"] + [layout.task, layout.row, "place"]
    return mapped(found.select(text, layout.task, layout.row, key, *[f"_places_{k}" for k in range(len(before))]), run, schema)


def places(layout: Layout, key: str, text: str, window: int = WINDOW, first: int = FIRST) -> tuple[list[int], list[DataFrame], DataFrame | None]:
    """(levels, places of lone runs by level, first places of the windows left); the last is None where no window repeats."""
    levels, lone = lengths(window, first), []
    for length in levels[:-1]:
        sent = _sent(layout, layout.with_places(lone), text, key, window, levels, length)
        seen = Observation()
        runs_ = sent.groupBy("h").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in (layout.task, layout.row, "place")]).observe(seen, F.count_if(F.col("n") > 1).alias("again"))
        lone.append(written(runs_.where("n = 1").select(layout.task, layout.row, "place"), f"lone-{length}"))
        if not seen.get["again"]:
            return levels, lone, None
    sent = _sent(layout, layout.with_places(lone), text, key, window, levels, window)
    order = F.struct("_key", layout.row, "place", layout.task)
    heads = sent.groupBy("h", "h2").agg(F.min(order).alias("at")).select(F.col(f"at.{layout.task}").alias(layout.task), F.col(f"at.{layout.row}").alias(layout.row), F.col("at.place").alias("place"))
    return levels, lone, written(heads, "firsts")


def _finished(rows: DataFrame, key: str, text: str, window: int, first: int, digest: bool) -> DataFrame:
    """The rows with ``text`` replaced by what is kept, or by its SHA-256, and n_words, n_removed."""
    with _buckets_hold(rows.sparkSession):
        return _cut(rows, key, text, window, first, digest)


def _cut(rows: DataFrame, key: str, text: str, window: int, first: int, digest: bool) -> DataFrame:
    words_, removed_ = unused(rows, "n_words", "n_removed")
    layout = Layout(rows)
    levels, lone, heads = places(layout, key, text, window, first)
    whole = heads is not None
    levels = levels[: len(lone)]
    columns = rows.columns
    found = layout.with_places([*lone, heads] if whole else []).select(*columns, *([f"_places_{k}" for k in range(len(lone) + 1)] if whole else []))
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column(at), window)
            cut = np.zeros(len(words.words), bool)
            if whole and len(words.starts):
                least = standing(words, words.hashes()[0], levels[0]) if levels else words.starts
                left = alive(words, least, levels, [part.column(len(columns) + k) for k in range(len(levels))])
                cut = covered(words, left & ~_marked(words, part.column(len(columns) + len(levels)))[words.starts])
            kept, gone = [], np.bincount(words.owner[cut], minlength=part.num_rows)
            for i, (begin, n) in enumerate(zip(words.begin.tolist(), words.count.tolist(), strict=True)):
                own = (part.column(at)[i].as_py() or "").encode().split()
                if gone[i]:
                    own = [w for w, x in zip(own, cut[begin : begin + n].tolist(), strict=True) if not x]
                plain = b" ".join(own)
                kept.append(hashlib.sha256(plain).hexdigest() if digest else plain.decode())
            out = [pa.array(kept, pa.string()) if k == at else part.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(words.count.astype(np.int64)), pa.array(gone.astype(np.int64))], names=[*columns, words_, removed_])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in rows.schema) + f", {words_} bigint, {removed_} bigint"
    out = written(mapped(found, run, schema), "cut")
    layout.drop()
    discard(*lone, *([heads] if whole else []))
    return out


def digests(rows: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each row."""
    return _finished(rows.select(key, text), key, text, window, first, True).select(key, "n_words", "n_removed", F.col(text).alias("kept_sha256"))


def without_repeats(rows: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """The rows with all their columns, their texts without the passages that start earlier elsewhere."""
    return _finished(rows, key, text, window, first, False).select(*rows.columns)
