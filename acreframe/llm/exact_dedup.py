"""Exact duplicates by an extendible-hash index on files that all executors share.

Texts are equal when their bytes are, after white space has been deleted. One pass over the documents hashes each
normalised text, keeps its compressed bytes in a heap file of the task in the shared folder, and gives a small row for each
document; a task stores a text once however many copies it meets. The distinct texts of all tasks are entries of the index.
Owner tasks take ranges of the hash: each builds its part of the index, whose directory doubles when a full bucket has to
be split and whose buckets go to shared files when memory is short. Entries of one hash are a chain; their bytes are
fetched from the heap files and compared, so texts of one hash that differ stay apart. A chain of more than ``CHAIN`` entries,
as of a text that every task meets, is cut in parts that go to several owners first; of each part only one entry for each
text goes on.

Of equal texts the row with the most code points stays, then that with the smallest key. Defined results: a null text
counts as empty; empty texts are equal to each other; a null key counts as the smallest; of repeated rows one stays, of rows
that share key, text and length the one whose columns come first as JSON.
"""

from __future__ import annotations

import hashlib
import marshal
import uuid
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.llm._shared import SPACES, file_system, mapped, scratch, slices, unused, written

CAPACITY = 2048  # entries of a bucket before it is split
IN_MEMORY = 200_000  # entries that an owner task holds before buckets go to files
RECENT = 24_000_000  # bytes of normalised texts that a task remembers
PER_OWNER = 400_000
CHAIN = 256  # entries of a hash that one owner compares
_DELETE = SPACES.encode()


def hashed(rows: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """(key, sha256, points, hash, heap, at, bytes, row) of each row; texts go to heap files in ``folder``.

    (heap, at, bytes) tells where the text's bytes are; rows with the same place are equal. (heap, row) is one for each row.
    """

    def run(batches):
        import xxhash
        import zstandard

        name = uuid.uuid4().hex
        fs, path = file_system(f"{folder}/{name}")
        pack = zstandard.ZstdCompressor(level=1).compress
        heap, at, row, held = None, 0, 0, 0
        recent: OrderedDict[bytes, tuple] = OrderedDict()
        try:
            for part in slices(batches):
                out = []
                for t in part.column(1).to_pylist():
                    t = t or ""
                    plain = t.encode("utf-8", "surrogatepass").translate(None, _DELETE)
                    found = recent.get(plain)
                    if found is None:
                        packed = pack(plain)
                        if heap is None:
                            fs.create_dir(path.rpartition("/")[0], recursive=True)
                            heap = fs.open_output_stream(path)
                        heap.write(packed)
                        found = (hashlib.sha256(plain).hexdigest(), xxhash.xxh64_intdigest(plain) - (1 << 63), at, len(packed))
                        at += len(packed)
                        recent[plain] = found
                        held += len(plain) + 300
                        while held > RECENT and len(recent) > 1:
                            held -= len(recent.popitem(last=False)[0]) + 300
                    else:
                        recent.move_to_end(plain)
                    out.append((found[0], len(t), *found[1:], row))
                    row += 1
                sha, points, digest, place, size, number = zip(*out, strict=True)
                longs = [pa.array(x, pa.int64()) for x in (points, digest, place, size, number)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sha, pa.string()), *longs[:2], pa.array([name] * len(out), pa.string()), *longs[2:]], names=[key, "sha256", "points", "hash", "heap", "at", "bytes", "row"])
        finally:
            if heap is not None:
                heap.close()

    kind = rows.schema[key].dataType.simpleString()
    return mapped(rows.select(key, text), run, f"{key} {kind}, sha256 string, points bigint, hash bigint, heap string, at bigint, bytes bigint, row bigint")


class _Bucket:
    def __init__(self, depth: int, limit: int):
        self.depth, self.limit, self.rows, self.files, self.count = depth, limit, [], [], 0


class ExtendibleIndex:
    """Entries (hash, ...) in buckets that a directory of 2**depth pointers leads to; the hash's low bits choose."""

    def __init__(self, folder: str, capacity: int = CAPACITY, in_memory: int = IN_MEMORY):
        self.fs, self.path = file_system(folder)
        self.capacity, self.in_memory = capacity, in_memory
        self.depth, self.directory = 0, [_Bucket(0, capacity)]
        self.held = self.parts = 0

    def insert(self, entry: tuple) -> None:
        while True:
            bucket = self.directory[entry[0] & ((1 << self.depth) - 1)]
            if bucket.count < bucket.limit or bucket.depth >= 40 or not self._split(bucket):
                break
        bucket.rows.append(entry)
        bucket.count += 1
        self.held += 1
        if self.held > self.in_memory:
            self._spill()

    def _split(self, bucket: _Bucket) -> bool:
        """Deal a full bucket out to two; False where all entries have one hash, which no split can part."""
        rows = self._load(bucket)
        if all(r[0] == rows[0][0] for r in rows):
            bucket.limit *= 2
            return False
        if bucket.depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        self.held -= len(bucket.rows)
        self._drop(bucket)
        halves = (_Bucket(bucket.depth + 1, self.capacity), _Bucket(bucket.depth + 1, self.capacity))
        for r in rows:
            halves[r[0] >> bucket.depth & 1].rows.append(r)
        for h in halves:
            h.count = len(h.rows)
        self.held += len(rows)
        first = rows[0][0] & ((1 << bucket.depth) - 1)
        for i in range(first, len(self.directory), 1 << bucket.depth):
            self.directory[i] = halves[i >> bucket.depth & 1]
        return True

    def _spill(self) -> None:
        """Half of the entries to shared files, from the fullest buckets on."""
        self.fs.create_dir(self.path, recursive=True)
        for b in sorted(self.buckets(), key=lambda b: -len(b.rows)):
            if self.held <= self.in_memory // 2:
                break
            if b.rows:
                self.parts += 1
                with self.fs.open_output_stream(f"{self.path}/{self.parts}") as f:
                    f.write(marshal.dumps(b.rows))
                b.files.append(f"{self.path}/{self.parts}")
                self.held -= len(b.rows)
                b.rows = []

    def _load(self, bucket: _Bucket) -> list[tuple]:
        rows = list(bucket.rows)
        for name in bucket.files:
            with self.fs.open_input_stream(name) as f:
                rows += marshal.loads(f.read())
        return rows

    def _drop(self, bucket: _Bucket) -> None:
        for name in bucket.files:
            self.fs.delete_file(name)
        bucket.files = []

    def buckets(self) -> list[_Bucket]:
        return list({id(b): b for b in self.directory}.values())

    def chains(self):
        """The entries of each hash."""
        for b in self.buckets():
            chains: dict[int, list[tuple]] = {}
            for r in self._load(b):
                chains.setdefault(r[0], []).append(r)
            yield from chains.values()
            self._drop(b)


class Heaps:
    """Bytes of stored texts."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.open: OrderedDict[str, object] = OrderedDict()

    def read(self, heap: str, at: int, size: int) -> bytes:
        import zstandard

        if heap not in self.open:
            if len(self.open) >= 64:
                self.open.popitem(last=False)[1].close()
            self.open[heap] = self.fs.open_input_file(f"{self.path}/{heap}")
        self.open.move_to_end(heap)
        return zstandard.ZstdDecompressor().decompress(self.open[heap].read_at(size, at))


def classes(chain: list[tuple], read) -> list[list[tuple]]:
    """The entries of one hash, (hash, heap, at, bytes, ...), by equal bytes."""
    if len(chain) == 1:
        return [chain]
    found: list[tuple[bytes, list[tuple]]] = []
    for entry in chain:
        own = read(*entry[1:4])
        for text, members in found:
            if text == own:
                members.append(entry)
                break
        else:
            found.append((own, [entry]))
    return [members for _, members in found]


ENTRY = ("hash", "heap", "at", "bytes", "n", "less", "key", "of", "row")  # the last four tell the rows and the best one of them


def owned(entries: DataFrame, folder: str) -> DataFrame:
    """(the entry's heap and at; the first entry of its class: first_heap, first_at, first_bytes; the class's hash, n, less, key, of, row).

    Each partition is one owner's: it must hold all entries that are to be compared with each other.
    """

    def run(batches):
        index = ExtendibleIndex(f"{folder}/owner-{uuid.uuid4().hex}")
        for part in slices(batches, 4096):
            columns = part.to_pydict()
            for entry in zip(*(columns[c] for c in ENTRY), strict=True):
                index.insert(entry)
        heaps, out = Heaps(folder), []
        for chain in index.chains():
            for members in classes(chain, heaps.read):
                n = sum(m[4] for m in members)
                best = min(members, key=lambda m: (m[5], m[6] is not None, m[6], m[7], m[8]))
                first = min(m[1:4] for m in members)
                out += [(m[1], m[2], *first, m[0], n, *best[5:]) for m in members]
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    kind = entries.schema["key"].dataType
    fields = [("heap", pa.string()), ("at", pa.int64()), ("first_heap", pa.string()), ("first_at", pa.int64()), ("first_bytes", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("less", pa.int64()), ("key", to_arrow(kind)), ("of", pa.string()), ("row", pa.int64())]
    arrow = pa.schema(fields)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return mapped(entries.select(*ENTRY), run, f"heap string, at bigint, first_heap string, first_at bigint, first_bytes bigint, hash bigint, n bigint, less bigint, key {kind.simpleString()}, of string, row bigint")


def resolve(table: DataFrame, key: str, folder: str) -> DataFrame:
    """(heap, at, keep, keep_heap, keep_row, group_size) of each entry of a table that ``hashed`` made."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col(key).alias("key"), F.col("heap").alias("of"), F.col("row").alias("row")))
    entries = table.groupBy("hash", "heap", "at", "bytes").agg(F.count("*").alias("n"), best.alias("best")).select("hash", "heap", "at", "bytes", "n", "best.*")
    shuffles = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = max(shuffles, -(-table.count() // PER_OWNER))
    crowded = written(entries.groupBy("hash").agg(F.count("*").alias("length")).where(F.col("length") > CHAIN).withColumnRenamed("hash", "_hash"), "chains")
    early = None
    if not crowded.isEmpty():
        entries = written(entries, "entries")
        parts = F.pmod(F.xxhash64("heap"), F.ceil(F.col("length") / CHAIN))
        cut = entries.join(crowded, F.col("hash") == F.col("_hash")).withColumn("_part", parts)
        early = written(owned(cut.repartition(owners, "hash", "_part"), folder), "parts")
        firsts = early.where((F.col("heap") == F.col("first_heap")) & (F.col("at") == F.col("first_at"))).withColumnRenamed("first_bytes", "bytes")
        entries = entries.join(crowded, F.col("hash") == F.col("_hash"), "left_anti").unionByName(firsts.select(*ENTRY))
    # A range of the hash's upper 32 bits for each owner.
    owner = F.floor((F.shiftright("hash", 32) + (1 << 31)) * F.lit(float(owners)) / float(1 << 32))
    found = owned(entries.repartition(owners, owner), folder).select("heap", "at", F.col("key").alias("keep"), F.col("of").alias("keep_heap"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    if early is None:
        return found
    found = written(found, "classes")
    of_first = found.select(F.col("heap").alias("_heap"), F.col("at").alias("_at"), "keep", "keep_heap", "keep_row", "group_size")
    others = early.where((F.col("heap") != F.col("first_heap")) | (F.col("at") != F.col("first_at"))).select("heap", "at", "first_heap", "first_at")
    joined = others.join(of_first, (F.col("first_heap") == F.col("_heap")) & (F.col("first_at") == F.col("_at")))
    return found.unionByName(joined.select(*found.columns))


def to_arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def groups(rows: DataFrame, key: str = "doc_id", text: str = "text", points: str | None = None) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of each row, and its number of code points under the name given."""
    folder = scratch(rows.sparkSession, "exact")
    table = written(hashed(rows, key, text, f"{folder}"), "hashes")
    found = resolve(table, key, folder).select(F.col("heap").alias("_heap"), F.col("at").alias("_at"), F.col("keep").alias("keep_id"), "keep_heap", "keep_row", "group_size")
    joined = table.join(found, (table["heap"] == found["_heap"]) & (table["at"] == found["_at"]))
    kept = (F.col("heap") == F.col("keep_heap")) & (F.col("row") == F.col("keep_row"))
    return joined.select(table[key], "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"), *[F.col("points").alias(p) for p in [points] if p])


def keep_rows(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one for each group of equal texts, also where keys repeat."""
    key_, sha, points, whole = unused(rows, "_key", "_sha", "_points", "_row")
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    grouped = groups(rows, key, text, points="points").where("kept")
    kept = written(grouped.select(F.col(key).alias(key_), F.col("text_sha256").alias(sha), F.col("points").alias(points)), "kept")
    repeats = not rows.groupBy(key).count().where(F.col("count") > 1).isEmpty()
    same = rows[key].eqNullSafe(F.col(key_))
    if not repeats:
        return rows.join(kept, same, "left_semi")
    # A repeated key leads to all of its rows: those with the text and the length that stay are told apart by their columns.
    own = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, ""), 256)
    found = rows.join(kept, same & (own == F.col(sha)) & (length == F.col(points)), "left_semi")
    all_ = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    least = found.groupBy(F.col(key).alias(key_), own.alias(sha)).agg(F.min_by(all_, F.to_json(all_, {"ignoreNullFields": "false"})).alias(whole))
    return least.select(*[F.col(f"`{whole}`.`{c}`").alias(c) for c in rows.columns])
