"""Collocations: phrases whose words come together more often than their parts would, counted by minimal perfect hashing.

A phrase can only be frequent if its parts are, so phrases of two words are looked at where both words are candidates, and
longer ones where both phrases of a word less are. Candidates of a length are the keys (96 bits of hash) that all documents
together have often enough. Each range of keys becomes a shard: a minimal perfect hash, which gives each key a slot of
its own with less than six bits a key, and the keys themselves by slot, so that a phrase that is no candidate is known by its
key. Shards are files in the shared folder; a task reads those that it meets and holds ``HELD`` bytes of them at most.

One pass then counts the candidates of all lengths: a task numbers its phrases by slot, counts them with ``bincount`` in arrays
of its own and sends the blocks of slots that it met, which are summed as a tree, by block and group of tasks first, by
shard then. The sums lie beside the shards, so what a phrase's parts count, where it is cut, is read by slot. A phrase's text is
sent by the document that its key names, not by each that has it.

Defined results: a null text counts as empty, a null language is ``und``; repeated rows are documents of their own. Counts
and scores are whole numbers of any size.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreframe.llm._shared import discard, file_system, mapped, mixed, scratch, slices, trim, written

LEAST, MOST, TOP = 10, 3, 2000  # occurrences, words of a phrase, phrases of a language in the result
SHARD = 500_000  # keys of a shard
BLOCK = 4096  # slots of a block
HELD = 128_000_000  # bytes of shards, and of counts, that a task holds
CHARS = 2_000_000  # characters that are dealt with at once
GROUPS = 16  # groups of tasks in the tree of sums
SALTS = 64
_PARTS = r"[.,;:!?\x0a-\x0d]+"
_BREAK = "."  # stands between pieces; no word has it


# --- phrases of texts


class Phrases:
    """The words of several texts one behind the other, as numbers, and the keys of the phrases that lie inside pieces."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        import xxhash

        # Lower case before the cast: of large strings that are part of a longer array it comes out wrong.
        plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()), _PARTS, f" {_BREAK} ")
        split = pc.ascii_split_whitespace(plain)
        flat, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
        full = pc.not_equal(flat, "")
        coded = flat.filter(full).dictionary_encode()
        self.words = coded.dictionary
        self.at = coded.indices.to_numpy().astype(np.int64)
        self.owner = owner[full.to_numpy(zero_copy_only=False)].astype(np.int64)
        whole = _word_keys(self.words)
        known = pc.fill_null(langs, "und").dictionary_encode()
        self.langs, self.lang = known.dictionary.to_pylist(), known.indices.to_numpy().astype(np.int64)
        of = [x[self.lang][self.owner] if len(self.lang) else x[:0] for x in _word_keys(known.dictionary)]
        self.lanes = [x[self.at] if len(self.at) else x for x in whole]
        self.keys = {1: [mixed(a, b) for a, b in zip(of, self.lanes, strict=True)]}
        stop = pc.index(self.words, pa.scalar(_BREAK, self.words.type)).as_py()
        self.inside = {1: np.flatnonzero(self.at != stop)}
        self.documents = np.array([xxhash.xxh32_intdigest(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()], np.uint32).view(np.int32)

    def key(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the phrases of so many words that begin at the places: 64 bits and 32 bits."""
        lanes = [x[at] for x in self.keys[1]]
        for k in range(1, length):
            lanes = [mixed(a, own[at + k]) for a, own in zip(lanes, self.lanes, strict=True)]
        return lanes[0], (lanes[1] >> np.uint64(32)).astype(np.uint32)

    def begins(self, length: int) -> np.ndarray:
        """Where phrases of so many words begin: all words of one piece."""
        if length not in self.inside:
            least = self.begins(length - 1)
            least = least[least + length - 1 < len(self.at)]
            last = least + length - 1
            real = np.zeros(len(self.at) + 1, bool)
            real[self.inside[1]] = True
            self.inside[length] = least[real[last] & (self.owner[last] == self.owner[least])]
        return self.inside[length]

    def texts(self, length: int, at: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[self.words.take(pa.array(self.at[at + k])) for k in range(length)], pa.scalar(" ", self.words.type)).cast(pa.string())


def _word_keys(words: pa.Array) -> list[np.ndarray]:
    """Two numbers of 64 bits for each text."""
    import xxhash

    whole = b"".join(map(xxhash.xxh3_128_digest, words.cast(pa.large_binary()).to_pylist()))
    both = np.frombuffer(whole, ">u8").reshape(-1, 2).astype(np.uint64)
    return [np.ascontiguousarray(both[:, k]) for k in (1, 0)]


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, group): an order by key, where each key's run begins in it, and the run of each place.

    A key whose first number another key shares may have several runs.
    """
    order = np.argsort(one)
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


# --- minimal perfect hash


class PerfectHash:
    """Slots from 0 on, one for each key: bits of several levels, each set where just one key left falls, in words of 64 with
    the number of bits before each, so that levels take less than a byte a key."""

    def __init__(self, sizes: list[int], words: list[np.ndarray], one: np.ndarray, two: np.ndarray, owner: np.ndarray):
        self.sizes, self.words, self.one, self.two, self.owner = sizes, words, one, two, owner
        self.ranks, base = [], 0
        for w in words:
            each = np.bitwise_count(w).astype(np.int64)
            self.ranks.append((np.cumsum(each) - each + base).astype(np.int32))
            base += int(each.sum())
        self.bytes = sum(r.nbytes + w.nbytes for r, w in zip(self.ranks, words, strict=True)) + one.nbytes + two.nbytes + owner.nbytes

    @property
    def bits(self) -> list[np.ndarray]:
        """The bits of each level, one by one."""
        return [np.unpackbits(w.view(np.uint8), bitorder="little")[:n].astype(bool) for n, w in zip(self.sizes, self.words, strict=True)]

    @staticmethod
    def _place(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(one + np.uint64(level), two.astype(np.uint64) + np.uint64(level << 33)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, one: np.ndarray, two: np.ndarray, owner: np.ndarray) -> PerfectHash:
        """Of distinct keys."""
        left, sizes, words, order = np.arange(len(one)), [], [], []
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys repeat")
            size = max(8, 2 * len(left))
            place = cls._place(one[left], two[left], len(sizes), size)
            alone = np.zeros(-(-size // 64) * 64, bool)
            alone[:size] = np.bincount(place, minlength=size) == 1
            own = alone[place]
            order.append(left[own][np.argsort(place[own])])
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~own]
        order = np.concatenate(order) if order else left
        return cls(sizes, words, one[order], two[order], owner[order])

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        out, left = np.full(len(one), -1, np.int64), np.arange(len(one))
        for level, (size, words, ranks) in enumerate(zip(self.sizes, self.words, self.ranks, strict=True)):
            place = self._place(one[left], two[left], level, size)
            word, bit = words[place >> 6], np.uint64(1) << (place & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[left[hit]] = ranks[place[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            left = left[~hit]
            if not len(left):
                break
        found = np.flatnonzero(out >= 0)
        wrong = (self.one[out[found]] != one[found]) | (self.two[out[found]] != two[found])
        out[found[wrong]] = -1
        return out

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, sizes=np.array(self.sizes, np.int64), words=np.concatenate(self.words) if self.words else np.zeros(0, np.uint64), one=self.one, two=self.two, owner=self.owner)
        return to.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        x = np.load(io.BytesIO(data))
        sizes = x["sizes"].tolist()
        return cls(sizes, np.split(x["words"], np.cumsum([-(-n // 64) for n in sizes])[:-1]) if sizes else [], x["one"], x["two"], x["owner"])


_held: OrderedDict[str, tuple[object, int]] = OrderedDict()


def _read(path: str, load):
    """A file of the shared folder, held in this worker as long as there is room."""
    if path not in _held:
        fs, inside = file_system(path)
        with fs.open_input_stream(inside) as f:
            value = load(f.read())
        _held[path] = (value, value.bytes if isinstance(value, PerfectHash) else value.nbytes)
        while sum(n for _, n in _held.values()) > HELD and len(_held) > 1:
            _held.popitem(last=False)
    _held.move_to_end(path)
    return _held[path][0]


def _write(folder: str, data: bytes) -> str:
    """A new file of the shared folder: tasks that run again write files of their own."""
    path = f"{folder}/{uuid.uuid4().hex}"
    fs, inside = file_system(path)
    fs.create_dir(inside.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inside) as f:
        f.write(data)
    return path


@dataclass
class Shard:
    number: int
    path: str
    keys: int
    first: int  # its first slot among those of all shards
    counts: str = ""


@dataclass
class Candidates:
    """The shards of the candidates of one length, by the top bits of the keys; a range without keys has none."""

    bits: int
    shards: dict[int, Shard]

    def each(self, one: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """The shards that the keys fall into, and which keys."""
        of = (one >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(one), np.int64)
        order = np.argsort(of, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(own) and int(of[own[0]]) in self.shards:
                yield self.shards[int(of[own[0]])], own

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each key among those of all shards, or -1."""
        out = np.full(len(one), -1, np.int64)
        for shard, own in self.each(one):
            slot = _read(shard.path, PerfectHash.load).find(one[own], two[own])
            out[own] = np.where(slot >= 0, slot + shard.first, -1)
        return out

    def counts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """What each key counts, read by slot; 0 for keys that are not stored."""
        out = np.zeros(len(one), np.int64)
        for shard, own in self.each(one):
            slot = _read(shard.path, PerfectHash.load).find(one[own], two[own])
            counts = _read(shard.counts, lambda data: np.frombuffer(data, np.int64))
            out[own] = np.where(slot >= 0, counts[slot], 0)
        return out


def _possible(words: Phrases, length: int, shorter: Candidates | None) -> np.ndarray:
    """Where phrases begin whose two parts of a word less are candidates."""
    at = words.begins(length)
    if shorter is None or not len(at):
        return at
    own = words.begins(length - 1)
    one, two = words.key(length - 1, own)
    order, heads, group = _distinct(one, two)
    stored = (shorter.find(one[order[heads]], two[order[heads]]) >= 0)[group]
    known = np.zeros(len(words.at) + 1, bool)
    known[own[stored]] = True
    return at[known[at] & known[at + 1]]


def candidates(rows: DataFrame, text: str, lang: str, length: int, shorter: Candidates | None, first: int, folder: str, least: int) -> Candidates:
    """The candidates of one length; their slots begin with ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20, CHARS):
            words = Phrases(part.column(0), part.column(1))
            at = _possible(words, length, shorter)
            one, two = words.key(length, at)
            order, heads, _ = _distinct(one, two)
            n = np.diff(np.append(heads, len(order)))
            owner = np.minimum.reduceat(words.documents[words.owner[at]][order], heads) if len(heads) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(one[order[heads]].view(np.int64)), pa.array(two[order[heads]].view(np.int32)), pa.array(n), pa.array(owner)], names=["one", "two", "n", "owner"])
        trim()

    seen = mapped(rows.select(text, lang), run, "one bigint, two int, n bigint, owner int").groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
    keys = written(seen.where(F.col("n") >= least).select("one", "two", "owner"), f"candidates-{length}")
    bits = max(0, int(np.ceil(np.log2(max(1, keys.count()) / SHARD))))

    def build(table):
        hashed = PerfectHash.build(table["one"].to_numpy().view(np.uint64), table["two"].to_numpy().view(np.uint32), table["owner"].to_numpy())
        return pa.table({"number": pa.array([table["number"][0].as_py()], pa.int64()), "path": [_write(folder, hashed.dump())], "keys": pa.array([table.num_rows], pa.int64())})

    number = F.shiftrightunsigned("one", 64 - bits) if bits else F.lit(0).cast("bigint")
    built = written(keys.withColumn("number", number).groupBy("number").applyInArrow(build, "number bigint, path string, keys bigint"), f"shards-{length}")
    shards = {}
    for r in sorted(built.collect()):  # a row for each shard
        shards[r["number"]] = Shard(r["number"], r["path"], r["keys"], first)
        first += -(-r["keys"] // BLOCK) * BLOCK
    discard(keys, built)
    return Candidates(bits, shards)


# --- counts


class _Sums:
    """Counts of a task by shard; blocks of slots leave when it ends or has no more room."""

    def __init__(self):
        self.arrays: dict[int, np.ndarray] = {}

    def add(self, shard: Shard, slots: np.ndarray) -> None:
        own = self.arrays.setdefault(shard.first, np.zeros(-(-shard.keys // BLOCK) * BLOCK, np.int64))
        own += np.bincount(slots, minlength=len(own))

    def full(self) -> bool:
        return sum(a.nbytes for a in self.arrays.values()) > HELD

    def blocks(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(the shard's first slot, block, slots met in it, their counts)."""
        for first, own in self.arrays.items():
            met = np.flatnonzero(own)
            for part in np.split(met, np.flatnonzero(np.diff(met // BLOCK)) + 1):
                if len(part):
                    yield first, first // BLOCK + int(part[0]) // BLOCK, (part % BLOCK).astype(np.uint16).tobytes(), own[part].tobytes()
        self.arrays = {}


_COUNTED = "shard bigint, block bigint, task int, slots binary, counts binary, slot bigint, lang string, phrase string, words int, n bigint"


def counted(rows: DataFrame, text: str, lang: str, found: list[Candidates]) -> DataFrame:
    """Blocks of counts of all tasks; a row for each candidate's text, from the document that its key names; words by language."""
    schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[k]) for n, k in (c.strip().split(" ") for c in _COUNTED.split(","))])

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        given = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in columns.items()}
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, sums, told = TaskContext.get().partitionId(), _Sums(), {}

        def blocks() -> Iterator[pa.RecordBatch]:
            for shard, block, slots, counts in sums.blocks():
                yield batch(shard=[shard], block=[block], task=[task], slots=[slots], counts=[counts])

        for part in slices(batches, 1 << 20, CHARS):
            words = Phrases(part.column(0), part.column(1))
            for name, n in zip(words.langs, np.bincount(words.lang[words.owner[words.inside[1]]], minlength=len(words.langs)).tolist(), strict=True):
                told[name] = told.get(name, 0) + n
            known, out = None, []
            for length, own in enumerate(found, 1):
                at = words.begins(length)
                if known is not None:
                    at = at[known[at] & known[at + 1]]
                one, two = words.key(length, at)
                order, heads, group = _distinct(one, two)
                stored = np.zeros(len(words.at) + 1, bool)
                for shard, some in own.each(one[order[heads]]):
                    hashed = _read(shard.path, PerfectHash.load)
                    slots = np.full(len(heads), -1, np.int64)
                    slots[some] = hashed.find(one[order[heads[some]]], two[order[heads[some]]])
                    here = np.flatnonzero(slots[group] >= 0)
                    met = slots[group][here]
                    stored[at[here]] = True
                    sums.add(shard, met)
                    if length == 1:
                        continue  # only phrases are scored
                    named = np.flatnonzero(hashed.owner[met] == words.documents[words.owner[at[here]]])
                    each, where = np.unique(met[named], return_index=True)
                    begin = at[here[named[where]]]
                    langs = pa.array(words.langs, pa.string()).take(pa.array(words.lang[words.owner[begin]]))
                    out.append(batch(slot=shard.first + each, lang=langs, phrase=words.texts(length, begin), words=np.full(len(each), length, np.int32)))
                known = stored
            yield from (x for x in out if x.num_rows)
            if sums.full():
                yield from blocks()
        yield from blocks()
        yield batch(lang=list(told), n=list(told.values()))
        trim()

    return written(mapped(rows.select(text, lang), run, _COUNTED), "counted")


def summed(counts: DataFrame, found: list[Candidates], folder: str) -> None:
    """Sum the blocks as a tree, and put each shard's counts into a file beside it."""
    sizes = {s.first: s.keys for c in found for s in c.shards.values()}

    def block(key, table):
        out = np.zeros(BLOCK, np.int64)
        for slots, n in zip(table["slots"], table["counts"], strict=True):
            out[np.frombuffer(slots.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int64)
        return pa.table({"shard": key[0:1], "block": key[1:2], "counts": pa.array([out.tobytes()], pa.binary())})

    def shard(key, table):
        first = key[0].as_py()
        out = np.zeros(-(-sizes[first] // BLOCK) * BLOCK, np.int64)
        for at, n in zip(table["block"].to_pylist(), table["counts"], strict=True):
            out[at * BLOCK - first : (at + 1) * BLOCK - first] += np.frombuffer(n.as_buffer(), np.int64)
        return pa.table({"shard": pa.array([first], pa.int64()), "path": [_write(folder, out.tobytes())]})

    parts = counts.where("block is not null").select("shard", "block", (F.col("task") % GROUPS).alias("of"), "slots", "counts")
    some = parts.groupBy("shard", "block", "of").applyInArrow(block, "shard bigint, block bigint, counts binary")
    paths = {r["shard"]: r["path"] for r in written(some.groupBy("shard").applyInArrow(shard, "shard bigint, path string"), "sums").collect()}  # a row for each shard
    for c in found:
        for s in c.shards.values():
            s.counts = paths[s.first]


# --- cuts


def cuts(phrases: DataFrame, found: list[Candidates]) -> DataFrame:
    """(slot, lang, phrase, a, l, r, score, inside) of candidates of two words or more, cut where the score is least.

    ``inside`` are the slots of the shorter candidates that lie in the phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 100_000):
            out = []
            size = part.column(3).to_numpy()
            for length in range(2, len(found) + 1):
                own = part.take(pa.array(np.flatnonzero(size == length)))
                if not own.num_rows:
                    continue
                words = pc.split_pattern(own.column(2).cast(pa.large_string()), " ").flatten().dictionary_encode()
                at = words.indices.to_numpy().reshape(-1, length)
                lanes = [x[at] for x in _word_keys(words.dictionary)]
                langs = own.column(1).dictionary_encode()
                head = [x[langs.indices.to_numpy()] for x in _word_keys(langs.dictionary)]

                def key(i: int, j: int, lanes=lanes, head=head) -> tuple[np.ndarray, np.ndarray]:
                    both = head
                    for k in range(i, j):
                        both = [mixed(a, b[:, k]) for a, b in zip(both, lanes, strict=True)]
                    return both[0], (both[1] >> np.uint64(32)).astype(np.uint32)

                n = lambda i, j, key=key: found[j - i - 1].counts(*key(i, j)).tolist()
                whole, sides = n(0, length), [(n(0, k), n(k, length)) for k in range(1, length)]
                inner = [found[j - i - 1].find(*key(i, j)) for i in range(length) for j in range(i + 2, length + 1) if j - i < length]
                inside = np.stack(inner, 1).tolist() if inner else [[]] * own.num_rows
                for x, (slot, lang, phrase) in enumerate(zip(*(own.column(c).to_pylist() for c in range(3)), strict=True)):
                    a = whole[x]
                    score, k = min((1_000_000 * a * a // (l[x] * r[x]), k) for k, (l, r) in enumerate(sides))
                    out.append((slot, lang, phrase, a, sides[k][0][x], sides[k][1][x], score, inside[x]))
            if out:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["slot", "lang", "phrase", "a", "l", "r", "score", "inside"])

    return mapped(phrases.select("slot", "lang", "phrase", "words"), run, "slot bigint, lang string, phrase string, a bigint, l bigint, r bigint, score bigint, inside array<bigint>")


def mined(rows: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST, top: int = TOP, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most`` words.

    A phrase goes if a longer candidate, which it lies in, has ``share`` percent of its occurrences or more.
    """
    folder = scratch(rows.sparkSession, "phrases")
    found: list[Candidates] = []
    for length in range(1, most + 1):
        first = max((s.first + -(-s.keys // BLOCK) * BLOCK for c in found for s in c.shards.values()), default=0)
        found.append(candidates(rows, text, lang, length, found[-1] if found else None, first, folder, least))
    counts = counted(rows, text, lang, found)
    summed(counts, found, folder)
    whole = counts.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = counts.where("words >= 2").select("slot", "lang", "phrase", "words").dropDuplicates(["slot"])
    scored = written(cuts(phrases, found), "cuts")
    longer = scored.select(F.explode("inside").alias("slot"), "a").groupBy("slot").agg(F.max("a").alias("longer"))
    kept = scored.drop("inside").join(longer, "slot", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("slot"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)  # SALTS * top rows of a language
    return best.join(whole, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
