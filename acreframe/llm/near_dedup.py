"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five lower-case words in a row (all words, where a text has fewer). Its weight is 1 + ln of how often the text
holds it, so that a line repeated a hundred times does not outweigh all others, times its inverse document frequency: the
logarithm of the share of documents that hold it, 1 up to a share of ``RARE`` and never under ``FLOOR``. Shares come from a
count sketch of all documents, two rows of ``SLOTS`` counters, whose size does not grow with the corpus; what chance puts
into a slot is a like share of any corpus and is taken off. All documents see the same sketch, so weights agree.

Each text draws ``BANDS * ROWS`` consistent samples; two texts agree in a sample with a chance equal to their weighted
Jaccard similarity. A text with weights other than 1 draws again with all weights 1, as the plain similarity alone may make a
pair, whatever the weighted one is. Texts that agree in all samples of a band, by either draw, share a bucket. Identical texts
are one from the start. In a bucket, members are compared with the bucket's hubs, members whose other buckets are full, and
with a few others: all of them up to ``SMALL`` members, those of the same hash block beyond; so these pairs grow in
proportion to members. Every compared pair is verified on whole texts: the weighted Jaccard similarity must reach ``LEAST``,
or that with all weights 1 must. Classes are the connected components.

Then the members of larger buckets are compared exactly with those of other classes. Texts of similarity ``LEAST`` share a
shingle among the rarest ones that make up 1 - LEAST of either, and behind the first one that they share, enough is left in
both for the overlap that ``LEAST`` asks for. Pairs that meet by such a shingle and pass that bound, by weights or by numbers,
are all verified; no other pair can be similar. So no pair of similar texts that shares a bucket is left out, and texts that
share a bucket by a common passage only, or strays around a group of copies, do not meet at all, as their rarest shingles
are their own.

A pair of weighted or of plain similarity 0.8 shares no bucket with a chance of (1 - 0.8**3)**14, 1 in 23,000. Defined results: null, empty and wordless texts are
in no class but their own; a null key gives a null class; of a key that repeats, the least text is verified.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.llm._shared import SPACES, discard, group_attach, group_whole, mapped, slices, trim, unused, whole_attach, written
from acreframe.llm.language_id import pieces

BANDS, ROWS = 14, 3
LEAST = 0.8
WIDTH = 5  # words of a shingle
SLOTS, PARTS = 1 << 19, 256  # counters of a row of the sketch, and the parts in which rows travel
RARE, FLOOR = 1 / 256, 0.1  # document share up to which a shingle has its whole weight; the least inverse document frequency
PRIOR = 1000  # documents that a corpus is taken to have besides its own, as few documents tell little of what is common
BLOCK_SHINGLES = 1_000_000  # that a task counts at once
SMALL, PART = 24, 6  # members of a bucket that are all compared; members of a block of larger ones
HUBS, VARIES = 4, 0.15  # hubs of a bucket; share of a member's weight that chance takes when a hub is chosen
FEW, CHUNK = 8, 256  # open pairs for each member of mixed buckets that are compared at once; members in a task's part of a shingle
MEMBERS = 64  # of a pair's head that go to a task together

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if "up" not in _tables or len(_tables["up"]) < n:
        n = max(n, 1 << 19)
        for name, m in (("up", _MULTIPLIER), ("down", _INVERSE)):
            f = np.full(n, m, np.uint64)
            f[0] = 1
            _tables[name] = np.cumprod(f, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    if "value" not in _tables:
        _tables["value"] = mix(np.arange(1, 257, dtype=np.uint64) * _U(_MULTIPLIER))
        space = np.zeros(256, bool)
        space[list(SPACES.encode())] = True
        _tables["space"] = space
    return _tables["value"], _tables["space"]


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text."""
    value, space = _bytes_table()
    parts, of = pieces([t.lower() for t in texts])
    out: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) < 250_000):
            size += len(parts[end])
            end += 1
        encoded = [p.encode("utf-8", "surrogatepass") for p in parts[at:end]]
        data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        up, down = _powers(len(data) + 1)
        inside = ~space[data]
        edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[: len(data)], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, np.cumsum([len(e) + 1 for e in encoded]))
        for k, h in enumerate(np.split(hashes, bounds[:-1])):
            out[of[at + k]].append(h)
        at = end
    return [np.concatenate(o) if o else np.zeros(0, np.uint64) for o in out]


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each shingle, in order."""
    if not len(words):
        return words
    n = max(1, len(words) - WIDTH + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(words))):
        total += words[k : k + n] * _U((_MULTIPLIER * (2 * k + 3)) % (1 << 64))
    return mix(total + _U(min(WIDTH, len(words))))


def gamma_quantiles() -> np.ndarray:
    """2**16 quantiles of the gamma distribution of shape 2, by Newton's method; their logarithms stand beside them."""
    if "gamma" not in _tables:
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.sqrt(2 * p) + p
        for _ in range(60):
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 8)
        _tables["gamma"], _tables["log_gamma"] = x.astype(np.float32), np.log(x).astype(np.float32)
    return _tables["gamma"]


def draw(found: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, quantised log weight) of each consistent sample of a weighted set."""
    return draws(found, weights, samples)[0]


def draws(found: np.ndarray, weights: np.ndarray, samples: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The samples of a weighted set, then, where weights other than 1 are among them, those with all weights 1.

    Both come from the same random numbers. A weight of 1 has the quantised logarithm 0, so that both draws differ in the
    other columns only.
    """
    gamma = gamma_quantiles()
    log_gamma = _tables["log_gamma"]
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * _U(0x165667B19E3779F9)) | _U(1)
    uneven, each = np.flatnonzero(weights != 1), np.arange(samples)
    best = [(np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64), np.zeros(samples, np.int64)) for _ in range(1 + bool(len(uneven)))]

    def keep(to: tuple, a: np.ndarray, part: np.ndarray, near: np.ndarray, t: np.ndarray | None) -> None:
        k = a.argmin(1)
        least = a[each, k]
        better = least < to[0]
        to[0][better], to[1][better] = least[better], part[k[better]]
        if t is None:
            to[2][better] = 0
        else:
            at = np.minimum(np.searchsorted(near, k), len(near) - 1)
            to[2][better] = np.where(near[at] == k, t[each, at], 0)[better]

    for at in range(0, len(found), 512):  # parts that stay in a processor's cache
        part = found[at : at + 512]
        h = part[None, :] * seeds[:, None]
        h ^= h >> _U(31)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        bits = h.astype("<u8", copy=False).view("<u2").reshape(samples, -1, 4)
        r = gamma.take(bits[:, :, 0], mode="clip")
        left = np.float32(1) - bits[:, :, 1] * np.float32(1 / 65536)
        c = log_gamma.take(bits[:, :, 2], mode="clip")
        a = c - r * left
        near = uneven[np.searchsorted(uneven, at) : np.searchsorted(uneven, at + 512)] - at
        if len(best) > 1:
            keep(best[1], a, part, near, None)
        t = None
        if len(near):
            own, rest_ = r[:, near], left[:, near]
            t = np.floor(np.log(weights[at + near]).astype(np.float32)[None, :] / own + (1 - rest_))
            a[:, near] = c[:, near] - own * (t + rest_)
        keep(best[0], a, part, near, t)
    return [(s, t) for _, s, t in best]


def slots(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each shingle in either row of the sketch."""
    return (found & _U(SLOTS - 1)).astype(np.int64), (found >> _U(40) & _U(SLOTS - 1)).astype(np.int64)


class Weights:
    """Inverse document frequency of shingles, from a sketch of (2, SLOTS) document counts."""

    def __init__(self, counts: np.ndarray, documents: int):
        own = np.maximum(counts - counts.mean(1, keepdims=True), 1)
        self.share = (own / (documents + PRIOR)).astype(np.float32)

    def shares(self, found: np.ndarray) -> np.ndarray:
        one, two = slots(found)
        return np.minimum(self.share[0][one], self.share[1][two])

    def of(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.log(np.maximum(self.shares(found).astype(np.float64), 1e-12)) / np.log(RARE)
        return (1 + np.log(counts)) * np.clip(idf, FLOOR, 1.0)


def weighted(words: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(shingles(words), return_counts=True)
    return found, weights.of(found, counts)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(weighted, plain) Jaccard similarity of two weighted sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)), len(i) / (len(a[0]) + len(b[0]) - len(i))


def signature(found: np.ndarray, weights: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int | None]:
    """A code for each band, then, where weights differ from 1, a code for each band with weights of 1, null if the same.

    With weights of 1 both draws are one, so texts without repeated or heavy shingles meet others by either rule.
    """
    out: list[int | None] = []
    for s, t in draws(found, weights, bands * rows):
        each = mix(s + t.astype(np.uint64) * _U(_MULTIPLIER)).reshape(bands, rows)
        total = np.zeros(bands, np.uint64)
        for k in range(rows):
            total = mix(total * _U(0x9FB21C651E98DF25) + each[:, k] + _U(k))
        codes = total.view(np.int64).tolist()
        out += [None if x == y else x for x, y in zip(codes, out, strict=True)] if out else codes
    return out


def document_frequencies(rows: DataFrame, text: str) -> Weights:
    """The sketch of all documents: each task counts its own, parts of the counters are summed up by task."""

    def local(batches):
        counts, held, size, docs = np.zeros((2, SLOTS), np.int64), [], 0, 0

        def add():
            for row, at in enumerate(slots(np.concatenate(held))):
                counts[row] += np.bincount(at, minlength=SLOTS)
            held.clear()

        for part in slices(batches):
            for words in word_hashes([t or "" for t in part.column(0).to_pylist()]):
                held.append(np.unique(shingles(words)))
                docs, size = docs + 1, size + len(held[-1])
            if size >= BLOCK_SHINGLES:
                add()
                size = 0
        if held:
            add()
        pieces_ = counts.reshape(2 * PARTS, -1)
        some = [k for k in range(2 * PARTS) if pieces_[k].any()]
        # Each part in the least width that holds its counts.
        packed = [pieces_[k].astype(np.min_scalar_type(int(pieces_[k].max()))).tobytes() for k in some]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([np.int64(docs).tobytes(), *packed], pa.binary())], names=["part", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = 1 if k < 0 else SLOTS // PARTS
                data = data.as_buffer()
                own = np.frombuffer(data, f"u{data.size // n}").astype(np.int64)
                sums[k] = sums[k] + own if k in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part bigint, counts binary"
    summed = mapped(mapped(rows.select(text), local, schema).repartition("part"), total, schema).collect()  # 2 * PARTS rows of fixed size
    counts, docs = np.zeros((2 * PARTS, SLOTS // PARTS), np.int64), 0
    for k, data in summed:
        if k < 0:
            docs = int(np.frombuffer(data, np.int64)[0])
        else:
            counts[k] = np.frombuffer(data, np.int64)
    del summed
    trim()
    return Weights(counts.reshape(2, SLOTS), docs)


def signed(rows: DataFrame, key: str, text: str, shipped: Broadcast) -> DataFrame:
    """(key, one, two, bands) of each row: two hashes of the sequence of words, and a code for each band."""

    def run(batches):
        import xxhash

        known: dict[tuple[int, int], list[int | None]] = {}
        for part in slices(batches):
            one, two, codes = [], [], []
            for words in word_hashes([t or "" for t in part.column(1).to_pylist()]):
                raw = words.tobytes()
                same = (xxhash.xxh64_intdigest(raw, 1) - (1 << 63), xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                if same not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[same] = signature(*weighted(words, shipped.value)) if len(words) else []
                one.append(same[0])
                two.append(same[1])
                codes.append(known[same])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], names=[key, "one", "two", "bands"])

    return mapped(rows.select(key, text), run, f"{key} {rows.schema[key].dataType.simpleString()}, one bigint, two bigint, bands array<bigint>")


def buckets(texts: DataFrame) -> DataFrame:
    """(id, band, code, n) of the members of each bucket of n > 1 different texts (id, bands)."""
    drawn = texts.select("id", F.posexplode("bands").alias("place", "code")).where("code is not null")
    banded = drawn.select("id", (F.col("place") % BANDS).alias("band"), "code")
    sized = group_attach(banded, ["band", "code"], {"n": (F.count("*"), F.sum("n"))}, F.col("id"))
    return written(sized.where("n > 1"), "buckets")


def pairs(full: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the ids in buckets that are to be compared first."""
    weight = full.groupBy("id").agg(F.sum(F.log2(F.col("n").cast("double"))).alias("weight"))
    central = full.join(weight, "id")
    # A hub's weight varies by chance, so that the buckets of a group have different central texts for hubs.
    chance = lambda k: F.pmod(F.xxhash64("id", "band", F.lit(k)), F.lit(1000)) / 1000.0
    hubs = {f"hub{k}": (F.max(F.struct((F.col("weight") * (1 - VARIES * chance(k))).alias("weight"), F.col("id").alias("id"))), F.max(f"hub{k}")) for k in range(HUBS)}
    starred = group_attach(central, ["band", "code"], hubs, F.col("id"))
    star = starred.select(F.col("id").alias("x"), F.explode(F.array_distinct(F.array(*[F.col(f"hub{k}.id") for k in range(HUBS)]))).alias("y")).where("x <> y")
    block = F.when(F.col("n") <= SMALL, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "band", "code"), F.ceil(F.col("n") / PART)))
    parts = full.groupBy("band", "code", block.alias("block")).agg(F.collect_set("id").alias("members")).where(F.size("members") > 1)
    near = parts.select(F.explode("members").alias("x"), "members").select("x", F.explode(F.filter("members", lambda m: m > F.col("x"))).alias("y"))
    return star.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(compared: DataFrame, stored: DataFrame, shipped: Broadcast) -> DataFrame:
    """(a, b, weighted, plain) of the pairs that are similar enough, from the whole texts stored by id.

    The end of a pair that is in more pairs is its head. A head's text goes once to each task that holds some of its
    members, next to their texts, so nothing waits for a hub's pairs in one task.
    """
    ends = compared.select(F.col("a").alias("id")).unionByName(compared.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    of_a, of_b = (ends.select(F.col("id").alias(c), F.col("degree").alias(f"degree_{c}")) for c in "ab")
    both = compared.join(of_a, "a").join(of_b, "b")
    a_heads = (F.col("degree_a") > F.col("degree_b")) | ((F.col("degree_a") == F.col("degree_b")) & (F.col("a") < F.col("b")))
    led = both.select(F.when(a_heads, F.col("a")).otherwise(F.col("b")).alias("head"), F.when(a_heads, F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest("degree_a", "degree_b").alias("degree"))
    led = written(led.withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("degree") / MEMBERS))), "pairs")
    heads = led.select("head", "salt").distinct().join(stored, F.col("head") == stored["id"]).select("head", "salt", F.col("head").alias("id"), F.lit(0).alias("place"), "text")
    members = led.join(stored, F.col("member") == stored["id"]).select("head", "salt", "id", F.lit(1).alias("place"), "text")
    lined = heads.unionByName(members).repartition("head", "salt").sortWithinPartitions("head", "salt", "place", "id")
    kind = stored.schema["id"].dataType.simpleString()

    def run(batches):
        head, own = None, None
        for part in slices(batches):
            sets = [weighted(w, shipped.value) for w in word_hashes([t or "" for t in part.column(4).to_pylist()])]
            out = []
            for h, i, place, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), sets, strict=True):
                if not place:
                    head, own = h, s
                elif head == h:
                    w, p = similarity(own, s)
                    if w >= LEAST or p >= LEAST:
                        out.append((min(h, i), max(h, i), w, p))
            if out:
                a, b, w, p = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, part.column(0).type), pa.array(b, part.column(0).type), pa.array(w, pa.float64()), pa.array(p, pa.float64())], names=["a", "b", "weighted", "plain"])

    return mapped(lined, run, f"a {kind}, b {kind}, weighted double, plain double")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id: the least id of its connected component.

    A group's members have many links each, but two of them hold most of it together: the least of the larger ends and
    the least of the smaller ones. Stars join those first, so that the other links are read once more, to find those whose
    ends are apart still, and go into no further step.
    """
    edges = written(links.select("a", "b").distinct(), "edges")
    of_a = written(group_whole(edges, ["a"], {"m": (F.min("b"), F.min("m"))}, F.col("b")), "nodes")
    of_b = written(group_whole(edges, ["b"], {"m": (F.min("a"), F.min("m"))}, F.col("a")), "nodes")
    rooted = stars(hooks(of_a, of_b))
    known = rooted.withColumnRenamed("root", "_root")
    rooted_a, rooted_b = (of.join(known, F.col(f"_key_{c}") == F.col("id"), "left").select(f"_key_{c}", "_salts", F.coalesce("_root", f"_key_{c}").alias(f"root_{c}")) for c, of in (("a", of_a), ("b", of_b)))
    ends = whole_attach(whole_attach(edges, rooted_a, ["a"], F.col("b")), rooted_b, ["b"], F.col("a")).where("root_a <> root_b")
    apart = written(ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
    discard(edges, of_a, of_b)
    if apart.isEmpty():
        discard(apart)
        return rooted
    whole = stars(rooted.select(F.col("root").alias("a"), F.col("id").alias("b")).unionByName(apart))
    discard(apart)
    return whole


def hooks(of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """(a, b): of each node the link to the least of its larger neighbours and that to the least of its smaller ones."""
    return of_a.select(F.col("_key_a").alias("a"), F.col("m").alias("b")).unionByName(of_b.select(F.col("m").alias("a"), F.col("_key_b").alias("b")))


def stars(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id, by all links.

    Large-star and small-star steps in turn until nothing changes; each halves distances, hubs are salted.
    """
    edges = written(links.select("a", "b").distinct(), "edges")
    state = None
    while True:
        # Large star: the larger neighbours of a node go to the least of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = group_attach(both, ["a"], {"m": (F.min("b"), F.min("m"))}, F.col("b"))
        large = least.where("b > a").select(F.least("m", "a").alias("a"), "b").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = group_attach(down, ["u"], {"m": (F.min("v"), F.min("m"))}, F.col("v"))
        small = least.select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).where("a <> b").select("a", "b").distinct()
        before, edges = edges, written(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(before)
        if now == state:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        state = now


def rarest(stored: DataFrame, shipped: Broadcast) -> DataFrame:
    """(id, root, token, left, width, heft, weight) of the rarest shingles of texts (id, root, text).

    left and heft are the number and the weight of a text's shingles from the token on, rarest first, width and weight
    those of all; tokens go on as long as either is ``LEAST`` of the whole.
    """
    kind = stored.schema["id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            ids, roots = part.column(0).to_pylist(), part.column(1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for i, root, words in zip(ids, roots, word_hashes([t or "" for t in part.column(2).to_pylist()]), strict=True):
                found, w = weighted(words, shipped.value)
                order = np.lexsort((found, shipped.value.shares(found)))
                found, w = found[order], w[order]
                heft = np.cumsum(w[::-1])[::-1]
                left = np.arange(len(found), 0, -1)
                n = int(((left >= LEAST * len(found) - 1e-9) | (heft >= LEAST * heft[0] - 1e-9)).sum())
                for column, values in zip(out, ([i] * n, [root] * n, found[:n].view(np.int64), left[:n], [len(found)] * n, heft[:n], [heft[0]] * n), strict=True):
                    column.extend(values)
            kinds = [part.column(0).type] * 2 + [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "root", "token", "left", "width", "heft", "weight"])

    return mapped(stored.select("id", "root", "text"), run, f"id {kind}, root {kind}, token bigint, left bigint, width bigint, heft double, weight double")


def rest(full: DataFrame, stored: DataFrame, rooted: DataFrame, shipped: Broadcast) -> tuple[DataFrame, int]:
    """Distinct pairs (a, b), a < b, of texts of larger buckets that are in different classes and may be similar, and the number of those texts."""
    large = full.where(F.col("n") > SMALL).select("id", "band", "code").join(rooted.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    large = large.select("id", "band", "code", F.coalesce("root", "id").alias("root"))
    mixed = group_attach(large, ["band", "code"], {"lo": (F.min("root"), F.min("lo")), "hi": (F.max("root"), F.max("hi"))}, F.col("id"))
    members = written(mixed.where("lo <> hi").select("id", "root").distinct(), "mixed")
    tokens = written(rarest(stored.join(members, "id"), shipped), "tokens")
    counts = tokens.groupBy("token", "root").agg(F.count("*").alias("c"))
    shared = counts.groupBy(F.col("token").alias("_token")).agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("n")).where("top.c < n")
    found = written(tokens.join(shared, F.col("token") == F.col("_token")).select(*tokens.columns, "n", (F.col("root") != F.col("top.root")).alias("stray")), "shared")
    # One end is not of the shingle's largest class; the other end's side of a shingle is dealt out in parts.
    parts = F.ceil(F.col("n") / CHUNK).cast("long")
    names = ("id", "root", "left", "width", "heft", "weight")
    x = found.where("stray").select("token", *[F.col(c).alias(f"x_{c}") for c in names], F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    y = found.select("token", *[F.col(c).alias(f"y_{c}") for c in names], F.pmod(F.xxhash64("id", F.lit(7)), parts).alias("part"))
    need = LEAST / (1 + LEAST) * (1 - 1e-9)
    plain = F.least("x_left", "y_left") >= need * (F.col("x_width") + F.col("y_width"))
    heavy = F.least("x_heft", "y_heft") >= need * (F.col("x_weight") + F.col("y_weight"))
    met = x.join(y.hint("merge"), ["token", "part"]).where((F.col("x_root") != F.col("y_root")) & (plain | heavy))
    out = written(met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "open")
    n = members.count()
    discard(members, tokens, found)
    return out, n


def across(compared: DataFrame, rooted: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes still."""
    of_a, of_b = (rooted.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    both = compared.join(of_a, "a", "left").join(of_b, "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def all_linked(full: DataFrame, stored: DataFrame, shipped: Broadcast) -> DataFrame:
    """(id, root) by the links of all pairs that share a bucket.

    First the pairs of hubs, blocks and small buckets; then all that ``rest`` finds. Where those are many, some of them
    are compared first, about one for each text, so that classes grow together and the others need not be: as long as
    that halves their number.
    """
    compared = written(pairs(full), "compared")
    found = [written(verified(compared, stored, shipped).select("a", "b"), "links")]
    rooted = components(found[0])
    open_, members = rest(full, stored, rooted, shipped)
    left = written(open_.join(compared, ["a", "b"], "left_anti"), "open")
    discard(open_, compared)
    turn, last = 0, None
    while n := left.count():
        final = n <= FEW * members or (last is not None and n > last / 2)
        some = F.lit(True) if final else F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(-(-n // max(1, members)))) == 0
        found.append(written(verified(left.where(some), stored, shipped).select("a", "b"), "links"))
        rooted = components(reduce(DataFrame.unionByName, found))
        if final:
            break
        before, left = left, written(across(left.where(~some), rooted), "open")
        discard(before)
        turn, last = turn + 1, n
    discard(left, *found)
    return rooted


def classes(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, copy_of, kept) of each row: the least key of its class, and of the texts with the same words."""
    shipped = rows.sparkSession.sparkContext.broadcast(document_frequencies(rows, text))
    table = written(signed(rows, key, text, shipped), "signatures")
    same = ["one", "two"]
    by = F.col(key).cast("string")
    worded = table.where((F.size("bands") > 0) & F.col(key).isNotNull())
    whole = written(group_whole(worded, same, {"id": (F.min(key), F.min("id")), "bands": (F.any_value("bands"), F.any_value("bands"))}, by), "distinct")
    full = buckets(whole.select("id", "bands"))
    ids = full.select(F.col("id").alias("_id")).distinct()
    own = rows.select(F.col(key).alias("id"), F.col(text).alias("text"))
    stored = written(own.join(ids, F.col("id") == F.col("_id"), "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")
    rooted = all_linked(full, stored, shipped)
    discard(full, stored)
    shipped.unpersist()
    final = whole.drop("bands").join(rooted.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id")
    found = whole_attach(worded.select(key, *same), final, same, by)
    known = found.select(key, F.coalesce("root", "id").alias("class_id"), F.col("id").alias("copy_of"))
    alone = table.where((F.size("bands") <= 0) | F.col(key).isNull()).select(key, F.col(key).alias("class_id"), F.col(key).alias("copy_of"))
    return known.unionByName(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("class_id")))


def keep_rows(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document stays, with all their columns; of a key that repeats, every row with that key."""
    (name,) = unused(rows, "_key")
    kept = classes(rows, key, text).where("kept").select(F.col(key).alias(name))
    return rows.join(kept, rows[key].eqNullSafe(F.col(name)), "left_semi")
