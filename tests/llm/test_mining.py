"""Resampling, repeated passages and collocations against brute force and their SQL."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from acreframe.llm import collocations, queries, repeats, resample
from tests.conftest import DATA
from tests.llm.test_text import HARD, hard, none  # noqa: F401

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def same_as_sql(spark, other, name):
    """The query's rows are those of its SQL, columns by name."""
    got = queries.QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    want = other.execute(queries.ORACLES[name])
    at = [[c[0] for c in want.description].index(n) for n in names]
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    assert order(tuple(r[n] for n in names) for r in got.collect()) == order(tuple(r[i] for i in at) for r in want.fetchall())


# --- resampling


def plain_resample(rows, target, share, least, most, buckets, seed=2024):
    """(key, n_features, weight, score, rank) by loops."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    own, other = [(k, *grams(t)) for k, t in rows], [b for _, t in target for b in grams(t)[1]]
    s, t = collections.Counter(b for _, _, g in own for b in g), collections.Counter(other)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for k, n, g in own:
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(order[: share[0] * len(order) // share[1]])}
    return [(k, n, weight, score, rank.get(id(r))) for r in out for k, _, n, weight, score in [r]]


def test_resample_is_its_sql(spark, other):
    same_as_sql(spark, other, "op12_resample")


@pytest.mark.parametrize("most", [1, 2, 3])
def test_resample_of_longer_features(spark, most):
    words = "the Cat of thE dog, Été ÉTÉ 日本 x1 2024".split()
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 5 + i % 40))) for i in range(200)]
    target = [(i, "the dog 2024 " * 20) for i in range(3)]
    got = resample.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(target, "item_id long, text string"), most=most, buckets=64, share=(1, 3))
    order = lambda x: sorted(x, key=str)
    assert order(map(tuple, got.collect())) == order(plain_resample(rows, target, (1, 3), 20, most, 64))


def test_ranks_follow_one_another_and_selected_rows_keep_their_columns(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(7)
    target = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    ranks = sorted(r["rank"] for r in resample.resampled(documents, target).where("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 50
    kept = resample.selected(documents, target)
    assert kept.columns == documents.columns and kept.count() == len(ranks)


def test_resample_defined_results(hard, none):  # noqa: F811
    got = resample.resampled(hard, hard.select(F.col("text").alias("body")), target_text="body", least=0, share=(1, 2))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(HARD) and sorted(r[4] for r in rows if r[4]) == [1, 2, 3, 4]
    assert {r[0]: r[1:3] for r in rows if r[0] in (2, 3, 4)} == {2: (0, 0), 3: (0, 0), 4: (0, 0)}
    assert sorted(rows, key=str) == sorted(plain_resample(HARD, HARD, (1, 2), 0, 1, resample.BUCKETS), key=str)
    assert resample.resampled(none, hard).count() == 0 and resample.resampled(hard, none).count() == len(HARD)
    assert resample.selected(hard, hard, least=0).columns == hard.columns


# --- passages that repeat


def plain_cut(rows, window):
    """(key, n_words, n_removed, kept) by a dictionary of all windows; rows in the order of their keys, null first."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone.update(range(i, i + window))
            seen.add(x)
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def cut_rows(rows, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.digests(rows, **options).collect()), key=str)


def test_passages_are_their_sql(spark, other):
    same_as_sql(spark, other, "op13_substring_dedup")


@pytest.mark.parametrize(("window", "first"), [(20, 10), (20, 5), (6, 2), (7, 2), (3, 10), (1, 1), (5, 1)])
def test_windows_of_any_length(spark, window, first):
    """Few different words, so that many short runs repeat whose windows do not."""
    r = random.Random(window * 31 + first)
    vocabulary = ["a", "b", "é", "日本", "x.y"] + [f"w{i}" for i in range(40 if window > 3 else 4000)]
    shared = [[r.choice(vocabulary) for _ in range(3 * window)] for _ in range(4)]
    rows = []
    for i in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            at, part = r.randrange(len(words) + 1), shared[i % 4]
            words[at:at] = part[r.randrange(3) :] * (1 + i % 2)
        rows.append((i, r.choice([" ", "  ", "\n", "\t"]).join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted(((k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in plain_cut(rows, window)), key=str)
    assert cut_rows(frame, window=window, first=first) == want


def test_no_window_repeats(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(40))) for i in range(20)]
    got = repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_words, r.n_removed) for r in got} == {(40, 0)} and len(got) == 20


def test_a_passage_that_most_documents_have(spark):
    """One group holds most windows: the first document keeps it, all others lose it."""
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, f"{passage} own{i} words{i}") for i in range(3000)]
    got = repeats.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("n_removed").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).collect()
    assert {(r.n_removed, r.n, r.first) for r in got} == {(0, 1, 0), (30, 2999, 1)}


def test_kept_texts_and_columns(spark):
    rows = [(2, "a b c d e", "x", 5), (1, "z a b c d", "y", 6), (3, None, None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string, n_words int")
    got = {r.doc_id: tuple(r) for r in repeats.without_repeats(frame, window=3, first=2).collect()}
    assert got == {1: (1, "z a b c d", "y", 6), 2: (2, "e", "x", 5), 3: (3, "", None, 7)}


def test_passages_defined_results(hard, none):  # noqa: F811
    assert len(cut_rows(hard)) == len(HARD) and repeats.without_repeats(hard).columns == hard.columns
    got = cut_rows(hard, window=5, first=2)
    assert [(r[1], r[2]) for r in got if r[0] == 7] == [(5, 5), (5, 5)] and [(r[1], r[2]) for r in got if r[0] in (2, 3, 4)] == [(0, 0)] * 3
    assert repeats.digests(none).count() == 0
    long = "y " * 200_000
    assert cut_rows(hard.limit(1).withColumn("text", F.lit(long)).select("doc_id", "text")) == [(1, 200_000, 199_999, hashlib.sha256(b"y").hexdigest())]


def test_runs_and_least_places():
    words = np.random.default_rng(3).integers(0, 3, 200).astype(np.uint64)
    for length in range(1, 12):
        got, of = repeats.runs(words, length), [tuple(words[i : i + length]) for i in range(200 - length + 1)]
        assert len(got) == len(of) and len(set(got.tolist())) == len(set(of)) == len(set(zip(of, got.tolist(), strict=True)))
        least = repeats.least_places(words, length)
        assert least.tolist() == [i + min(range(length), key=lambda k: (w[k], k)) for i, w in enumerate(of)]


# --- collocations


def plain_collocations(rows, least, most, top, share=50):
    """(lang, rank, phrase, a, l, r, n, score) by dictionaries."""
    lower, f, n = str.maketrans(string.ascii_uppercase, string.ascii_lowercase), collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {}
    known = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in known.items():
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], p))
    out = []
    for lang, each in found.items():
        covered = {(p[i:j]) for (g, p), a in known.items() if g == lang for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * known[lang, p[i:j]]}
        kept = sorted(x for x in each if x[5] not in covered)[:top]
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -score) for k, (score, a, p, l, r, _) in enumerate(kept, 1)]
    return sorted(out)


def odd_phrases(n, seed):
    r = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "日本", "x-y", "n\x00l", "to"]
    return [("".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ".", "\n", " ,; "]) for _ in range(r.randrange(60))), r.choice(["en", "de", None, "und"])) for _ in range(n)]


def test_collocations_are_their_sql(spark, other):
    same_as_sql(spark, other, "op11_collocations")


@pytest.mark.parametrize(("least", "most", "top", "shard"), [(10, 3, 2000, 500_000), (3, 4, 7, 40), (2, 2, 50, 10), (5, 5, 2000, 100)])
def test_collocations_of_odd_texts(spark, monkeypatch, least, most, top, shard):
    """Shards of few keys, too, so that keys fall into many of them."""
    monkeypatch.setattr(collocations, "SHARD", shard)
    rows = odd_phrases(300, least)
    got = collocations.mined(spark.createDataFrame(rows, "text string, lang string").repartition(5), least=least, most=most, top=top)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, least, most, top)


def test_collocations_defined_results(hard, none):  # noqa: F811
    assert [tuple(r) for r in collocations.mined(hard, least=3).collect()] == plain_collocations([(t, None) for _, t in HARD], 3, 3, 2000)
    assert collocations.mined(none).count() == 0 and collocations.mined(hard).count() == 0


@pytest.mark.parametrize("cut", [(0, 50), (7, 40), (49, 1), (13, 0)])
def test_words_of_a_part_of_a_batch(cut):
    """Batches are dealt with in slices; words of a slice are those of its texts."""
    import pyarrow as pa

    texts = [None if i % 9 == 4 else f"Ünï{i} ÇA  va\t日本.B{'é' * i}\nX" for i in range(50)]
    part, own = pa.array(texts, pa.string()).slice(*cut), texts[cut[0] : cut[0] + cut[1]]
    got = collocations.Phrases(part, pa.array(["en"] * 50).slice(*cut))
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    assert [got.words[int(k)].as_py() for k in got.at] == [w for t in own for w in re.sub(r"[.\n]", " . ", (t or "").translate(lower)).split()]
    plain = repeats.Words(part, 2)
    assert plain.words.to_pylist() == [w for t in own for w in (t or "").split()] and plain.count.tolist() == [len((t or "").split()) for t in own]


def test_perfect_hash_is_minimal_and_knows_its_keys():
    r = np.random.default_rng(5)
    one = r.integers(0, 2**63, 50_000).astype(np.uint64)
    one[:1000] = one[0]  # keys that differ in their second part alone
    two, owner = np.arange(50_000).astype(np.uint32), r.integers(-(2**31), 2**31, 50_000).astype(np.int32)
    hashed = collocations.PerfectHash.load(collocations.PerfectHash.build(one, two, owner).dump())
    slots = hashed.find(one, two)
    assert sorted(slots.tolist()) == list(range(50_000)) and (hashed.owner[slots] == owner).all()
    assert sum(map(len, hashed.bits)) < 4 * 50_000
    assert (hashed.find(one, two + np.uint32(1_000_000)) == -1).all() and (hashed.find(r.integers(0, 2**63, 50_000).astype(np.uint64), two) == -1).all()
    empty = collocations.PerfectHash.load(collocations.PerfectHash.build(one[:0], two[:0], owner[:0]).dump())
    assert (empty.find(one, two) == -1).all()


def test_shards_that_do_not_fit_are_read_again(tmp_path, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 1)
    monkeypatch.setattr(collocations, "_held", collections.OrderedDict())
    paths = [collocations._write(str(tmp_path), np.arange(10 + k).tobytes()) for k in range(3)]
    for _ in range(2):
        assert [len(collocations._read(p, lambda data: np.frombuffer(data, np.int64))) for p in paths] == [10, 11, 12]
    assert len(collocations._held) == 1


def test_a_shard_takes_little_more_than_its_keys():
    """What a task holds of a shard, so that it holds many: 16 bytes a key for the keys and owners, less than one for the hash."""
    draw = np.random.default_rng(9)
    one, two = np.unique(draw.integers(0, 1 << 63, 40_000, dtype=np.uint64)), None
    two = draw.integers(0, 1 << 32, len(one), dtype=np.uint32)
    hashed = collocations.PerfectHash.load(collocations.PerfectHash.build(one, two, np.arange(len(one), dtype=np.int32)).dump())
    assert 16 * len(one) < hashed.bytes < 17 * len(one)
    assert (one[hashed.owner[hashed.find(one, two)]] == one).all()


def test_counted_sends_texts_of_phrases_only(spark, monkeypatch):
    """Words alone are counted, but no row is sent for their texts."""
    seen, counted = [], collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda *a: [seen.append(counted(*a)), seen[-1]][1])
    rows = spark.createDataFrame([("one two three four. five", "en")] * 12, "text string, lang string")
    assert {r.phrase for r in collocations.mined(rows).collect()} == {"one two three", "two three four"}
    assert sorted({r.words for r in seen[0].where("words is not null").collect()}) == [2, 3]
