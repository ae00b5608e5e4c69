"""Archives, mixing, duplicates, quality rules and the pipeline against plain versions."""

import base64
import collections
import hashlib
import io
import re

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from acreframe.llm import exact_dedup, mixing, near_dedup, pieces, quality_rules, queries, toxicity, warc
from acreframe.llm._shared import group_attach
from tests.conftest import DATA
from tests.llm.test_text import HARD, hard, model_path, none  # noqa: F401

FOLDER = f"{DATA}/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# --- archives


def test_pages_come_back(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").toPandas().set_index("page_id")
    got = queries.op4_warc(spark, FOLDER).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for i, r in got.iterrows():
        body = pages.html[i].encode()
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.url == pages.url[i]


def test_equal_payloads_are_revisits(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (9, None, "same"), (3, "a\r\nb", "other"), (4, "u", None), (5, "u", ""), (None, "u", "lone"), (6, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("last", F.lit(2)).repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), None: ("response", None), 6: ("response", None)}
    assert got[1].payload_bytes == 4 and got[4].payload_bytes == 0 and got[6].payload_bytes == 200_000
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_and_dictionary(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    archives, folder = warc.archive(pages)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives, folder, True).collect()}
    assert back == {r.page_id: r.html for r in pages.collect()}
    fs, root = warc.file_system(folder)
    with fs.open_input_stream(f"{root}/{archives.first().archive}") as f:
        head = f.read(8)
    assert head[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18]) and int.from_bytes(head[4:], "little") > 1000


def test_what_a_lost_task_left_is_not_read(spark):
    """Archives and heap files of attempts that broke off stand beside those that tables name."""
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    archives, folder = warc.archive(pages)
    fs, root = warc.file_system(folder)
    for name in ("lost.warc.zst", "empty.warc.zst"):
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(b"half a frame"[: 12 if name[0] == "l" else 0])
    assert warc.read_archives(archives, folder).count() == pages.count()
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    heaps = exact_dedup.scratch(spark, "exact")
    first = exact_dedup.hashed(docs, "doc_id", "text", heaps).collect()  # an attempt whose rows are lost
    table = exact_dedup.written(exact_dedup.hashed(docs, "doc_id", "text", heaps), "hashes")
    assert {r.heap for r in first}.isdisjoint({r.heap for r in table.select("heap").distinct().collect()})
    found = exact_dedup.resolve(table, "doc_id", heaps).agg(F.sum("group_size")).first()
    assert found[0] >= len(first) and exact_dedup.groups(docs).where("kept").count() == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})


def test_intermediate_tables_go(spark):
    from acreframe.llm._shared import discard, scratch, written

    one, two = written(spark.range(3), "a"), written(spark.range(4), "b")
    discard(one)
    assert two.count() == 4 and f"acreframe-{spark.sparkContext.applicationId}/" in scratch(spark, "c")
    with pytest.raises(Exception):
        spark.read.parquet(one._scratch)


def test_reader_refuses_damage():
    good = warc.record(1, "u", b"body", warc.payload_digest(b"body"), None, False)
    assert warc.parse(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Content-Length: 4\r\n", b"Content-Length: 5\r\n")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    frame = zstandard.ZstdCompressor().compress(good)
    assert [r["page"] for r in warc.read_archive(io.BytesIO(warc.leading_frame(b"") + frame + frame))] == [1, 1]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(warc.leading_frame(b"") + frame[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(frame)))


# --- mixing


def plain_targets(sizes):
    """Repeated capping, source by source."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else weight[s] * rest / free for s in names}
        over = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixture(spark, documents):
    got = mixing.mixture(documents).join(documents.select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (got["size"] == [len(WORD.findall(t)) for t in got.text]).all() and (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    whole = got.groupby("source")["size"].sum().to_dict()
    want = plain_targets(whole)
    for s, part in got.groupby("source"):
        assert part.source_size.iloc[0] == whole[s] and abs(part.target.iloc[0] - want[s]) < 1e-6 * want[s]
        assert abs(part.taken.sum() - want[s]) < 0.02 * want[s]
        assert abs((part["size"] * part.rate).sum() - want[s]) < 1e-4 * want[s]
    again = mixing.mixture(documents.repartition(7)).toPandas().sort_values("doc_id")
    assert (again.taken.tolist() == got.sort_values("doc_id").taken.tolist())


def test_rates_solve_the_dual(spark, documents):
    """Rates against bisection, source by source, and against other rates that meet the constraint."""
    import numpy as np

    got = mixing.mixture(documents).join(documents.select("doc_id", "source"), "doc_id").toPandas()
    rng = np.random.default_rng(1)
    for _, part in got[got["size"] > 0].groupby("source"):
        size, target = part["size"].to_numpy(float), part.target.iloc[0]
        mean = got[got.source == part.source.iloc[0]]["size"].mean()
        low, high = -500.0, 500.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (size * np.minimum(3, np.exp(np.minimum(50, mid * size / mean)))).sum() < target else (low, mid)
        want = np.minimum(3, np.exp(np.minimum(50, low * size / mean)))
        if target < 3 * size.sum() * (1 - 1e-9):
            assert np.abs(part.rate - want).max() < 1e-6
        # Moving words between documents raises the relative entropy to rate 1.
        entropy = lambda r: (r * np.log(np.maximum(r, 1e-300)) - r + 1).sum()
        for _ in range(20):
            i, j = rng.choice(len(size), 2, replace=False)
            other = part.rate.to_numpy().copy()
            words = 1e-3 * size[[i, j]].min()
            other[i], other[j] = other[i] + words / size[i], other[j] - words / size[j]
            if 0 <= other.min() and other.max() <= 3:
                assert entropy(other) > entropy(part.rate.to_numpy()) - 1e-9


def test_sources_of_one_size_and_extreme_targets(spark):
    rows = [(k, "w " * (5 if s == "b" else 1 + k % 700), s) for k, s in enumerate(["a"] * 30 + ["b"] * 900 + ["c"] * 4 + [None] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for parts in (1, 6):
        got = mixing.mixture(df.repartition(parts)).join(df, "doc_id").toPandas().sort_values("doc_id")
        whole = got.groupby("source", dropna=False)["size"].sum()
        want = plain_targets({None if s != s else s: n for s, n in whole.items()})
        for s, part in got.groupby("source", dropna=False):
            goal = want[None if s != s else s]
            assert abs((part["size"] * part.rate).sum() - goal) < 1e-6 * goal and abs(part.taken.sum() - goal) <= max(0.02 * goal, part["size"].min())
        assert parts == 1 or got.taken.tolist() == first
        first = got.taken.tolist()


def test_targets_stop_at_three_times_the_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 700, None: 300, "e": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, "source").collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in sizes) and got["a"] == 30


def test_mixing_defined_results(hard, none):  # noqa: F811
    got = mixing.mixture(hard).collect()
    assert len(got) == len(HARD) and all(r.taken <= 3 * r.size for r in got) and {r.size for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mixture(none).count() == 0
    assert mixing.repeated(hard).columns == hard.columns and {tuple(r[7:]) for r in mixing.repeated(hard).collect()} <= {tuple(r[7:]) for r in hard.collect()}


# --- exact duplicates


def test_exact_groups(spark, documents):
    docs = documents.toPandas()
    docs["plain"], docs["n"] = [re.sub(r"[\x20\x09-\x0D]", "", t) for t in docs.text], docs.text.str.len()
    docs = docs.sort_values(["n", "doc_id"], ascending=[False, True])
    keep, size = docs.groupby("plain").doc_id.transform("first"), docs.groupby("plain").doc_id.transform("size")
    got = queries.op7_exact_dedup(spark, FOLDER).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert (got.keep_id.values == keep.values).all() and (got.group_size.values == size.values).all() and (got.kept == (got.index == got.keep_id)).all()
    assert got.text_sha256.tolist() == [hashlib.sha256(p.encode()).hexdigest() for p in docs.plain]


def test_exact_defined_results(hard, none):  # noqa: F811
    got = exact_dedup.groups(hard).collect()
    assert len(got) == len(HARD) and exact_dedup.groups(none).count() == 0
    blank = [r for r in got if r.doc_id in (2, 3, 4)]
    assert {r.group_size for r in blank} == {3} and {r.keep_id for r in blank} == {4}
    same = [r for r in got if r.doc_id in (1, 7)]
    assert {(r.keep_id, r.group_size) for r in same} == {(1, 3)} and sum(r.kept for r in got) == 5
    kept = exact_dedup.keep_rows(hard)
    assert kept.columns == hard.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "None"]


def test_one_row_of_a_group_stays_where_keys_repeat(spark):
    rows = [(1, "a b c", 1), (1, "ab c", 2), (2, "abc", 3), (3, "zz", 4), (1, "a b c", 0), (None, "n n", 5), (None, "nn ", 6), (1, "zz", 7)]
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(parts)
        got = sorted((str(r.doc_id), r.text, r.extra) for r in exact_dedup.keep_rows(df).collect())
        assert got[:2] == [("1", "a b c", 0), ("1", "zz", 7)] and len(got) == 3 and got[2][0] == "None"
        assert [r.kept for r in exact_dedup.groups(df).collect()].count(True) == 3


def test_long_chains_are_cut(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHAIN", 4)
    monkeypatch.setattr(exact_dedup, "RECENT", 1)  # every row is an entry of its own
    rows = [(k, ["one text", "onetext ", "other", None, ""][k % 5]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(df).collect()}
    want = {0: (0, 120), 1: (0, 120), 2: (2, 60), 3: (3, 120), 4: (3, 120)}
    assert {k: v[:2] for k, v in got.items()} == {k: want[k % 5] for k in range(300)} and sorted(k for k, v in got.items() if v[2]) == [0, 2, 3]


def test_index_splits_spills_and_chains(tmp_path):
    index = exact_dedup.ExtendibleIndex(str(tmp_path), capacity=4, in_memory=20)
    entries = [(h * 7919 % 1009 - 500, "x", i, 1) for i, h in enumerate(list(range(200)) + [5] * 30)]
    for e in entries:
        index.insert(e)
    assert index.depth > 3 and index.parts > 0
    assert all(b.count <= b.limit or len({r[0] for r in index._load(b)}) == 1 for b in index.buckets())
    chains = list(index.chains())
    assert sorted(e for c in chains for e in c) == sorted(entries) and len({c[0][0] for c in chains}) == len(chains) and max(map(len, chains)) == 31


def test_colliding_hashes_compare_bytes():
    texts = {("h", 0, 1): b"a", ("h", 1, 1): b"b", ("g", 0, 1): b"a"}
    chain = [(5, "h", 0, 1), (5, "h", 1, 1), (5, "g", 0, 1)]
    assert exact_dedup.classes(chain, lambda *place: texts[place]) == [[chain[0], chain[2]], [chain[1]]]


# --- near duplicates


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    common = collections.Counter((a, b) for ids in held.values() for k, b in enumerate(sorted(ids)) for a in sorted(ids)[:k])
    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_classes(spark, documents):
    got = {r.doc_id: r.class_id for r in queries.op8_near_dedup(spark, FOLDER).collect()}
    want = brute_classes([(r.doc_id, r.text) for r in documents.collect()])
    assert got == want and len(set(want.values())) < len(want)


def test_a_large_group_of_near_copies(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        if k:
            words[int(rng.integers(0, 120))] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"x{k}y{i}" for i in range(40)) + " " + " ".join(base[:60])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    assert all(got[k] == 0 for k in range(150)) and all(got[1000 + k] == 1000 + k for k in range(60))


def test_pairs_that_share_only_large_buckets(spark, monkeypatch):
    # Every text is in one bucket for each band, and similar to one other text of it alone.
    signed = near_dedup.signed
    monkeypatch.setattr(near_dedup, "signed", lambda *a: signed(*a).withColumn("bands", F.array(*[F.lit(b) for b in range(14)]).cast("array<bigint>")))
    rows = [(k, " ".join([f"p{k // 2}x{i}" for i in range(90)] + [f"q{k}x{i}" for i in range(4)])) for k in range(600)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k in range(600)}


def test_texts_that_repeat_another_are_its_class(spark):
    rows = []
    for k in range(40):
        words = " ".join(f"r{k}x{i}" for i in range(100))
        rows += [(10 * k + j, f"{words} ".join([""] + [""] * n).strip()) for j, n in enumerate((1, 5, 20))]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_samples_agree_as_often_as_sets_are_similar():
    import numpy as np

    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.sort(np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    wa, wb = np.ones(300), np.where(np.isin(b, a), 2.0, 1.0)
    s, t = near_dedup.draw(a, wa, 4000)
    u, v = near_dedup.draw(b, wb, 4000)
    w, _ = near_dedup.similarity((a, wa), (b, wb))
    assert abs(((s == u) & (t == v)).mean() - w) < 0.04


def test_document_frequencies_come_from_all_documents(spark):
    import numpy as np

    rows = [(i, "one common line of seven plain words " + " ".join(f"u{i}x{j}" for j in range(6))) for i in range(2000)] + [(5000, None), (5001, ""), (5002, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weights = near_dedup.document_frequencies(df.repartition(5), "text")
    own = near_dedup.shingles(near_dedup.word_hashes([rows[7][1]])[0])
    shares = weights.shares(own) * (2003 + near_dedup.PRIOR)
    assert (np.abs(shares[:3] - 2000) < 2).all() and (shares[3:] < 3).all()
    idf = weights.of(own, np.ones(len(own)))
    assert (idf[3:] == 1).all() and np.allclose(idf[:3], np.log(2000 / 3003) / np.log(near_dedup.RARE), atol=1e-3) | (idf[:3] == near_dedup.FLOOR).all()
    again = near_dedup.document_frequencies(df.repartitionByRange(17, "doc_id"), "text")
    assert (again.share == weights.share).all()
    assert (near_dedup.document_frequencies(df.limit(0), "text").share <= 1 / near_dedup.PRIOR).all()


def test_rarest_shingles_leave_no_similar_pair_apart(spark, monkeypatch):
    # Without the first pairs, everything hangs on the exact pass over larger buckets.
    import numpy as np

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(200):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 7))):
            words[int(at)] = f"n{k}x{at}"
        rows.append((k, " ".join(words)))
    pairs = near_dedup.pairs
    monkeypatch.setattr(near_dedup, "pairs", lambda full: pairs(full).limit(0))
    signed = near_dedup.signed
    monkeypatch.setattr(near_dedup, "signed", lambda *a: signed(*a).withColumn("bands", F.array(*[F.lit(b) for b in range(14)]).cast("array<bigint>")))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert got == want and 1 < len(set(want.values())) < 200


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (100, 102)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_see_few_links_of_each_node(spark, monkeypatch):
    """Classes of random links and of a group linked pair by pair; no more than two links a node go into the stars, and class pairs."""
    import random

    draw = random.Random(4)
    links = {tuple(sorted(draw.sample(range(200), 2))) for _ in range(150)} | {(a, b) for a in range(1000, 1040) for b in range(a + 1, 1040)}
    least = {x: x for pair in links for x in pair}
    for _ in range(200):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    seen, stars = [], near_dedup.stars
    monkeypatch.setattr(near_dedup, "stars", lambda rows: [seen.append(rows.count()), stars(rows)][1])
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert got == {x: root for x, root in least.items() if x != root}
    assert len(links) > 900 and all(n <= 2 * len(least) for n in seen)


def test_near_defined_results(hard, none):  # noqa: F811
    got = near_dedup.classes(hard).collect()
    assert len(got) == len(HARD) and near_dedup.classes(none).count() == 0
    assert {r.class_id for r in got if r.doc_id in (1, 7)} == {1} and {r.class_id for r in got if r.doc_id in (2, 3, 4)} == {2, 3, 4}
    assert near_dedup.keep_rows(hard).columns == hard.columns


# --- quality rules


def test_base_counts(spark, documents):
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, FOLDER).collect()}
    for r in documents.collect():
        w = WORD.findall(r.text)
        three = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {k for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        own = got[r.doc_id]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(covered))
        assert own.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (own.base_failed and own.kept)


def test_divergence_keeps_prose_and_drops_junk(spark):
    got = queries.op9_quality_rules(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.99 and got.kept[got.quality == 0].mean() < 0.7


def test_many_languages_take_the_salted_way(spark, documents, monkeypatch):
    few = {r.doc_id: r for r in quality_rules.judged(documents).collect()}
    monkeypatch.setattr(quality_rules, "MOST_LANGUAGES", 0)
    assert {r.doc_id: r for r in quality_rules.judged(documents).collect()} == few


def test_common_words_may_be_long(spark):
    rows = [(i, "communications and unquestionably the " * 40 + f"word{i}", "en") for i in range(20)]
    common = quality_rules.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    assert {r._word for r in common.collect()} == {"communications", "and", "unquestionably", "the"}


def test_distance(spark):
    p, q = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    r = spark.range(1).select(quality_rules.distance(p, q).alias("far"), quality_rules.distance(p, p).alias("near")).first()
    assert r.far == 1.0 and r.near == 0.0


def test_rules_defined_results(hard, none):  # noqa: F811
    got = quality_rules.judged(hard).collect()
    assert len(got) == len(HARD) and all(r.base_failed and not r.kept for r in got) and quality_rules.judged(none).count() == 0


# --- shared parts and the pipeline


def test_group_attach_is_null_safe(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, v int")
    got = group_attach(df, ["g"], {"most": (F.max("v"), F.max("most"))}, F.col("v").cast("string"))
    assert sorted((str(r.g), r.v, r.most) for r in got.collect()) == [("None", 3, 4), ("None", 4, 4), ("a", 1, 2), ("a", 2, 2)]


def test_pipeline(spark, documents):
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == documents.columns
        docs = spark.createDataFrame(docs.collect(), documents.schema)
        sizes.append((name, docs))
    tox, exact, near, mixed = (d for _, d in sizes)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit_rows(documents, labels)
    scores = dict(zip([r.doc_id for r in documents.collect()], model.scores([r.text for r in documents.collect()]), strict=True))
    assert {r.doc_id for r in tox.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    assert tox.join(labels.where("toxic = 0"), "doc_id").count() >= 0.99 * labels.where("toxic = 0").count()
    best = {}
    for r in tox.collect():
        key, rank = re.sub(r"[\x20\x09-\x0D]", "", r.text), (-len(r.text), r.doc_id)
        best[key] = min(best.get(key, rank), rank)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(i for _, i in best.values())
    classes = brute_classes([(r.doc_id, r.text) for r in exact.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(classes.values()))
    taken = {r.doc_id: r.copies for r in mixing.mixture(near).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == taken
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, FOLDER)
    table = pieces.ChunkTable(open(model_path(), "rb").read())
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert sorted((r.doc_id, r.n_tokens) for r in last.collect()) == sorted((r.doc_id, len(table.encode([text[r.doc_id]])[0][0])) for r in mixed.collect())


def test_pipeline_runs_on_odd_tables(spark, hard, none, tmp_path):  # noqa: F811
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for k, rows in enumerate((hard.select(*columns), none.select(*columns))):
        folder = str(tmp_path / str(k))
        rows.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, folder).count() >= 0
