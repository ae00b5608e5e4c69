"""The queries of this subpackage: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe.llm import collocations, exact_dedup, language_id, mixing, near_dedup, pieces, pii, quality_model, quality_rules, repeats, resample, toxicity, warc
from acreframe.llm._shared import remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents whose crc32 remainder by 3 is not 1."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_rows(documents.where(remainder(F.col("doc_id"), 3) != 1))
    found = language_id.identify(documents, model)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "lang_accepted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled documents whose crc32 remainder by 4 is not 2."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    found = toxicity.score(documents, toxicity.fit_rows(documents, labels))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and their decoded text for every document."""
    from public_tokenizers import path

    return pieces.token_digests(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mixture of all sources takes of every document."""
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates over all documents."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and distribution divergence of every document."""
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its own text and the posteriors of its host and path.

    Learnt from the labelled documents whose crc32 remainder by 4 is not 2. A document's host is that of its page, else
    its source.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = quality_model.fit_rows(documents, table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2))
    found = quality_model.sites(quality_model.evidence(documents, model, keep=("source",)), table(spark, sf_dir, "pages"))
    scored = quality_model.combine(found, "host", "path")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "host", "path", "evidence", "host_posterior", "path_posterior", "score", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of each language."""
    return collocations.mined(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the texts of ``benchmark``."""
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of 20 words which starts earlier too."""
    return repeats.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_model": op10_quality_model,
    "op11_collocations": op11_collocations,
    "op12_resample": op12_resample,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLES: dict[str, str] = {}

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Twenty bits of the digest at a time give four characters of base 32.
_BASE32 = " || ".join(f"substr('{_DIGITS}', cast(((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31) + 1 AS INT), 1)" for g in range(8) for shift in (15, 10, 5, 0))
ORACLES["op4_warc"] = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages), d AS (SELECT *, sha1(body) AS h FROM p),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM d)
SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN top <> page_id THEN top END AS refers_to, coalesce(url, 'urn:none') AS url FROM m"""

ORACLES["op7_exact_dedup"] = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)"""


def _rules_sql() -> str:
    word = r"[^\x20\x09-\x0D]"
    classes = ("[A-Z]", "[0-9]", "[.,;:!?''\"()\\-]", "[^\\x00-\\x7F]", "[#*$%&|<>]", r"[\x20\x09-\x0D]")
    count = [f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in classes]
    names = [f"c{i}" for i in range(7)]
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p}*log2(2*{p}/({p}+{q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q}*log2(2*{q}/({p}+{q})) ELSE 0 END)"
    chars = " + ".join(part(f"(d.{c}/greatest(d.len, 1e0))", f"(r.{c}/greatest(r.len, 1e0))") for c in names)
    return f"""WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
 b AS (SELECT *, regexp_extract_all(t, '{word}+') AS w, {", ".join(f"{c} AS c{i}" for i, c in enumerate(count))} FROM a),
 d AS (SELECT *, len(w) AS n, length(t) AS len, length(t) - c0 - c1 - c2 - c3 - c4 - c5 AS c6, length(t) - c5 AS word_chars FROM b),
 g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS three FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM d WHERE n >= 3) x),
 k AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS m FROM g) x WHERE m > 1),
 rep AS (SELECT doc_id, count(DISTINCT i + o) AS rep FROM k, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
 dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '{word}') GROUP BY 1),
 s AS (SELECT doc_id, lang, lower(x) AS x FROM (SELECT doc_id, lang, unnest(w) AS x FROM d) y),
 r AS (SELECT lang, sum(n) AS total, sum(len) AS len, {", ".join(f"sum({c}) AS {c}" for c in names)} FROM d GROUP BY 1),
 q AS (SELECT s.lang, s.x, count(*) * 1e0 / any_value(r.total) AS share FROM s JOIN r ON r.lang IS NOT DISTINCT FROM s.lang WHERE regexp_matches(s.x, '^\\p{{L}}+$') GROUP BY 1, 2 HAVING count(*) >= 0.004 * any_value(r.total)),
 own AS (SELECT doc_id, x, count(*) AS m FROM s GROUP BY 1, 2),
 v AS (SELECT d.doc_id, coalesce(own.m, 0) * 1e0 / greatest(d.n, 1) AS p, q.share FROM d JOIN q ON q.lang IS NOT DISTINCT FROM d.lang LEFT JOIN own ON own.doc_id = d.doc_id AND own.x = q.x),
 u AS (SELECT doc_id, sum({part("p", "share")}) AS listed, greatest(1 - sum(p), 0) AS p, greatest(1 - sum(share), 0) AS share FROM v GROUP BY 1),
 z AS (SELECT d.*, coalesce(rep.rep, 0) AS rep, coalesce(dup.dup, 0) AS dup,
  CASE WHEN r.total >= 2000 AND n >= 50 THEN sqrt(greatest(({chars}) / 2, 0)) END AS cd,
  CASE WHEN r.total >= 2000 AND n >= 100 THEN sqrt(greatest((listed + {part("u.p", "u.share")}) / 2, 0)) END AS wd
  FROM d JOIN r ON r.lang IS NOT DISTINCT FROM d.lang LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id)
SELECT doc_id, n AS n_words, word_chars, c4 AS n_symbols, dup AS n_dup_lines, rep AS n_repeat_words, n < 50 OR 100*rep > 50*n AS base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
 NOT (n < 50 OR 100*rep > 50*n) AND coalesce(cd, 0) <= 0.3 AND coalesce(wd, 0) <= 0.45 AS kept FROM z"""


ORACLES["op9_quality_rules"] = _rules_sql()

# The table of crc32 from its rule, and a fold over the bytes of each distinct word.
_CRC_ROUND = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
ORACLES["op12_resample"] = f"""WITH RECURSIVE rounds AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, {_CRC_ROUND} FROM rounds WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS of FROM rounds WHERE k = 8),
 d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 own AS (SELECT doc_id, unnest(w) AS x FROM d), target AS (SELECT unnest(w) AS x FROM b),
 hexed AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM own UNION SELECT x FROM target) u),
 key AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(x)), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, y: xor(c >> 8, crc.of[(xor(c & 255, y) + 1)::INT])), 4294967295) % 10000 AS k FROM hexed, crc),
 s AS (SELECT k, count(*) AS n FROM own JOIN key USING (x) GROUP BY 1), t AS (SELECT k, count(*) AS n FROM target JOIN key USING (x) GROUP BY 1),
 g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k)),
 v AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM own JOIN key USING (x) JOIN g USING (k) GROUP BY 1),
 h AS (SELECT doc_id, len(w)::BIGINT AS n_features, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d),
 z AS (SELECT doc_id, n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h LEFT JOIN v USING (doc_id)),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)"""

ORACLES["op13_substring_dedup"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20) y),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM s) y WHERE k > 1),
 gone AS (SELECT doc_id, list(DISTINCT i + o) AS cut FROM again, range(20) r(o) GROUP BY 1),
 kept AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, CASE WHEN cut IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(cut, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_words - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""

ORACLES["op11_collocations"] = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k)) y),
 f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL),
 n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
 c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
 cut AS (SELECT lang, k, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) z),
 s AS (SELECT cut.*, l.a AS l, r.a AS r, 1000000::HUGEINT * cut.a * cut.a // (l.a::HUGEINT * r.a) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s) z WHERE o = 1),
 top AS (SELECT lang, x, max(a) AS longer FROM (SELECT lang, a, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2], string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) AS x FROM c WHERE k = 3) z GROUP BY 1, 2),
 kept AS (SELECT b.* FROM b LEFT JOIN top ON top.lang = b.lang AND top.x = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) z JOIN n USING (lang) WHERE rank <= 2000"""
