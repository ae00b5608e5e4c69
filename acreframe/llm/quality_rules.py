"""Quality rules by distribution divergence, in DataFrame operations alone.

Base rules count words, repeated lines and repeated windows of three words. The method compares a document with the
reference of its language: histograms of character classes and of common words, both gathered over all documents of the
language, by Jensen-Shannon distance (base 2, from 0 to 1). Common words are the words that make up at least
``COMMON_SHARE`` of a language's words, so there are 1 / COMMON_SHARE of them at most. A document is dropped if its distance in
either histogram passes a limit; the histograms of short documents, and of languages with few words, are not judged.

Words are counted by language first, in one aggregation. The common words of all languages then pick those of a document,
so that only these are kept for the histogram; with more than ``MOST_LANGUAGES`` languages all words are kept instead, which
gives the same distances.

Defined results: a null text counts as empty; documents without a word fail the base rules; a null language is a language
of its own. Nothing but the language's histograms is shared between documents, so repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreframe.llm._shared import SALTS, discard, written

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
COMMON_SHARE = 0.004
CHARS_LIMIT, WORDS_LIMIT = 0.30, 0.45
CHARS_WORDS, WORDS_WORDS, REFERENCE_WORDS = 50, 100, 2000  # words that a histogram needs to be judged
MOST_LANGUAGES = 2000  # languages whose references may be broadcast, each of 1 / COMMON_SHARE words at most


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def common_words(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """(_of, _total, _word, count) of the words that make up ``COMMON_SHARE`` of a language's words; languages without one are left out."""
    words = rows.select(F.col(lang).alias("_lang"), F.explode(words_of(F.col(text))).alias("_word"))
    counts = written(words.groupBy("_lang", F.lower("_word").alias("_word")).agg(F.count("*").alias("count")), "words")
    whole = counts.groupBy(F.col("_lang").alias("_of")).agg(F.sum("count").alias("_total"))
    listed = counts.where(F.col("_word").rlike(r"^\p{L}+$")).join(whole, F.col("_lang").eqNullSafe(F.col("_of")))
    found = written(listed.where(F.col("count") >= COMMON_SHARE * F.col("_total")).select("_of", "_total", "_word", "count"), "common")
    discard(counts)
    return found


def counted(rows: DataFrame, key: str, text: str, lang: str, common: list[str] | None) -> DataFrame:
    """(key, lang, the base counts, chars, listed) of each row; listed are the words of the list, or all words without one."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = rows.select(F.col(key), F.col(lang).alias("_lang"), t.alias("_text"))
    found = found.withColumn("_words", words_of(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = found.withColumn("_lines", lines)
    found = found.withColumn("n_words", F.size("_words").cast("bigint"))
    found = found.withColumn("_spaces", F.regexp_count("_text", F.lit(BLANK)).cast("bigint"))
    three = F.transform(F.slice(F.col("_words"), 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    found = found.withColumn("_three", three)
    # Only texts with a window that repeats are sorted; a window repeats if a neighbour in that order equals it.
    ordered = F.when(F.size(F.array_distinct("_three")) < F.size("_three"), F.sort_array(F.transform("_three", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    found = found.withColumn("_ordered", ordered)
    twice = F.filter("_ordered", lambda x, i: (F.get("_ordered", i - 1)["h"] == x["h"]) | (F.get("_ordered", i + 1)["h"] == x["h"]))
    found = found.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_twice", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_twice", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    listed = F.transform("_words", F.lower)
    if common is not None:
        listed = F.filter(listed, lambda w: w.isin(common))
    symbols = F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint")
    return found.select(
        key,
        "_lang",
        "n_words",
        (F.length("_text") - F.col("_spaces")).cast("bigint").alias("word_chars"),
        symbols.alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.array(*[c.cast("double") for c in _classes(F.col("_text"), F.col("_spaces"), symbols)]).alias("_chars"),
        # Words stand between blanks of their own, so each can be counted by taking it out.
        F.concat(F.lit(" "), F.array_join(listed, "  "), F.lit(" ")).alias("_listed"),
    )


def _classes(text: Column, spaces: Column, symbols: Column) -> list[Column]:
    """Characters by class: upper case, digits, punctuation, beyond ASCII, symbols, white space, all others."""
    some = [F.regexp_count(text, F.lit(p)).cast("bigint") for p in (r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[^\x00-\x7F]")]
    some += [symbols, spaces]
    rest = F.length(text).cast("bigint")
    for c in some:
        rest = rest - c
    return [*some, rest]


def references(found: DataFrame, common: DataFrame) -> DataFrame:
    """(lang, words and shares array, char shares array, words of the language) of each language."""
    n = len(_classes(F.lit(""), F.lit(0), F.lit(0)))
    whole = found.groupBy("_lang").agg(F.sum("n_words").alias("_total"), *[F.sum(F.element_at("_chars", i + 1)).alias(f"_c{i}") for i in range(n)])
    listed = common.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct((F.col("count") / F.col("_total")).alias("share"), F.col("_word").alias("word")))).alias("_common"))
    joined = whole.withColumnRenamed("_lang", "_ref").join(listed, F.col("_ref").eqNullSafe(F.col("_of")), "left")
    total = F.greatest(sum((F.col(f"_c{i}") for i in range(n)), F.lit(0.0)), F.lit(1.0))
    empty = F.array().cast("array<struct<share:double,word:string>>")
    return joined.select("_ref", F.coalesce("_common", empty).alias("_common"), F.array(*[F.col(f"_c{i}") / total for i in range(n)]).alias("_ref_chars"), F.col("_total").alias("_ref_total"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    half = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0))
    return F.sqrt(F.greatest(F.aggregate(half, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def judged(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, the base counts, base_failed, char_distance, word_distance, kept) of each row."""
    common = common_words(rows, text, lang)
    few = common.select("_of").distinct().count() <= MOST_LANGUAGES
    words = [r[0] for r in common.select("_word").distinct().collect()] if few else None  # MOST_LANGUAGES / COMMON_SHARE at most
    found = written(counted(rows, key, text, lang, words), "counted")
    known = written(references(found, common), "references")
    if known.count() <= MOST_LANGUAGES:
        joined = found.join(F.broadcast(known), F.col("_lang").eqNullSafe(F.col("_ref")), "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(SALTS))
        spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = found.join(spread, F.col("_lang").eqNullSafe(F.col("_ref")) & (salt == F.col("_salt")), "left")
    letters = F.greatest(F.aggregate("_chars", F.lit(0.0), lambda a, b: a + b), F.lit(1.0))
    joined = joined.withColumn("_p", F.transform("_chars", lambda c: c / letters))
    each = F.transform("_common", lambda w: (F.length("_listed") - F.length(F.replace(F.col("_listed"), F.concat(F.lit(" "), w["word"], F.lit(" ")), F.lit("")))) / (F.length(w["word"]) + 2) / F.greatest(F.col("n_words"), F.lit(1)))
    joined = joined.withColumn("_w", each).withColumn("_v", F.transform("_common", lambda w: w["share"]))
    rest = lambda c: F.concat(F.col(c), F.array(F.greatest(1.0 - F.aggregate(c, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))))
    joined = joined.withColumn("_w", rest("_w")).withColumn("_v", rest("_v"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.coalesce(F.col("_ref_total") >= REFERENCE_WORDS, F.lit(False))
    chars = F.when(enough & (F.col("n_words") >= CHARS_WORDS), distance(F.col("_p"), F.col("_ref_chars")))
    words = F.when(enough & (F.col("n_words") >= WORDS_WORDS) & (F.size("_common") > 0), distance(F.col("_w"), F.col("_v")))
    judged_ = joined.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), chars.alias("char_distance"), words.alias("word_distance"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= CHARS_LIMIT) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= WORDS_LIMIT)
    return judged_.withColumn("kept", kept).withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})
