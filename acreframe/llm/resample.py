"""Importance resampling of documents towards a target distribution, in DataFrame operations alone.

Features are runs of words; each falls into one of ``BUCKETS`` buckets by its crc32. The buckets of all documents and of all
target texts are counted, and a bucket's gain is the logarithm of how much more often the target has it. A document weighs
the mean gain of its features, a Gumbel number drawn from a hash of its key is added, and the highest scores are drawn:
a sample without replacement in proportion to the weights' exponentials.

The feature arrays are exploded twice: for the counts, of which a task sends ``BUCKETS`` rows at most, and for the weights, where
the table of gains, ``BUCKETS`` rows whatever the corpus, is broadcast and a document's features are summed where they stand.
No feature is shuffled. The scores are sorted by range, and a row's rank is its place in its range behind the rows of
all ranges before; the driver sees one count for each range.

Defined results: a null or empty text has no feature and weight 0; a null key counts as empty text in the draw and comes
last of equal scores; rows that share a key are documents of their own, with ranks of their own; an empty target gives
every bucket the gain of no occurrence. Documents of fewer than ``least`` words are scored but never drawn.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreframe.llm._shared import discard, id_text, unused, written

BUCKETS = 10_000
#: Words before A to Z become a to z; ASCII but digits and letters parts them.
WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_PLACES = 33  # bits of a place within its range


def words_of(text: Column) -> Column:
    """The words of a text, A to Z in lower case and no other letter changed."""
    plain = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 1), plain)


def grams_of(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` consecutive words, joined by a blank."""

    def runs(n: int) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, n)]))

    return words if most == 1 else F.concat(words, *[runs(n) for n in range(2, most + 1)])


def bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def bucket_counts(rows: DataFrame, text: str, most: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""
    grams = rows.select(F.explode(grams_of(words_of(F.col(text)), most)).alias("gram"))
    return grams.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(rows: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of each bucket: 1000 times the logarithm of the smoothed ratio of its shares, rounded down."""
    own = written(bucket_counts(rows, text, most, buckets).withColumn("of", F.lit("own")).unionByName(bucket_counts(target, target_text, most, buckets).withColumn("of", F.lit("target"))), "buckets")
    whole = {r[0]: r[1] for r in own.groupBy("of").agg(F.sum("n")).collect()}
    part = lambda of: F.coalesce(F.max(F.when(F.col("of") == of, F.col("n"))), F.lit(0))
    counts = rows.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").groupBy("bucket").agg(part("own").alias("s"), part("target").alias("t"))
    ratio = (F.col("t") + 1).cast("double") * float(whole.get("own", 0) + buckets) / ((F.col("s") + 1).cast("double") * float(whole.get("target", 0) + buckets))
    found = written(counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain")), "gains")
    discard(own)
    return found


def weights(rows: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight) of each row: the mean gain of its features, rounded down."""
    row, words = unused(rows, "_row", "_words")
    numbered = rows.select(F.col(key), words_of(F.col(text)).alias(words)).withColumn(row, F.monotonically_increasing_id())
    grams = numbered.select(key, row, F.size(words).cast("bigint").alias("n_words"), F.explode_outer(grams_of(F.col(words), most)).alias("gram"))
    known = F.broadcast(gain.select(F.col("bucket").alias("_bucket"), "gain"))  # a row for each bucket
    summed = grams.join(known, bucket(F.col("gram"), buckets) == F.col("_bucket"), "left").groupBy(row, key, "n_words").agg(F.count("gram").alias("n_features"), F.sum("gain").alias("gain"))
    mean = F.floor(F.try_divide(F.col("gain").cast("double"), F.col("n_features").cast("double"))).cast("bigint")
    return summed.select(key, "n_words", "n_features", F.coalesce(mean, F.lit(0).cast("bigint")).alias("weight"))


def gumbel(key: Column, seed: int) -> Column:
    """1000 times a Gumbel number from a hash of the key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text(key)), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their rank from 1 on in that order: a sort by range and the number of rows in the ranges before."""
    place, rank = unused(rows, "_place", "rank")
    placed = written(rows.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "ranked")
    before, starts = 0, {}
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright(place, _PLACES)).count().collect()):  # a row for each range
        starts[part], before = before, before + n
    start = F.element_at(F.map_from_arrays(F.lit(list(starts) or [0]), F.lit(list(starts.values()) or [0])), F.shiftright(place, _PLACES))
    return placed.withColumn(rank, (start + F.col(place).bitwiseAND(F.lit((1 << _PLACES) - 1)) + 1).cast("bigint")).drop(place)


def resampled(rows: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: tuple[int, int] = (10, 100), least: int = 20, most: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(key, n_features, weight, score, rank) of each row; rank is null for rows that are not drawn.

    ``share`` (p, q) draws floor(p * N / q) of the N rows of ``least`` words or more.
    """
    gain = gains(rows, target, text, target_text, most, buckets)
    scored = written(weights(rows, gain, key, text, most, buckets).withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "scores")
    discard(gain)
    enough = F.col("n_words") >= least
    drawn = share[0] * scored.where(enough).count() // share[1]
    found = ranked(scored.withColumn("_enough", enough), [F.col("_enough").desc(), F.col("score").desc(), F.col(key).asc_nulls_last()])
    return found.select(key, "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def selected(rows: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows with all their columns; of a key that repeats, all rows if one of them is drawn."""
    known = unused(rows, "_drawn_key")[0]
    drawn = resampled(rows, target, key, text, **options).where("rank is not null").select(F.col(key).alias(known)).distinct()
    return rows.join(drawn, rows[key].eqNullSafe(F.col(known)), "left_semi")
