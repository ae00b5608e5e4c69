"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Each source has one token constraint: the sizes of its documents, times their rates, must add up to its target. Among all
rates between 0 and ``CAP`` that meet the constraints, the ones of least relative entropy to rate 1 are exponentially tilted,
exp(tilt * size / mean) with the source's mean size, and ``CAP`` where that is more. The tilts solve a convex dual without
constraints. Its gradient and curvature are sums over documents that depend on their sizes alone, so documents are counted
by source and size once; each Newton step then is a distributed aggregation of those counts for all sources, and a bracket
around every tilt keeps the steps safe. Sums are of decimals, so no order of summation shows.

Rates are rounded to copies that add up: every document takes the whole part of its rate. The fractions are rounded from the
largest size class to the smallest: of a class the documents first in a random order (a hash of the key over the fraction,
so that larger fractions come earlier) take one more copy, as many as bring the words taken nearest to what all classes so
far should take. What a class of long documents misses is thus made up by shorter ones. The order is summed over ``BINS``
ranges for each class, and whole ranges take a copy or not, so no task sees the documents of a source together; a source
misses its target by about half of the words that a range of its smallest classes holds, which is one short document or
less where a source has few documents, and a ten-thousandth of its words where it has many.

Defined results: size is the number of words, 0 for a null or empty text; sources go by code point, a null one last; a
source without words has target 0; documents of size 0 take no words. Reruns agree, whatever the partitioning; rows that
repeat are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreframe.llm._shared import WORD, discard, id_text, unused, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
STEP = 8  # size classes for each doubling of the size
CLASSES = STEP * 40
BINS = 256
NEWTON, CLOSE = 60, 1e-11  # most steps, and the share of a target that a tilt may miss
CHAINED = 4  # steps between two tables of tilts
_EXACT = "decimal(38,6)"


def sizes(rows: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, size, class, mark) of each row: the class is that of the size's logarithm, the mark a uniform hash."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    mark = (F.pmod(F.xxhash64(id_text(F.col(key)), F.lit(6)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    found = rows.select(F.col(key), F.col(source), size.alias("size"), mark.alias("mark"))
    return found.withColumn("class", F.when(F.col("size") > 0, F.least(F.floor(F.log2(F.col("size").cast("double")) * STEP).cast("int"), F.lit(CLASSES - 1))).otherwise(-1))


def targets(totals: DataFrame, source: str) -> DataFrame:
    """(source, source_size, target): shares by weight, none above CAP times its source, the excess dealt out anew.

    Sources are numbered by a sort that many tasks share: numbers within a partition, and the partitions' counts before it.
    The share for a unit of weight is raised, one aggregation at a time, until no source is above its cap.
    """
    in_order = totals.select(source, "source_size").orderBy(F.col(source).isNull(), F.col(source)).withColumn("_part", F.spark_partition_id())
    in_order = written(in_order, "sources")
    before, starts = 0, {}
    for part, n in sorted((r[0], r[1]) for r in in_order.groupBy("_part").count().collect()):  # a row for each partition
        starts[part], before = before, before + n
    within = Window.partitionBy("_part").orderBy(F.col(source).isNull(), F.col(source))
    start = F.element_at(F.map_from_arrays(F.lit(list(starts) or [0]), F.lit(list(starts.values()) or [0])), F.col("_part"))
    rank = start + F.row_number().over(within) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    weighed = written(in_order.withColumn("weight", weight), "weights")
    discard(in_order)
    limit = CAP * F.col("source_size") / F.col("weight")
    whole, level, capped = None, 0.0, -1
    while True:
        over = limit < level
        got = weighed.agg(F.count_if(over).alias("capped"), F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum("source_size").alias("whole")).first()
        whole = float(got["whole"] or 0)
        if got["capped"] == capped or not got["weight"]:
            break
        capped, level = got["capped"], (whole - CAP * float(got["held"])) / got["weight"]
    return weighed.select(source, "source_size", F.least(CAP * F.col("source_size"), F.col("weight") * level).cast("double").alias("target"))


def rate(tilt: Column, size: Column, mean: Column) -> Column:
    """Tilted rate of a document of a size."""
    return F.least(F.exp(F.least(tilt * size / mean, F.lit(50.0))), F.lit(CAP))


def solve(counts: DataFrame, goals: DataFrame, source: str) -> DataFrame:
    """(source, source_size, target, mean, tilt): the dual's solution for each source, from its documents n of each size."""
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    exact = lambda c: F.sum(c.cast(_EXACT)).cast("double")
    facts = counts.groupBy(F.col(source).alias("_source")).agg(F.sum("n").alias("_n"), exact(size * size * n).alias("_square"))
    begun = goals.join(facts, goals[source].eqNullSafe(F.col("_source")))  # sources without words have nothing to solve
    mean = F.greatest(F.col("source_size") / F.col("_n"), F.lit(1.0))
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    # A first guess from the mean size of a word's document; sources that take all they may are solved.
    guess = F.log(F.col("target") / F.col("source_size")) / (F.col("_square") / F.col("source_size") / mean)
    begun = begun.select("_source", "target", mean.alias("mean"), F.when(full, F.lit(1e300)).otherwise(guess).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), full.alias("done"))
    state = written(begun, "tilts")

    def step(state: DataFrame) -> DataFrame:
        at = counts.join(state, counts[source].eqNullSafe(F.col("_source")))
        r, x = rate(F.col("tilt"), size, F.col("mean")), size / F.col("mean")
        kept = [F.any_value(c).alias(c) for c in state.columns if c != "_source"]
        sums = at.groupBy("_source").agg(exact(n * size * r).alias("taken"), exact(F.when(r < CAP, n * size * x * r).otherwise(0.0)).alias("slope"), *kept)
        return sums.withColumns(_newton()).select(*state.columns)

    for _ in range(NEWTON // CHAINED):
        before, after = state, state
        for _ in range(CHAINED):
            after = step(after)
        state = written(after, "tilts")
        discard(before)
        if state.where("not done").isEmpty():
            break
    found = goals.join(state.select("_source", "mean", "tilt"), goals[source].eqNullSafe(F.col("_source")), "left")
    return found.select(source, "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), "tilt")


def _newton() -> dict[str, Column]:
    """The next tilt: a Newton step on the logarithm of the words taken, inside the bracket that the residuals tell."""
    tilt, taken, target = F.col("tilt"), F.col("taken"), F.col("target")
    over = taken > target
    low, high = F.when(over, F.col("low")).otherwise(tilt), F.when(over, tilt).otherwise(F.col("high"))
    jump = tilt - F.log(taken / target) * taken / F.col("slope")
    inside = (F.col("slope") > 0) & (taken > 0) & (jump > low) & (jump < high)
    wide = F.when(over, tilt - 2 * F.greatest(F.abs(tilt), F.lit(1.0))).otherwise(tilt + 2 * F.greatest(F.abs(tilt), F.lit(1.0)))
    middle = F.when((low > float("-inf")) & (high < float("inf")), (low + high) / 2).otherwise(wide)
    close = (F.abs(taken - target) <= CLOSE * target) | (high - low <= 1e-15 * F.abs(tilt))
    done = F.col("done") | close
    return {
        "tilt": F.when(done, tilt).when(inside, jump).otherwise(middle),
        "low": F.when(done, F.col("low")).otherwise(low),
        "high": F.when(done, F.col("high")).otherwise(high),
        "done": done,
    }


def mixture(rows: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, rate, copies, taken) of each row."""
    base = written(sizes(rows, key, text, source), "sizes")
    counts = written(base.groupBy(source, "size").agg(F.count("*").alias("n")), "counts")
    goals = written(targets(counts.groupBy(source).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), source), "goals")
    solved = solve(counts.where("size > 0"), goals, source)
    known = _attach(base, solved, key, source, ("source_size", "target", "mean", "tilt"))
    r = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate(F.col("tilt"), F.col("size"), F.col("mean")))
    known = known.select(key, source, "size", "class", "source_size", "target", "mark", r.alias("rate"))
    known = known.withColumn("_whole", F.floor("rate")).withColumn("_part", F.col("rate") - F.col("_whole"))
    order = F.col("mark") / F.greatest("_part", F.lit(1e-9))
    known = written(known.withColumn("_bin", F.least(F.floor(BINS * order / (1 + order)), F.lit(BINS - 1)).cast("int")).drop("mark"), "rates")
    # The words of a range if it takes one more copy, and those that it should take.
    bins = known.where((F.col("_part") > 1e-9) & (F.col("size") > 0)).groupBy(source, "class", "_bin").agg(F.sum("size").alias("tokens"), F.sum((F.col("size") * F.col("_part")).cast(_EXACT)).alias("goal"))
    of_class = bins.groupBy(source, "class").agg(F.sum("goal").cast("double").alias("goal"), F.sort_array(F.collect_list(F.struct("_bin", "tokens"))).alias("bins"))
    of_source = of_class.groupBy(source).agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("order"), "class", "goal", "bins"))).alias("classes"))
    start = F.struct(F.lit(0).cast("bigint").alias("taken"), F.lit(0.0).alias("goal"), F.array().cast("array<struct<class:int,cut:int>>").alias("cuts"))
    cuts = of_source.select(source, F.map_from_entries(F.aggregate("classes", start, _cut)["cuts"]).alias("cuts"))
    found = _attach(known, written(cuts, "cuts"), key, source, ("cuts",))
    extra = (F.col("_part") > 1e-9) & (F.col("_bin") <= F.coalesce(F.try_element_at("cuts", F.col("class")), F.lit(-1)))
    copies = (F.col("_whole") + extra.cast("int")).cast("bigint")
    return found.select(key, "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _cut(state: Column, c: Column) -> Column:
    """The last bin of a class that takes one more copy, and the words that it and larger classes have taken.

    The goal is what all classes so far should take; bins go in as long as each brings the words nearer to it.
    """
    goal = state["goal"] + c["goal"]

    def take(s: Column, b: Column) -> Column:
        more = s["open"] & (F.abs(s["taken"] + b["tokens"] - goal) <= F.abs(s["taken"] - goal))
        return F.struct(F.when(more, s["taken"] + b["tokens"]).otherwise(s["taken"]).alias("taken"), F.when(more, b["_bin"]).otherwise(s["cut"]).alias("cut"), more.alias("open"))

    found = F.aggregate(c["bins"], F.struct(state["taken"].alias("taken"), F.lit(-1).alias("cut"), F.lit(True).alias("open")), take)
    return F.transform(F.array(found), lambda f: F.struct(f["taken"].alias("taken"), goal.alias("goal"), F.array_append(state["cuts"], F.struct(c["class"].alias("class"), f["cut"].alias("cut"))).alias("cuts")))[0]


def _attach(rows: DataFrame, facts: DataFrame, key: str, source: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows with columns of their source: a source's facts go once to each salt that its rows have."""
    salt = F.pmod(F.xxhash64(id_text(F.col(key))), F.lit(128))
    salts = rows.select(F.col(source).alias("_source"), salt.alias("_salt")).distinct()
    spread = salts.join(facts, facts[source].eqNullSafe(F.col("_source"))).select("_source", "_salt", *columns)
    return rows.join(spread, rows[source].eqNullSafe(F.col("_source")) & (salt == F.col("_salt")), "left").select(*[rows[c] for c in rows.columns], *columns)


def repeated(rows: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows with all their columns, each as many times as the mixture takes it.

    Rows of a key that repeats are all taken as often as the one of them that is taken most, so a source with such rows may
    get more than its target; keys of documents do not repeat.
    """
    key_, copies, copy = unused(rows, "_key", "_copies", "_copy")
    taken = mixture(rows, key, text, source).where("copies > 0").groupBy(F.col(key).alias(key_)).agg(F.max("copies").alias(copies))
    joined = rows.join(taken, rows[key].eqNullSafe(F.col(key_)))
    return joined.select(*[rows[c] for c in rows.columns], F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
