"""The active-learning loop over label and pixel tables, with versioned outputs for each round.

Labels come from a table (key to label) instead of a person: that is what makes a round repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.operators import labels as L
from acreframe.operators import models, regions, sampling
from acreframe.sources.files import kept
from acreframe.sources.sinks import exists

KEY = ("tile", "r", "c")


@dataclass
class Round:
    """What a round leaves: the scorer, its predictions' path, and the labels it added."""

    number: int
    scorer: object
    predictions: str
    added: DataFrame


def finished_rounds(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the rounds that were written whole, in order; a round's labels are its last output and so its checkpoint."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/labels")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [x.getPath().getName() for x in system.listStatus(path)]
    numbers = sorted(int(n.removeprefix("round=")) for n in names if n.startswith("round=") and n.removeprefix("round=").isdigit())
    return [n for n in numbers if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/labels/round={n}/_SUCCESS"))]


def next_round(spark: SparkSession, root: str) -> int:
    """One more than the last round that was written whole."""
    return max(finished_rounds(spark, root), default=0) + 1


def final_model(spark: SparkSession, root: str):
    """The scorer of the last finished round; None where there is none or it left no model."""
    last = max(finished_rounds(spark, root), default=None)
    if last is None or not exists(spark, f"{root}/models/round={last}/scorer/_SUCCESS"):
        return None
    return models.load(f"{root}/models/round={last}")


def run_round(spark: SparkSession, root: str, number: int, pixels: DataFrame, labelled: DataFrame, oracle: DataFrame, features: Sequence[str], choice: str = "RandomForest") -> Round:
    """Fit on labelled pixels, score all pixels once, pick candidates, and label those that the oracle knows.

    Labelled pixels are looked up once and kept for all steps of the fit, so a round reads the pixels twice, whatever the model.
    """
    places = labelled.select(*KEY, "label").join(pixels.select(*dict.fromkeys((*KEY, *features))), list(KEY))
    known = kept(places.withColumn("y", L.is_positive(F.col("label")).cast("int")), "known")
    scorer = models.train(choice, known, features, "y", list(KEY))
    models.save(scorer, f"{root}/models/round={number}")
    path = f"{root}/predictions/round={number}"
    scorer.score(pixels).select(*KEY, "p").write.mode("overwrite").parquet(path)
    predictions = spark.read.parquet(path)
    candidates = sampling.round_candidates(predictions.join(labelled.select(*KEY), list(KEY), "left_anti"), KEY)
    added = candidates.join(oracle, list(KEY)).select(*KEY, "label")
    added.write.mode("overwrite").parquet(f"{root}/labels/round={number}")
    return Round(number, scorer, path, spark.read.parquet(f"{root}/labels/round={number}"))


def run_loop(spark: SparkSession, root: str, pixels: DataFrame, labelled: DataFrame, oracle: DataFrame, features: Sequence[str], rounds: int = 1, choice: str = "RandomForest", merge_last: bool = False) -> tuple[list[Round], DataFrame]:
    """Rounds from the first that is not there yet; labels of the last one are merged only if asked for.

    Labels of rounds that were finished before count as those of this call's earlier rounds do, so a loop that was stopped
    after a round gives the labels of one that was not.
    """
    if choice not in ("RandomForest", "SVM", "ResNet", "Logistic", "Ensemble"):
        choice = "RandomForest"
    done, labels = [], kept(labelled.select(*KEY, "label"), "seed")
    start = next_round(spark, root)
    for number in finished_rounds(spark, root):
        labels = L.appended(labels, spark.read.parquet(f"{root}/labels/round={number}"))
    for number in range(start, start + max(1, rounds)):
        one = run_round(spark, root, number, pixels, labels, oracle, features, choice)
        done.append(one)
        if merge_last or number < start + rounds - 1:
            labels = L.appended(labels, one.added)
    return done, labels


def postprocess(predictions: DataFrame) -> DataFrame:
    """(tile, pct_agricultural) of predictions after threshold and sieve."""
    mask = predictions.withColumn("v", (F.col("p") >= SETTINGS.positive_probability).cast("int"))
    return regions.sieve(mask).groupBy("tile").agg(F.bround(F.avg("v") * 100, 2).alias("pct_agricultural"))
