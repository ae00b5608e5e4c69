"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier on measures of the whole text gives each document evidence, a probability of good quality. The
evidence of a host's documents, and of a path's below it, is combined by grouped aggregation: a host's rate is shrunk towards
the mean of all documents, a path's towards its host's. How far is told by variance components of a nested design, by the
method of moments: W within paths, P between paths of a host, H between hosts. A mean of n documents of a path counts for
P / (P + W / n), that of a host for H / (H + W / n + P * sum(n_path**2) / n**2), the rest is the level above; for evidence of
0 and 1 these are the posteriors of beta priors of strengths W / P and W / H. A document's own evidence is left out of its
host's and path's sums. Its score adds to its own log odds those of its path's posterior, less those of the mean. Sparse
sites thus stay near the mean, and sites that do not differ change nothing.

Defined results: a null text counts as empty; without labelled rows of both classes every evidence is 0.5; a null host or
path is a host or path of its own; a key with several labels is good if one is. Only sums leave the documents, so a host of a
third of all rows is no burden; its sums come back by a salted join.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreframe.llm._shared import SAMPLE_CHARS, group_whole, id_text, labelled_sample, mapped, slices, unused, whole_attach, written
from acreframe.llm.near_dedup import shingles, word_hashes

THRESHOLD = 0.5


def measures(text: str, words: np.ndarray) -> list[float]:
    """Measures of a text that tell junk from prose: shares of character classes, repetition, length."""
    n = max(1, len(text))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(data, minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    stops = count[[44, 46]].sum()
    calls = count[[33, 63]].sum()
    symbols = count[[35, 36, 37, 38, 42, 60, 62, 64, 92, 94, 124, 126]].sum()
    beyond = (count[0x80:0xC0].sum() + count[0xC0:].sum()) / 2
    share = count[count > 0] / max(1, len(data))
    lines = [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    seen = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(0)
    runs = shingles(words)
    return [
        upper / n, lower / n, digit / n, stops / n, calls / n, symbols / n, beyond / n, count[32] / n, count[10] / n,
        upper / max(1, upper + lower), float(-(share * np.log2(share)).sum()), np.log1p(len(words)), float(len(words) < 20), float(len(words) < 50),
        n / w / 10, len(seen) / w, float(seen.max(initial=0)) / w, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(np.unique(runs)) / max(1, len(runs)), len(lines) / w,
        float(symbols > 0.05 * n), float(calls > 0.03 * n), float(upper > 0.5 * (upper + lower)), float(max(Counter(lines).values(), default=0)) / max(1, len(lines)),
    ]


def table_of(texts: list[str]) -> np.ndarray:
    return np.array([measures(t, w) for t, w in zip(texts, word_hashes(texts), strict=True)]).reshape(len(texts), -1)


@dataclass
class EvidenceModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias
    known: bool = True

    def evidence(self, texts: list[str]) -> np.ndarray:
        if not self.known or not texts:
            return np.full(len(texts), 0.5)
        x = np.clip((table_of(texts) - self.mean) / self.scale, -8, 8)
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], shares: tuple[float, float] | None = None, ridge: float = 0.05) -> EvidenceModel:
    """Logistic regression by Newton's method; ``shares`` are the true shares of the classes, where the sample's differ."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return EvidenceModel(np.zeros(0), np.zeros(0), np.zeros(0), False)
    raw = table_of(texts)
    mean, scale = raw.mean(0), np.maximum(raw.std(0), 1e-6)
    x = np.concatenate([np.clip((raw - mean) / scale, -8, 8), np.ones((len(y), 1))], 1)
    good = shares[1] if shares else y.mean()
    each = np.where(y > 0, good / y.mean(), (1 - good) / (1 - y.mean()))
    flat = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + flat, x.T @ (each * (y - p)) - flat @ w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return EvidenceModel(mean, scale, w)


def fit_rows(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, most_chars: int = SAMPLE_CHARS) -> EvidenceModel:
    """Fit on about ``per_class`` labelled documents of each class, of ``most_chars`` characters at most."""
    found, share = labelled_sample(documents, labels, key, text, label, per_class, most_chars)
    if not found:
        return fit([], [])
    good = sum(n for y, n in share.items() if y > 0) / sum(share.values())
    return fit([t for t, _ in found], [int(y > 0) for _, y in found], (1 - good, good))


def evidence(rows: DataFrame, model: EvidenceModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, the columns to keep, evidence) of each row."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            found = shipped.value.evidence([t or "" for t in part.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.float64())], names=[key, *keep, "evidence"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return mapped(rows.select(text, key, *keep), run, f"{kinds}, evidence double")


@dataclass
class Components:
    """Mean of all evidence, and its variance within paths, between paths of a host, and between hosts."""

    mean: float = 0.5
    within: float = 0.0
    paths: float = 0.0
    hosts: float = 0.0


def components(paths: DataFrame, host: str) -> tuple[Components, DataFrame]:
    """(variance components by the method of moments, the sums of each host) from the sums n, s, q of each path."""
    square = F.col("n").cast("double") * F.col("n")
    hosts = paths.groupBy(F.col(f"_key_{host}").alias("_host")).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum(square).alias("host_square"), F.count("*").alias("_paths"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_of_paths"), F.sum("q").alias("_q"))
    n, s = F.col("host_n").cast("double"), F.col("host_s")
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("_q").alias("q"), F.count("*").alias("hosts"), F.sum("_paths").alias("paths"), F.sum("_of_paths").alias("of_paths"), F.sum(s * s / n).alias("of_hosts"), F.sum("host_square").alias("square"), F.sum(n * n).alias("host_square"), F.sum(F.col("host_square") / n).alias("ratio")).first()
    if not sums["n"]:
        return Components(), hosts
    mean = sums["s"] / sums["n"]
    # Sums of squares within paths, between paths of a host and between hosts; what each is expected to be is linear in
    # the components.
    within = max(0.0, sums["q"] - sums["of_paths"]) / max(1, sums["n"] - sums["paths"])
    between_paths = sums["of_paths"] - sums["of_hosts"] - (sums["paths"] - sums["hosts"]) * within
    of_paths = max(0.0, between_paths / (sums["n"] - sums["ratio"])) if sums["n"] - sums["ratio"] > 1e-9 else 0.0
    between_hosts = sums["of_hosts"] - sums["s"] ** 2 / sums["n"] - (sums["hosts"] - 1) * within - (sums["ratio"] - sums["square"] / sums["n"]) * of_paths
    room = sums["n"] - sums["host_square"] / sums["n"]
    return Components(mean, within, of_paths, max(0.0, between_hosts / room) if room > 1e-9 else 0.0), hosts


def _toward(level: Column, n: Column, s: Column, between: float, noise: Column) -> Column:
    """The level above, drawn towards the mean of n rows of sum s as far as their noise allows."""
    share = between / F.greatest(between + noise, F.lit(1e-300))
    return F.when((n > 0) & F.lit(between > 0), level + share * (s / n - level)).otherwise(level)


def posteriors(found: DataFrame, of: Components) -> DataFrame:
    """Rows with the sums of their host and path: host_posterior and path_posterior, from all rows but the row itself."""
    own, mean = F.col("evidence"), F.lit(of.mean)
    n, s, host_n, host_s = F.col("n") - 1.0, F.col("s") - own, F.col("host_n") - 1.0, F.col("host_s") - own
    square = F.col("host_square") - 2.0 * F.col("n") + 1.0  # of the host's paths, with one row less in this one
    inside = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    of_host = _toward(mean, host_n, host_s, of.hosts, of.within / F.greatest(host_n, F.lit(1.0)) + of.paths * square / F.greatest(host_n * host_n, F.lit(1.0)))
    found = found.withColumn("host_posterior", inside(of_host))
    return found.withColumn("path_posterior", inside(_toward(F.col("host_posterior"), n, s, of.paths, of.within / F.greatest(n, F.lit(1.0)))))


def _log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def combine(rows: DataFrame, host: str, path: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, host, path, evidence) with host_posterior, path_posterior, score and kept."""
    rows = written(rows.select(key, host, path, "evidence"), "evidence")
    sums = {"n": (F.count("*"), F.sum("n")), "s": (F.sum("evidence"), F.sum("s")), "q": (F.sum(F.col("evidence") * F.col("evidence")), F.sum("q"))}
    paths = written(group_whole(rows, [host, path], sums, id_text(F.col(key))), "paths")
    of, hosts = components(paths, host)
    known = paths.join(hosts.select("_host", "host_n", "host_s", "host_square"), paths[f"_key_{host}"].eqNullSafe(F.col("_host"))).drop("_host", "q")
    found = posteriors(whole_attach(rows, known, [host, path], id_text(F.col(key))), of)
    z = _log_odds(F.col("evidence")) + _log_odds(F.col("path_posterior")) - _log_odds(F.lit(of.mean))
    scored = found.select(*rows.columns, "host_posterior", "path_posterior", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("kept", F.col("score") >= THRESHOLD)


def sites(documents: DataFrame, pages: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Rows with host and path: of the page whose address ends in the document's number, else its source.

    An address is ``scheme://host/path/number``; of several pages of a document the one with the least id counts. Columns
    host and path that the rows have are replaced.
    """
    address = r"^[a-z]+://([^/]+)/([^/]*)/([0-9]{1,18})(?:[./?#]|$)"
    part = lambda k: F.regexp_extract("url", address, k)
    number, page = unused(documents, "_number", "_page")
    parts = pages.select(part(1).alias("host"), part(2).alias("path"), part(3).try_cast("bigint").alias(number), "page_id")
    first = parts.where(F.col(number).isNotNull()).groupBy(number).agg(F.min(F.struct("page_id", "host", "path")).alias(page))
    joined = documents.join(first, documents[key] == F.col(number), "left")
    own = [documents[c] for c in documents.columns if c.lower() not in ("host", "path")]
    return joined.select(*own, F.coalesce(F.col(f"{page}.host"), documents[source]).alias("host"), F.coalesce(F.col(f"{page}.path"), F.lit("")).alias("path"))
