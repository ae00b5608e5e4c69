"""Language identification: averaged hashed subword embeddings with a linear softmax.

Training is stochastic gradient descent in numpy on a bounded, hash-chosen sample. A temperature and a rejection
threshold are calibrated on a part of the sample that training leaves out. For prediction the embedding table and the
output layer are multiplied once into one table of logits for each bucket: the mean of embeddings times a matrix is the
mean of their products, so the result is the same and a text costs a table look-up for each subword.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; without any labelled row every
text is ``und``. Very long texts are read in pieces and summed, whole. Ties go to the language first in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.llm._shared import SAMPLE_CHARS, class_sample, mapped, slices

UNDETERMINED = "und"
PIECE = 1 << 19
PARTS = 6  # sentences of a sampled text that training takes besides the whole text
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts in pieces that end at a space where there is one, and the text each piece is from."""
    out, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = len(t) if len(t) - at <= PIECE else t.find(" ", at + PIECE)
            end = min(len(t) if end < 0 else end, at + 2 * PIECE)
            out.append(t[at:end])
            owner.append(i)
            if end >= len(t):
                break
            at = end
    return out, np.array(owner)


def subwords(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2-, 3- and 4-grams of words, whose ends are marked, and how many each text has."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 1 for t in lowered])
    owner = np.repeat(np.arange(len(texts)), size)  # of the code points from the second on
    marked = np.where(letters()[points], points, 0).astype(np.uint64)
    before, here, after, then = marked[:-3], marked[1:-2], marked[2:-1], marked[3:]
    keep = np.flatnonzero(here)
    before, here, after, then, owner = before[keep], here[keep], after[keep], then[keep], owner[keep]
    a, b, c, d = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
    shift = np.uint64(64 - bits)
    two = before * a + here * b
    three = two + (after + np.uint64(1)) * c
    four = three + (then + np.uint64(1)) * d
    inner = np.flatnonzero(after)
    found = np.concatenate([(x * a) >> shift for x in (two ^ (two >> np.uint64(29)), three ^ (three >> np.uint64(31)), (four ^ (four >> np.uint64(30)))[inner])])
    of = np.concatenate([owner, owner, owner[inner]])
    order = np.argsort(of, kind="stable")
    return found[order].astype(np.int64), np.bincount(of, minlength=len(texts))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # a row of logits for each bucket
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    least: float = 0.0  # below this probability the prediction is rejected

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the number of subwords, of each text."""
        parts, owner = pieces(texts)
        ids, n = subwords(parts, self.bits)
        total, count = np.zeros((len(texts), len(self.languages)), np.float64), np.zeros(len(texts), np.int64)
        some = np.flatnonzero(n)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])[some]
            for k in range(len(self.languages)):
                np.add.at(total[:, k], owner[some], np.add.reduceat(self.table[:, k][ids], starts, dtype=np.float64))
            np.add.at(count, owner, n)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, calibrated probability, accepted) of each text."""
        if not self.languages:
            return [(UNDETERMINED, 0.0, False)] * len(texts)
        logits, count = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        return [(self.languages[k], float(min(1.0, p[i, k])), bool(p[i, k] >= self.least)) if count[i] else (UNDETERMINED, 0.0, False) for i, k in enumerate(best)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], bits: int = 16, width: int = 12, epochs: int = 4, rate: float = 4.0, reject: float = 0.002, seed: int = 3) -> LanguageModel:
    """Train on texts and on ``PARTS`` sentences of each; every fifth text calibrates instead."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), bits)
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    held = [i for i in range(len(texts)) if i % 5 == 4]
    samples, of = [], []
    for i, t in enumerate(texts):
        if i % 5 != 4:
            parts = [x for x in t.replace("\n", ".").split(".") if x.strip()]
            chosen = [t, *(parts if len(parts) <= PARTS else [parts[j] for j in rng.choice(len(parts), PARTS, replace=False)])]
            samples += chosen
            of += [number[labels[i]]] * len(chosen)
    ids, n = subwords(samples, bits)
    starts = np.concatenate([[0], np.cumsum(n)])
    use, of = np.flatnonzero(n), np.array(of)
    share = np.maximum(np.bincount(of[use], minlength=len(languages)), 1) if len(use) else np.ones(len(languages))
    weight = len(use) / (len(languages) * share)
    embedding = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(use)
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            flat = np.concatenate([ids[starts[i] : starts[i + 1]] for i in batch])
            length = n[batch]
            mean = np.add.reduceat(embedding[flat], np.concatenate([[0], np.cumsum(length)[:-1]])) / length[:, None].astype(np.float32)
            error = softmax(mean @ out + bias)
            error[np.arange(len(batch)), of[batch]] -= 1
            error *= (weight[of[batch]] / len(batch))[:, None].astype(np.float32)
            back = (error @ out.T).astype(np.float32)
            out -= step * (mean.T @ error)
            bias -= step * error.sum(0)
            # A bucket's step counts its share of the text, scaled up as each text touches few of the buckets.
            unique, where = np.unique(flat, return_inverse=True)
            change = np.zeros((len(unique), width), np.float32)
            np.add.at(change, where, np.repeat(back * (32.0 / np.sqrt(length))[:, None].astype(np.float32), length, axis=0))
            embedding[unique] -= step * change / 8
    model = LanguageModel(languages, (embedding @ out).astype(np.float32), bias.astype(np.float64), bits)
    calibrate(model, [texts[i] for i in held], np.array([number[labels[i]] for i in held], int), reject)
    return model


def calibrate(model: LanguageModel, texts: list[str], of: np.ndarray, reject: float) -> None:
    """Temperature of least log loss, and the probability below which only ``reject`` of the right predictions fall."""
    if not texts:
        return
    logits, count = model.logits(texts)
    logits, of = logits[count > 0], of[count > 0]
    if not len(of):
        return
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(of)), of], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = p.max(1)[p.argmax(1) == of]
    if len(right):
        model.least = float(np.quantile(right, reject))


def fit_rows(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 200, most_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language; rows without text or label, or of more than ``most_chars`` characters, are left out."""
    found = class_sample(rows.select(key, text, label).where(F.col(text).isNotNull() & F.col(label).isNotNull()), key, label, per_language, text, most_chars)
    return fit([r[text] for r in found], [r[label] for r in found])


def identify(rows: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, lang_accepted) of each row; lang_accepted is ``und`` where calibration rejects."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for part in slices(batches):
            found = own.predict([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] if x[2] else UNDETERMINED for x in found], pa.string())], names=[key, "lang_pred", "score", "lang_accepted"])

    kind = rows.schema[key].dataType.simpleString()
    return mapped(rows.select(key, text), run, f"{key} {kind}, lang_pred string, score double, lang_accepted string")
