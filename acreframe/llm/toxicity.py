"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums, over the subsequences of ``ORDER`` characters that they share, ``DECAY`` to the power of the
stretches that the subsequence spans in both, so an insult keeps most of its kernel when characters are put into it or
left between its letters. Landmarks are strings that tell labelled toxic sentences from clean ones, and clean words that come
near them. The machine is linear in the Nystroem features of a word, that is, its decision is a weighted sum of the word's
normalised kernels with the landmarks. In fitting, a sentence counts as its worst word, and a toxic document's label holds
for its worst sentence and for others that come near the landmarks. A document's score is a logistic function of the decisions
of its ``WORST`` worst words, so that several words that resemble insults a little count together.

The kernel is an inner product of the words' subsequences, so the weighted landmarks add up to one weight for each
subsequence that a landmark has: a few thousand. A word's decision is the sum of the weights of its own subsequences over its
norm, which is the whole kernel machine, without a filter, at the cost of a table look-up for each three of its characters.

A word is the letters and digits of a run of characters between white space. Neighbouring short words make up words too: three
single characters or more in a row, two words of at most ``SHORT`` characters each, or three of at most ``SHORT`` - 1 each.

Defined results: null, empty and wordless texts score like a text of harmless words; without labelled rows of both
classes every score is 0. Long texts are read whole, long words in overlapping windows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import compress
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acreframe.llm._shared import SAMPLE_CHARS, WORD, labelled_sample, mapped, slices, trim

ORDER, DECAY = 3, 0.7
WINDOW = 32
SHORT = 4
THRESHOLD = 0.3
WORST = 3  # words of a document that its score hangs on
TURNS, RIDGE = 10, 1e-4
_CACHE = 400_000  # words whose decisions a task remembers
START, END = "\x02", "\x03"  # of a word, in landmarks and in the kernel
_word = re.compile(WORD)


def marked(word: str) -> str:
    """The word's letters and digits between marks of its ends: punctuation in it or around it does not hide it."""
    return START + (word if word.isalnum() else "".join(c for c in word if c.isalnum())) + END


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lag(k: int) -> np.ndarray:
    d = np.arange(k)[:, None] - np.arange(k)[None, :] - 1
    return np.where(d >= 0, DECAY ** np.maximum(d, 0), 0.0)


def _common(same: np.ndarray) -> np.ndarray:
    """Kernels from which characters of both words are the same: sums over where a shared subsequence ends."""
    same = same * DECAY**2
    left, right = _lag(same.shape[1]), _lag(same.shape[2]).T
    ends = same
    for _ in range(ORDER - 1):
        ends = same * (np.matmul(left, ends) @ right)
    return ends.sum((1, 2))


def _grid(words: list[str]) -> np.ndarray:
    grid = np.zeros((len(words), max(map(len, words))), np.uint32)
    for i, w in enumerate(words):
        grid[i, : len(w)] = _points(w)
    return grid


def kernels(words: list[str], landmark: str) -> np.ndarray:
    """Gap-weighted subsequence kernel of each word (of WINDOW characters at most) with the landmark."""
    return _common(_grid(words)[:, :, None] == _points(landmark)[None, None, :])


def self_kernels(words: list[str]) -> np.ndarray:
    grid = _grid(words)
    return _common((grid[:, :, None] == grid[:, None, :]) & (grid[:, :, None] > 0))


@dataclass
class Landmark:
    text: str
    toxic: bool
    self_kernel: float = 0.0

    def __post_init__(self):
        self.self_kernel = float(kernels([self.text], self.text)[0])


class _Plain(dict):
    """The letters and digits of words, remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) >= _CACHE // 3:
            self.clear()
        self[word] = found = word if word.isalnum() else "".join(filter(str.isalnum, word))
        return found


_plain = _Plain()


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def words_of(text: str) -> set[str]:
    """The words of a text, and those that neighbouring short words make up."""
    row = list(filter(None, map(_plain.__getitem__, _word.findall(text.lower()))))
    out = set(row)
    size = np.fromiter(map(len, row), np.int64, len(row))
    both = ((size[:-1] <= SHORT) & (size[1:] <= SHORT)).tolist()
    out.update(map(add, compress(row, both), compress(row[1:], both)))
    short = size < SHORT
    three = (short[:-2] & short[1:-1] & short[2:]).tolist()
    out.update(map(add, map(add, compress(row, three), compress(row[1:], three)), compress(row[2:], three)))
    if (size == 1).sum() > 3:
        edge = np.diff(np.concatenate([[False], size == 1, [False]]).astype(np.int8))
        out.update("".join(row[a:b]) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a > 3)
    return out


def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a word's length: positions of pairs i < j, of each triple its pair and last position, and its decay."""
    if length not in _places:
        i, j = np.triu_indices(length, 1)
        pair, last = np.nonzero(np.arange(length)[None, :] > j[:, None])
        _places[length] = i, j, pair, last, DECAY ** (last - i[pair] + 1.0)
    return _places[length]


_places: dict[int, tuple] = {}


class Subsequences:
    """Values of the subsequences that some strings hold, to be summed over words."""

    def __init__(self, strings: list[str]):
        letters = sorted({c for x in strings for c in x})
        self.code = {c: k + 1 for k, c in enumerate(letters)}  # 0 stands for all other characters
        self.size = len(letters) + 1
        points = np.array([ord(c) for c in letters], np.uint32)
        self.points = points
        pairs: dict[tuple[int, int], int] = {}
        rows: dict[tuple[int, int], int] = {}
        own: list[dict[int, float]] = []
        for x in strings:
            codes = np.array([self.code[c] for c in x])
            held: dict[int, float] = {}
            if len(x) >= ORDER:
                i, j, pair, last, decay = _triples(len(x))
                for p, k, d in zip(pair.tolist(), last.tolist(), decay.tolist(), strict=True):
                    two = pairs.setdefault((int(codes[i[p]]), int(codes[j[p]])), len(pairs) + 1)
                    row = rows.setdefault((two, int(codes[k])), len(rows) + 1)
                    held[row] = held.get(row, 0.0) + d
            own.append(held)
        self.pairs = np.zeros(self.size * self.size, np.int32)
        for (a, b), k in pairs.items():
            self.pairs[a * self.size + b] = k
        self.rows = np.zeros((len(pairs) + 1) * self.size, np.int32)
        for (a, b), k in rows.items():
            self.rows[a * self.size + b] = k
        self.values = np.zeros((len(rows) + 1, len(strings)), np.float32)  # a column for each string, of norm 1
        for k, held in enumerate(own):
            norm = sum(v * v for v in held.values()) ** 0.5
            for row, v in held.items():
                self.values[row, k] = v / norm

    def sums(self, words: list[str], values: np.ndarray) -> np.ndarray:
        """Of each word (of WINDOW characters at most) the values of its subsequences, weighted by decay."""
        out = np.zeros((len(words), *values.shape[1:]), np.float32)
        for part, grid in by_length(words, 16_384 // (1 if values.ndim == 1 else values.shape[1] // 8 + 1)):
            length = grid.shape[1]
            if length < ORDER:
                continue
            i, j, pair, last, decay = _triples(length)
            decay = decay.astype(np.float32)
            where = np.minimum(np.searchsorted(self.points, grid), len(self.points) - 1)
            codes = np.where(self.points[where] == grid, where + 1, 0)
            two = self.pairs[codes[:, i] * self.size + codes[:, j]]
            some = np.flatnonzero(two.any(1))  # words that share a pair of characters at least
            step = max(1, 400_000 // (len(pair) * (1 if values.ndim == 1 else values.shape[1])))
            for at in range(0, len(some), step):
                own = some[at : at + step]
                found = values[self.rows[two[own][:, pair] * self.size + codes[own][:, last]]]
                out[part[own]] = found @ decay if values.ndim == 1 else np.einsum("ijk,j->ik", found, decay)
        return out


def by_length(words: list[str], step: int):
    """(positions, code points) of words of one length, ``step`` characters of them at most or one word."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    size = np.array([len(words[k]) for k in order])
    for length in np.unique(size).tolist():
        own = order[np.searchsorted(size, length) : np.searchsorted(size, length, side="right")]
        for at in range(0, len(own), max(1, step // max(1, length))):
            part = own[at : at + max(1, step // max(1, length))]
            yield np.array(part), np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)


def norms(words: list[str]) -> np.ndarray:
    """Square roots of the words' kernels with themselves."""
    out = np.ones(len(words))
    for part, grid in by_length(words, 8192):
        if grid.shape[1] >= ORDER:
            # Where no character comes twice, each subsequence does once, and the length tells the kernel.
            length = grid.shape[1]
            twice = (np.diff(np.sort(grid, 1), axis=1) == 0).any(1)
            out[part] = np.sqrt((_triples(length)[4] ** 2).sum())
            if twice.any():
                some = grid[twice]
                out[part[twice]] = np.sqrt(np.maximum(_common((some[:, :, None] == some[:, None, :]).astype(np.float32)), 1e-12))
        else:
            out[part] = 1e-6  # without a subsequence of ORDER characters
    return out


def similarities(words: list[str], landmarks: list[Landmark]) -> np.ndarray:
    """Normalised kernel of each marked word with each landmark."""
    if not words:
        return np.zeros((0, len(landmarks)))
    known = Subsequences([m.text for m in landmarks])
    return known.sums(words, known.values) / norms(words)[:, None]


@dataclass
class ToxicityModel:
    landmarks: list[Landmark]
    weights: np.ndarray  # of the kernels, after the Nystroem map has been multiplied in
    bias: float
    slope: float = 1.0  # of the calibration
    offset: float = 0.0
    mix: tuple[float, ...] = (1.0,) + (0.0,) * (WORST - 1)  # of the decisions of a document's worst words
    cache: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.known = Subsequences([m.text for m in self.landmarks])
        self.values = self.known.values @ np.asarray(self.weights, np.float32)

    def marked(self, words: list[str]) -> np.ndarray:
        """Decision of each word between its marks, less the bias; zero stands for all that is not above it."""
        total = self.known.sums(words, self.values).astype(np.float64)
        above = np.flatnonzero(total > 0)
        out = np.zeros(len(words))
        out[above] = total[above] / norms([words[k] for k in above])
        return out

    def learn(self, words: set[str]) -> None:
        """Put the words' decisions into the cache, the bias at least; long words count as their worst window."""
        new = list(words.difference(self.cache))
        if len(self.cache) + len(new) > _CACHE:
            self.cache.clear()
            new = list(words)
        if new:
            parts = [windows(START + w + END) for w in new]
            found = self.marked([x for p in parts for x in p])
            worst = np.maximum.reduceat(found, np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]))
            self.cache.update(zip(new, (worst + self.bias).tolist(), strict=True))

    def worst(self, texts: list[str]) -> np.ndarray:
        """Decisions of the WORST worst words of each text, the bias where there are fewer."""
        out, held = np.full((len(texts), WORST), self.bias), []
        for i, t in enumerate(texts):
            held.append((i, words_of(t)))
            if len(held) == 64 or i == len(texts) - 1:
                self.learn(set().union(*(w for _, w in held)))
                for k, own in held:
                    out[k] = worst_of(np.fromiter(map(self.cache.__getitem__, own), float, len(own)), self.bias)
                held = []
        return out

    def decisions(self, texts: list[str]) -> np.ndarray:
        return self.worst(texts) @ np.array(self.mix)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(texts) + self.offset, -30, 30)))


_sentence_end = re.compile(r"(?<=[.!?])(?=[\x20\t\n])|\n")


def sentences(text: str) -> list[str]:
    """Parts that end in a line's end or in a full stop, exclamation or question mark before white space."""
    return [s for s in _sentence_end.split(text) if s.strip()]


def _grams(word: str) -> set[str]:
    return {word[i : i + n] for n in range(4, 12) for i in range(len(word) - n + 1)}


def surprise(a: int, b: int, share: float) -> float:
    """Log likelihood ratio of a toxic and b clean texts with a string, where ``share`` of all texts are toxic."""
    n = a + b
    return a * np.log(a / n / share) + (b * np.log(b / n / (1 - share)) if b else 0.0)


def without_copies(texts: list[str]) -> list[int]:
    """Positions of texts that share none of their eight least three-word shingles (by crc32) with an earlier one kept."""
    seen: set[int] = set()
    kept = []
    for i, t in enumerate(texts):
        w = t.split()
        least = sorted({zlib.crc32(" ".join(w[j : j + 3]).encode()) for j in range(max(1, len(w) - 2))})[:8]
        if not seen.intersection(least):
            kept.append(i)
            seen.update(least)
    return kept


def pick_landmarks(toxic: list[str], clean: list[str], most: int) -> list[str]:
    """Strings of 4 to 11 characters, ends of words among them, that stand in words of toxic texts and hardly in clean texts.

    The next one is that which most words of toxic texts hold that none so far stands in, longer ones first.
    """
    known = {marked(w) for t in clean for w in set(t.split())}
    words = [[w for w in {marked(w) for w in set(t.split())} if w not in known and len(w) <= WINDOW] for t in toxic]
    least = max(3, len(toxic) // 150)
    # Most strings stand in one text; they are told by counts of their hashes, so that few are counted one by one.
    hashed = np.zeros(1 << 22, np.int32)
    for own in words:
        hashed[list({hash(g) & 0x3FFFFF for w in own for g in _grams(w)})] += 1
    often = hashed >= least
    count = Counter(g for own in words for g in {g for w in own for g in _grams(w) if often[hash(g) & 0x3FFFFF]})
    found = {g for g, n in count.items() if n >= least}
    seen = Counter(g for t in clean for g in {g for w in {marked(w) for w in set(t.split())} if len(w) <= WINDOW for g in _grams(w) & found})
    share = len(toxic) / (len(toxic) + len(clean))
    good = {g for g in found if count[g] / len(toxic) >= 25 * seen[g] / len(clean) and surprise(count[g], seen[g], share) >= 10}
    holds: dict[str, set[tuple[int, str]]] = {g: set() for g in good}
    for i, own in enumerate(words):
        for w in own:
            for g in _grams(w) & good:
                holds[g].add((i, w))
    chosen: list[str] = []
    while holds and len(chosen) < most:
        best = max(holds, key=lambda g: (len(holds[g]) * (1 + 0.1 * len(g)), len(g), g))
        if len({i for i, _ in holds[best]}) < least:
            break
        chosen.append(best)
        gone = holds.pop(best)
        holds = {g: left for g, own in holds.items() if len(left := own - gone) >= least}
    return chosen


def fit(texts: list[str], labels: list[int], most: int = 64) -> ToxicityModel:
    """Landmarks, then the machine on sentences of both classes, then a calibration of documents."""
    lowered = [t.lower() for t in texts]
    kept = without_copies(lowered)  # copies of one text would make all of its words telling
    lowered, labels = [lowered[i] for i in kept], [labels[i] for i in kept]
    toxic = [t for t, y in zip(lowered, labels, strict=True) if y]
    clean = [t for t, y in zip(lowered, labels, strict=True) if not y]
    chosen = pick_landmarks(toxic, clean, most) if toxic and clean else []
    if not chosen:
        return ToxicityModel([], np.zeros(0), 0.0)
    landmarks = [Landmark(g, True) for g in chosen]
    # Clean words that come nearest to the toxic landmarks become landmarks too.
    near: Counter = Counter()
    seen = sorted({x for t in clean for w in words_of(t) for x in windows(START + w + END)})
    for at in range(0, len(seen), 10_000):
        near.update(dict(zip(seen[at : at + 10_000], similarities(seen[at : at + 10_000], landmarks).max(1, initial=0).tolist(), strict=True)))
    landmarks += [Landmark(w, False) for w, s in sorted(near.items(), key=lambda x: (-x[1], x[0]))[: len(chosen) // 2 + 1] if len(w) > ORDER + 2 and w not in chosen]
    own = np.array([m.self_kernel for m in landmarks])
    among = np.stack([kernels([m.text for m in landmarks], k.text) for k in landmarks]) / np.sqrt(own[:, None] * own[None, :])
    value, vector = np.linalg.eigh((among + among.T) / 2 + 1e-3 * np.eye(len(own)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    # The label of a sentence holds for its worst word, that of a toxic document for its worst sentence; which ones those
    # are is told first by the nearest toxic landmark, then by the machine itself, fitted anew.
    place: dict[str, int] = {}
    bags = []  # of each text the words of its sentences, by their number
    for text in lowered:
        own = [[place.setdefault(x, len(place)) for w in sorted(words_of(p)) for x in windows(START + w + END)] for p in sentences(text)]
        bags.append([np.array(sorted(set(f)), np.int32) for f in own if f])
    every = list(place)
    place.clear()
    x = np.zeros((len(every) + 1, len(landmarks) + 1), np.float32)  # the last row, of position -1, is a word that resembles none
    x[:, -1] = 1
    told = np.zeros(len(x))
    for at in range(0, len(every), 10_000):
        found = similarities(every[at : at + 10_000], landmarks)
        x[at : at + len(found), :-1] = found @ root
        told[at : at + len(found)] = found[:, : len(chosen)].max(1)
    del every
    flat = np.diag([RIDGE] * (x.shape[1] - 1) + [1e-8])
    documents = [np.array(sorted({int(k) for f in own for k in f}), int) for own in bags]
    w = np.zeros(x.shape[1])
    best = (np.inf, 0, w)
    for turn in range(TURNS):
        held: dict[tuple[int, int], float] = {(-1, -1): -1.0}
        for i, (own, y) in enumerate(zip(bags, labels, strict=True)):
            worst = sorted((int(f[told[f].argmax()]) for f in own), key=lambda k: -told[k])
            if y:
                worst = [k for k in worst if k == worst[0] or told[k] > 0.5]
            held.update({(i, k): 1.0 if y else -1.0 for k in worst})
        rows, y = [k for _, k in held], np.array(list(held.values()))
        share = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean))  # a document's worst sentences weigh as much as it does
        z = x[rows].astype(float)
        for step in range(50):  # Newton's steps on the squared hinge loss
            active = share * (y * (z @ w) < 1)
            new = np.linalg.solve((z * active[:, None]).T @ z + flat, z.T @ (active * y))
            if np.abs(new - w).max() < 1e-9:
                break
            w = (w + new) / 2 if step > 25 else new
        before, told = told, x @ w
        loss = mixed(np.array([worst_of(told[own], float(w[-1])) for own in documents]), np.array(labels))[1]
        best = min(best, (loss, turn, w), key=lambda found: found[:2])
        if turn and np.abs(told - before).max() < 1e-6:
            break
    w = best[2]  # turns need not settle; that counts which tells the sample's documents apart best
    w, b = w[:-1], w[-1]
    model = ToxicityModel(landmarks, root @ w, float(b))
    calibrate(model, lowered, labels)
    return model


def worst_of(found: np.ndarray, bias: float) -> np.ndarray:
    """The WORST largest decisions, the bias where there are fewer."""
    out = np.full(WORST, bias)
    top = np.sort(np.partition(found, -WORST)[-WORST:] if len(found) > WORST else found)[::-1]
    out[: len(top)] = np.maximum(top, bias)
    return out


def mixed(worst: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of documents' worst decisions, loss) of a logistic regression in which both classes count alike."""
    x = np.concatenate([worst, np.ones((len(y), 1))], 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 1).sum()))
    u = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(u)), x.T @ (share * (y - p)) - 1e-3 * u)
        u += step
        if np.abs(step).max() < 1e-8:
            break
    z = np.clip(x @ u, -30, 30)
    return u, float((share * np.log1p(np.exp(np.where(y > 0, -z, z)))).sum())


def calibrate(model: ToxicityModel, texts: list[str], labels: list[int]) -> None:
    """Mix the worst words' decisions by logistic regression; the cut that errs least on the sample gets the score THRESHOLD."""
    worst = np.concatenate([model.worst(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    y = np.array(labels)
    mix = np.maximum(mixed(worst, y)[0][:-1], 0)
    mix[0] = max(mix[0], 1e-3)
    model.mix = tuple((mix / mix.sum()).tolist())
    f = worst @ np.array(model.mix)
    order = np.argsort(f, kind="stable")
    f, y = f[order], y[order]
    # errors of a cut below position i: toxic ones under it and clean ones above
    wrong = np.concatenate([[0], np.cumsum(y)]) + ((1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)]))
    best = np.flatnonzero(wrong == wrong.min())
    gap = [(f[i] if i < len(f) else f[-1] + 1) - (f[i - 1] if i else f[0] - 1) for i in best]
    i = int(best[int(np.argmax(gap))])
    low, high = (f[i - 1] if i else f[0] - 1), (f[i] if i < len(f) else f[-1] + 1)
    cut = low + 0.4 * (high - low)  # nearer to clean texts, as disguised insults fall between
    model.slope = 6.0 / max(1e-6, abs(high - low) + float(np.std(f)))
    model.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * cut)


def fit_rows(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1000, most_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Fit on about ``per_class`` labelled documents of each class, of ``most_chars`` characters at most; a key with several labels is toxic if one is."""
    found, _ = labelled_sample(documents, labels, key, text, label, per_class, most_chars)
    model = fit([t for t, _ in found], [y for _, y in found])
    del found
    forget(model)
    return model


def forget(model: ToxicityModel) -> None:
    """Give back what a worker has remembered: it goes on to other stages."""
    model.cache.clear()
    _plain.clear()
    trim()


def score(rows: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for part in slices(batches):
            found = own.scores([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=[key, "score"])
        forget(own)

    return mapped(rows.select(key, text), run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")


def clean_rows(rows: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows that score below THRESHOLD, with all their columns."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text)

    def run(batches):
        own = shipped.value
        for part in slices(batches):
            found = own.scores([t or "" for t in part.column(at).to_pylist()])
            yield part.filter(pa.array(found < THRESHOLD))
        forget(own)

    return mapped(rows, run, rows.schema)
