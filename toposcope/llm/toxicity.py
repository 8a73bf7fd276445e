"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

Words are compared by the gap-weighted subsequence kernel over letter triples: a triple counts in full where
its letters are neighbours and less by ``DECAY`` for each letter between them (two at most), so an insult
keeps most of its likeness when characters are inserted. A sign stands before each word as a letter of its
own; what isn't a letter is skipped and digits read as the letters they resemble. Landmarks are words and word
beginnings that tell toxic training texts from others. A text's features are its largest and its summed kernel
value with each landmark, mapped by the inverse root of the landmarks' own kernel matrix (Nyström); a linear
machine with squared hinge loss and a logistic link gives the score. Kernels, landmarks and weights are fitted on a bounded sample of labelled
rows; all texts are scored whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposcope.llm import words as W

DECAY = 0.7
STEPS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]  # places of the second and third letter
FLOOR = 0.5  # smaller kernel values count as none
LONG = 9  # words are normalised as if they had at most so many letters
BLOCK = 1 << 14  # words whose kernel rows are held at once
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


START = 63


def _letter_tables() -> tuple[np.ndarray, list[str]]:
    """Code point to letter number (0: skipped) and back: a to z are 1 to 26, then the accented letters of Latin-1."""
    chars = ["", *"abcdefghijklmnopqrstuvwxyz", *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
    number = {c: i for i, c in enumerate(chars) if c}
    out = np.zeros(0x250, dtype=np.uint8)
    for c in range(0x250):
        low = _LEET.get(chr(c), chr(c)).lower()
        out[c] = number.get(low, number.get(unicodedata.normalize("NFD", low)[:1], 0))
    return out, chars + [""] * (START - len(chars)) + ["^"]


_LETTERS, _CHARS = _letter_tables()


def _numbers(word: str) -> np.ndarray:
    return np.array([_CHARS.index(c) for c in word], dtype=np.uint8)


def _norms(most: int) -> np.ndarray:
    n = np.arange(most + 1)
    square = sum(np.maximum(0, n - b) * DECAY ** (2 * (b - 2)) for _, b in STEPS)
    return np.sqrt(np.maximum(square, 1e-9))


_NORM = _norms(LONG)


def letter_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(letters, word offsets, row of each word)`` of texts, words with their start sign; none of fewer than 3 letters."""
    texts = [t.as_buffer().to_pybytes().decode("utf-8", "replace") for t in column]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row_end = np.cumsum([len(t) for t in texts])
    gap = (points < 33) & np.isin(points, [9, 10, 11, 12, 13, 32])
    cut = gap.copy()
    begins = np.r_[0, row_end[:-1]]
    cut[begins[begins < len(points)]] = True
    word = np.cumsum(cut)
    letters = np.where(points < len(_LETTERS), _LETTERS[np.minimum(points, len(_LETTERS) - 1)], 0)
    keep = letters > 0
    letters, word, at = letters[keep], word[keep], np.flatnonzero(keep)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, int)
    row = np.searchsorted(row_end, at[first], side="right")
    sizes = np.diff(np.r_[first, len(letters)])
    good = sizes >= 3
    take = np.repeat(good, sizes)
    sizes = sizes[good]
    begin = np.r_[0, np.cumsum(sizes)]
    return np.insert(letters[take], begin[:-1], START), np.r_[0, np.cumsum(sizes + 1)], row[good]


def _triples(letters: np.ndarray, left: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(left > b)
    return at, (letters[at].astype(np.int32) << 12) | (letters[at + a].astype(np.int32) << 6) | letters[at + b]


@dataclass
class Landmarks:
    """Kernel columns of the landmark words: for each triple number the landmarks that have it, and its weight there."""

    words: list[str]
    first: np.ndarray
    times: np.ndarray
    mark: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Landmarks:
        entries: Counter = Counter()
        for m, w in enumerate(words):
            letters = _numbers(w)
            for a, b in STEPS:
                _, triple = _triples(letters, len(letters) - np.arange(len(letters)), a, b)
                for t in triple.tolist():
                    entries[t, m] += DECAY ** (b - 2) / _NORM[min(len(w), LONG)]
        keys = sorted(entries)
        triples = np.array([k[0] for k in keys], dtype=np.int64)
        times = np.bincount(triples, minlength=1 << 18).astype(np.int32)
        first = (np.cumsum(times) - times).astype(np.int32)
        return Landmarks(words, first, times, np.array([k[1] for k in keys], np.int32), np.array([entries[k] for k in keys]))

    def kernel(self, letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word numbers, kernel rows)`` of the words with some value above FLOOR; smaller values are 0."""
        found, rows, m = [np.zeros(0, int)], [np.zeros((0, len(self.words)), np.float32)], len(self.words)
        for low in range(0, len(offsets) - 1 if m else 0, BLOCK):
            own = offsets[low : low + BLOCK + 1]
            part, sizes = letters[own[0] : own[-1]], np.diff(own)
            left = np.repeat(own[1:] - own[0], sizes) - np.arange(len(part))
            word = np.repeat(np.arange(len(sizes)), sizes)
            total = np.zeros(len(sizes) * m)
            for a, b in STEPS:
                at, triple = _triples(part, left, a, b)
                hit = self.times[triple] > 0
                at, triple = at[hit], triple[hit]
                times = self.times[triple]
                entry = np.repeat(self.first[triple] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                total += np.bincount(np.repeat(word[at], times) * m + self.mark[entry], self.weight[entry] * DECAY ** (b - 2), minlength=len(total))
            value = total.reshape(-1, m) / _NORM[np.minimum(sizes, LONG), None]
            some = np.flatnonzero((value > FLOOR).any(axis=1))
            found.append(some + low)
            rows.append(np.minimum(np.maximum(value[some] - FLOOR, 0) / (1 - FLOOR), 1).astype(np.float32))
        return np.concatenate(found), np.concatenate(rows)

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Per text the largest kernel value with each landmark, then log(1 + sum) of the values over all words."""
        letters, offsets, row = letter_words(column)
        m = len(self.words)
        out = np.zeros((len(column), 2 * m), dtype=np.float32)
        if not len(row):
            return out
        hashes = W.span_hashes(letters, offsets[:-1], offsets[1:])
        _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = np.diff(offsets)[first]
        ends = np.r_[0, np.cumsum(sizes)]
        take = np.arange(ends[-1]) + np.repeat(offsets[first] - ends[:-1], sizes)
        near, values = self.kernel(letters[take], ends)
        place = np.full(len(first), -1)
        place[near] = np.arange(len(near))
        hit = np.flatnonzero(place[same] >= 0)
        if len(hit):
            own, values = row[hit], values[place[same[hit]]]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[heads], :m] = np.maximum.reduceat(values, heads, axis=0)
            out[own[heads], m:] = np.log1p(np.add.reduceat(values, heads, axis=0))
        return out


def _mapped(pooled: np.ndarray, root: np.ndarray) -> np.ndarray:
    m = len(root)
    return np.concatenate([pooled[:, :m] @ root, pooled[:, m:] @ root], axis=1)


@dataclass
class Model:
    landmarks: Landmarks
    root: np.ndarray
    weights: np.ndarray
    link: tuple[float, float]

    def scores(self, column: pa.Array) -> np.ndarray:
        margin = _mapped(self.landmarks.pooled(column), self.root) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.link[0] * margin + self.link[1], -40, 40)))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches):
        toxic = chunk.column("toxic").to_pylist()
        letters, offsets, row = letter_words(chunk.column("text"))
        text = "".join([_CHARS[i] for i in letters])
        seen: dict[int, set[str]] = {}
        for r, a, b in zip(row.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            w = text[a : min(b, a + 24)]
            seen.setdefault(r, set()).update([w, w[:5], w[:6], w[:7]])
        counts = [Counter(), Counter()]
        for r, grams in seen.items():
            counts[toxic[r]].update(g for g in grams if len(g) >= 5)
        grams = sorted(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array([counts[k][g] for g in grams], pa.int64()) for k in (1, 0))], names=["gram", "n_toxic", "n_clean"])


def choose_landmarks(grams: list[tuple[str, int, int]], toxic: int, clean: int, most: int) -> list[str]:
    """Grams far more frequent in toxic texts, best first; of grams that begin alike only the best (longest if equal)."""
    rate = lambda g: (g[1] + 0.5) / (toxic + 1) - (g[2] + 0.5) / (clean + 1)
    good = [g for g in grams if (g[1] + 0.5) * (clean + 1) > 8 * (g[2] + 0.5) * (toxic + 1)]
    chosen: list[str] = []
    for g, _, _ in sorted(good, key=lambda g: (-rate(g), -len(g[0]), g[0])):
        if not any(g.startswith(c) or c.startswith(g) for c in chosen):
            chosen.append(g)
        if len(chosen) == most:
            break
    return chosen


def _vectors(batches: Iterator[pa.RecordBatch], landmarks: Landmarks) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches):
        values = landmarks.pooled(chunk.column("text")).astype(np.float64)
        yield pa.RecordBatch.from_arrays([chunk.column("toxic"), pa.array(list(values), pa.list_(pa.float64()))], names=["toxic", "vector"])


def fit(texts: DataFrame, most_rows: int = 3000, landmarks: int = 64, ridge: float = 1e-3, penalty: float = 0.05) -> Model:
    """Fit on ``texts`` (doc_id, text, toxic 0/1): at most ``most_rows`` toxic and twice as many other rows, by hash of the id.

    Counts of words and prefixes and the kernel rows are made in Spark; the driver gets at most 5,000 grams and
    one row of twice ``landmarks`` numbers per sampled text.
    """
    draw = lambda t, n: texts.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).limit(n)
    sample = draw(1, most_rows).unionByName(draw(0, 2 * most_rows)).persist()
    try:
        sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        counted = sample.mapInArrow(_grams, "gram string, n_toxic long, n_clean long").groupBy("gram").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        counted = counted.where(f"n_toxic >= {max(3, toxic // 200)} and (n_toxic + 0.5) * {clean + 1} > 8 * (n_clean + 0.5) * {toxic + 1}")
        rows = counted.orderBy(F.desc("n_toxic"), "n_clean", "gram").limit(5000).collect()
        marks = Landmarks.of(choose_landmarks([(r.gram, r.n_toxic, r.n_clean) for r in rows], toxic, clean, landmarks))
        got = sample.mapInArrow(partial(_vectors, landmarks=marks), "toxic int, vector array<double>").toArrow()
    finally:
        sample.unpersist()
    n = len(marks.words)
    y = np.where(got["toxic"].to_numpy() == 1, 1.0, -1.0)
    x = np.array(got["vector"].to_pylist(), dtype=np.float64).reshape(len(y), 2 * n)
    own = np.zeros((n, n))
    for m, w in enumerate(marks.words):
        letters = _numbers(w)
        near, values = marks.kernel(letters, np.array([0, len(letters)]))
        own[m] = values[0] if len(near) else 0
    value, vector = np.linalg.eigh((own + own.T) / 2 + ridge * np.eye(n)) if n else (np.zeros(0), np.zeros((0, 0)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, ridge))) @ vector.T
    z = np.c_[_mapped(x, root), np.ones(len(y))]
    w = np.zeros(2 * n + 1)
    for _ in range(50):  # squared hinge: least squares over the rows inside the margin, until they stay the same
        inside = y * (z @ w) < 1
        new = np.linalg.solve(penalty * np.eye(2 * n + 1) + z[inside].T @ z[inside], z[inside].T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    margin, a, b = z @ w, 1.0, 0.0
    # The link leans on smoothed targets, so that it stays finite where the classes part.
    target = np.where(y > 0, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        h = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * margin).sum(), (p - target).sum()])
        hess = np.array([[(h * margin * margin).sum(), (h * margin).sum()], [(h * margin).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        scale = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(marks, root, w, (float(a), float(b)))


def _score(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    for chunk in W.text_chunks(batches):
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.round(model.value.scores(chunk.column("text")), 6))], names=["doc_id", "score"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document; trained on the labelled rows not held out.

    Null and empty texts get the score of a text without any landmark. Null labels are left out; a document with
    several labels trains with each. Null ids are not held out, repeated rows stay. Without a toxic training row
    there are no landmarks and all scores are equal. Only ``doc_id, text, toxic`` are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    n = int(settings.get("most_rows", 3000))
    # The bounded sample's ids first: only they meet the texts, and they are few enough to be broadcast.
    ids = marks.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).unionByName(marks.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.join(F.broadcast(ids), "doc_id"), **settings))
    scored = rows.mapInArrow(partial(_score, model=model), "doc_id long, score double")
    out = F.coalesce(held_out(), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
