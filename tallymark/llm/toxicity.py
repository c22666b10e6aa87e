"""Convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

Trained in numpy on a bounded sample of labelled rows. A word's vector is the sum of the vectors of
its hashed whole form and hashed beginnings. Filters of one to three words slide over the whole text,
their maxima feed one logistic unit. A threshold is calibrated for each language, on all rows that may be
learnt from; the language of a text is itself guessed from its hashed words, so that a score depends on the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import BROADCAST_ROWS, batch_column, labelled_sample, stored

#: Rows of each class, and characters of a text, that the fit takes at most.
FIT_ROWS, FIT_CHARS = 900, 12_000
BITS, SIZE, WIDTHS, FILTERS = 16, 12, (1, 2, 3), 8
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE, DECAY, WORD_DROP = 10, 32, 0.15, 1e-3, 0.25
#: Features that occur in fewer texts of the sample keep a zero vector.
MIN_TEXTS = 3
#: Language thresholds are drawn towards the common one as by this many toxic texts.
SHRINK = 20
#: Steps of the margin histogram, and margins at which it ends.
STEP, MOST = 1 / 64, 512
CACHE = 200_000
#: Words of a text whose filters are evaluated at once.
PIECE = 32_768

_LETTERS = re.compile(r"[^\W\d_]+")
_OFFSETS = [(w, k) for w in WIDTHS for k in range(w)]


def features(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings; bucket 0 stands for none."""
    keys = [word] + [f"{word[:n]}\x00{n}" for n in PREFIXES]
    return tuple((zlib.crc32(k.encode()) >> (32 - BITS)) | 1 if len(word) >= 2 else 0 for k in keys)


def tokens(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


@dataclass
class Model:
    """Bucket vectors, filters by (width, offset), the output unit, and languages with thresholds."""

    embed: np.ndarray
    filters: list[np.ndarray]
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    language_words: np.ndarray | None = None
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def projected(self, buckets: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each offset."""
        vectors = self.embed[buckets].sum(1)
        return np.hstack([vectors @ f for f in self.filters]).astype(np.float32)


class Scorer:
    """Scores whole texts; words seen before are looked up in a bounded table of projections."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self):
        self.rows = {"": 0}
        self.table = np.zeros((1, len(_OFFSETS) * FILTERS), np.float32)
        self.tongues = np.zeros((1, max(1, len(self.model.languages))), np.float32)

    def _numbers(self, found: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self._empty()
        rows = self.rows
        fresh = [w for w in dict.fromkeys(found) if w not in rows]
        if fresh:
            buckets = np.array([features(w) for w in fresh])
            start = len(rows)
            rows.update(zip(fresh, range(start, start + len(fresh))))
            if len(rows) > len(self.table):
                grown = max(len(rows), 2 * len(self.table))
                for name in ("table", "tongues"):
                    old = getattr(self, name)
                    new = np.zeros((grown, old.shape[1]), np.float32)
                    new[:len(old)] = old
                    setattr(self, name, new)
            self.table[start:len(rows)] = self.model.projected(buckets)
            if self.model.language_words is not None:
                self.tongues[start:len(rows)] = self.model.language_words[buckets[:, 0]]
        return np.fromiter(map(rows.__getitem__, found), np.int64, len(found))

    def margin_and_tongue(self, text: str | None) -> tuple[float, int]:
        """The output unit's value and the guessed language's number (0 where nothing tells)."""
        found = tokens(text)
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        tongue = np.zeros(self.tongues.shape[1])
        for lo in range(0, max(1, len(found)), PIECE):
            ids = self._numbers(found[lo:lo + PIECE + max(WIDTHS) - 1])
            part = ids[:PIECE]
            tongue += self.tongues.take(part, 0).sum(0) if len(part) else 0
            ids = np.concatenate([ids, np.zeros(max(WIDTHS), np.int64)])
            rows, n, at = self.table.take(ids, 0), max(1, len(part)), 0
            for i, width in enumerate(WIDTHS):
                total = rows[:n, at * FILTERS:(at + 1) * FILTERS]
                for k in range(1, width):
                    total = total + rows[k:k + n, (at + k) * FILTERS:(at + k + 1) * FILTERS]
                best[i * FILTERS:(i + 1) * FILTERS] = np.maximum(best[i * FILTERS:(i + 1) * FILTERS], total.max(0))
                at += width
        pooled = np.maximum(best + self.model.filter_bias, 0)
        return float(pooled @ self.model.out) + self.model.out_bias, int(tongue.argmax())


def _kept_buckets(token_lists) -> np.ndarray:
    """Which buckets occur in at least MIN_TEXTS texts."""
    seen = Counter()
    for found in token_lists:
        seen.update({b for w in set(found) for b in features(w)})
    keep = np.zeros(1 << BITS, bool)
    keep[[b for b, n in seen.items() if n >= MIN_TEXTS and b]] = True
    return keep


def fit(texts: list[str], y: np.ndarray, languages: list[str | None], seed: int = 5) -> Model:
    """Train on labelled texts; without labels of both kinds the score is constant."""
    rng = np.random.default_rng(seed)
    pooled_size = len(WIDTHS) * FILTERS
    embed = np.zeros((1 << BITS, SIZE))
    filters = [rng.normal(0, 0.4, (SIZE, FILTERS)) for _ in _OFFSETS]
    fbias, out, bias = np.zeros(pooled_size), rng.normal(0.4, 0.2, pooled_size), -1.0
    if not len(y) or y.min() == y.max():
        sure = 6.0 if len(y) and y.max() == 1 else -6.0
        return Model(embed.astype(np.float32), [f.astype(np.float32) for f in filters], fbias, out * 0, sure)
    found = [tokens(t) for t in texts]
    keep = _kept_buckets(found)
    embed[keep] = rng.normal(0, 0.15, (int(keep.sum()), SIZE))
    vocabulary: dict[str, int] = {"": 0}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t), np.int64, len(t)) for t in found]
    buckets = np.array([(0,) * (1 + len(PREFIXES))] + [features(w) for w in list(vocabulary)[1:]])
    buckets = np.where(keep[buckets], buckets, 0)
    memory = {"embed": np.full((1 << BITS, 1), 1e-6), "filters": [np.full(f.shape, 1e-6) for f in filters],
              "fbias": np.full(pooled_size, 1e-6), "out": np.full(pooled_size, 1e-6), "bias": 1e-6}
    weight = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (1 - y).sum())

    def step(value, slope, past):
        past += slope ** 2
        value -= RATE * slope / np.sqrt(past)

    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            picked = order[lo:lo + BATCH]
            flat = [np.concatenate([ids[i], np.zeros(max(WIDTHS), np.int64)]) for i in picked]
            for f in flat:
                f[rng.random(len(f)) < WORD_DROP] = 0
            local, where = np.unique(np.concatenate([[0], *flat]), return_inverse=True)
            where, vectors = where.ravel()[1:], embed[buckets[local]].sum(1)
            table = np.hstack([vectors @ f for f in filters]).astype(np.float32)
            pooled, at_word = np.zeros((len(picked), pooled_size)), np.zeros((len(picked), pooled_size), np.int64)
            start = 0
            for b, f in enumerate(flat):
                n = max(1, len(f) - max(WIDTHS))
                rows, at = table[where[start:start + len(f)]], 0
                for i, width in enumerate(WIDTHS):
                    total = rows[:n, at * FILTERS:(at + 1) * FILTERS]
                    for k in range(1, width):
                        total = total + rows[k:k + n, (at + k) * FILTERS:(at + k + 1) * FILTERS]
                    here = slice(i * FILTERS, (i + 1) * FILTERS)
                    top = total.argmax(0)
                    pooled[b, here], at_word[b, here] = total[top, np.arange(FILTERS)], start + top
                    at += width
                start += len(f)
            active = np.maximum(pooled + fbias, 0)
            margin = active @ out + bias
            error = weight[picked] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[picked]) / len(picked)
            back = error[:, None] * out * (pooled + fbias > 0)
            slope_vectors, at = np.zeros_like(vectors), 0
            for i, width in enumerate(WIDTHS):
                here = slice(i * FILTERS, (i + 1) * FILTERS)
                for k in range(width):
                    word = where[np.minimum(at_word[:, here] + k, len(where) - 1)]
                    slope = np.einsum("bf,bfd->df", back[:, here], vectors[word]) + DECAY * filters[at]
                    np.add.at(slope_vectors, word, back[:, here, None] * filters[at].T[None])
                    step(filters[at], slope, memory["filters"][at])
                    at += 1
            step(out, active.T @ error + DECAY * out, memory["out"])
            step(fbias, back.sum(0), memory["fbias"])
            memory["bias"] += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(memory["bias"])
            touched, slot = np.unique(buckets[local], return_inverse=True)
            slope = np.zeros((len(touched), SIZE))
            np.add.at(slope, slot.reshape(buckets[local].shape), slope_vectors[:, None, :])
            slope += DECAY * 0.1 * embed[touched]
            memory["embed"][touched] += (slope ** 2).mean(1, keepdims=True)
            embed[touched] -= RATE * slope / np.sqrt(memory["embed"][touched])
            embed[0] = 0
    model = Model(embed.astype(np.float32), [f.astype(np.float32) for f in filters], fbias, out, float(bias))
    _calibrate(model, texts, found, y, languages)
    return model


def _calibrate(model: Model, texts, found, y, languages) -> None:
    """Word log frequencies by language for the guess, and one margin threshold per language."""
    names = sorted({x for x in languages if x})
    if names:
        counts = np.full((1 << BITS, len(names)), 0.1)
        for t, name in zip(found, languages):
            if name:
                hit = Counter(features(w)[0] for w in t)
                counts[list(hit), names.index(name)] += list(hit.values())
        model.languages = names
        model.language_words = np.log(counts / counts.sum(0)).astype(np.float32)
        model.language_words[0] = 0
    scorer = Scorer(model)
    margins, tongues = map(np.array, zip(*map(scorer.margin_and_tongue, texts)))
    _settle(model, margins, tongues, 1 - y, y)


def _settle(model: Model, margins, tongues, fine, toxic) -> None:
    """One threshold per guessed language from margins with their numbers of fine and of toxic texts."""
    common = _threshold(margins, fine, toxic)
    model.thresholds = np.full(max(1, len(model.languages)), common)
    for k in range(len(model.languages)):
        mine = tongues == k
        n = toxic[mine].sum()
        if n and fine[mine].sum():
            share = n / (n + SHRINK)
            model.thresholds[k] = share * _threshold(margins[mine], fine[mine], toxic[mine]) + (1 - share) * common


def _threshold(margins: np.ndarray, fine: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best sum of both classes' hit rates, in the middle of its gap."""
    m, at = np.unique(margins, return_inverse=True)
    fine, toxic = np.bincount(at, fine), np.bincount(at, toxic)
    below = np.concatenate([[0], np.cumsum(fine)]) / fine.sum()
    above = 1 - np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
    gain = below + above
    good = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    return float(edges[good].mean())


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labels whose crc32(doc_id as text) mod 5 is not 0; thresholds from all of them."""
    learn = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    texts, y, _, languages = labelled_sample(docs, learn, "toxic", FIT_ROWS, FIT_CHARS)
    model = fit(texts, y, languages)
    _calibrate_on_all(model, docs, learn)
    return model


def _calibrate_on_all(model: Model, docs: DataFrame, learn: DataFrame) -> None:
    """Thresholds from the margins of all labelled texts, of any length, as a histogram per guessed language."""
    known = stored(learn.select("doc_id", F.col("toxic").cast("int").alias("__y")).where("__y in (0, 1)")
                   .groupBy("doc_id").agg(F.max("__y").alias("__y")))  # an id labelled twice counts once
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    payload = docs.sparkSession.sparkContext.broadcast(model)
    rows = (docs.select("doc_id", "text").where(F.length("text") > 0).join(known, "doc_id")
            .select("__y", batch_column(F.col("text"), "step long, tongue long", _MARGINS, _start_margins, payload)
                    .alias("__at"))
            .groupBy("__at.step", "__at.tongue").agg(F.sum(1 - F.col("__y")), F.sum("__y"))
            .collect())  # at most 2 * MOST / STEP + 1 rows per language
    if not rows:
        return
    steps, tongues, fine, toxic = (np.array(x) for x in zip(*map(tuple, rows)))
    if fine.sum() and toxic.sum():  # with one class there is nothing to tell apart
        _settle(model, steps * STEP, tongues, fine, toxic)


_MARGINS = {"step": pa.int64(), "tongue": pa.int64()}


def _start_margins(model):
    scorer = Scorer(model)

    def work(texts):
        margins, tongues = zip(*map(scorer.margin_and_tongue, texts))
        return np.rint(np.clip(margins, -MOST, MOST) / STEP).astype(np.int64), np.array(tongues, np.int64)

    return work


def _start(model):
    scorer = Scorer(model)

    def one(text):
        margin, tongue = scorer.margin_and_tongue(text)
        level = float(model.thresholds[tongue])
        score = 1 / (1 + np.exp(-np.clip(margin - level, -30, 30)))
        return float(score), int(score >= 0.5), model.languages[tongue] if model.languages else None, level

    def work(texts):
        return list(zip(*map(one, texts)))

    return work


FIELDS = {"score": pa.float64(), "predicted": pa.int32(), "language": pa.string(), "threshold": pa.float64()}


def scored(docs: DataFrame, model: Model, into: str = "scored") -> DataFrame:
    """``docs`` plus a struct ``into``: score, predicted (score >= 0.5), guessed language, threshold.

    The score is the logistic of the margin over the language's threshold. NULL, empty and
    letter-free texts score as texts of unknown words; texts of any length are read whole; equal texts
    have equal scores. lang, source, ids and labels are no inputs.
    """
    payload = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, batch_column(
        F.col("text"), "score double, predicted int, language string, threshold double", FIELDS, _start, payload))
