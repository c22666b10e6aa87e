"""Quality rules: text statistics, and a hashed n-gram logistic regression with calibrated output."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import batch_column, labelled_sample

#: Rows of each class, and characters of a text, that the fit takes at most.
FIT_ROWS, FIT_CHARS = 1000, 10_000
#: Buckets of word and of character n-grams.
WORD_BITS, CHAR_BITS = 16, 16
CHAR_N = 4
SCALE = 30.0
STEPS, RATE, DECAY = 30, 1.0, 1e-4
FOLDS = 3
#: Pull of the calibration towards slope 1 and shift 0.
PRIOR = 1e-2
#: A text stays from this probability of being of good quality on.
THRESHOLD = 0.35
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
CACHE = 300_000
#: Characters whose n-grams are hashed at once.
PIECE = 1 << 20

_SYMBOLS = tuple(b"#*$%&|<>"[i:i + 1] for i in range(8))
_SPACES = b" \t\n\r\x0b\x0c"


class Numbers(dict):
    """Numbers of words in order of first sight, with a 64-bit hash of each lower-cased word."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        low = word.lower()
        self.hashes[n] = zlib.crc32(low) << 32 | zlib.crc32(low, 0x5BD1E995)
        return n

    def of(self, found: list[bytes]) -> np.ndarray:
        """The words' numbers; the table is emptied between texts once it has CACHE words."""
        if len(self) > CACHE:
            self.clear()
        return np.array(list(map(self.__getitem__, found)), np.int64)


def base_counts(data: bytes, numbers: Numbers) -> tuple[np.ndarray, int, int, int, int]:
    """The words' numbers, and word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    ids = numbers.of(data.split())
    bare = data.translate(None, _SPACES)
    chars = len(bare) if bare.isascii() else len(bare.decode())
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line and line.strip(_SPACES):
            dup += line in seen
            seen.add(line)
    return ids, chars, sum(map(data.count, _SYMBOLS)), dup, repeated_words(ids)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if int(ids.max()) < 2 ** 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(keys)
    placed = keys[order]
    same = placed[1:] == placed[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k:k + n] |= again
    return int(inside.sum())


def word_buckets(ids: np.ndarray, numbers: Numbers) -> np.ndarray:
    """Buckets of the word unigrams and bigrams."""
    one = numbers.hashes[ids]
    two = one[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
    mixed = np.concatenate([one, two]) * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def char_buckets(data: bytes):
    """Buckets of the n-grams of characters, in pieces that bound the memory for a very long text.

    A character is a code point. One beyond ASCII is spread over 32 bits; four are laid over one another, each
    turned by a byte more, which for ASCII is the text's own bytes, so these are not decoded.
    """
    if data.isascii():
        data = data.ljust(CHAR_N, b" ")
        for lo in range(0, len(data) - CHAR_N + 1, PIECE):
            piece = data[lo:lo + PIECE + CHAR_N - 1]
            for k in range(min(4, len(piece) - 3)):
                yield _bucket(np.frombuffer(piece, "<u4", (len(piece) - k) // 4, k))
        return
    text = data.decode().ljust(CHAR_N)
    for lo in range(0, len(text) - CHAR_N + 1, PIECE):
        points = np.frombuffer(text[lo:lo + PIECE + CHAR_N - 1].encode("utf-32-le"), "<u4")
        points = np.where(points < 128, points, points * np.uint32(0x85EBCA6B))
        key = points[:len(points) - CHAR_N + 1].copy()
        for k in range(1, CHAR_N):
            part = points[k:k + len(key)]
            key ^= (part << np.uint32(8 * k)) | (part >> np.uint32(32 - 8 * k))
        yield _bucket(key)


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)


@dataclass
class Model:
    """Weights of both n-gram kinds, and the calibration of their sum."""

    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray, data: bytes, numbers: Numbers) -> float:
        """Mean weight of the word n-grams plus mean weight of the character n-grams, scaled."""
        total = self.bias
        if len(ids):
            total += SCALE * float(self.word.take(word_buckets(ids, numbers)).mean())
        if data:
            summed = n = 0
            for buckets in char_buckets(data):
                summed, n = summed + float(self.char.take(buckets).sum(dtype=np.float64)), n + len(buckets)
            total += SCALE * summed / n
        return total

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _rows(texts: list[str]):
    """Per text the buckets and shares of its n-grams, character buckets after word buckets."""
    numbers, index, value = Numbers(), [], []
    for text in texts:
        data, parts = text.encode(), []
        found = ((word_buckets(numbers.of(data.split()), numbers), 0),
                 (np.concatenate(list(char_buckets(data))).astype(np.int64), 1 << WORD_BITS))
        for buckets, offset in found:
            if len(buckets):
                ids, n = np.unique(buckets, return_counts=True)
                parts.append((ids + offset, n * (SCALE / len(buckets))))
        index.append(np.concatenate([p[0] for p in parts]).astype(np.int32))
        value.append(np.concatenate([p[1] for p in parts]).astype(np.float32))
    return index, value


def _descend(index, value, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with per-weight step sizes, classes weighted alike."""
    flat, share = np.concatenate(index), np.concatenate(value)
    lengths = np.array([len(i) for i in index])
    row = np.repeat(np.arange(len(y)), lengths)
    size = (1 << WORD_BITS) + (1 << CHAR_BITS)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b, seen, seen_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(STEPS):
        margin = np.bincount(row, share * w[flat], len(y)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        slope = np.bincount(flat, share * error[row], size) + DECAY * w
        seen, seen_b = seen + slope ** 2, seen_b + error.sum() ** 2
        w, b = w - RATE * slope / np.sqrt(seen), b - RATE * error.sum() / np.sqrt(seen_b)
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins of texts that the weights have not seen.

    Rows count by ``weight``, whose mean is 1. Newton's steps are halved until the loss falls, since
    full ones run away over wide margins.
    """
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a, b):
        z = a * margin + b
        return (weight * (np.logaddexp(0, z) - target * z)).mean() + PRIOR / 2 * ((a - 1) ** 2 + b ** 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e, v = p - target, np.maximum(p * (1 - p), 1e-6)
        e, v = weight * e, weight * v
        g = np.array([(e * margin).mean() + PRIOR * (a - 1), e.mean() + PRIOR * b])
        h = np.array([[(v * margin ** 2).mean() + PRIOR, (v * margin).mean()], [(v * margin).mean(), v.mean() + PRIOR]])
        step = np.linalg.solve(h, g)
        part, now = 1.0, loss(a, b)
        while part > 1e-9 and loss(a - part * step[0], b - part * step[1]) >= now:
            part /= 2
        if part <= 1e-9:
            break
        a, b = a - part * step[0], b - part * step[1]
    return float(max(a, 1e-3)), float(b)


def fit(texts: list[str], y: np.ndarray, labelled: tuple[int, int] | None = None) -> Model:
    """Weights from all texts; their calibration from FOLDS-fold held-out margins.

    ``labelled`` are all bad and all good labels that the texts were taken from: each class counts in
    the calibration as by its share of these, so that a probability means the same however few of a
    class were taken.

    Without labels of both kinds the model is constant: probability 1 where no label is bad (or there
    is none), 0 where all are.
    """
    if len(y) < 2 * FOLDS or y.min() == y.max():
        sure = 30.0 if not len(y) or y.max() == 1 else -30.0
        return Model(np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << CHAR_BITS, np.float32), sure, 1.0, 0.0)
    index, value = _rows(texts)
    held = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        w, b = _descend([index[i] for i in train], [value[i] for i in train], y[train])
        held[test] = [float(value[i] @ w[index[i]]) + b for i in test]
    share = y.mean() if labelled is None else labelled[1] / sum(labelled)
    slope, shift = _platt(held, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    w, b = _descend(index, value, y)
    return Model(w[:1 << WORD_BITS].astype(np.float32), w[1 << WORD_BITS:].astype(np.float32), float(b), slope, shift)


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    texts, y, _, _ = labelled_sample(docs, labels, "quality", FIT_ROWS, FIT_CHARS)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("__y")).where("__y in (0, 1)")
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    return fit(texts, y, tuple(known.agg(F.count_if(F.expr("__y = 0")), F.count_if(F.expr("__y = 1"))).first()))


FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
          "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "probability": pa.float64(), "kept": pa.bool_()}
KIND = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, probability double, kept boolean")


def _start(config):
    model, threshold = config
    numbers = Numbers()

    def judge(text):
        data = (text or "").encode()
        ids, chars, symbols, dup, repeat = base_counts(data, numbers)
        n = len(ids)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        p = float(model.probability(model.margin(ids, data, numbers)))
        return n, chars, symbols, dup, repeat, failed, p, not failed and p >= threshold

    def work(texts):
        return list(zip(*map(judge, texts)))

    return work


def rated(docs: DataFrame, model: Model, threshold: float = THRESHOLD, into: str = "rated") -> DataFrame:
    """``docs`` plus a struct ``into`` of the statistics, the probability of good quality and ``kept``.

    NULL and empty texts have no words and fail the base rules. Texts of any length are read whole,
    in Arrow batches; repeated rows are rated alike.
    """
    config = docs.sparkSession.sparkContext.broadcast((model, threshold))
    return docs.withColumn(into, batch_column(F.col("text"), KIND, FIELDS, _start, config))
