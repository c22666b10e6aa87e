"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Byte vectors, filters of two to four bytes, max pooling over a fixed window and a softmax. A text is
cut into windows without gaps, windows are scored in batches, and a text's probabilities are the mean
of its windows', weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import batch_column, fold_of, stored

#: Texts of a language that are learnt from, and of all languages: with many, each gets an equal part.
LANGUAGE_ROWS, FIT_ROWS = 400, 20_000
#: Windows of a text that are learnt from, and characters that such a text may have.
FIT_WINDOWS, FIT_CHARS = 3, 20_000
WINDOW, SIZE, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.05, 1e-4
#: Windows that are scored at once.
AT_ONCE = 64
UNKNOWN = "und"
_BLANK = 32
_OFFSETS = [(w, k) for w in WIDTHS for k in range(w)]
_STEPS = WINDOW - max(WIDTHS) + 1


@dataclass
class Model:
    """Filter responses by byte and offset (embedding times filter), biases, and the softmax layer."""

    responses: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    out_bias: np.ndarray
    languages: list[str]


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last filled with blanks, and the bytes of the text in each.

    Neighbours share max(WIDTHS) - 1 bytes, so every n-gram of the text lies in some window.
    """
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // _STEPS))
    flat = np.full((n - 1) * _STEPS + WINDOW, _BLANK, np.uint8)
    flat[:len(data)] = np.frombuffer(data, np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::_STEPS]
    return cut, np.clip(len(data) - np.arange(n) * _STEPS, 1, _STEPS)


def _tree_max(x: np.ndarray) -> np.ndarray:
    """Maximum over axis 1, by halves."""
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        top = np.maximum(x[:, :half], x[:, half:2 * half])
        if x.shape[1] % 2:
            np.maximum(top[:, 0], x[:, -1], out=top[:, 0])
        x = top
    return x[:, 0]


class Scorer:
    """Probabilities of batches of windows; responses to byte pairs are tabulated once."""

    def __init__(self, model: Model):
        self.model = model
        one = {o: model.responses[:, i * FILTERS:(i + 1) * FILTERS] for i, o in enumerate(_OFFSETS)}
        pair = lambda w, k: (one[w, k][None, :, :] + one[w, k + 1][:, None, :]).reshape(65536, FILTERS)
        # little-endian pairs: the later byte is the high one
        self.first = np.ascontiguousarray(np.hstack([pair(2, 0), pair(3, 0), pair(4, 0)]), np.float32)
        self.last = np.ascontiguousarray(pair(4, 2), np.float32)
        self.third = np.ascontiguousarray(one[3, 2], np.float32)

    def probabilities(self, cut: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(cut), AT_ONCE):
            part = np.ascontiguousarray(cut[lo:lo + AT_ONCE])
            pairs = part[:, :-1].astype(np.uint16) | part[:, 1:].astype(np.uint16) << np.uint16(8)
            found = self.first.take(pairs[:, :_STEPS], 0)
            found[:, :, FILTERS:2 * FILTERS] += self.third.take(part[:, 2:2 + _STEPS], 0)
            found[:, :, 2 * FILTERS:] += self.last.take(pairs[:, 2:2 + _STEPS], 0)
            pooled = np.maximum(_tree_max(found) + self.model.bias, 0)
            out.append(_softmax(pooled @ self.model.weights + self.model.out_bias))
        return np.concatenate(out)

    def many(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parts = [windows((t or "").encode()) for t in texts]
        counts = [len(c) for c, _ in parts]
        shares = np.concatenate([s for _, s in parts]).astype(np.float64)
        chances = np.concatenate([self.probabilities(c) for c in _batched(parts)]) if parts else np.zeros((0, 1))
        edges = np.cumsum([0, *counts[:-1]])
        mean = (np.add.reduceat(chances * shares[:, None], edges, axis=0)
                / np.add.reduceat(shares, edges)[:, None])
        top = mean.argmax(1)
        return [self.model.languages[k] for k in top], mean[np.arange(len(top)), top].tolist()


def _batched(parts):
    """Windows of consecutive texts, joined until they fill a batch."""
    held, n = [], 0
    for cut, _ in parts:
        held.append(cut)
        n += len(cut)
        if n >= AT_ONCE:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], languages: list[str], seed: int = 3) -> Model:
    """Train on windows spread over each text, languages weighted alike.

    With one known language, or none (then ``und``), the model always answers that one.
    """
    names = sorted(set(languages)) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    pooled = len(WIDTHS) * FILTERS
    embed = rng.normal(0, 0.5, (256, SIZE))
    filters = [rng.normal(0, 0.3, (SIZE, FILTERS)) for _ in _OFFSETS]
    bias, out, out_bias = np.zeros(pooled), rng.normal(0, 0.2, (pooled, len(names))), np.zeros(len(names))
    cuts, y = [], []
    for text, name in zip(texts, languages):
        cut, _ = windows(text.encode())
        picked = np.unique(np.linspace(0, len(cut) - 1, FIT_WINDOWS).astype(int))
        cuts.append(cut[picked])
        y += [names.index(name)] * len(picked)
    if len(names) > 1:
        x, y = np.concatenate(cuts), np.array(y)
        weight = len(y) / len(names) / np.bincount(y, minlength=len(names))
        values = [embed, *filters, bias, out, out_bias]
        first, second, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                picked = order[lo:lo + BATCH]
                slopes = _slopes(x[picked], y[picked], weight[y[picked]], values)
                t += 1
                for v, g, m, s in zip(values, slopes, first, second):
                    m *= 0.9
                    m += 0.1 * g
                    s *= 0.99
                    s += 0.01 * g * g
                    v -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6) * min(1.0, 60 / t + 0.1)
    responses = np.hstack([embed @ f for f in filters]).astype(np.float32)
    return Model(responses, bias.astype(np.float32), out.astype(np.float32), out_bias.astype(np.float32), names)


def _slopes(x, y, weight, values):
    """Gradients of the weighted cross entropy of a batch, through the maxima."""
    embed, bias, out, out_bias = values[0], values[-3], values[-2], values[-1]
    filters = values[1:-3]
    tables = [(embed @ f).astype(np.float32) for f in filters]
    n, pooled, where, at = len(x), [], [], 0
    for width in WIDTHS:
        total = tables[at].take(x[:, :_STEPS], 0)
        for k in range(1, width):
            total += tables[at + k].take(x[:, k:k + _STEPS], 0)
        top = total.argmax(1)
        pooled.append(np.take_along_axis(total, top[:, None], 1)[:, 0])
        where.append(top)
        at += width
    pooled = np.hstack(pooled) + bias
    active = np.maximum(pooled, 0)
    chances = _softmax(active @ out + out_bias)
    chances[np.arange(n), y] -= 1
    error = chances * (weight / n)[:, None]
    back = (error @ out.T) * (pooled > 0)
    g_embed, g_filters, at = np.zeros_like(embed), [], 0
    for i, width in enumerate(WIDTHS):
        mine = back[:, i * FILTERS:(i + 1) * FILTERS]
        for k in range(width):
            byte = x[np.arange(n)[:, None], where[i] + k]
            g_filters.append(np.einsum("bf,bfd->df", mine, embed[byte]) + DECAY * filters[at])
            np.add.at(g_embed, byte, mine[:, :, None] * filters[at].T[None])
            at += 1
    return [g_embed + DECAY * embed, *g_filters, back.sum(0), active.T @ error + DECAY * out, error.sum(0)]


def fit_model(docs: DataFrame) -> Model:
    """Fit on a bounded sample of rows with a language and crc32(doc_id as text) mod 3 not 1.

    Of each language the LANGUAGE_ROWS texts of smallest id hash are taken (fewer if there are so many languages
    that they would be more than FIT_ROWS in all), so a language is learnt however rare it is.
    """
    known = (docs.select("doc_id", "text", "lang")
             .where((fold_of("doc_id", 3) != 1) & F.col("lang").isNotNull()
                    & F.length("text").between(1, FIT_CHARS) & F.col("text").rlike(r"\p{L}")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id")
    ids = stored(known.select("doc_id", "lang").withColumn("__at", F.row_number().over(order))
                 .where(F.col("__at") <= LANGUAGE_ROWS))
    each = max(1, FIT_ROWS // max(1, ids.agg(F.countDistinct("lang")).first()[0]))
    chosen = (ids.where(F.col("__at") <= each).select("doc_id").distinct()
              .orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(FIT_ROWS))
    rows = (known.join(F.broadcast(chosen), "doc_id")  # at most FIT_ROWS rows
            .toPandas().sort_values(["doc_id", "text", "lang"]).drop_duplicates("doc_id"))
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def _start(model):
    scorer = Scorer(model)
    return lambda texts: scorer.many(texts)


def identified(docs: DataFrame, model: Model, into: str = "identified") -> DataFrame:
    """``docs`` plus a struct ``into``: lang_pred and score (the mean window probability).

    A NULL text, and one without a letter, is ``und`` with score 0. Every byte of a text lies in a
    window. Equal texts have equal answers; lang, source and ids are no inputs. A column that is called like
    ``into`` gives way to it.
    """
    payload = docs.sparkSession.sparkContext.broadcast(model)
    found = docs.withColumn(into, batch_column(
        F.col("text"), "lang_pred string, score double", {"lang_pred": pa.string(), "score": pa.float64()},
        _start, payload))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    lang, score = F.col(f"`{into}`.lang_pred"), F.col(f"`{into}`.score")
    return found.withColumn(into, F.struct(
        F.when(letters, lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(letters, score).otherwise(0.0).alias("score")))
