"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import shared_folder, stored

__all__ = ["batch_column", "fold_of", "labelled_sample", "on_path", "shared_folder", "sized", "slices",
           "stored", "words"]

#: What a task holds as Python objects at once, in rows and in characters.
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000
#: Rows of narrow (id or short string) tables up to which they are sent to every executor.
BROADCAST_ROWS = 500_000


def on_path(spark) -> None:
    """Lets Python workers import this package from where the driver has it, as well as by their own path."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def words(text: str | None) -> list[bytes]:
    """The runs of anything but ASCII white space, A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode().lower().split()


def slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The values in slices that stay within SLICE_ROWS and, but for a single text, SLICE_CHARS."""
    held, chars = [], 0
    for value in texts:
        text = value.as_py()
        if held and (len(held) == SLICE_ROWS or chars + len(text or "") > SLICE_CHARS):
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text or "")
    if held:
        yield held


def batch_column(source: Column, kind: str, fields: dict[str, pa.DataType],
                 start: Callable, payload) -> Column:
    """A struct column of what ``start(payload)`` makes of slices of texts.

    ``start`` runs once a task on the broadcast payload and returns a function from a list of
    texts to one sequence per field. The column is marked nondeterministic so that no filter on
    it makes the optimizer run it a second time.
    """

    @F.arrow_udf(kind)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start(payload.value if payload is not None else None)
        for batch in batches:
            parts = [work(held) for held in slices(batch)]
            yield pa.StructArray.from_arrays(
                [pa.concat_arrays([pa.array(part[i], type=t) for part in parts])
                 if parts else pa.array([], type=t) for i, t in enumerate(fields.values())],
                names=list(fields))

    return column.asNondeterministic()(source)


def sized(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow table, broadcast if it has no more rows than that."""
    return F.broadcast(narrow) if narrow.count() <= rows else narrow


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the folds; NULL for a NULL key."""
    return F.crc32(F.col(key).cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int,
                    max_chars: int) -> tuple[list[str], np.ndarray, np.ndarray, list[str | None]]:
    """Texts, 0/1 labels, crc32 draws and languages of a bounded sample, for fitting only.

    Of each class the ``per_class`` labels of smallest id hash are taken; texts over ``max_chars``
    characters are left out, so at most 2 * per_class * max_chars characters reach the driver.
    Labels that are NULL or neither 0 nor 1 are not used.
    """
    known = (labels.select("doc_id", F.col(target).cast("int").alias("__y"))
             .where("doc_id is not null and __y in (0, 1)"))
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = (known.where("__y = 1").orderBy(order, "doc_id").limit(per_class)
              .unionByName(known.where("__y = 0").orderBy(order, "doc_id").limit(per_class)))
    rows = (docs.select("doc_id", "text", "lang")
            .where(F.length("text").between(1, max_chars))
            .join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
            .select("doc_id", "text", "lang", "__y",
                    F.crc32(F.col("doc_id").cast("string")).alias("__draw"))
            .toPandas().sort_values(["doc_id", "text"]).drop_duplicates("doc_id"))
    return (rows["text"].tolist(), rows["__y"].to_numpy(np.float64),
            rows["__draw"].to_numpy(np.int64), [x if isinstance(x, str) else None for x in rows["lang"]])
