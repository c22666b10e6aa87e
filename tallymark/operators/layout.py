"""Both sides of a keyed comparison laid out once, so that comparing them again needs no shuffle.

Each side is folded to one row per key (its number of rows and, where that is one, its values) and written as a
table bucketed and sorted by key. Copies of a key fold on the map side, so a key with a third of all rows is a row
per task before the write and a single row in its bucket. Both tables have the same buckets, and every later result
of the comparison joins them bucket by bucket. Keys are stored so that they are never NULL and equal where they
group together; which parts of a key are NULL is a column beside them.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.diff import Folded, KeyedDiff
from tallymark.session import discard

_PARTITIONS, _MOST = "spark.sql.shuffle.partitions", "spark.sql.sources.bucketing.maxBuckets"
#: Rows of a side that a bucket holds at most on average: one task sorts a bucket of both sides when they meet.
BUCKET_ROWS = 500_000


def _stored(c: Column, kind: T.DataType) -> Column:
    """A part of a key as it is stored: floats as text, in which zero has one sign; never NULL."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce((c + F.lit(0.0)).cast("string"), F.lit(""))
    blank = (F.lit(0) if isinstance(kind, T.NumericType) else F.lit(False) if isinstance(kind, T.BooleanType)
             else F.lit("") if isinstance(kind, T.StringType) else F.lit("1970-01-01"))
    return F.coalesce(c, blank.cast(kind))


def _fold(side: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key; values are only meant where ``n`` is one, and any aggregate gives a single one back."""
    return side.groupBy(*keys, "nulls").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in values])


def laid_out(diff: KeyedDiff, folder: str, buckets: int, name: str | None = None) -> KeyedDiff:
    """The same comparison over two tables ``<name>_source`` and ``<name>_target`` below ``folder``.

    Counts, cells, one-sided rows, findings and samples read these tables and shuffle nothing by key. Rows with a
    repeated key are still listed from the rows themselves. There are ``buckets`` of them at least, and more where the
    larger side has over BUCKET_ROWS rows for each, so the memory of a task does not grow with the table. A bucket
    holds about keys / buckets rows, whatever the number of copies. :func:`dropped` deletes the tables.
    """
    spark = diff.source.sparkSession
    name = name or f"tallymark_{uuid.uuid4().hex}"
    keys = [f"k{i}" for i in range(len(diff.keys))]
    values = [f"c{i}" for i in range(len(diff.columns))]
    both = diff.source.unionByName(diff.target)
    kinds = {f.name: f.dataType for f in both.schema}  # the types in which the sides meet
    nulls = F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])
    rows = max(side.count() for side in (diff.source, diff.target))
    buckets = max(buckets, min(-(-rows // BUCKET_ROWS), int(spark.conf.get(_MOST))))
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(buckets))  # the fold's own shuffle then deals rows to buckets
    try:
        for side, df in (("source", diff.source), ("target", diff.target)):
            typed = df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in keys + values]).select(
                *[_stored(F.col(k), kinds[k]).alias(k) for k in keys], nulls.alias("nulls"), *values)
            (_fold(typed, keys, values).write.format("parquet").mode("overwrite").bucketBy(buckets, *keys, "nulls")
             .sortBy(*keys, "nulls").option("path", f"{folder}/{name}_{side}").saveAsTable(f"{name}_{side}"))
    finally:
        spark.conf.set(_PARTITIONS, before)
    shown = {k: F.when(F.substring("nulls", i + 1, 1) == "0", F.col(k).cast(kinds[k])) for i, k in enumerate(keys)}
    return replace(diff, folded=Folded(spark.table(f"{name}_source"), spark.table(f"{name}_target"), shown))


def dropped(diff: KeyedDiff, folder: str, name: str) -> None:
    """Deletes the tables of a layout and their files."""
    spark = diff.source.sparkSession
    for side in ("source", "target"):
        spark.sql(f"DROP TABLE IF EXISTS `{name}_{side}`")
        discard(spark, f"{folder}/{name}_{side}")
