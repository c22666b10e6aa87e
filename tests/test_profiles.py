"""Counters kept per file against counters of the whole feed."""

import os
import shutil

from pyspark.sql import functions as F

from tallymark.session import shared_folder
from tallymark.sources.profiles import FileProfile, column_counters

COUNTED = {"nulls": ["a", "b"], "kinds": {"b": "numeric"}, "defaults": {"a": "x"}, "sums": ["c"]}


def rows(spark, lo, hi):
    return spark.range(lo, hi).select(
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, " n/a ").otherwise("y").alias("a"),
        F.when(F.col("id") % 5 == 0, "1.5").when(F.col("id") % 5 == 1, "abc").alias("b"),
        (F.col("id") * 0.25).alias("c"))


def test_only_new_files_are_read(spark, monkeypatch):
    feed, store = shared_folder(spark), shared_folder(spark)
    rows(spark, 0, 600).repartition(3).write.parquet(feed)
    counters = column_counters(rows(spark, 0, 1), **COUNTED)
    profile, seen = FileProfile(spark, feed, store, counters), []
    scan = FileProfile.scan
    monkeypatch.setattr(FileProfile, "scan", lambda self, new: (seen.append(len(new)), scan(self, new))[1])

    def whole(*ranges):
        frames = [rows(spark, *r) for r in ranges]
        df = frames[0]
        for other in frames[1:]:
            df = df.unionByName(other)
        return df.agg(*[c.alias(n) for n, c in counters.items()]).first()

    assert profile.totals().first() == whole((0, 600)) and seen == [3]
    assert profile.totals().first() == whole((0, 600)) and seen == [3]
    rows(spark, 600, 700).coalesce(1).write.mode("append").parquet(feed)
    assert profile.totals().first() == whole((0, 700)) and seen == [3, 1]
    # a file that is gone no longer counts, a rewritten one counts anew
    files = sorted(f for f in os.listdir(feed) if f.endswith(".parquet"))
    at = spark.read.parquet(f"{feed}/{files[0]}")
    lost = at.agg(F.count("*")).first()[0]
    other = shared_folder(spark)
    rows(spark, 5000, 5010).coalesce(1).write.parquet(other)
    new = next(f for f in os.listdir(other) if f.endswith(".parquet"))
    shutil.copy(f"{other}/{new}", f"{feed}/{files[0]}")
    crc = f"{feed}/.{files[0]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert profile.totals().first()["rows"] == 700 - lost + 10 and seen == [3, 1, 1]
    os.remove(f"{feed}/{files[0]}")
    assert profile.totals().first()["rows"] == 700 - lost and seen == [3, 1, 1]


def test_files_without_rows_are_not_new_again(spark):
    feed = shared_folder(spark)
    rows(spark, 0, 0).coalesce(1).write.parquet(feed)
    profile = FileProfile(spark, feed, shared_folder(spark), column_counters(rows(spark, 0, 1), **COUNTED))
    assert profile.totals().first()["rows"] == 0 and profile.refresh() == 0
