"""A comparison laid out in buckets against the comparison itself."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators.diff import keyed_diff
from tallymark.operators.layout import dropped, laid_out
from tallymark.session import shared_folder


def results(diff):
    return {name: sorted(map(repr, frame.collect())) for name, frame in {
        "totals": diff.totals(), "findings": diff.findings(), "source": diff.source_only(), "target": diff.target_only(),
        "cells": diff.cells(), "columns": diff.column_counts(), "duplicates": diff.duplicates(), "sample": diff.sample()}.items()}


@pytest.mark.parametrize("text", [True, False])
def test_later_comparisons_shuffle_nothing_by_key(spark, text):
    value = F.concat(F.lit("v"), F.col("id") % 7) if text else F.col("id") % 7
    source = spark.range(4000).select(
        F.when(F.col("id") < 1300, -1).when(F.col("id") % 50 == 0, None).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 3).cast("int").alias("j"), value.alias("v"), F.col("id").alias("w"))
    target = source.where("w % 31 <> 0").withColumn("w", F.when(F.col("w") % 17 == 0, -1).otherwise(F.col("w"))) \
        .withColumn("j", F.col("j").cast("bigint"))
    diff = keyed_diff(source, target, ["k", "j"])
    folder = shared_folder(spark)
    laid = laid_out(diff, folder, 5, "tallymark_test_layout")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    for frame in (laid.pairs, laid.cells(), laid.findings(), laid.source_only()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = laid.totals()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange SinglePartition") == 1  # the row of counts of each task
    assert results(laid) == results(diff)
    files = [f for side in (laid.folded.source, laid.folded.target) for f in side.inputFiles()]
    assert len(files) <= 10
    # a key with a third of the rows is one row of its bucket
    assert laid.folded.source.agg(F.max("n")).first()[0] > 400 and laid.folded.source.count() < 2800
    dropped(diff, folder, "tallymark_test_layout")
    assert not spark.catalog.tableExists("tallymark_test_layout_source")


def test_buckets_follow_the_rows(spark, monkeypatch):
    """A bucket is the work of one task, so a larger table has more of them, the same on both sides."""
    monkeypatch.setattr("tallymark.operators.layout.BUCKET_ROWS", 100, raising=False)
    source = spark.range(4000).select((F.col("id") % 3900).alias("k"), F.col("id").alias("v"))
    diff = keyed_diff(source, source.where("v < 500"), ["k"])
    folder = shared_folder(spark)
    laid = laid_out(diff, folder, 5, "tallymark_test_rows")
    counts = [spark.sql(f"DESCRIBE EXTENDED tallymark_test_rows_{side}").where("col_name = 'Num Buckets'").first()["data_type"]
              for side in ("source", "target")]
    assert counts == ["40", "40"]
    assert max(r["n"] for r in laid.folded.source.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) < 200
    assert "Exchange" not in laid.pairs._jdf.queryExecution().executedPlan().toString()
    assert results(laid) == results(diff)
    dropped(diff, folder, "tallymark_test_rows")


def test_float_keys_keep_their_buckets(spark):
    rows = [(0.0, 1), (1.5, 2), (None, 3), (1e300, 4), (0.1, 5)]
    source = spark.createDataFrame(rows, "k double, v int")
    target = spark.createDataFrame([(-0.0, 1), *rows[1:]], "k double, v int")
    diff = keyed_diff(source, target, ["k"])
    laid = laid_out(diff, shared_folder(spark), 3)
    assert "Exchange" not in laid.pairs._jdf.queryExecution().executedPlan().toString()
    assert results(laid) == results(diff) and laid.summary().first()["is_clean"]


def test_layout_of_keys_only_and_of_empty_sides(spark):
    some, none = spark.range(10).withColumn("v", F.col("id")), spark.range(0).withColumn("v", F.col("id"))
    for source, target, columns in ((some, none, None), (none, none, None), (some, some, [])):
        diff = keyed_diff(source, target, ["id"], columns)
        assert results(laid_out(diff, shared_folder(spark), 3)) == results(diff)
