"""Comparisons pruned by digests against the whole comparison."""

import json
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions.normalize import Norm
from tallymark.operators.diff import keyed_diff
from tallymark.operators.digests import pruned
from tallymark.session import stored

KIND = "k long, j string, a string, b string, x double, d date"


def rows_of(n, rng):
    return [(i, f"j{i % 7}" if i % 11 else None, None if i % 5 == 0 else f"a{rng.integers(9)}",
             f"b{rng.integers(3)}", float(rng.integers(100)), None) for i in range(n)]


def everything(diff):
    frames = {"totals": diff.totals(), "findings": diff.findings(), "duplicates": diff.duplicates(), "sample": diff.sample()}
    return {name: sorted(map(repr, frame.collect())) for name, frame in frames.items()}


@pytest.mark.parametrize("unique", [False, True])
def test_results_are_those_of_the_whole_comparison(spark, unique):
    rng = np.random.default_rng(3)
    source = rows_of(3000, rng)
    target = list(source)
    target[10] = (*target[10][:4], 1e6, None)
    # values that change places with NULL, which a hash over values alone would not see
    source[20] = (*source[20][:2], None, "x", 1.0, None)
    target[20] = (*source[20][:2], "x", None, 1.0, None)
    del target[2000:2003]
    target.append((9999, "new", "a", "b", 0.0, None))
    if not unique:
        source += [source[50]] * 2 + [source[60]]
        target += [target[50]] * 2 + [(None, None, "n", "n", 0.0, None)]
        source += [(None, None, "n", "n", 0.0, None)]
    whole = keyed_diff(spark.createDataFrame(source, KIND), spark.createDataFrame(target, KIND), ["k", "j"])
    found = pruned(whole, stored, unique, coarse=64, leaf_rows=16)
    assert found.diff.settled > 2000 and found.rows == len(source) + len(target)
    assert found.rows_open == found.rows - 2 * found.diff.settled < 800
    assert everything(found.diff) == everything(whole)


def test_sides_of_other_types_meet_in_one_bucket(spark):
    source = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("$"), "id").alias("v"))
    target = spark.range(2000).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") != 5, F.col("id")).alias("v"))
    whole = keyed_diff(source, target, ["k"])
    found = pruned(whole, stored, coarse=32, leaf_rows=16)
    assert found.diff.settled > 1800 and everything(found.diff) == everything(whole)


def test_tolerances_and_infinite_values(spark):
    near = spark.range(2000).select("id", (F.col("id") * 1.0).alias("v"))
    far = near.select("id", F.when(F.col("id") == 3, 3.4).when(F.col("id") == 4, 5.5).otherwise(F.col("v")).alias("v"))
    endless = F.when(F.col("id") == 7, float("inf")).otherwise(F.col("v")).alias("v")
    whole = keyed_diff(near.select("id", endless), far.select("id", endless), ["id"], norms={"v": Norm(numeric_tolerance=0.5)})
    found = pruned(whole, stored, coarse=32, leaf_rows=16)
    assert found.diff.settled > 1800 and everything(found.diff) == everything(whole)


@pytest.mark.parametrize("columns", [None, []])
def test_equal_empty_and_wholly_different_sides(spark, columns):
    some, none = spark.createDataFrame(rows_of(500, np.random.default_rng(1)), KIND), spark.createDataFrame([], KIND)
    for source, target, settled in ((some, some, 500), (none, none, 0), (some, none, 0),
                                    (some, some.withColumn("k", F.col("k") + 1000), 0)):
        whole = keyed_diff(source, target, ["k", "j"], columns)
        found = pruned(whole, stored, coarse=8)
        assert found.diff.settled == settled and everything(found.diff) == everything(whole)


def test_a_hot_key_opens_its_leaf_only(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") < 10_000, -1).otherwise(F.col("id")).alias("k"),
                                     (F.col("id") % 3).alias("v"))
    found = pruned(keyed_diff(hot, hot, ["k"]), stored, coarse=64, leaf_rows=32)
    assert found.diff.settled > 19_500 and found.diff.summary().first()["source_dup_keys"] == 1


def test_changes_in_most_leaves_are_told_by_some_of_them(spark, monkeypatch):
    """Where the leaves of a few coarse buckets show that pruning would not pay, those of the others are not made."""
    from tallymark.operators import digests

    monkeypatch.setattr(digests, "PROBE", 4, raising=False)
    monkeypatch.setattr(digests, "PROBED", 3, raising=False)
    source = spark.range(6000).select("id", F.concat(F.lit("v"), F.col("id") % 9).alias("v"))
    for n, kept, settled in ((3, 1, 0), (120, 3, 4000)):  # changes in every leaf; in every coarse bucket, but few leaves
        target = source.withColumn("v", F.when(F.col("id") % n == 0, "new").otherwise(F.col("v")))
        whole, made = keyed_diff(source, target, ["id"]), []
        found = pruned(whole, lambda df: (made.append(1), stored(df))[1], coarse=16, leaf_rows=16)
        assert len(made) == kept and found.diff.settled >= settled and (settled or found.diff.settled == 0)
        assert found.rows == 12_000 and found.coarse_open >= 12 and everything(found.diff) == everything(whole)


SCRIPT = """
    import sys
    from pyspark.sql import functions as F
    from tallymark.operators.diff import keyed_diff
    from tallymark.operators.digests import pruned
    from tallymark.session import build_session, stored
    spark = build_session("bytes", "local[4]", shuffle_partitions=4)
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").withColumn("id", F.monotonically_increasing_id())
    lines = stored(lines)
    after = stored(lines.withColumn("l_quantity", F.when(F.col("id") % 1000 == 7, -1.0).otherwise(F.col("l_quantity"))))
    diff = keyed_diff(lines, after, ["l_orderkey", "l_linenumber", "id"])
    spark.sparkContext.setJobGroup(sys.argv[1], "")
    diff = diff if sys.argv[1] == "whole" else pruned(diff, stored, sys.argv[1] == "unique").diff
    print("CELLS", diff.cells().count())
    spark.stop()
"""


def shuffled(folder, how):
    folder.mkdir()
    conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}", "spark.eventLog.compress": "false",
            "spark.eventLog.rolling.enabled": "false", "spark.ui.enabled": "false"}
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": " ".join([f"--conf {k}={v}" for k, v in conf.items()] + ["pyspark-shell"])}
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(SCRIPT), how], capture_output=True, text=True,
                         timeout=300, env=env, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "CELLS" in run.stdout, run.stderr[-2000:]
    total, ours = 0, set()
    for log in folder.iterdir():
        for line in log.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart" and event["Properties"].get("spark.jobGroup.id") == how:
                ours.update(event["Stage IDs"])
            if event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in ours:
                total += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    return run.stdout.split()[-1], total


def test_few_changes_shuffle_under_a_tenth(tmp_path):
    """A changed cell in every thousandth of 600,000 rows a side."""
    cells, whole = shuffled(tmp_path / "whole", "whole")
    print("whole", whole)
    for how in ("unique", "any"):
        same_cells, bytes_pruned = shuffled(tmp_path / how, how)
        print(how, bytes_pruned)
        assert same_cells == cells and bytes_pruned < whole / 10


def test_a_mapping_asks_for_pruning(spark):
    from dataclasses import replace

    from catalog.q_suite import suite

    plain = suite(spark, "/root/testdata/sf0.001")
    asked = replace(plain, mapping=plain.mapping.with_options({"orders_dim": {"prune": True}}))
    wanted = ["reconciliation", "transformation"]
    rows = [sorted(map(repr, x.run(wanted, ["orders_dim"]).drop("evidence", "duration", "run_at").collect()))
            for x in (plain, asked)]
    assert rows[0] == rows[1] and len(rows[0]) == 3
