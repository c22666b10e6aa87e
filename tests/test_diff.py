import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark.functions.normalize import Norm
from tallymark.operators.diff import keyed_diff, rows_with_repeated_keys
from tallymark.session import stored


def text(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names.split()))


def source(spark):
    return text(spark, [("1", "1,000", "Public"), ("2", "2000", "Private"), ("3", "3000", "Public")],
                "id amt flag")


AMOUNT = {"amt": Norm(kind="numeric")}


def test_formatting_and_case_do_not_matter(spark):
    target = text(spark, [("1", "1000", "public"), ("2", "2000", "private"), ("3", "3000", "PUBLIC")],
                  "id amt flag")
    got = keyed_diff(source(spark), target, ["id"], ["amt", "flag"], AMOUNT).summary().first()
    assert got.is_clean and got.matched_keys == 3 and got.value_mismatches == 0


def test_missing_extra_and_mismatch(spark):
    target = text(spark, [("1", "1000", "Private"), ("2", "2000", "Private"), ("4", "9999", "Public")],
                  "id amt flag")
    diff = keyed_diff(source(spark), target, ["id"], ["amt", "flag"], AMOUNT)
    got = diff.summary().first()
    assert (got.source_only, got.target_only, got.value_mismatches) == (1, 1, 1)
    assert [tuple(r) for r in diff.column_counts().collect()] == [("flag", 1)]
    assert [tuple(r) for r in diff.cells().collect()] == [("1", "flag", "public", "private")]
    assert [tuple(r) for r in diff.source_only().collect()] == [("3", "3000.0", "public")]
    assert [tuple(r) for r in diff.target_only().collect()] == [("4", "9999.0", "public")]
    assert {r.finding for r in diff.sample().collect()} == {"mismatch"}


def test_repeated_keys_are_reported_not_paired(spark):
    src = text(spark, [("1", "a"), ("1", "b"), ("2", "c")], "id v")
    tgt = text(spark, [("1", "a"), ("2", "c")], "id v")
    diff = keyed_diff(src, tgt, ["id"], ["v"])
    got = diff.summary().first()
    assert (got.source_dup_keys, got.matched_keys, got.target_only, got.is_clean) == (1, 1, 1, False)
    assert sorted(tuple(r) for r in diff.duplicates().collect()) == [
        ("source", "1", "a"), ("source", "1", "b")]


def test_missing_key_raises(spark):
    with pytest.raises(ValueError):
        keyed_diff(text(spark, [("1",)], "id"), text(spark, [("1",)], "other"), ["id"])
    with pytest.raises(ValueError):
        keyed_diff(source(spark), source(spark), [])


def test_column_choice(spark):
    other = text(spark, [("1", "x", "1")], "id Flag amt")
    diff = keyed_diff(source(spark), other, ["id"])
    assert diff.columns == ("amt",)  # names are matched exactly
    empty = keyed_diff(source(spark), other, ["id"], [])
    assert empty.columns == () and empty.cells().count() == 0
    assert empty.summary().first().matched_keys == 1


def test_keys_of_different_types_and_names(spark):
    src = text(spark, [("9007199254740993", "1"), ("07", "2")], "a.b v")
    tgt = spark.createDataFrame([(9007199254740993, 1), (9007199254740992, 1), (7, 2)],
                                "`a.b` bigint, v int")
    got = keyed_diff(src, tgt, ["a.b"]).summary().first()
    assert (got.matched_keys, got.values_matched, got.source_only, got.target_only) == (2, 2, 0, 1)


def test_empty_sides(spark):
    nothing = source(spark).where(F.lit(False))
    got = keyed_diff(nothing, nothing, ["id"]).summary().first()
    assert got.is_clean and got.source_total == 0
    assert keyed_diff(source(spark), nothing, ["id"]).summary().first().source_only == 3


def brute_force(src, tgt):
    counts = [Counter(r[0] for r in side) for side in (src, tgt)]
    single = [{r[0]: r[1:] for r in side if c[r[0]] == 1} for side, c in zip((src, tgt), counts)]
    both = single[0].keys() & single[1].keys()
    cells = sum(a != b for k in both for a, b in zip(single[0][k], single[1][k]))
    return (len(src), len(tgt), len(both), sum(single[0][k] == single[1][k] for k in both), cells,
            len(single[0].keys() - both), len(single[1].keys() - both),
            *[sum(n > 1 for n in c.values()) for c in counts])


@pytest.mark.parametrize("seed", range(4))
def test_counts_add_up_with_hot_and_null_keys(spark, seed):
    rng = random.Random(seed)

    def rows(n):
        # a third of all rows share one key, some keys are NULL
        return [(("hot" if rng.random() < .33 else rng.choice([None, *map(str, range(60))])),
                 rng.choice([None, 1.0, 2.0]), rng.choice([None, "x", "y"])) for _ in range(n)]
    src, tgt = rows(80), rows(70)
    frames = [spark.createDataFrame(r, "k string, a double, b string") for r in (src, tgt)]
    diff = keyed_diff(*frames, ["k"])
    got = diff.summary().first()
    assert tuple(got)[:9] == brute_force(src, tgt)
    repeated = sum(r["side"] == "source" for r in diff.duplicates().collect())
    assert got.matched_keys + got.source_only + repeated == got.source_total
    assert diff.findings().count() == got.value_mismatches + got.source_only + got.target_only
    assert rows_with_repeated_keys(frames[0], ["k"]).count() == repeated
    assert rows_with_repeated_keys(frames[0], ["k"], stored).count() == repeated


def test_findings_and_totals_in_one_pass(spark, tmp_path):
    tgt = text(spark, [("1", "7", "Private"), ("2", "2000", "x"), ("4", "3000", "y"), ("4", "1", "y")],
               "id amt flag")
    diff = keyed_diff(source(spark), tgt, ["id"], ["amt", "flag"], AMOUNT)
    once = diff.write_findings(str(tmp_path / "found"), ["amt"]).first().asDict()
    assert once == diff.totals(["amt"]).first().asDict()
    stored = spark.read.option("header", True).csv(str(tmp_path / "found"))
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(
        map(tuple, diff.findings().collect()), key=repr)


def test_subset_of_columns_from_the_same_totals(spark):
    tgt = text(spark, [("1", "7", "Private"), ("2", "2000", "x"), ("3", "3000", "Public")], "id amt flag")
    got = keyed_diff(source(spark), tgt, ["id"], ["amt", "flag"], AMOUNT).totals(["amt"]).first()
    assert (got.value_mismatches, got.mismatched_rows) == (3, 2)
    assert (got.subset_mismatches, got.subset_rows) == (1, 1)


def test_keys_are_never_cut(spark):
    """Moments of one day, and decimals beyond ten digits, are keys of their own."""
    from decimal import Decimal

    from tallymark.operators.diff import keyed_diff
    rows = spark.sql("select timestamp'2026-01-01 10:00:00' k, 1 v union all select timestamp'2026-01-01 11:00:00', 2")
    metrics = keyed_diff(rows, rows, ["k"]).summary().first()
    assert (metrics["matched_keys"], metrics["source_dup_keys"]) == (2, 0)
    exact = spark.createDataFrame([(Decimal("0.000000000011"), 1), (Decimal("0.000000000012"), 1)],
                                  "k decimal(20,12), v int")
    texts = exact.selectExpr("cast(k as string) k", "v")
    assert keyed_diff(texts, exact, ["k"]).summary().first()["matched_keys"] == 2


def test_fixed_width_values_need_no_sort(spark):
    one = spark.range(20).selectExpr("id", "cast(id as double) AS amount",
                                     "date_add(date '2024-01-01', cast(id as int)) AS day")
    two = one.selectExpr("id", "amount + if(id = 4, 1, 0) AS amount", "if(id = 5, null, day) AS day")
    diff = keyed_diff(one, two, ["id"])
    plan = diff.totals()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan
    assert sorted((r.id, r.column) for r in diff.cells().collect()) == [("4", "amount"), ("5", "day")]
    bare = keyed_diff(one, two, ["id"], [])
    assert "SortAggregate" not in bare.totals()._jdf.queryExecution().executedPlan().toString()
    assert bare.summary().first().matched_keys == 20
