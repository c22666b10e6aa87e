import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import checks, rules
from tallymark.operators.rules import Rule
from tallymark.session import stored


def test_foreign_keys_match_brute_force(spark):
    rng = random.Random(5)
    values = [None, "", " 1 ", "1", "1.0", "A", "a", *map(str, range(8))]
    child = [("hot" if rng.random() < .33 else rng.choice(values), rng.choice(["x", " x", None]))
             for _ in range(120)]
    parent = [(v, "x") for v in ["1", "A", "2", "2", "3", None]]
    c = spark.createDataFrame(child, "a string, b string")
    p = spark.createDataFrame(parent, "k string, l string")
    known = {(k or "").strip() + "|" + v for k, v in parent if k is not None}
    filled = [r for r in child if (r[0] or "").strip() and r[1]]
    orphans = [r for r in filled if f"{r[0].strip()}|{r[1].strip()}" not in known]
    got = checks.fk_summary(c, p, ["a", "b"], ["k", "l"]).first()
    assert (got.child_rows, got.parent_rows, got.orphans, got.null_child_keys, got.status) == (
        120, 6, len(orphans), 120 - len(filled), "FAIL")
    found = checks.fk_orphans(c, p, ["a", "b"], ["k", "l"]).collect()
    assert sorted(map(tuple, found)) == sorted(orphans)
    settled = checks.fk_orphans(c, p, ["a", "b"], ["k", "l"], keep=stored).collect()
    assert sorted(map(tuple, settled)) == sorted(orphans)
    with pytest.raises(ValueError):
        checks.fk_summary(c, p, ["a"], ["k", "l"])


def test_integer_and_text_keys(spark):
    c = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    whole = spark.createDataFrame([(1,)], "k bigint")
    text = spark.createDataFrame([(" 1",), ("2.0",)], "k string")
    for parent in (whole, text):
        got = checks.fk_summary(c, parent, ["a"], ["k"]).first()
        assert (got.orphans, got.null_child_keys) == (1, 1)
        assert [r.a for r in checks.fk_orphans(c, parent, ["a"], ["k"]).collect()] == [2]


def test_variance_bases(spark):
    one = lambda v: spark.createDataFrame(v, "a string")
    def variance(s, t):
        r = checks.aggregate_variance(one(s), one(t), ["a"]).first()
        return round(r.rel_variance, 6), r.status
    assert variance([("1,000",), ("x",)], [("$1000",)]) == (0.0, "PASS")
    assert variance([("0",)], [("5",)]) == (1.0, "FAIL")
    assert variance([("",)], [(None,)]) == (0.0, "PASS")
    assert variance([("100",)], [("101",)]) == (0.01, "FAIL")


def test_presence_and_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("", 3)], "v string, n int")
    got = {r.value: (r.present, r.status) for r in
           checks.value_presence(df, "v", ["a", "b"], ["", "A"]).collect()}
    assert got == {"a": (True, "PASS"), "b": (False, "FAIL"), "": (True, "FAIL"), "A": (False, "PASS")}
    sides = checks.group_counts(df, df.where("n < 3"), ["v"]).orderBy("v").collect()
    assert [tuple(r) for r in sides] == [(None, 1, 1, 0), ("", 1, 0, -1), ("a", 2, 2, 0)]
    with pytest.raises(ValueError):
        checks.group_counts(df, df.drop("v"), ["v"])
    summary = checks.dedup_summary(df, ["v"]).first()
    assert (summary.rows, summary.duplicate_keys, summary.duplicate_rows) == (4, 1, 2)


def test_zero_and_null_over_several_columns(spark):
    src = spark.createDataFrame([("1", None, "0"), ("2", "", "x"), (" 3", "5", "n/a"), ("3", "0", "")],
                                "id string, a string, b string")
    tgt = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 0.0), (3, None, 0.0)],
                                "id int, a double, b double")
    got = {r.column: (r.target_zeros, r.target_nulls, r.null_source_zero_target) for r in
           checks.zero_vs_null(src, tgt, ["id"], ["a", "b", "gone"]).collect()}
    assert got == {"a": (3, 1, 2), "b": (3, 0, 2)}
    rows = checks.zero_vs_null_rows(src, tgt, ["id"], ["a", "b"]).collect()
    assert sorted((int(r.id), r.column) for r in rows) == [(1, "a"), (2, "a"), (3, "b"), (3, "b")]
    alone = checks.zero_vs_null(None, tgt, ["id"], ["a"]).first()
    assert (alone.target_zeros, alone.status) == (3, "WARN")


def test_snapshot_verdicts(spark):
    old = spark.createDataFrame([(1, 2020, "a"), (2, 2020, "b"), (3, 2021, "c")], "k int, y int, v string")
    new = spark.createDataFrame([(1, 2020, "a"), (3, 2021, "z"), (4, 2020, "n")], "k int, y int, v string")
    totals = checks.immutability(old, new, ["k"], ["v"], "y", 2021).totals()
    got = totals.withColumn("s", checks.immutability_verdict()).first()
    assert (got.source_only, got.value_mismatches, got.target_only, got.s) == (1, 0, 1, "FAIL")
    delta = checks.incremental(old, new, ["k"], ["v"], ["v"]).totals()
    assert delta.select(checks.incremental_verdict(True)).first()[0] == "PASS"
    assert delta.select(checks.incremental_verdict(False)).first()[0] == "FAIL"


def test_rules_on_nulls_and_bounds(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a"), (None, "b"), ("x", "b"), ("1,0", None)],
                               "n string, g string")
    def bad(kind, scope=None, **params):
        return sorted(str(r.n) for r in rules.offenders(Rule("r", kind, params, scope), df).select("n").collect())
    assert bad("range", column="n", min=1, max=1) == ["1,0", "2", "None", "x"]
    assert bad("range", column="n") == []
    assert bad("allowed_values", column="n", allowed_values=[1, " X"]) == ["1,0", "2", "None"]
    assert bad("not_allowed", column="n", allowed_values=["X", "none"]) == ["x"]
    assert bad("value_equals", "g = 'a'", column="n", expected="1.0") == ["2"]
    assert bad("flag_override", column="n", when="g == 'b'", value="X") == ["None"]
    assert bad("valid_expr", valid_expr="n > '1'") == ["1", "None"]
    groups = lambda kind, **p: sorted(
        (str(r.g), r[1]) for r in rules.offenders(Rule("r", kind, p), df).collect())
    assert groups("split", group_by="g", type_column="n") == [("None", 1), ("b", 1)]
    assert groups("split", group_by=["g"], min_count=2) == [("None", 1)]
    assert groups("combine", group_by="g", expect_count=2) == [("None", 1)]
    total = rules.group_rule_totals(Rule("r", "unique", {"column": "g"}), df).first()
    assert (total.groups, total.bad_groups, total.violations, total.checked_rows) == (3, 2, 4, 5)
    with pytest.raises(ValueError):
        rules.group_rule(Rule("r", "combine", {}), df)


def test_type_samples_keep_the_first_per_column(spark):
    df = spark.range(40).select(F.concat(F.lit("bad"), F.col("id")).alias("a"), F.lit("1").alias("b"))
    got = checks.type_samples(df, {"a": "numeric", "b": "numeric"}).collect()
    assert [r.value for r in sorted(got, key=lambda r: r.place)] == ["bad0", "bad1", "bad10", "bad11", "bad12"]


def test_long_value_lists_stay_one_small_plan(spark):
    df = spark.range(6000).selectExpr("cast(id as string) v")
    expected = [str(i) for i in range(3000, 8000)]
    got = checks.value_presence(df, "v", expected, ["5", "x", "5"])
    assert len(got._jdf.queryExecution().analyzed().output().mkString()) < 200
    totals = got.groupBy("role", "present").count().collect()
    assert {(r.role, r.present): r["count"] for r in totals} == {
        ("expected", True): 3000, ("expected", False): 2000, ("forbidden", True): 2, ("forbidden", False): 1}
    assert got.first().distinct_present == 6000
    nothing = checks.value_presence(df.where("false"), "v", ["1"], ["2"]).collect()
    assert {(r.value, r.status, r.distinct_present) for r in nothing} == {("1", "FAIL", 0), ("2", "PASS", 0)}


@pytest.mark.parametrize("kinds, values, limit", [
    (("string", "int"), ["9", "10", "x", None], 10),
    (("string", "string"), ["9", "10", "100", None], 10),
    (("string", "date"), ["2025-12-31", "2026-01-01", "soon", None], "2026-01-01"),
    (("timestamp", "string"), ["2025-12-31 23:59:59", "2026-01-01 00:00:00", "2026-01-02", None], "2026-01-01"),
])
def test_one_typed_period_for_both_sides(spark, kinds, values, limit):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, p string")
    sides = [rows.selectExpr("k", f"try_cast(p as {kind}) p") for kind in kinds]
    for df in checks.before(sides, "p", limit):
        assert [r.k for r in df.collect()] == [0]
    with pytest.raises(ValueError):
        checks.before([rows, rows.drop("p")], "p", limit)
