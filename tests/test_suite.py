import re

import copy

import demo
import pytest
from pyspark.sql import functions as F

from tallymark.operators import history
from tallymark.plans.suite import CATEGORIES, Suite, suite_from_config
from tallymark.sources import sinks
from tallymark.sources.connections import frames_connection
from tallymark.spec import (RunOptions, as_list, mapping_from_dict, tab_from_dict,
                            tabs_from_report)


def by_name(checks):
    return {r.name: r for r in checks.collect()}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    checks = demo.suite(spark, name="demo").run(history=f"{folder}/history",
                                                evidence=f"{folder}/evidence", run_id="run_1")
    return by_name(checks), folder


GOLDEN = {
    "Row count [DEAL]": "PASS", "Row count [FUND]": "PASS",
    "Row count by ['FUND_CODE'] [DEAL]": "PASS", "Schema [DEAL]": "WARN", "Schema [FUND]": "PASS",
    "Reconciliation [DEAL]": "FAIL", "Reconciliation [FUND]": "PASS",
    "Aggregate variance [DEAL]": "PASS", "[BR001] value_equals": "FAIL",
    "[BR002] conditional": "FAIL", "[BR003] must_not_exist": "FAIL", "[BR004] unique": "PASS",
    "Zero-vs-null [DEAL]": "FAIL", "Deduplication [DEAL]": "PASS",
    "Completeness of PERIOD [DEAL]": "PASS", "Mandatory completeness [DEAL]": "PASS",
    "FK DEAL.['FUND_CODE'] -> FUND.['FUND_CODE']": "PASS", "Lineage [DEAL]": "PASS",
    "Lineage [FUND]": "SKIPPED", "Transformation [DEAL]": "SKIPPED",
    "Default/null handling [DEAL]": "SKIPPED", "Data types [DEAL]": "PASS",
}


def test_golden_statuses(run):
    checks, _ = run
    assert {n: checks[n].status for n in GOLDEN} == GOLDEN
    assert "ERROR" not in {r.status for r in checks.values()}
    diff = checks["Reconciliation [DEAL]"].metrics
    assert diff["value_mismatches"] == "3"
    assert {k for k in diff if k.startswith("mismatches:")} == {
        "mismatches:ADJ_CODE", "mismatches:PUBLIC_PRIVATE_FLAG", "mismatches:FMV"}
    assert checks["[BR001] value_equals"].metrics == {"checked_rows": "2", "violations": "1"}
    assert checks["Zero-vs-null [DEAL]"].metrics["null_source_zero_target"] == "1"
    assert checks["Row count by ['FUND_CODE'] [DEAL]"].metrics["groups"] == "3"


def test_history_and_evidence_are_written(spark, run):
    checks, folder = run
    stored = sinks.read_checks(spark, f"{folder}/history/checks")
    record = sinks.read_runs(spark, f"{folder}/history/runs").first()
    assert record.run_id == "run_1" and len(record.categories) == 16
    assert stored.count() == len(checks) + 1  # both report categories skip under one name
    listed = {r.check_name: r.rows for r in
              sinks.read_listing(spark, f"{folder}/history/evidence").collect()}
    assert listed["Reconciliation [DEAL]"] == 3 and listed["[BR002] conditional"] == 1
    assert len(listed) == 5  # the schema warning has no rows of its own
    verdict = history.run_verdicts(stored).first()
    assert (verdict.exit_code, verdict.passed, verdict.suite) == (1, False, "demo")
    found = spark.read.option("header", True).csv(
        f"{folder}/evidence/run_1/check_name=Reconciliation_DEAL_????????????").orderBy("DEAL_ID").collect()
    assert [(r.DEAL_ID, r.column, r.source_value, r.target_value) for r in found] == [
        ("D001D", "ADJ_CODE", "27", "1"), ("D002", "PUBLIC_PRIVATE_FLAG", "Private", "Public"),
        ("D003", "FMV", "(null)", "0.0")]


def test_one_bad_check_costs_only_itself(spark):
    mapping = copy.deepcopy(demo.MAPPING)
    rule = lambda i, kind, **p: {"rule_id": i, "target_table": "DEAL", "rule_type": kind, **p}
    mapping["business_rules"] = [
        rule("OK", "not_null", params={"column": "DEAL_ID"}),
        rule("FILTER", "not_null", params={"column": "DEAL_ID"}, filter="no_such = 1"),
        rule("COLUMN", "not_null", params={"column": "no_such"}),
        rule("TYPE", "no_such_type"), rule("PARAM", "range", params={}),
        # fails on the data, not in planning: the cast throws under ANSI rules
        rule("RUNTIME", "valid_expr", params={"valid_expr": "cast(COMPANY as int) > 0"})]
    got = by_name(demo.suite(spark, mapping).run(["business_rules", "nonsense", "row_count"]))
    statuses = {r.rule_id: r.status for r in got.values() if r.rule_id}
    assert statuses == {"OK": "PASS", "FILTER": "ERROR", "COLUMN": "ERROR", "TYPE": "ERROR",
                        "PARAM": "ERROR", "RUNTIME": "ERROR"}
    assert got["Unknown category nonsense"].status == "ERROR"
    assert got["Row count [DEAL]"].status == "PASS"


def test_unreadable_and_unselected_tables(spark):
    mapping = mapping_from_dict({"tables": [{"target_table": "GONE", "key_columns": "a"},
                                            {"target_table": "FUND", "active": False}]})
    suite = Suite(spark, mapping, frames_connection(demo.frames(spark)[1]))
    assert by_name(suite.run(["row_count"]))["Row count [GONE]"].status == "ERROR"
    assert by_name(suite.run(["row_count"], ["nobody"]))["No tables selected"].status == "ERROR"
    named = by_name(suite.run(["row_count", "reconciliation", "null_handling"], ["FUND"]))
    assert named["Row count [FUND]"].message == "Target has 3 rows (no source to compare)."
    assert named["Reconciliation [FUND]"].status == "SKIPPED"


def test_snapshots_and_second_source(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, period string, amount double, note string")
    base = make([("1", "2026Q1", 1.0, "a"), ("2", "2026Q1", 2.0, "b"), ("3", "2026Q2", 3.0, "c")])
    now = make([("1", "2026Q1", 1.0, "z"), ("3", "2026Q2", 9.0, "c"), ("4", "2026Q1", 4.0, "d")])
    columns = [{"target_column": c, "source_column": c} for c in ("id", "period", "amount", "note")]
    mapping = mapping_from_dict({"tables": [{
        "target_table": "T", "source_object": "S", "key_columns": ["id"], "columns": columns,
        "options": {
            "historical": {"baseline": "old", "period_column": "period", "current_period": "2026Q2",
                           "expected_periods": ["2026Q1", "2026Q3"]},
            "incremental": {"baseline": "old", "updatable_columns": ["note", "amount"],
                            "allow_deletes": True},
            "cross_source": {"second_source": "old", "object": "T", "compare_columns": ["note"]}}}]})
    suite = Suite(spark, mapping, frames_connection({"T": now}), frames_connection({"S": now}),
                  {"old": frames_connection({"T": base})})
    got = by_name(suite.run(["historical", "incremental", "cross_source"]))
    assert got["Period continuity [T]"].status == "FAIL"
    fixed = got["Historical immutability [T]"]
    assert (fixed.status, fixed.metrics["source_only"], fixed.metrics["value_mismatches"],
            fixed.metrics["target_only"]) == ("FAIL", "1", "1", "1")
    assert got["Incremental integrity [T]"].status == "PASS"
    assert got["Incremental integrity [T]"].metrics["additions"] == "1"
    assert got["Cross-source [T]"].metrics["value_mismatches"] == "1"


TAB = "FUND_CODE string, PERIOD string, NAV double, IRR double"


def report_suite(spark, tab, drop=None):
    expected = spark.createDataFrame([("F1", "2026Q1", 100.0, .1), ("F2", "2026Q1", 200.0, .2),
                                      ("F1", "2026Q2", 150.0, .15)], TAB)
    actual = spark.createDataFrame([("F1", "2026Q1", 100.0, .1), ("F2", "2026Q1", 200.0, .2),
                                    ("F1", "2026Q2", 175.0, .15), ("F9", "2026Q2", 50.0, .05)], TAB)
    actual = actual.drop(drop) if drop else actual
    spec = tab_from_dict({"key_columns": ["FUND_CODE", "PERIOD"], "compare_columns": ["NAV", "IRR"],
                          "measures": [{"label": "NAV", "column": "NAV"}],
                          "report": {"table": "TAB", "where": tab.pop("where", None)},
                          "gold": {"table": "TAB", "connection": "source",
                                   "where": "PERIOD = '2026Q1'" if tab["name"] == "Q1" else "PERIOD = '2026Q2'"},
                          **tab})
    return {n.split()[1]: r.status for n, r in by_name(Suite(
        spark, mapping_from_dict({}), frames_connection({"TAB": actual}),
        frames_connection({"TAB": expected}), tabs=(spec,)).run(["report"])).items()}


def test_report_phases(spark):
    q1, q2 = "PERIOD = '2026Q1'", "PERIOD = '2026Q2'"
    assert report_suite(spark, {"name": "Q1", "where": q1}) == {
        "structure": "PASS", "data": "PASS", "measures": "PASS"}
    assert report_suite(spark, {"name": "Q2", "where": q2}) == {
        "structure": "WARN", "data": "FAIL", "measures": "FAIL"}
    assert report_suite(spark, {"name": "Q2", "where": q2}, drop="NAV") == {
        "structure": "FAIL", "data": "SKIPPED", "measures": "SKIPPED"}
    assert report_suite(spark, {"name": "Q2", "where": q2, "row_count_gate": "fail"}) == {
        "structure": "FAIL", "data": "SKIPPED", "measures": "SKIPPED"}
    assert report_suite(spark, {"name": "Q2", "where": q2, "row_count_gate": "fail",
                                "gate_on_structure": False}) == {
        "structure": "FAIL", "data": "FAIL", "measures": "FAIL"}


def test_specifications():
    assert as_list("a, b; c") == ["a, b", "c"] and as_list(" x ") == ["x"] and as_list(None) == []
    book = mapping_from_dict(demo.MAPPING)
    assert list(book.tables) == ["DEAL", "FUND"] and len(book.rules) == 4
    assert book.foreign_keys[0].child_columns == ("FUND_CODE",)
    assert mapping_from_dict({"tables": [{"target_table": "x"}]}).warnings
    assert book.with_options({"FUND": {"group_by": "a"}}).tables["FUND"].options == {
        "lineage_columns": [], "group_by": "a"}
    tabs = tabs_from_report({"name": "R", "actual_connection": "new", "tabs": [
        {"name": "a", "actual": {"table": "t"}, "expected": {"table": "u", "connection": "old"}}]})
    assert (tabs[0].name, tabs[0].actual.connection, tabs[0].expected.connection) == (
        "R · a", "new", "old")
    with pytest.raises(ValueError):
        tab_from_dict({"name": "x", "actual": {"table": "t"}})
    assert RunOptions.from_dict({"lineage_columns": "a;b", "unknown": 1}).lineage_columns == ("a", "b")
    assert len(CATEGORIES) == 16


def test_wide_tables_are_cut_into_batches(spark):
    from tallymark.operators import checks, counters
    wide = spark.range(10).select(*[F.when(F.col("id") > i % 3, F.lit("x")).alias(f"c{i}")
                                    for i in range(450)])
    got = checks.null_counts(wide, wide.columns).collect()
    assert len(got) == 450 and sum(r.null_count for r in got) == sum(1 + i % 3 for i in range(450))
    assert counters.MAX_COUNTERS == 200


def test_suite_from_files(spark, tmp_path):
    import json
    for side, rows in (("old", demo.SOURCE_DEALS), ("new", [r[:9] for r in demo.TARGET_DEALS])):
        (tmp_path / side).mkdir()
        lines = [",".join(demo.DEAL_COLUMNS)] + [
            ",".join(f'"{v}"' for v in r) for r in rows]
        for part, chunk in enumerate((lines[:3], [lines[0], *lines[3:]])):
            (tmp_path / side / f"deals_{part}.csv").write_text("\n".join(chunk) + "\n")
    mapping = copy.deepcopy(demo.MAPPING)
    mapping["ref_integrity"] = []
    (tmp_path / "mapping.json").write_text(json.dumps(mapping))
    (tmp_path / "report.json").write_text(json.dumps({
        "id": "r", "name": "Deals", "actual_connection": "new", "expected_connection": "old",
        "tabs": [{"name": "All", "actual": {"path": "deals_*.csv"},
                  "expected": {"path": "deals_*.csv"}, "key_columns": ["DEAL_ID"],
                  "compare_columns": ["COMPANY"], "measures": [{"column": "FMV"}]}]}))
    config = {"name": "files", "mapping": str(tmp_path / "mapping.json"),
              "source": "old", "target": "new", "tests": ["row_count", "reconciliation"],
              "reports": [str(tmp_path / "report.json")], "expected": "fail",
              "tables": [{"name": "DEAL", "options": {
                  "source_options": {"path": "deals_*.csv"},
                  "target_options": {"path": "deals_*.csv"}}}]}
    connections = {n: {"type": "files", "base_dir": str(tmp_path / n)} for n in ("old", "new")}
    got = by_name(suite_from_config(spark, config, connections).run())
    assert got["Reconciliation [DEAL]"].metrics["value_mismatches"] == "3"
    assert got["Report data [Deals · All]"].status == "PASS"
    assert got["Report measures [Deals · All]"].status == "PASS"
    assert {r.expected for r in got.values()} == {"fail"}
    for broken in ({**config, "tests": ["nope"]}, {**config, "target": None},
                   {**config, "target": "gone"}, {"target": "new"}):
        with pytest.raises(ValueError):
            suite_from_config(spark, broken, connections)


def test_evidence_of_repeated_keys(spark, tmp_path):
    source, target = demo.frames(spark)
    target["FUND"] = target["FUND"].union(target["FUND"].where("FUND_CODE = 'F1'"))
    suite = Suite(spark, mapping_from_dict(demo.MAPPING), frames_connection(target),
                  frames_connection(source))
    got = by_name(suite.run(["reconciliation"], ["FUND"], history=f"{tmp_path}/h",
                            evidence=f"{tmp_path}/e", run_id="r"))
    assert got["Reconciliation [FUND]"].metrics["target_dup_keys"] == "1"
    listed = sinks.read_listing(spark, f"{tmp_path}/h/evidence").collect()
    assert {(re.sub("_[0-9a-f]{12}", "", r.path.split("=")[-1]), r.rows) for r in listed} == {
        ("Reconciliation_FUND", 1), ("Reconciliation_FUND_duplicate_keys", 2)}


def test_evidence_names_never_meet():
    from tallymark.plans.suite import _file_name
    long = "Foreign key [" + "column_" * 30
    names = [_file_name(long + "a]"), _file_name(long + "b]"), _file_name("['x', 'y']"), _file_name("['x_y']"),
             _file_name("same", "a", "t"), _file_name("same", "b", "t")]
    assert len(set(names)) == len(names)


def _pair(spark, tables, target, source=None):
    return Suite(spark, mapping_from_dict({"tables": tables}), frames_connection(target),
                 frames_connection(source) if source else None)


def test_an_absent_column_does_not_cost_the_type_check(spark):
    columns = [{"target_column": c, "target_datatype": "decimal"} for c in ("a", "gone")]
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    got = by_name(_pair(spark, [{"target_table": "T", "columns": columns}], {"T": df}).run(["datatype", "schema"]))
    types = got["Data types [T]"]
    assert (types.status, types.metrics["bad:a"], types.metrics["absent_columns"]) == ("FAIL", "1", "gone")
    assert got["Schema [T]"].metrics["missing"] == "gone"


@pytest.fixture
def broken(spark, tmp_path):
    """A pair that fails, and an evidence folder that is a file."""
    blocked = tmp_path / "evidence"
    blocked.write_text("in the way")
    columns = [{"target_column": c, "source_column": c} for c in ("id", "v")]
    table = {"target_table": "T", "source_object": "S", "key_columns": ["id"], "columns": columns}
    make = lambda rows: spark.createDataFrame(rows, "id int, v string")
    suite = _pair(spark, [table], {"T": make([(1, "a"), (1, "b"), (2, "c")])}, {"S": make([(1, "a"), (2, "d")])})
    return suite, str(blocked), str(tmp_path / "history")


def test_evidence_that_cannot_be_written_is_noted(spark, broken):
    suite, blocked, folder = broken
    checks = suite.run(["deduplication", "reconciliation"], history=folder, evidence=blocked)
    got = by_name(checks)
    for name in ("Deduplication [T]", "Reconciliation [T]"):
        assert got[name].status == "FAIL" and "Evidence was not written" in got[name].message
    assert sinks.read_checks(spark, f"{folder}/checks").count() == checks.count()


def test_all_evidence_is_listed(spark, tmp_path):
    """Findings that the verdict allows are listed like others."""
    columns = [{"target_column": c, "source_column": c} for c in ("id", "v")]
    mapping = mapping_from_dict({"tables": [{
        "target_table": "T", "source_object": "S", "key_columns": ["id"], "columns": columns,
        "options": {"cross_source": {"second_source": "two", "object": "T"}}}]})
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    suite = Suite(spark, mapping, frames_connection({"T": one}), frames_connection({"S": one}),
                  {"two": frames_connection({"T": one.where("id = 1")})})
    got = by_name(suite.run(["cross_source"], history=f"{tmp_path}/h", evidence=f"{tmp_path}/e"))
    assert got["Cross-source [T]"].status == "PASS"
    listed = sinks.read_listing(spark, f"{tmp_path}/h/evidence").collect()
    assert [(r.status, r.rows) for r in listed] == [("PASS", 1)]
    assert spark.read.option("header", True).csv(listed[0].path).count() == 1


def test_structure_names_the_row_gate(spark):
    from tallymark.operators import report
    tab = tab_from_dict({"name": "t", "actual": {"connection": "a", "table": "x"},
                         "expected": {"connection": "b", "table": "y"}, "row_count_gate": "fail"})
    row = report.structure(spark.range(3), spark.range(1), tab).first()
    assert row.status == "FAIL" and row.problems.startswith("row counts differ by 2")
    mixed = report.line_up(["A", "b", "x"], ["a", "b", "y"], ["a", "b", "c"])
    assert (mixed.only_actual, mixed.only_expected) == (("x",), ("y",)) and len(mixed.hard) == 2
    assert mixed.soft[0] == "column case differs on ['a']"


def test_a_table_is_read_at_most_six_times(spark):
    """All counters of a pair share one scan a side, all groupings another; each table is told by a column of its own."""
    from catalog import seeds
    from catalog.q_suite import MAPPING
    from tallymark.session import stored

    sf_dir = "/root/testdata/sf0.001"
    target = stored(seeds.orders_target(spark, sf_dir).withColumn("mark_target", F.lit(1)))
    source = stored(seeds.orders_source(spark, sf_dir).withColumn("mark_source", F.lit(1)))
    customers = stored(seeds.table(spark, sf_dir, "customer").withColumn("mark_customer", F.lit(1)))
    suite = Suite(spark, MAPPING, frames_connection({"orders_dim": target, "customer_dim": customers}),
                  frames_connection({"orders_feed": source, "customers": customers}))
    plan = suite.plan()
    assert len(plan.pieces) > 5
    relations = [line for piece in plan.pieces
                 for line in piece.rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line]
    reads = {mark: sum(mark in line for line in relations) for mark in ("mark_target", "mark_source", "mark_customer")}
    assert reads["mark_target"] <= 6 and reads["mark_source"] <= 5, reads
    counters = [p for p in plan.pieces if any(h.name.startswith("Row count [orders") for h in p.heads)][0]
    assert {"row_count", "datatype", "completeness", "null_handling", "reconciliation", "business_rules"} <= {
        h.category for h in counters.heads}
    groups = [p for p in plan.pieces if any(h.name.startswith("Deduplication [orders") for h in p.heads)][0]
    assert {h.category for h in groups.heads} == {"row_count", "completeness", "business_rules", "deduplication"}


def test_one_faulty_grouping_costs_the_others_nothing(spark):
    """Groupings share a scan; a check that cannot be planned is an ERROR of its own."""
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, "a")], "id int, name string")
    mapping = mapping_from_dict({"tables": [{
        "target_table": "t", "source_object": "s", "key_columns": ["id"], "columns": [],
        "options": {"group_by": "no_such", "completeness": [
            {"column": "name", "expected_values": ["a", "z"], "forbidden_values": ["b"]},
            {"column": "gone", "expected_values": ["a"]}, {"column": "id", "expected_values": [1, 2]}]}}],
        "business_rules": [
            {"rule_id": "U", "target_table": "t", "rule_type": "unique", "params": {"columns": ["id", "name"]}},
            {"rule_id": "F", "target_table": "t", "rule_type": "unique", "params": {"columns": ["id"]}, "filter": "name = 'a'"},
            {"rule_id": "C", "target_table": "t", "rule_type": "combine", "params": {"group_by": ["name"], "expect_count": 3}},
            {"rule_id": "X", "target_table": "t", "rule_type": "unique", "params": {"columns": ["nope"]}}]})
    suite = Suite(spark, mapping, frames_connection({"t": df}), frames_connection({"s": df}))
    rows = {r.name: r for r in suite.run(["row_count", "completeness", "business_rules", "deduplication"]).collect()}
    status = {name: r.status for name, r in rows.items()}
    assert status == {
        "Row count [t]": "PASS", "Row count by ['no_such'] [t]": "ERROR", "Mandatory completeness [t]": "SKIPPED",
        "Completeness of name [t]": "FAIL", "Completeness of gone [t]": "ERROR", "Completeness of id [t]": "FAIL",
        "[U] unique": "FAIL", "[F] unique": "FAIL", "[C] combine": "FAIL", "[X] unique": "ERROR", "Deduplication [t]": "FAIL"}
    assert rows["Completeness of name [t]"].metrics == {"missing": "1", "intruders": "1", "distinct_present": "2",
                                                        "missing_values": "z", "forbidden_values": "b"}
    assert rows["Completeness of id [t]"].metrics["missing_values"] == "2"
    assert rows["Deduplication [t]"].metrics == {"rows": "4", "duplicate_keys": "2", "duplicate_rows": "4"}
    assert rows["[U] unique"].metrics == {"checked_rows": "4", "groups": "3", "bad_groups": "1", "violations": "2"}
    assert rows["[C] combine"].metrics["bad_groups"] == "1"
