"""Registered queries over report tabs: a yearly revenue tab, new load against old load."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import seeds
from catalog.seeds import every, table
from tallymark.operators import report
from tallymark.spec import tab_from_dict, tabs_from_report

QUERIES, SQL = {}, {}

SIDES = {"actual": {"table": "actual"}, "expected": {"table": "expected"}}
TAB = tab_from_dict(SIDES | {
    "name": "Revenue", "key_columns": ["custkey", "year"], "compare_columns": ["revenue", "orders"],
    "tolerance": 0.5, "row_count_tolerance": 5, "measures": [
        {"label": "Total revenue", "column": "revenue", "tolerance": 0.01},
        {"column": "orders"}, {"column": "margin"}]})


def expected(s, d):
    return (table(s, d, "orders").groupBy(F.col("o_custkey").alias("custkey"),
                                          F.year("o_orderdate").alias("year"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders")))


def actual(s, d):
    """The same tab after a migration: lost customers, drifted sums, a column more."""
    return expected(s, d).where(~every(97, "custkey")).select(
        "custkey", "year",
        F.when(every(13, "custkey"), F.col("revenue") + 0.25)
        .when(every(17, "custkey"), F.col("revenue") + 10).otherwise(F.col("revenue")).alias("revenue"),
        F.when(every(19, "custkey"), F.col("orders") + 1).otherwise(F.col("orders")).alias("orders"),
        F.lit("new").alias("source"))


TAB_SQL = """WITH e AS (SELECT o_custkey AS custkey, year(o_orderdate) AS year,
    round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders GROUP BY 1, 2),
a AS (SELECT custkey, year, CASE WHEN custkey % 13 = 0 THEN revenue + 0.25
    WHEN custkey % 17 = 0 THEN revenue + 10 ELSE revenue END AS revenue,
  CASE WHEN custkey % 19 = 0 THEN orders + 1 ELSE orders END AS orders FROM e WHERE custkey % 97 <> 0)"""

QUERIES["report_structure"] = lambda s, d: report.structure(actual(s, d), expected(s, d), TAB)
SQL["report_structure"] = TAB_SQL + """,
c AS (SELECT (SELECT count(*) FROM a) AS actual_rows, (SELECT count(*) FROM e) AS expected_rows)
SELECT CAST(5 AS INTEGER) AS actual_columns, CAST(4 AS INTEGER) AS expected_columns, *,
  abs(actual_rows - expected_rows) AS row_delta,
  'source' AS only_in_actual, '' AS only_in_expected,
  '1 columns only in ACTUAL: [''source'']' AS problems, 'WARN' AS status FROM c"""

QUERIES["report_structure_gate"] = lambda s, d: report.structure(
    actual(s, d), expected(s, d), replace(TAB, row_count_gate="fail", row_count_tolerance=0)).select(
    "row_delta", "problems", "status")
SQL["report_structure_gate"] = TAB_SQL + """,
c AS (SELECT abs((SELECT count(*) FROM a) - (SELECT count(*) FROM e)) AS row_delta)
SELECT row_delta, '1 columns only in ACTUAL: [''source'']' || CASE WHEN row_delta > 0
    THEN '; row counts differ by ' || row_delta || ', more than 0' ELSE '' END AS problems,
  CASE WHEN row_delta > 0 THEN 'FAIL' ELSE 'WARN' END AS status FROM c"""

QUERIES["report_data"] = lambda s, d: report.data_diff(actual(s, d), expected(s, d), TAB).summary()
SQL["report_data"] = TAB_SQL + """,
j AS (SELECT abs(a.revenue - e.revenue) > 0.5 AS r, abs(a.orders - e.orders) > 0.5 AS o
  FROM a JOIN e USING (custkey, year)),
c AS (SELECT (SELECT count(*) FROM a) AS source_total, (SELECT count(*) FROM e) AS target_total,
  (SELECT count(*) FROM j) AS matched_keys, (SELECT count(*) FROM j WHERE NOT (r OR o)) AS values_matched,
  (SELECT CAST(sum(r::INT + o::INT) AS BIGINT) FROM j) AS value_mismatches,
  (SELECT count(*) FROM a ANTI JOIN e USING (custkey, year)) AS source_only,
  (SELECT count(*) FROM e ANTI JOIN a USING (custkey, year)) AS target_only,
  CAST(0 AS BIGINT) AS source_dup_keys, CAST(0 AS BIGINT) AS target_dup_keys,
  (SELECT count(*) FROM j WHERE r OR o) AS mismatched_rows)
SELECT *, value_mismatches + source_only + target_only = 0 AS is_clean FROM c"""


def _measures(s, d):
    found = report.measures(actual(s, d), expected(s, d), TAB.measures, TAB.variance_threshold)
    return found.withColumns({c: F.round(c, 2) for c in ("actual_sum", "expected_sum")}) \
        .withColumn("variance", F.round("variance", 8))


QUERIES["report_measures"] = _measures
SQL["report_measures"] = TAB_SQL + ",".join(f"""
{n} AS (SELECT '{label}' AS measure, '{c}' AS "column",
  CAST((SELECT sum({c}) FROM a) AS DOUBLE) AS x, CAST((SELECT sum({c}) FROM e) AS DOUBLE) AS y,
  {tol} AS tol)""" if i else f""",
{n} AS (SELECT '{label}' AS measure, '{c}' AS "column",
  CAST((SELECT sum({c}) FROM a) AS DOUBLE) AS x, CAST((SELECT sum({c}) FROM e) AS DOUBLE) AS y,
  {tol} AS tol)""" for i, (n, label, c, tol) in enumerate(
    (("m1", "Total revenue", "revenue", 0.01), ("m2", "orders", "orders", 0.0001)))) + """
SELECT measure, "column", round(x, 2) AS actual_sum, round(y, 2) AS expected_sum,
  round(abs(x - y) / abs(y), 8) AS variance, abs(x - y) / abs(y) <= tol AS within,
  CASE WHEN abs(x - y) / abs(y) <= tol THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2)
UNION ALL SELECT 'margin', 'margin', NULL, NULL, NULL, false, 'FAIL'"""


def _gate(s, d):
    """Status per phase for an open tab, a tab gated by a column, one gated by its count and one let through."""
    a, e = actual(s, d), expected(s, d)
    open_tab = TAB
    column_gated = tab_from_dict(SIDES | {"name": "margin", "key_columns": ["custkey", "year"],
                                          "compare_columns": ["margin"],
                                          "measures": [{"column": "orders"}]})
    count_gated = tab_from_dict(SIDES | {"name": "count", "key_columns": ["custkey", "year"],
                                         "compare_columns": ["orders"], "row_count_gate": "fail",
                                         "measures": [{"column": "orders"}]})
    within = replace(count_gated, name="wide", row_count_tolerance=10 ** 9)
    rows = [frame.select(F.lit(tab.name).alias("tab"), F.lit(phase).alias("phase"), "status")
            for tab in (open_tab, column_gated, count_gated, within)
            for phase, frame in report.phases(a, e, tab).items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


QUERIES["report_gate"] = _gate
SQL["report_gate"] = TAB_SQL + """,
j AS (SELECT a.revenue IS NOT NULL AND e.revenue IS NOT NULL AND abs(a.revenue - e.revenue) > 0.5 AS r,
    a.orders IS NOT NULL AND e.orders IS NOT NULL AND abs(a.orders - e.orders) > 0.5 AS o,
    a.custkey IS NULL OR e.custkey IS NULL AS alone, a.orders <> e.orders AS x
  FROM a FULL JOIN e ON a.custkey = e.custkey AND a.year = e.year),
c AS (SELECT abs((SELECT count(*) FROM a) - (SELECT count(*) FROM e)) AS delta,
  (SELECT coalesce(bool_or(r OR o OR alone), false) FROM j) AS loose,
  (SELECT coalesce(bool_or(coalesce(x, false) OR alone), false) FROM j) AS exact,
  (SELECT abs(sum(a.orders) - (SELECT sum(orders) FROM e)) / (SELECT sum(orders) FROM e) FROM a) AS variance)
SELECT 'Revenue' AS tab, 'structure' AS phase, 'WARN' AS status FROM c
UNION ALL SELECT 'Revenue', 'data', CASE WHEN loose THEN 'FAIL' ELSE 'PASS' END FROM c
UNION ALL SELECT 'Revenue', 'measures', 'FAIL' FROM c
UNION ALL SELECT 'margin', phase, status FROM (VALUES ('structure', 'FAIL'), ('data', 'SKIPPED'),
  ('measures', 'SKIPPED')) v(phase, status)
UNION ALL SELECT 'count', 'structure', CASE WHEN delta > 0 THEN 'FAIL' ELSE 'WARN' END FROM c
UNION ALL SELECT 'count', 'data', CASE WHEN delta > 0 THEN 'SKIPPED' WHEN exact THEN 'FAIL' ELSE 'PASS' END FROM c
UNION ALL SELECT 'count', 'measures', CASE WHEN delta > 0 THEN 'SKIPPED'
  WHEN variance > 0.0001 THEN 'FAIL' ELSE 'PASS' END FROM c
UNION ALL SELECT 'wide', 'structure', CASE WHEN delta > 1000000000 THEN 'FAIL' ELSE 'WARN' END FROM c
UNION ALL SELECT 'wide', 'data', CASE WHEN exact THEN 'FAIL' ELSE 'PASS' END FROM c
UNION ALL SELECT 'wide', 'measures', CASE WHEN variance > 0.0001 THEN 'FAIL' ELSE 'PASS' END FROM c"""


def _flatten(s, d):
    """Tabs of a report with the row counts of the datasets they name."""
    flat = tabs_from_report({
        "id": "fin", "name": "Finance", "actual_connection": "target",
        "expected_connection": "source", "tabs": [
            {"name": "Orders", "actual": {"table": "orders"}, "expected": {"table": "orders"},
             "key_columns": ["o_orderkey"]},
            {"name": "Lines", "report": {"table": "lineitem"}, "gold": {"table": "lineitem"},
             "key_columns": seeds.LINE_KEY}]})
    rows = [table(s, d, t.actual.table).agg(F.count("*").alias("actual_rows")).select(
        F.lit(t.name).alias("name"), F.lit(t.report_id).alias("report_id"),
        F.lit(t.tab).alias("tab"), F.lit(t.actual.connection).alias("actual_connection"),
        F.lit(t.expected.connection).alias("expected_connection"), "actual_rows") for t in flat]
    return rows[0].unionByName(rows[1])


QUERIES["report_flatten"] = _flatten
SQL["report_flatten"] = """
SELECT 'Finance · Orders' AS name, 'fin' AS report_id, 'Orders' AS tab, 'target' AS actual_connection,
  'source' AS expected_connection, count(*) AS actual_rows FROM orders
UNION ALL SELECT 'Finance · Lines', 'fin', 'Lines', 'target', 'source', count(*) FROM lineitem"""
