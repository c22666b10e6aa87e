"""Registered queries over the business rules, on the seeded target of the orders pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import seeds
from catalog.seeds import every, sql_nullish
from tallymark.operators import rules
from tallymark.operators.counters import tally_rows
from tallymark.operators.rules import Rule

QUERIES, SQL = {}, {}
PAIR = f"WITH {seeds.ORDERS_PAIR_SQL}"
KEY = ["o_orderkey"]


def target(s, d):
    """Orders as loaded, with a text column of mixed content for the numeric rules."""
    return seeds.orders_target(s, d).withColumn(
        "code", F.when(every(3), "27").when(every(5), " 27.0 ").when(every(7), "1,000")
        .when(~every(11), "abc"))


TARGET_SQL = PAIR + """,
t AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '27' WHEN o_orderkey % 5 = 0 THEN ' 27.0 '
  WHEN o_orderkey % 7 = 0 THEN '1,000' WHEN o_orderkey % 11 <> 0 THEN 'abc' END AS code FROM tgt)"""


def register(name: str, rule: Rule, sql: str, keys=KEY) -> None:
    QUERIES[name] = lambda s, d: rules.offenders(rule, target(s, d), keys)
    SQL[name] = TARGET_SQL + sql


register("rule_value_equals", Rule("BR1", "value_equals", {"column": "code", "expected": 27}), """
SELECT o_orderkey, code FROM t
WHERE NOT coalesce(trim(code) = '27' OR TRY_CAST(trim(code) AS DOUBLE) = 27, false)""")

register("rule_allowed_values", Rule("BR2", "allowed_values", {
    "column": "o_orderpriority", "allowed_values": ["1-urgent ", "2-HIGH", "5-LOW"]}), """
SELECT o_orderkey, o_orderpriority FROM t
WHERE coalesce(lower(trim(o_orderpriority)) NOT IN ('1-urgent', '2-high', '5-low'), true)""")

register("rule_not_allowed", Rule("BR3", "not_allowed", {
    "column": "o_orderpriority", "allowed_values": ["n/a", "3-medium"]}), """
SELECT o_orderkey, o_orderpriority FROM t WHERE lower(trim(o_orderpriority)) IN ('n/a', '3-medium')""")

register("rule_conditional", Rule("BR4", "conditional", {
    "when": "o_orderpriority == '1-URGENT'", "column": "o_orderstatus", "expected": "f"}), """
SELECT o_orderkey, o_orderstatus FROM t
WHERE o_orderpriority = '1-URGENT' AND lower(trim(o_orderstatus)) <> 'f'""")

register("rule_not_null", Rule("BR5", "not_null", {"column": "o_orderpriority"}), f"""
SELECT o_orderkey, o_orderpriority FROM t WHERE {sql_nullish('o_orderpriority')}""")

register("rule_range", Rule("BR6", "range", {"column": "code", "min": 10, "max": 500}), """
SELECT o_orderkey, code FROM t
WHERE NOT coalesce(TRY_CAST(trim(code) AS DOUBLE) BETWEEN 10 AND 500, false)""")

register("rule_unique", Rule("BR7", "unique", {"columns": ["o_custkey", "o_orderpriority"]}), """
SELECT o_orderkey, o_custkey, o_orderpriority FROM t
QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1""")

EXCLUDED = Rule("BR8", "must_not_exist", {}, "o_totalprice = 0")
QUERIES["rule_must_not_exist"] = lambda s, d: rules.offenders(
    EXCLUDED, target(s, d).withColumn("o_orderdate", F.col("o_orderdate").cast("string")))
SQL["rule_must_not_exist"] = TARGET_SQL + """
SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM t
WHERE o_totalprice = 0"""

register("rule_split_distinct", Rule("BR9", "split", {
    "group_by": "o_custkey", "type_column": "o_orderpriority", "expect_distinct": 4}), """
SELECT o_custkey, count(DISTINCT o_orderpriority) AS distinct_o_orderpriority FROM t
GROUP BY 1 HAVING count(DISTINCT o_orderpriority) < 4""")

register("rule_split_count", Rule("BR10", "split", {"group_by": ["o_custkey"], "min_count": 5}), """
SELECT o_custkey, count(*) AS row_count FROM t GROUP BY 1 HAVING count(*) < 5""")

register("rule_combine", Rule("BR11", "combine", {"group_by": "o_orderkey"}, "o_custkey > 10"), """
SELECT o_orderkey, count(*) AS row_count FROM t WHERE o_custkey > 10 GROUP BY 1 HAVING count(*) <> 1""")

register("rule_valid_expr", Rule("BR12", "valid_expr", {
    "valid_expr": "o_totalprice > 1000 and code <> 'abc'"}), """
SELECT o_orderkey FROM t WHERE NOT coalesce(o_totalprice > 1000 AND code <> 'abc', false)""")

register("rule_scope_filter", Rule("BR13", "value_equals", {"column": "code", "value": "27"},
                                   "o_orderpriority in ('2-HIGH', '5-LOW')"), """
SELECT o_orderkey, code FROM t WHERE o_orderpriority IN ('2-HIGH', '5-LOW')
AND NOT coalesce(trim(code) = '27' OR TRY_CAST(trim(code) AS DOUBLE) = 27, false)""")


def _counts_sql(rule_id: str, kind: str, scope: str, bad: str, status: str | None = None) -> str:
    checked = f"count(*) FILTER ({scope})"
    found = f"count(*) FILTER (({scope}) AND ({bad}))"
    passed = status or f"{found} = 0"
    return f"""
SELECT '{rule_id}' AS rule_id, '{kind}' AS rule_type, {checked} AS checked_rows,
  {found} AS violations, CASE WHEN {passed} THEN 'PASS' ELSE 'FAIL' END AS status FROM t"""


QUERIES["rule_must_exist"] = lambda s, d: (lambda t: tally_rows(t, [
    rules.row_rule_tally(r, t) for r in (
        Rule("BR14", "must_exist", {"min_count": 3}, "o_orderstatus = 'F'"),
        Rule("BR15", "must_exist", {}, "o_orderstatus = 'none'"))]))(target(s, d))
SQL["rule_must_exist"] = TARGET_SQL + " UNION ALL ".join((
    _counts_sql("BR14", "must_exist", "o_orderstatus = 'F'", "false", "count(*) FILTER (o_orderstatus = 'F') >= 3"),
    _counts_sql("BR15", "must_exist", "o_orderstatus = 'none'", "false",
                "count(*) FILTER (o_orderstatus = 'none') >= 1")))

# Every row rule of a table in one scan.
FUSED = [
    Rule("BR1", "value_equals", {"column": "code", "expected": 27}),
    Rule("BR3", "not_allowed", {"column": "o_orderpriority", "allowed_values": ["n/a"]}),
    Rule("BR4", "flag_override", {"when": "o_orderpriority == '1-URGENT'",
                                  "column": "o_orderstatus", "expected": "f"}),
    Rule("BR5", "not_null", {"column": "o_orderpriority"}),
    Rule("BR6", "range", {"column": "code", "min": 10}),
    Rule("BR8", "must_not_exist", {}, "o_totalprice < 0"),
]
QUERIES["rule_summary"] = lambda s, d: (lambda t: tally_rows(
    t, [rules.row_rule_tally(r, t) for r in FUSED]))(target(s, d))
SQL["rule_summary"] = TARGET_SQL + " UNION ALL ".join((
    _counts_sql("BR1", "value_equals", "true",
                "NOT coalesce(trim(code) = '27' OR TRY_CAST(trim(code) AS DOUBLE) = 27, false)"),
    _counts_sql("BR3", "not_allowed", "true", "coalesce(lower(trim(o_orderpriority)) = 'n/a', false)"),
    _counts_sql("BR4", "flag_override", "o_orderpriority = '1-URGENT'", "lower(trim(o_orderstatus)) <> 'f'"),
    _counts_sql("BR5", "not_null", "true", sql_nullish("o_orderpriority")),
    _counts_sql("BR6", "range", "true", "NOT coalesce(TRY_CAST(trim(code) AS DOUBLE) >= 10, false)"),
    _counts_sql("BR8", "must_not_exist", "o_totalprice < 0", "true")))
