"""Registered queries over the checks of one table or a pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import seeds
from catalog.seeds import every, sql_nullish, sql_number, sql_trim, table
from tallymark.operators import checks
from tallymark.session import stored
from tallymark.spec import mapping_from_dict

QUERIES, SQL = {}, {}

PAIR = f"WITH {seeds.ORDERS_PAIR_SQL}"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def rounded(df, *columns, digits=2):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("row_count_overall", PAIR + """,
c AS (SELECT (SELECT count(*) FROM src) AS source_rows, (SELECT count(*) FROM tgt) AS target_rows)
SELECT *, target_rows - source_rows AS difference,
  CASE WHEN target_rows = source_rows THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def row_count_overall(s, d):
    return checks.row_count(seeds.orders_source(s, d), seeds.orders_target(s, d))


@query("row_count_by_group", PAIR + """
SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority,
  coalesce(source_rows, 0) AS source_rows, coalesce(target_rows, 0) AS target_rows,
  coalesce(target_rows, 0) - coalesce(source_rows, 0) AS difference
FROM (SELECT o_orderpriority, count(*) AS source_rows FROM src GROUP BY 1) a
FULL JOIN (SELECT o_orderpriority, count(*) AS target_rows FROM tgt GROUP BY 1) b
  ON a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority""")
def row_count_by_group(s, d):
    return checks.group_counts(seeds.orders_source(s, d), seeds.orders_target(s, d),
                               ["o_orderpriority"])


DECLARED = ["o_orderkey", "O_CUSTKEY", "o_orderstatus", "o_clerk", "o_comment"]


@query("schema_drift", """
SELECT v."column", v.drift, v.status, CAST(CASE v."column"
    WHEN 'o_totalprice' THEN (SELECT count(o_totalprice) FROM orders)
    WHEN 'o_orderdate' THEN (SELECT count(o_orderdate) FROM orders)
    WHEN 'o_orderpriority' THEN (SELECT count(o_orderpriority) FROM orders) ELSE 0 END AS BIGINT)
  AS filled_rows
FROM (VALUES ('o_clerk', 'missing', 'FAIL'), ('o_comment', 'missing', 'FAIL'),
  ('o_totalprice', 'extra', 'WARN'), ('o_orderdate', 'extra', 'WARN'),
  ('o_orderpriority', 'extra', 'WARN')) v("column", drift, status)""")
def schema_drift(s, d):
    return checks.schema_drift(table(s, d, "orders"), DECLARED)


# Text columns with values that do not fit their declared kind.
def _typed(s, d):
    return table(s, d, "orders").select(
        "o_orderkey",
        F.when(every(41), "12x").when(every(43), "n/a").when(every(7), F.format_number("o_totalprice", 2))
        .otherwise(F.col("o_totalprice").cast("decimal(15,2)").cast("string")).alias("amount"),
        F.when(every(47), "31.12.1999x").when(every(3), "")
        .otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")).alias("day"),
        F.when(every(5), "Y").when(every(7), " false ").when(every(11), "maybe")
        .otherwise("0").alias("shipped"))


_TYPED_SQL = """WITH t AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 41 = 0 THEN '12x' WHEN o_orderkey % 43 = 0 THEN 'n/a'
    WHEN o_orderkey % 7 = 0 THEN format('{:,.2f}', o_totalprice)
    ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 47 = 0 THEN '31.12.1999x' WHEN o_orderkey % 3 = 0 THEN ''
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Y' WHEN o_orderkey % 7 = 0 THEN ' false '
    WHEN o_orderkey % 11 = 0 THEN 'maybe' ELSE '0' END AS shipped FROM orders)"""
KINDS = {"amount": "numeric", "day": "date", "shipped": "bool"}
_UNFIT = {
    "amount": f"NOT {sql_nullish('amount')} AND {sql_number('amount', ',$')} IS NULL",
    "day": f"NOT {sql_nullish('day')} AND TRY_CAST(day AS DATE) IS NULL",
    "shipped": (f"NOT {sql_nullish('shipped')} AND lower({sql_trim('shipped')}) NOT IN "
                "('true','t','yes','y','1','1.0','false','f','no','n','0','0.0')")}


@query("datatype_conformance", _TYPED_SQL + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{k}' AS expected_kind,
  count(*) FILTER (NOT {sql_nullish(c)}) AS checked, count(*) FILTER ({_UNFIT[c]}) AS bad_count,
  CASE WHEN count(*) FILTER ({_UNFIT[c]}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM t"""
                                                               for c, k in KINDS.items()))
def datatype_conformance(s, d):
    return checks.type_conformance(_typed(s, d), KINDS)


@query("datatype_samples", _TYPED_SQL + """,
b AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS copies FROM t WHERE {_UNFIT[c]} GROUP BY 2"
    for c in KINDS) + """)
SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) AS INTEGER) AS place FROM b
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY value) <= 5""")
def datatype_samples(s, d):
    return checks.type_samples(_typed(s, d), KINDS)


@query("completeness_mandatory", PAIR + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER ({sql_nullish(c)}) AS null_count, count(*) AS rows,
  CASE WHEN count(*) FILTER ({sql_nullish(c)}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM tgt"""
                                                      for c in ("o_orderstatus", "o_orderpriority")))
def completeness_mandatory(s, d):
    return checks.null_counts(seeds.orders_target(s, d), ["o_orderstatus", "o_orderpriority"]) \
        .withColumn("status", checks.verdict(F.col("null_count") == 0))


@query("completeness_values", PAIR + """,
p AS (SELECT DISTINCT o_orderpriority AS v FROM tgt WHERE o_orderpriority IS NOT NULL)
SELECT w.value, w.role, w.value IN (SELECT v FROM p) AS present,
  (SELECT count(*) FROM p) AS distinct_present,
  CASE WHEN (w.value IN (SELECT v FROM p)) = (w.role = 'expected') THEN 'PASS' ELSE 'FAIL' END AS status
FROM (VALUES ('1-URGENT', 'expected'), ('2-HIGH', 'expected'), ('6-NONE', 'expected'),
  (' N/A ', 'forbidden'), ('9-OLD', 'forbidden')) w(value, role)""")
def completeness_values(s, d):
    return checks.value_presence(seeds.orders_target(s, d), "o_orderpriority",
                                 ["1-URGENT", "2-HIGH", "6-NONE"], [" N/A ", "9-OLD"])


@query("fk_orphans", PAIR + """
SELECT o_orderkey, o_custkey FROM tgt
WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""")
def fk_orphans(s, d):
    return checks.fk_orphans(seeds.orders_target(s, d).select("o_orderkey", "o_custkey"),
                             table(s, d, "customer"), ["o_custkey"], ["c_custkey"])


@query("fk_orphans_settled", SQL["fk_orphans"])
def fk_orphans_settled(s, d):
    """As a run lists them: the orphan keys are settled first, the rows then filtered by them."""
    return checks.fk_orphans(seeds.orders_target(s, d).select("o_orderkey", "o_custkey"),
                             table(s, d, "customer"), ["o_custkey"], ["c_custkey"], stored)


# Composite key with null parts: a line's order and a status text that is empty for some.
_FK_CHILD_SQL = """WITH child AS (SELECT l_orderkey, CASE WHEN l_orderkey % 13 = 0 THEN ''
    WHEN l_orderkey % 17 = 0 THEN 'Z' ELSE ' ' || o_orderstatus END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("fk_summary", _FK_CHILD_SQL + f""",
c AS (SELECT count(*) AS child_rows, (SELECT count(*) FROM orders) AS parent_rows,
  count(*) FILTER (NOT {sql_nullish('status')} AND o_orderkey IS NULL) AS orphans,
  count(*) FILTER ({sql_nullish('status')}) AS null_child_keys
  FROM child LEFT JOIN orders ON l_orderkey = o_orderkey AND trim(status) = o_orderstatus)
SELECT *, CASE WHEN orphans > 0 THEN 'FAIL' WHEN null_child_keys > 0 THEN 'WARN' ELSE 'PASS' END
  AS status FROM c""")
def fk_summary(s, d):
    orders = table(s, d, "orders")
    child = table(s, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", F.when(every(13, "l_orderkey"), "").when(every(17, "l_orderkey"), "Z")
        .otherwise(F.concat(F.lit(" "), "o_orderstatus")).alias("status"))
    return checks.fk_summary(child, orders, ["l_orderkey", "status"],
                             ["o_orderkey", "o_orderstatus"])


RENAMED = mapping_from_dict({"tables": [{
    "target_table": "orders_dim", "source_object": "orders_feed", "key_columns": ["o_orderkey"],
    "columns": [{"target_column": "o_orderstatus", "source_column": "o_orderstatus"},
                {"target_column": "o_orderpriority", "source_column": "prio"}]}]}).tables["orders_dim"]


def _metrics(diff, status):
    return diff.totals().select("matched_keys", "value_mismatches", "source_only", "target_only",
                                "source_dup_keys", "target_dup_keys").withColumn("status", status)


def _metric_sql(mismatch: str, status: str, keys: str = "d") -> str:
    return f""",
c AS (SELECT (SELECT count(*) FROM d) AS matched_keys,
    (SELECT CAST(coalesce(sum({mismatch}), 0) AS BIGINT) FROM d) AS value_mismatches,
    (SELECT count(*) FROM su WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tu)) AS source_only,
    (SELECT count(*) FROM tu WHERE o_orderkey NOT IN (SELECT o_orderkey FROM su)) AS target_only,
    (SELECT count(*) FROM (SELECT o_orderkey FROM ns GROUP BY 1 HAVING count(*) > 1)) AS source_dup_keys,
    (SELECT count(*) FROM (SELECT o_orderkey FROM nt GROUP BY 1 HAVING count(*) > 1)) AS target_dup_keys)
SELECT *, CASE WHEN {status} THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""


@query("transformation_diff", seeds.ORDERS_DIFF_SQL + _metric_sql(
    "d4::INT", "value_mismatches + source_only + target_only + source_dup_keys + target_dup_keys = 0"))
def transformation_diff(s, d):
    feed = seeds.orders_source(s, d).withColumnRenamed("o_orderpriority", "prio")
    source = feed.withColumnsRenamed(RENAMED.source_to_target())
    diff = checks.keyed_diff(source, seeds.orders_target(s, d), RENAMED.key_columns,
                             RENAMED.transformed_columns(), RENAMED.norms())
    return _metrics(diff, checks.verdict(diff.is_clean()))


@query("completeness_long_list", """
WITH w AS (SELECT CAST(i AS VARCHAR) AS value, 'expected' AS role FROM range(1, 5001) t(i)
  UNION ALL SELECT CAST(-i AS VARCHAR), 'forbidden' FROM range(1, 101) t(i)),
p AS (SELECT DISTINCT CAST(CASE WHEN o_custkey % 50 = 0 THEN -o_custkey ELSE o_custkey END AS VARCHAR) AS v FROM orders)
SELECT w.value, w.role, p.v IS NOT NULL AS present, (SELECT count(*) FROM p) AS distinct_present,
  CASE WHEN (p.v IS NOT NULL) = (w.role = 'expected') THEN 'PASS' ELSE 'FAIL' END AS status
FROM w LEFT JOIN p ON p.v = w.value""")
def completeness_long_list(s, d):
    """Five thousand expected values and a hundred forbidden ones."""
    customers = table(s, d, "orders").select(
        F.when(F.col("o_custkey") % 50 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("customer"))
    return checks.value_presence(customers, "customer", range(1, 5001), range(-100, 0))


YEAR = "CAST(strftime(o_orderdate, '%Y') AS INTEGER)"


@query("period_continuity", f"""
WITH p AS (SELECT DISTINCT CAST({YEAR} AS VARCHAR) AS v FROM orders)
SELECT w.value, 'expected' AS role, w.value IN (SELECT v FROM p) AS present,
  (SELECT count(*) FROM p) AS distinct_present,
  CASE WHEN w.value IN (SELECT v FROM p) THEN 'PASS' ELSE 'FAIL' END AS status
FROM (VALUES ('1995'), ('1996'), ('2000'), ('2002')) w(value)""")
def period_continuity(s, d):
    years = table(s, d, "orders").select(F.year("o_orderdate").alias("period"))
    return checks.value_presence(years, "period", [1995, 1996, 2000, 2002])


def snapshots(s, d):
    """Two snapshots of orders: drift, vanished and new keys, with the year as period."""
    base = table(s, d, "orders").withColumn("period", F.year("o_orderdate"))
    now = base.where(~every(71)).withColumns({
        "o_orderkey": F.when(every(73), F.col("o_orderkey") + seeds.FAR).otherwise(F.col("o_orderkey")),
        "o_totalprice": F.when(every(79), F.col("o_totalprice") + 5).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(every(67), F.lit("X")).otherwise(F.col("o_orderstatus"))})
    return base, now


SNAPSHOT_SQL = f"""WITH b AS (SELECT *, {YEAR} AS period FROM orders),
n AS (SELECT CASE WHEN o_orderkey % 73 = 0 THEN o_orderkey + {seeds.FAR} ELSE o_orderkey END AS o_orderkey,
    o_custkey, CASE WHEN o_orderkey % 67 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 79 = 0 THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority, period FROM b WHERE o_orderkey % 71 <> 0)"""


def _snapshot_metrics(where: str, cells: str) -> str:
    return f""",
bb AS (SELECT * FROM b {where}), nn AS (SELECT * FROM n {where}),
j AS (SELECT (bb.o_totalprice <> nn.o_totalprice)::INT AS p,
    (bb.o_orderstatus <> nn.o_orderstatus)::INT AS s FROM bb JOIN nn USING (o_orderkey)),
c AS (SELECT (SELECT count(*) FROM j) AS matched_keys,
    (SELECT CAST(sum({cells}) AS BIGINT) FROM j) AS value_mismatches,
    (SELECT count(*) FROM bb ANTI JOIN nn USING (o_orderkey)) AS source_only,
    (SELECT count(*) FROM nn ANTI JOIN bb USING (o_orderkey)) AS target_only,
    CAST(0 AS BIGINT) AS source_dup_keys, CAST(0 AS BIGINT) AS target_dup_keys)"""


VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("historical_immutability", SNAPSHOT_SQL + _snapshot_metrics("WHERE period < 2000", "p + s") + """
SELECT *, CASE WHEN value_mismatches + source_only = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def historical_immutability(s, d):
    base, now = snapshots(s, d)
    diff = checks.immutability(base, now, ["o_orderkey"], VALUES, "period", 2000)
    return _metrics(diff, checks.immutability_verdict())


@query("immutability_mixed_types", SNAPSHOT_SQL + _snapshot_metrics("WHERE period < 2000", "p + s") + """
SELECT *, CASE WHEN value_mismatches + source_only = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def immutability_mixed_types(s, d):
    """The baseline's period is padded text, the current one's a number; both are before 2000 alike."""
    base, now = snapshots(s, d)
    base = base.withColumn("period", F.concat(F.lit("0"), F.col("period").cast("string"), F.lit(" ")))
    diff = checks.immutability(base, now, ["o_orderkey"], VALUES, "period", 2000)
    return _metrics(diff, checks.immutability_verdict())


@query("incremental_delta", SNAPSHOT_SQL + _snapshot_metrics("", "s") + """
SELECT *, CASE WHEN value_mismatches + source_only = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def incremental_delta(s, d):
    base, now = snapshots(s, d)
    diff = checks.incremental(base, now, ["o_orderkey"], VALUES, ["o_totalprice"])
    return _metrics(diff, checks.incremental_verdict())


@query("cross_source", SNAPSHOT_SQL + _snapshot_metrics("", "p + s") + """
SELECT *, CASE WHEN value_mismatches = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def cross_source(s, d):
    base, now = snapshots(s, d)
    second = now.withColumnsRenamed({"o_orderkey": "order_no", "o_totalprice": "total"})
    diff = checks.cross_source(base, second, ["o_orderkey"], VALUES,
                               {"order_no": "o_orderkey", "total": "o_totalprice"})
    return _metrics(diff, checks.cross_source_verdict())


LINE = ["l_orderkey", "l_linenumber"]


@query("dedup_summary", """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS duplicate_keys,
  CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM g)
SELECT *, CASE WHEN duplicate_keys = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def dedup_summary(s, d):
    return checks.dedup_summary(table(s, d, "lineitem"), LINE)


@query("dedup_keys", """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def dedup_keys(s, d):
    return checks.dedup_keys(table(s, d, "lineitem"), LINE)


@query("dedup_rows", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def dedup_rows(s, d):
    return checks.dedup_rows(table(s, d, "lineitem").select(*LINE, "l_partkey", "l_suppkey"), LINE)


@query("dedup_rows_settled", SQL["dedup_rows"])
def dedup_rows_settled(s, d):
    """As a run lists them: the repeated keys are settled first."""
    return checks.dedup_rows(table(s, d, "lineitem").select(*LINE, "l_partkey", "l_suppkey"), LINE, stored)


@query("null_defaulting", PAIR + """,
s AS (SELECT 'o_totalprice' AS "column", '0.0' AS default_value,
    avg((o_totalprice = 0)::INT) AS share, count(*) FILTER (o_totalprice IS NULL) AS null_count FROM tgt
  UNION ALL SELECT 'o_orderstatus', 'F', avg((o_orderstatus = 'F')::INT), 0 FROM tgt
  UNION ALL SELECT 'half', 'x', avg((o_orderkey % 3 <> 0)::INT), 0 FROM tgt)
SELECT "column", default_value, round(share, 4) AS default_share, CAST(null_count AS BIGINT) AS null_count,
  share >= 0.5 AND null_count = 0 AS flagged,
  CASE WHEN share >= 0.5 AND null_count = 0 THEN 'WARN' ELSE 'PASS' END AS status FROM s""")
def null_defaulting(s, d):
    target = seeds.orders_target(s, d).withColumn("half", F.when(~every(3), " x ").otherwise("y"))
    return checks.default_shares(target, {"o_totalprice": 0.0, "o_orderstatus": "F", "half": "x"})


@query("zero_vs_null", PAIR + """,
c AS (SELECT 'o_totalprice' AS "column", count(*) FILTER (o_totalprice = 0) AS target_zeros,
  count(*) FILTER (o_totalprice IS NULL) AS target_nulls,
  count(*) FILTER (o_totalprice = 0 AND o_orderkey IN
    (SELECT o_orderkey FROM src WHERE o_totalprice IS NULL)) AS null_source_zero_target FROM tgt)
SELECT *, CASE WHEN null_source_zero_target = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def zero_vs_null(s, d):
    return checks.zero_vs_null(seeds.orders_source(s, d), seeds.orders_target(s, d),
                               ["o_orderkey"], ["o_totalprice"])


@query("zero_vs_null_rows", PAIR + """
SELECT o_orderkey, 'o_totalprice' AS "column" FROM tgt
WHERE o_totalprice = 0 AND o_orderkey IN (SELECT o_orderkey FROM src WHERE o_totalprice IS NULL)""")
def zero_vs_null_rows(s, d):
    return checks.zero_vs_null_rows(seeds.orders_source(s, d), seeds.orders_target(s, d),
                                    ["o_orderkey"], ["o_totalprice"])


@query("aggregate_variance", PAIR + f""",
t AS (SELECT (SELECT coalesce(sum({sql_number('o_totalprice')}), 0) FROM src) AS s,
  (SELECT sum(o_totalprice) FROM tgt) AS t)
SELECT 'o_totalprice' AS "column", round(s, 2) AS source_sum, round(t, 2) AS target_sum,
  round(t - s, 2) AS abs_diff, round(abs(t - s) / abs(s), 8) AS rel_variance,
  abs(t - s) / abs(s) <= 0.0001 AS within_threshold,
  CASE WHEN abs(t - s) / abs(s) <= 0.0001 THEN 'PASS' ELSE 'FAIL' END AS status FROM t""")
def aggregate_variance(s, d):
    df = checks.aggregate_variance(seeds.orders_source(s, d), seeds.orders_target(s, d),
                                   ["o_totalprice"])
    return rounded(rounded(df, "source_sum", "target_sum", "abs_diff"), "rel_variance", digits=8)


@query("lineage_populated", """
SELECT 'source' AS "column", count(*) FILTER (source IS NULL OR lower(trim(source)) IN
    ('', 'null', 'none', 'nan', 'na', 'n/a', '<null>', '(null)')) AS null_count, count(*) AS rows,
  CASE WHEN count(*) FILTER (source IS NULL OR lower(trim(source)) IN
    ('', 'null', 'none', 'nan', 'na', 'n/a', '<null>', '(null)')) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM documents
UNION ALL
SELECT 'loaded', count(*) FILTER (doc_id % 19 = 0), count(*),
  CASE WHEN count(*) FILTER (doc_id % 19 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END FROM documents""")
def lineage_populated(s, d):
    documents = table(s, d, "documents").withColumn(
        "loaded", F.when(~every(19, "doc_id"), F.lit("2026-01-01")))
    return checks.null_counts(documents, ["source", "loaded"]) \
        .withColumn("status", checks.verdict(F.col("null_count") == 0))
