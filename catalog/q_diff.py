"""Registered queries over the keyed comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import seeds
from tallymark.functions.normalize import Norm
from tallymark.operators.diff import keyed_diff
from tallymark.operators.digests import pruned
from tallymark.operators.layout import laid_out
from tallymark.session import shared_folder, stored

QUERIES, SQL = {}, {}

PRICE = {"o_totalprice": Norm(kind="numeric")}


def orders_diff(spark, d, columns=seeds.ORDER_COLUMNS):
    return keyed_diff(seeds.orders_source(spark, d), seeds.orders_target(spark, d),
                      ["o_orderkey"], columns, PRICE)


def lineitem_diff(spark, d):
    return keyed_diff(seeds.lineitem_before(spark, d), seeds.lineitem_after(spark, d),
                      seeds.LINE_KEY)


QUERIES["diff_summary"] = lambda s, d: orders_diff(s, d).summary()
SQL["diff_summary"] = seeds.ORDERS_DIFF_SQL + """,
c AS (SELECT
    (SELECT count(*) FROM ns) AS source_total, (SELECT count(*) FROM nt) AS target_total,
    (SELECT count(*) FROM d) AS matched_keys,
    (SELECT count(*) FROM d WHERE NOT (d0 OR d1 OR d2 OR d3 OR d4)) AS values_matched,
    (SELECT CAST(coalesce(sum(d0::INT + d1::INT + d2::INT + d3::INT + d4::INT), 0) AS BIGINT) FROM d)
      AS value_mismatches,
    (SELECT count(*) FROM su WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tu)) AS source_only,
    (SELECT count(*) FROM tu WHERE o_orderkey NOT IN (SELECT o_orderkey FROM su)) AS target_only,
    (SELECT count(*) FROM (SELECT o_orderkey FROM ns GROUP BY 1 HAVING count(*) > 1)) AS source_dup_keys,
    (SELECT count(*) FROM (SELECT o_orderkey FROM nt GROUP BY 1 HAVING count(*) > 1)) AS target_dup_keys,
    (SELECT count(*) FROM d WHERE d0 OR d1 OR d2 OR d3 OR d4) AS mismatched_rows)
SELECT *, (value_mismatches + source_only + target_only + source_dup_keys + target_dup_keys) = 0
  AS is_clean FROM c"""

QUERIES["diff_outer_join"] = lambda s, d: (
    (lambda x: x.pairs.select(
        F.col("k0").alias("o_orderkey"),
        F.when(x.matched, "both").when(x.only_source, "left_only")
        .when(x.only_target, "right_only").alias("side")).where("side IS NOT NULL"))(
        orders_diff(s, d, [])))
SQL["diff_outer_join"] = seeds.ORDERS_DIFF_SQL + """
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
  CASE WHEN t.o_orderkey IS NULL THEN 'left_only' WHEN s.o_orderkey IS NULL THEN 'right_only'
       ELSE 'both' END AS side
FROM su s FULL JOIN tu t ON s.o_orderkey = t.o_orderkey"""

_SHOWN = """coalesce(CAST(o_custkey AS VARCHAR), '(null)') AS o_custkey,
  coalesce(o_orderstatus, '(null)') AS o_orderstatus, {price} AS o_totalprice,
  coalesce(o_orderdate, '(null)') AS o_orderdate,
  coalesce(o_orderpriority, '(null)') AS o_orderpriority"""
_PRICE_NUMBER = "TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE)"
_KEY = "CAST(o_orderkey AS VARCHAR) AS o_orderkey, "


def _with_price(df, column="o_totalprice"):
    """Shown amounts back as numbers, since engines print floats differently."""
    return df.withColumn(column, F.col(column).try_cast("double"))


QUERIES["diff_source_only"] = lambda s, d: _with_price(orders_diff(s, d).source_only())
SQL["diff_source_only"] = seeds.ORDERS_DIFF_SQL + f"""
SELECT {_KEY}{_SHOWN.format(price=_PRICE_NUMBER)} FROM su
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM tu)"""

QUERIES["diff_target_only"] = lambda s, d: _with_price(orders_diff(s, d).target_only())
SQL["diff_target_only"] = seeds.ORDERS_DIFF_SQL + f"""
SELECT {_KEY}{_SHOWN.format(price=_PRICE_NUMBER)} FROM tu
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM su)"""

QUERIES["diff_duplicate_keys"] = lambda s, d: _with_price(orders_diff(s, d).duplicates())
SQL["diff_duplicate_keys"] = seeds.ORDERS_DIFF_SQL + f"""
SELECT 'source' AS side, {_KEY}{_SHOWN.format(price=_PRICE_NUMBER)} FROM ns
WHERE o_orderkey IN (SELECT o_orderkey FROM ns GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT 'target', {_KEY}{_SHOWN.format(price=_PRICE_NUMBER)} FROM nt
WHERE o_orderkey IN (SELECT o_orderkey FROM nt GROUP BY 1 HAVING count(*) > 1)"""

QUERIES["diff_cells"] = lambda s, d: orders_diff(s, d).cells().select(
    "o_orderkey", "column",
    F.when(F.col("column") != "o_totalprice", F.col("source_value")).alias("source_value"),
    F.when(F.col("column") != "o_totalprice", F.col("target_value")).alias("target_value"),
    F.when(F.col("column") == "o_totalprice", F.col("source_value").try_cast("double"))
    .alias("source_amount"),
    F.when(F.col("column") == "o_totalprice", F.col("target_value").try_cast("double"))
    .alias("target_amount"))
SQL["diff_cells"] = seeds.ORDERS_DIFF_SQL + " UNION ALL ".join(
    (f"\nSELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '{c}' AS \"column\", " + (
        f"CAST(NULL AS VARCHAR) AS source_value, CAST(NULL AS VARCHAR) AS target_value, "
        f"s{i} AS source_amount, t{i} AS target_amount FROM d WHERE d{i}"
        if c == "o_totalprice" else
        f"coalesce(CAST(s{i} AS VARCHAR), '(null)') AS source_value, "
        f"coalesce(CAST(t{i} AS VARCHAR), '(null)') AS target_value, "
        f"CAST(NULL AS DOUBLE) AS source_amount, CAST(NULL AS DOUBLE) AS target_amount "
        f"FROM d WHERE d{i}"))
    for i, c in enumerate(seeds.ORDER_COLUMNS))

QUERIES["diff_column_counts"] = lambda s, d: orders_diff(s, d).column_counts()
SQL["diff_column_counts"] = seeds.ORDERS_DIFF_SQL + " UNION ALL ".join(
    f"\nSELECT '{c}' AS \"column\", count(*) AS mismatches FROM d WHERE d{i} HAVING count(*) > 0"
    for i, c in enumerate(seeds.ORDER_COLUMNS))

# The limit is the feature: a stable preview of the first findings.
QUERIES["diff_sample"] = lambda s, d: orders_diff(s, d).sample().select(
    "o_orderkey", "finding", "column")
SQL["diff_sample"] = seeds.ORDERS_DIFF_SQL + ", f AS (" + " UNION ALL ".join(
    f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'mismatch' AS finding, '{c}' AS \"column\" "
    f"FROM d WHERE d{i}" for i, c in enumerate(seeds.ORDER_COLUMNS)) + """)
SELECT * FROM f ORDER BY o_orderkey, "column" LIMIT 100"""

QUERIES["reconciliation"] = lambda s, d: lineitem_diff(s, d).summary()
_LINE_TOTALS = f"""WITH {seeds.LINEITEM_PAIR_SQL},
n AS (SELECT 's' AS side, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    {seeds.sql_text('l_returnflag')} AS f FROM bef
  UNION ALL SELECT 't', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    {seeds.sql_text('l_returnflag')} FROM aft),
g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    count(*) FILTER (side = 's') AS ns, count(*) FILTER (side = 't') AS nt,
    max(l_quantity) FILTER (side = 's') AS sq, max(l_quantity) FILTER (side = 't') AS tq,
    max(f) FILTER (side = 's') AS sf, max(f) FILTER (side = 't') AS tf
  FROM n GROUP BY ALL)"""
SQL["reconciliation"] = _LINE_TOTALS + """,
c AS (SELECT CAST(sum(ns) AS BIGINT) AS source_total, CAST(sum(nt) AS BIGINT) AS target_total,
    count(*) FILTER (ns = 1 AND nt = 1) AS matched_keys,
    count(*) FILTER (ns = 1 AND nt = 1 AND sq = tq AND sf = tf) AS values_matched,
    count(*) FILTER (ns = 1 AND nt = 1 AND sq <> tq)
      + count(*) FILTER (ns = 1 AND nt = 1 AND sf <> tf) AS value_mismatches,
    count(*) FILTER (ns = 1 AND nt <> 1) AS source_only,
    count(*) FILTER (nt = 1 AND ns <> 1) AS target_only,
    count(*) FILTER (ns > 1) AS source_dup_keys, count(*) FILTER (nt > 1) AS target_dup_keys,
    count(*) FILTER (ns = 1 AND nt = 1 AND (sq <> tq OR sf <> tf)) AS mismatched_rows FROM g)
SELECT *, (value_mismatches + source_only + target_only + source_dup_keys + target_dup_keys) = 0
  AS is_clean FROM c"""

# The same comparison after digests have settled the leaves without a change.
QUERIES["reconciliation_pruned"] = lambda s, d: pruned(lineitem_diff(s, d), stored, leaf_rows=8).diff.summary()
SQL["reconciliation_pruned"] = SQL["reconciliation"]

# The same comparison over both sides laid out in buckets by key.
QUERIES["reconciliation_bucketed"] = lambda s, d: laid_out(lineitem_diff(s, d), shared_folder(s), 8).summary()
SQL["reconciliation_bucketed"] = SQL["reconciliation"]


def _one_sided_sql(moved: str, both: str) -> str:
    return f"""
SELECT count(*) AS source_total, count(*) FILTER (NOT {both}) AS target_total,
  count(*) FILTER (NOT ({moved}) AND NOT {both}) AS matched_keys,
  count(*) FILTER ({moved} OR {both}) AS source_only,
  count(*) FILTER ({moved} AND NOT {both}) AS target_only FROM orders"""


def _key_counts(diff):
    return diff.totals().select("source_total", "target_total", "matched_keys", "source_only", "target_only")


def _moments(s, d):
    """Keys that are moments to the microsecond: one side as text, some a microsecond later, some gone."""
    orders = seeds.table(s, d, "orders")
    moment = F.timestamp_micros(F.col("o_orderkey") * 1_000_003 + F.lit(1_600_000_000_000_000)).cast("timestamp_ntz")
    shift = F.when(seeds.every(6), F.expr("INTERVAL '0.000001' SECOND")).otherwise(F.expr("INTERVAL '0' SECOND"))
    return keyed_diff(orders.select(moment.alias("at"), "o_orderstatus"),
                      orders.where(~seeds.every(10)).select((moment + shift).cast("string").alias("at"), "o_orderstatus"), ["at"])


def _decimals(s, d):
    """Keys of 28 digits: decimals against text with separators, some with another last digit, some gone."""
    orders = seeds.table(s, d, "orders")
    whole = F.col("o_orderkey").cast("decimal(38,0)") * F.lit("1000000000000000000").cast("decimal(38,0)") + F.lit(7)
    other = whole + F.when(seeds.every(6), 1).otherwise(0)
    return keyed_diff(orders.select(whole.cast("decimal(38,2)").alias("id"), "o_orderstatus"),
                      orders.where(~seeds.every(10)).select(F.concat(F.lit("$"), other.cast("string")).alias("id"), "o_orderstatus"),
                      ["id"], norms={"id": Norm(kind="numeric")})


QUERIES["diff_timestamp_keys"] = lambda s, d: _key_counts(_moments(s, d))
QUERIES["diff_decimal_keys"] = lambda s, d: _key_counts(_decimals(s, d))
SQL["diff_timestamp_keys"] = SQL["diff_decimal_keys"] = _one_sided_sql("o_orderkey % 6 = 0", "o_orderkey % 10 = 0")
