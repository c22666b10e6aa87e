"""Test pairs derived from the given tables by key arithmetic.

The tables hold no defects, so each pair seeds them by rule over every row, once as a
DataFrame and once as SQL for the oracle. Both read the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAR = 10_000_000  # offset of keys and references that exist on one side only


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(n: int, key: str = "o_orderkey"):
    return F.col(key) % n == 0


# --- orders: source with text amounts and dates, target as loaded ------------------

def orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    dollars = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(~every(37), F.when(every(7), dollars).otherwise(price)).alias("o_totalprice"),
        F.when(every(5), F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("o_orderdate"),
        "o_orderpriority")


def orders_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    # offsets of the rows an order loads: itself, a copy for some, a stray key for some
    offsets = F.filter(F.array(F.lit(0), F.when(every(101), F.lit(0)),
                               F.when(every(89), F.lit(FAR))), lambda x: x.isNotNull())
    rows = (table(spark, sf_dir, "orders").where(~every(97))
            .withColumn("offset", F.explode(offsets)))
    return rows.select(
        (F.col("o_orderkey") + F.col("offset")).alias("o_orderkey"),
        F.when(every(61), F.col("o_custkey") + FAR).otherwise(F.col("o_custkey"))
        .alias("o_custkey"),
        F.when(every(2), F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
        .alias("o_orderstatus"),
        F.when(every(37), F.lit(0.0)).when(every(53), F.col("o_totalprice") + 1.0)
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(every(31), F.lit(" N/A ")).otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"))


ORDERS_PAIR_SQL = f"""
src AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL
         WHEN o_orderkey % 7 = 0 THEN '$' || format('{{:,.2f}}', o_totalprice)
         ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS o_totalprice,
    CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
    o_orderpriority
  FROM orders),
loaded AS (
  SELECT *, 0 AS shift FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL SELECT *, 0 FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 101 = 0
  UNION ALL SELECT *, {FAR} FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0),
tgt AS (
  SELECT o_orderkey + shift AS o_orderkey,
    CASE WHEN o_orderkey % 61 = 0 THEN o_custkey + {FAR} ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 37 = 0 THEN 0.0 WHEN o_orderkey % 53 = 0 THEN o_totalprice + 1.0
         ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 31 = 0 THEN ' N/A ' ELSE o_orderpriority END AS o_orderpriority
  FROM loaded)"""


# --- lineitem: two loads of a table with a four-column key ---------------------------

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def lineitem_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(~every(83, "l_orderkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(every(47, "l_orderkey"), F.col("l_quantity") + 1.0)
        .otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        F.when(every(29, "l_orderkey"), F.lower("l_returnflag"))
        .when(every(59, "l_orderkey"), F.lit("X"))
        .otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate")


LINEITEM_PAIR_SQL = """
bef AS (SELECT * FROM lineitem),
aft AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_orderkey % 47 = 0 THEN l_quantity + 1.0 ELSE l_quantity END AS l_quantity,
    l_extendedprice, l_discount, l_tax,
    CASE WHEN l_orderkey % 29 = 0 THEN lower(l_returnflag)
         WHEN l_orderkey % 59 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag,
    l_linestatus, l_shipdate
  FROM lineitem WHERE l_orderkey % 83 <> 0)"""


# --- SQL forms of the normalisation ---------------------------------------------------

_SPACES = " || ".join(["' '", "chr(9)", "chr(10)", "chr(13)"])
_NULL_LIST = "('', 'null', 'none', 'nan', 'na', 'n/a', '<null>', '(null)')"


def sql_trim(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def sql_nullish(x: str) -> str:
    return f"({x} IS NULL OR lower({sql_trim(x)}) IN {_NULL_LIST})"


def sql_text(x: str) -> str:
    return f"(CASE WHEN NOT {sql_nullish(x)} THEN replace(lower({sql_trim(x)}), 'ß', 'ss') END)"


def sql_number(x: str, marks: str = ",$€£") -> str:
    t = sql_trim(f"translate({sql_trim(x)}, '{marks}', '')")
    pattern = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"(CASE WHEN regexp_full_match({t}, '{pattern}') THEN CAST({t} AS DOUBLE) END)"


def sql_day(x: str) -> str:
    return (f"(CASE WHEN {x} LIKE '____-__-__' THEN CAST(TRY_CAST({x} AS DATE) AS VARCHAR) "
            f"ELSE CAST(CAST(try_strptime({x}, '%m/%d/%Y') AS DATE) AS VARCHAR) END)")


# Both sides of the orders pair in comparable form, grouped by key. ``p`` has one row per
# key with its row count per side and, for single rows, the values per side.
ORDERS_DIFF_SQL = f"""WITH {ORDERS_PAIR_SQL},
ns AS (SELECT o_orderkey, o_custkey, {sql_text('o_orderstatus')} AS o_orderstatus,
         {sql_number('o_totalprice')} AS o_totalprice, {sql_day('o_orderdate')} AS o_orderdate,
         {sql_text('o_orderpriority')} AS o_orderpriority FROM src),
nt AS (SELECT o_orderkey, o_custkey, {sql_text('o_orderstatus')} AS o_orderstatus, o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
         {sql_text('o_orderpriority')} AS o_orderpriority FROM tgt),
su AS (SELECT * FROM ns QUALIFY count(*) OVER (PARTITION BY o_orderkey) = 1),
tu AS (SELECT * FROM nt QUALIFY count(*) OVER (PARTITION BY o_orderkey) = 1),
m AS (SELECT s.o_orderkey,
    s.o_custkey AS s0, t.o_custkey AS t0, s.o_orderstatus AS s1, t.o_orderstatus AS t1,
    s.o_totalprice AS s2, t.o_totalprice AS t2, s.o_orderdate AS s3, t.o_orderdate AS t3,
    s.o_orderpriority AS s4, t.o_orderpriority AS t4
  FROM su s JOIN tu t ON s.o_orderkey = t.o_orderkey),
d AS (SELECT *, s0 IS DISTINCT FROM t0 AS d0, s1 IS DISTINCT FROM t1 AS d1,
    s2 IS DISTINCT FROM t2 AS d2, s3 IS DISTINCT FROM t3 AS d3,
    s4 IS DISTINCT FROM t4 AS d4 FROM m)"""

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
