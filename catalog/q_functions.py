"""Registered queries over the scalar functions, each on every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.seeds import every, sql_nullish, sql_number, sql_text, table
from tallymark.functions import normalize as nz
from tallymark.functions import scalars as sc
from tallymark.functions.normalize import Norm

QUERIES, SQL = {}, {}
TEXT = T.StringType()


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def by_key(column: str, values: list, otherwise):
    """A text chosen by key: the i-th value where key % (len + 1) = i, as Spark column."""
    texts = F.array(*[F.lit(v).cast("string") for v in values])
    place = (F.col(column) % (len(values) + 1)).cast("int")
    return F.when(place < len(values), F.get(texts, place)).otherwise(otherwise)


def by_key_sql(column: str, values: list, otherwise: str) -> str:
    n = len(values) + 1
    cases = " ".join(
        f"WHEN {column} % {n} = {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values))
    return f"CASE {cases} ELSE {otherwise} END"


NULLS = [None, "", "  ", " NULL ", "None", "NaN", "na", "N/A", "<null>", "(null)", "0", "abc"]
AMOUNTS = ["1,250,000.00", "$3,000", "", "abc", "0", "-", "12d", " 7.5 ", "1e3", "€ 12", ".5",
           "5.", "£1,2", "-3", "+4", "1-2", "0x1p3", None]
FLAGS = ["TRUE", " t ", "Yes", "y", "1", "1.0", "false", "F", "no", "N", "0", "0.0", "maybe", "", None]
DAYS = ["2026-03-31", "3/31/2026", "2026/03/31", "20260331", "31-Mar-2026", "2026-13-01", "soon",
        "", None, "2026-03-31 10:20:30", "2026-03-31T10:20:30+02:00"]
DAYS_READ = ["2026-03-31"] * 5 + [None] * 4 + ["2026-03-31"] * 2


@query("norm_nullish", f"""
SELECT o_orderkey, {sql_nullish('v')} AS is_null FROM (
  SELECT o_orderkey, {by_key_sql('o_orderkey', NULLS, 'o_orderpriority')} AS v FROM orders)""")
def norm_nullish(s, d):
    v = by_key("o_orderkey", NULLS, F.col("o_orderpriority"))
    return table(s, d, "orders").select("o_orderkey", v.alias("v")).select(
        "o_orderkey", nz.nullish(F.col("v"), TEXT).alias("is_null"))


@query("norm_string", f"""
SELECT doc_id, md5({sql_text('v')}) AS digest FROM (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN chr(9) || '  ' || text || chr(10)
    WHEN doc_id % 5 = 0 THEN ' None ' ELSE text END AS v FROM documents)""")
def norm_string(s, d):
    v = F.when(every(3, "doc_id"), F.concat(F.lit("\t  "), "text", F.lit("\n"))) \
        .when(every(5, "doc_id"), " None ").otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", v.alias("v")).select(
        "doc_id", F.md5(nz.text(F.col("v"), TEXT)).alias("digest"))


@query("norm_numeric", f"""
SELECT o_orderkey, {sql_number('v')} AS amount FROM (
  SELECT o_orderkey, {by_key_sql('o_orderkey', AMOUNTS, "format('{:,.2f}', o_totalprice)")} AS v
  FROM orders)""")
def norm_numeric(s, d):
    v = by_key("o_orderkey", AMOUNTS, F.format_number("o_totalprice", 2))
    return table(s, d, "orders").select("o_orderkey", v.alias("v")).select(
        "o_orderkey", nz.number(F.col("v"), TEXT).alias("amount"))


@query("norm_datetime", f"""
SELECT o_orderkey, {by_key_sql('o_orderkey', DAYS_READ, "strftime(o_orderdate, '%Y-%m-%d')")} AS day
FROM orders""")
def norm_datetime(s, d):
    v = by_key("o_orderkey", DAYS, F.col("o_orderdate").cast("string"))
    return table(s, d, "orders").select("o_orderkey", v.alias("v")).select(
        "o_orderkey", nz.moment(F.col("v"), TEXT).cast("string").alias("day"))


# Years 1 to 9999, a date of every month, in five ways to write it; every eleventh is none.
_ANY_DAY = "make_date(1 + CAST(o_orderkey * 37 % 9999 AS INTEGER), 1 + CAST(o_orderkey % 12 AS INTEGER), 1 + CAST(o_orderkey % 28 AS INTEGER))"


@query("norm_datetime_range", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime({_ANY_DAY}, '%Y-%m-%d') END AS day FROM orders""")
def norm_datetime_range(s, d):
    key = F.col("o_orderkey")
    year, month, day = (F.lpad((1 + x).cast("string"), n, "0") for x, n in (
        (key * 37 % 9999, 4), (key % 12, 2), (key % 28, 2)))
    names = F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    name = F.get(names, (key % 12).cast("int"))
    ways = [F.concat_ws("-", year, month, day), F.concat_ws("/", month, day, year), F.concat(year, month, day),
            F.concat_ws("-", day, name, year), F.concat(F.concat_ws("/", year, month, day), F.lit(" "))]
    v = F.get(F.array(*ways), (key % 5).cast("int"))
    v = F.when(key % 11 == 0, F.concat_ws("-", year, F.lit("13"), day)).otherwise(v)
    return table(s, d, "orders").select("o_orderkey", v.alias("v")).select(
        "o_orderkey", F.date_format(nz.moment(F.col("v"), TEXT), "yyyy-MM-dd").alias("day"))


@query("norm_bool", f"""
SELECT o_orderkey, CASE WHEN v IS NULL OR t = '' THEN NULL
  WHEN t IN ('true','t','yes','y','1','1.0') THEN 'true'
  WHEN t IN ('false','f','no','n','0','0.0') THEN 'false' ELSE t END AS flag FROM (
  SELECT *, lower(trim(v)) AS t FROM (
    SELECT o_orderkey, {by_key_sql('o_orderkey', FLAGS, 'o_orderstatus')} AS v FROM orders))""")
def norm_bool(s, d):
    v = by_key("o_orderkey", FLAGS, F.col("o_orderstatus"))
    return table(s, d, "orders").select("o_orderkey", v.alias("v")).select(
        "o_orderkey", nz.flag(F.col("v"), TEXT).alias("flag"))


@query("tolerance_equal", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL
    ELSE abs(a - b) <= greatest(0.5, 0.001 * greatest(abs(a), abs(b))) END AS same
FROM (SELECT *, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS a,
    CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_extendedprice + l_quantity END AS b FROM lineitem)""")
def tolerance_equal(s, d):
    norm = Norm(kind="numeric", numeric_tolerance=0.5, relative_tolerance=0.001)
    a = F.when(~every(9, "l_orderkey"), F.col("l_extendedprice"))
    b = F.when(~every(6, "l_orderkey"), F.col("l_extendedprice") + F.col("l_quantity"))
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nz.same(a, b, norm).alias("same"))


@query("name_slug", """
SELECT url, substring(regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g'), 1, 50) AS slug FROM pages""")
def name_slug(s, d):
    return table(s, d, "pages").select("url", sc.slug(F.col("url")).alias("slug"))


@query("quarter_end_plus_n", """
SELECT o_orderkey, CAST(CAST(date_trunc('quarter', o_orderdate + INTERVAL 1 DAY) AS DATE) - 1 + 6
  AS VARCHAR) AS run_day FROM orders""")
def quarter_end_plus_n(s, d):
    day = sc.quarter_end_plus(F.col("o_orderdate").cast("date"), 6)
    return table(s, d, "orders").select("o_orderkey", day.cast("string").alias("run_day"))


WORDS = ["p1", " P-2 ", "show stopper", "Critical", "3", "minor", "unknown", None, "critical-blocker"]
LEVELS = ["P1", "P2", "P1", "P2", "P3", "P4", "P3", "P3", "P1"]


@query("severity_coerce", f"""
SELECT event_id, {by_key_sql('event_id', LEVELS, "'P4'")} AS severity FROM events""")
def severity_coerce(s, d):
    word = by_key("event_id", WORDS, F.lit("MEDIUM"))
    return table(s, d, "events").select("event_id", word.alias("w")).select(
        "event_id", sc.severity(F.col("w")).alias("severity"))
