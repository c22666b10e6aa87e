"""Registered queries over sources and sinks; files are written from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import seeds
from catalog.q_diff import orders_diff
from catalog.seeds import every, table
from tallymark.operators.checks import row_count
from tallymark.session import shared_folder
from tallymark.sources import profiles, readers, sinks
from tallymark.sources.readers import Dataset
from tallymark.spec import mapping_from_dict

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def _texts(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("scan_delimited", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
  CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_name || ', "x"' END AS c_name,
  c_mktsegment FROM customer""")
def scan_delimited(s, d):
    """A semicolon file of quoted names with two sorts of missing values."""
    folder = shared_folder(s)
    named = F.when(every(7, "c_custkey"), "N/A").when(every(5, "c_custkey"), "missing") \
        .otherwise(F.concat("c_name", F.lit(', "x"')))
    (table(s, d, "customer").select("c_custkey", named.alias("c_name"), "c_mktsegment")
     .write.option("header", True).option("sep", ";").option("escape", '"').csv(folder))
    return readers.read_delimited(s, f"{folder}/*.csv", sep=";", na_values=["missing"],
                                  same_header=True).drop(readers.SOURCE_FILE)


@query("scan_glob_lineage", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS brand, CAST(NULL AS VARCHAR) AS city,
  true AS from_csv FROM part
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL, 'n' || s_nationkey, true FROM supplier""")
def scan_glob_lineage(s, d):
    """Two feeds with different headers below one glob, united by column name."""
    folder = shared_folder(s)
    table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                               F.col("p_brand").alias("brand")) \
        .write.option("header", True).csv(f"{folder}/feed_parts")
    table(s, d, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("city"),
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")) \
        .write.option("header", True).csv(f"{folder}/feed_suppliers")
    df = readers.read_delimited(s, f"{folder}/feed_*/*.csv")
    return df.select("id", "name", "brand", "city",
                     F.col(readers.SOURCE_FILE).endswith(".csv").alias("from_csv"))


@query("scan_glob_many_headers", """
SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS priority, CAST(o_orderkey % 40 AS VARCHAR) AS extra,
  CAST(count(*) OVER (PARTITION BY o_orderkey % 40) AS BIGINT) AS rows_of_file FROM orders""")
def scan_glob_many_headers(s, d):
    """Forty headers below one glob: columns in four orders, and one column that no other file has."""
    folder, feed = shared_folder(s), F.pmod(F.col("o_orderkey"), F.lit(40))
    names, cells = F.array(*map(F.lit, ("key", "customer", "status", "priority"))), F.array(
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus",
        F.when(every(9), F.lit("n/a")).otherwise(F.col("o_orderpriority")))

    def line(values, last):
        turn = (F.col("feed") % 4).cast("int")
        return F.concat_ws(",", F.slice(values, turn + 1, 4 - turn), F.slice(values, F.lit(1), turn), last)

    rows = table(s, d, "orders").withColumn("feed", feed).select(
        "feed", F.lit(1).alias("at"), line(cells, F.col("feed").cast("string")).alias("value"))
    heads = rows.select("feed").distinct().select(
        "feed", F.lit(0).alias("at"), line(names, F.concat(F.lit("x"), F.col("feed").cast("string"))).alias("value"))
    (rows.unionByName(heads).repartition(40, "feed").sortWithinPartitions("feed", "at").drop("at")
     .write.partitionBy("feed").text(folder))
    df = readers.read_delimited(s, f"{folder}/feed=*/*.txt")
    own = F.coalesce(*[F.col(c) for c in df.columns if c.startswith("x")])
    files = df.groupBy(readers.SOURCE_FILE, own.alias("extra")).agg(F.count("*").alias("rows_of_file"))
    return (df.withColumn("extra", own).join(files, [readers.SOURCE_FILE, "extra"])
            .select("key", "customer", "status", "priority", "extra", "rows_of_file"))


@query("scan_typed", """
SELECT CAST(p_partkey AS INTEGER) AS id, p_brand AS brand, CAST(NULL AS DOUBLE) AS balance, p_size > 10 AS flag,
  DATE '2024-02-01' AS day FROM part
UNION ALL SELECT CAST(s_suppkey AS INTEGER), NULL, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END, NULL,
  NULL FROM supplier""")
def scan_typed(s, d):
    """Two feeds below one glob, with types found over all their files; missing texts have none."""
    folder = shared_folder(s)
    table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"),
                               (F.col("p_size") > 10).alias("flag"), F.lit("2024-02-01").alias("day")) \
        .write.option("header", True).csv(f"{folder}/feed_parts")
    table(s, d, "supplier").select(
        F.when(every(7, "s_suppkey"), "N/A").otherwise(F.col("s_acctbal").cast("string")).alias("balance"),
        F.col("s_suppkey").alias("id")).write.option("header", True).csv(f"{folder}/feed_suppliers")
    df = readers.read_delimited(s, f"{folder}/feed_*/*.csv", dtype_str=False)
    return df.select("id", "brand", "balance", "flag", "day")


@query("scan_table", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def scan_table(s, d):
    """A table by its qualified name, narrowed to columns and a filter."""
    table(s, d, "orders").createOrReplaceGlobalTempView("tallymark_orders_by_name")
    return readers.read_dataset(s, Dataset(table="global_temp.tallymark_orders_by_name", where="o_orderstatus = 'F'",
                                           columns=["o_orderkey", "o_orderpriority"]))


@query("project_with_lineage", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, true AS has_file FROM orders
WHERE o_orderpriority <> '5-LOW'""")
def project_with_lineage(s, d):
    folder = shared_folder(s)
    table(s, d, "orders").write.option("header", True).csv(folder)
    df = readers.read_dataset(s, Dataset(
        path=f"{folder}/*.csv", columns=["o_orderkey", "o_orderpriority"],
        where="o_orderpriority <> '5-LOW'", options={"same_header": True}))
    return df.withColumn("has_file", F.col(readers.SOURCE_FILE).isNotNull()) \
        .drop(readers.SOURCE_FILE)


@query("union_tagged_parts", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance,
  'customers' AS __sheet FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, 'suppliers' FROM supplier""")
def union_tagged_parts(s, d):
    return readers.union_parts({
        "customers": table(s, d, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment")),
        "suppliers": table(s, d, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
            F.col("s_acctbal").alias("balance"))})


@query("sql_dataset", """
SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders
WHERE o_orderstatus = 'F' GROUP BY 1""")
def sql_dataset(s, d):
    """Query text wins over the table, and reads a view like any table."""
    table(s, d, "orders").createOrReplaceTempView("tallymark_orders")
    return readers.read_dataset(s, Dataset(table="no_such_table", query="""
        SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
        FROM tallymark_orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"""))


@query("capped_sample", """
WITH p(cap) AS (VALUES (1000), (20000), (10000000))
SELECT CAST(cap AS INTEGER) AS cap, least(cap, (SELECT count(*) FROM lineitem)) AS sampled,
  cap < (SELECT count(*) FROM lineitem) AS refused,
  least(cap, (SELECT count(*) FROM lineitem)) AS known FROM p""")
def capped_sample(s, d):
    """Both forms of the row cap: a sample where that is allowed, otherwise an error beyond the cap."""
    lines, caps = table(s, d, "lineitem"), (1_000, 20_000, 10_000_000)

    def refused(cap: int) -> bool:
        try:
            readers.capped(lines, cap)
        except readers.DatasetError:
            return True
        return False

    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    sides = ["given", *(f"in_{cap}" for cap in caps)]

    def marked(df, side: str):
        return df.select(*keys, *[F.lit(int(side == x)).cast("bigint").alias(x) for x in sides])

    # The table meets all samples in one shuffle; a sample leaves the one task that cut it before it is folded.
    samples = [marked(readers.capped(lines, cap, allow_truncation=True).select(*keys).repartition(*keys), f"in_{cap}")
               for cap in caps]
    met = readers.union_by_name([marked(lines, "given"), *samples]).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in sides])
    told = met.agg(*[F.struct(
        F.coalesce(F.sum(f"in_{cap}"), F.lit(0)).alias("sampled"), F.lit(cap).alias("cap"), F.lit(refused(cap)).alias("refused"),
        F.coalesce(F.sum(F.when(F.col("given") > 0, F.col(f"in_{cap}"))), F.lit(0)).cast("int").alias("known")).alias(f"in_{cap}")
        for cap in caps])
    return told.select(F.inline(F.array(*sides[1:])))


MAPPING = mapping_from_dict({"tables": [{
    "target_table": "customer_dim", "source_object": "customer", "key_columns": "customer_id",
    "columns": [
        {"source_column": "c_custkey", "target_column": "customer_id", "target_datatype": "BIGINT"},
        {"source_column": "c_name", "target_column": "customer_name"},
        {"source_column": "c_acctbal", "target_column": "balance", "target_datatype": "DECIMAL"}]}]})


@query("rename_to_target", """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey, c_acctbal AS balance, c_mktsegment
FROM customer""")
def rename_to_target(s, d):
    renames = MAPPING.tables["customer_dim"].source_to_target()
    return table(s, d, "customer").withColumnsRenamed(renames)


@query("side_filters", """
SELECT (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'F')
    AS source_rows,
  (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 1000)
    AS target_rows""")
def side_filters(s, d):
    orders = table(s, d, "orders")
    source = readers.filtered(orders, "o_orderdate >= '1998-01-01' and o_orderstatus = 'F'")
    target = readers.filtered(orders, "o_orderdate >= '1998-01-01' and o_totalprice > 1000")
    return row_count(source, target).select("source_rows", "target_rows")


@query("evidence_sink", seeds.ORDERS_DIFF_SQL + """
SELECT 'reconciliation' AS check_name, 'mismatch' AS finding, count(*) FILTER (d1) + count(*) FILTER (d0)
  + count(*) FILTER (d2) + count(*) FILTER (d3) + count(*) FILTER (d4) AS rows FROM d
UNION ALL SELECT 'reconciliation', 'source_only', count(*) FROM su ANTI JOIN tu USING (o_orderkey)
UNION ALL SELECT 'reconciliation', 'target_only', count(*) FROM tu ANTI JOIN su USING (o_orderkey)""")
def evidence_sink(s, d):
    """All findings of a comparison written in one pass and counted from storage."""
    folder = shared_folder(s)
    found = orders_diff(s, d).findings().withColumn("check_name", F.lit("reconciliation"))
    sinks.write_offenders(found, folder)
    return s.read.parquet(folder).groupBy("check_name", "finding").agg(F.count("*").alias("rows"))


@query("profile_incremental", """
SELECT count(*) AS rows, count(*) FILTER (l_orderkey % 7 = 0) AS null_flag, count(*) FILTER (l_returnflag = 'A' AND l_orderkey % 7 <> 0)
    AS default_flag, count(*) FILTER (l_orderkey % 13 = 0) AS bad_quantity, CAST(sum(l_partkey) AS BIGINT) AS partkeys
FROM lineitem""")
def profile_incremental(s, d):
    """Counters of a feed that came in three parts; each count reads only the files that are new."""
    lines = table(s, d, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(~every(7, "l_orderkey"), F.col("l_returnflag")).alias("flag"),
        F.when(every(13, "l_orderkey"), "many").otherwise(F.col("l_quantity").cast("string")).alias("quantity"))
    feed, counters = shared_folder(s), profiles.column_counters(
        lines, nulls=["flag"], kinds={"quantity": "numeric"}, defaults={"flag": "A"}, sums=["l_partkey"])
    profile = profiles.FileProfile(s, feed, shared_folder(s), counters)
    for part in range(3):
        lines.where(F.col("l_orderkey") % 3 == part).write.mode("append").parquet(feed)
        profile.refresh()
    return profile.totals().select("rows", F.col("null:flag").alias("null_flag"), F.col("default:flag").alias("default_flag"),
                                   F.col("bad:quantity").alias("bad_quantity"),
                                   F.col("sum:l_partkey").cast("bigint").alias("partkeys"))


@query("evidence_sorted", seeds.ORDERS_DIFF_SQL + """,
f AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM d, (VALUES (0), (1), (2), (3), (4)) w(i)
    WHERE list_extract([d0, d1, d2, d3, d4], i + 1)
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM su ANTI JOIN tu USING (o_orderkey)
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM tu ANTI JOIN su USING (o_orderkey)),
k AS (SELECT o_orderkey, count(*) AS rows FROM f GROUP BY 1)
SELECT o_orderkey, rows, sum(rows) OVER (ORDER BY o_orderkey) - rows AS first_place,
  sum(rows) OVER (ORDER BY o_orderkey) - 1 AS last_place FROM k""")
def evidence_sorted(s, d):
    """Findings written in order over six files: where the rows of every key lie, counted over all files."""
    folder = shared_folder(s)
    sinks.in_order(orders_diff(s, d).findings(), ["o_orderkey"], 6).write.parquet(folder)
    rows = s.read.parquet(folder).select("o_orderkey", F.col("_metadata.file_name").alias("file"),
                                         F.col("_metadata.row_index").alias("at"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at")
    return rows.join(files, "file").groupBy("o_orderkey").agg(
        F.count("*").alias("rows"), F.min(place).alias("first_place"), F.max(place).alias("last_place"))


@query("evidence_preview", seeds.ORDERS_DIFF_SQL + """,
n AS (SELECT count(*) FILTER (d0) + count(*) FILTER (d1) + count(*) FILTER (d2) + count(*) FILTER (d3)
  + count(*) FILTER (d4) AS total FROM d)
SELECT total AS preview_total, total > 500 AS preview_truncated, least(total, 500) AS shown FROM n""")
def evidence_preview(s, d):
    shown = sinks.preview(orders_diff(s, d).cells())
    return shown.groupBy("preview_total", "preview_truncated").agg(F.count("*").alias("shown"))
