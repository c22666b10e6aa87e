"""Registered queries over whole runs: a mapping of orders and customers, checked in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import seeds
from catalog.q_checks import SNAPSHOT_SQL, snapshots
from catalog.seeds import table
from tallymark.operators.checks import DEFAULT_SHARE
from tallymark.plans.suite import CATEGORIES as ALL_CATEGORIES
from tallymark.plans.suite import Suite
from tallymark.session import shared_folder
from tallymark.sources import sinks
from tallymark.sources.connections import frames_connection
from tallymark.spec import mapping_from_dict, tab_from_dict

QUERIES, SQL = {}, {}

ORDERS = {
    "target_table": "orders_dim", "source_object": "orders_feed", "key_columns": ["o_orderkey"],
    "options": {"group_by": "o_orderpriority", "null_not_zero": ["o_totalprice"],
                "completeness": {"column": "o_orderpriority", "expected_values": ["1-URGENT"],
                                 "forbidden_values": ["9-OLD"]},
                "lineage_columns": ["o_orderpriority"]},
    "columns": [
        {"target_column": "o_orderkey", "source_column": "o_orderkey", "target_datatype": "BIGINT",
         "nullable": False},
        {"target_column": "o_custkey", "source_column": "o_custkey", "target_datatype": "BIGINT"},
        {"target_column": "o_orderstatus", "source_column": "o_orderstatus",
         "target_datatype": "VARCHAR", "default_value": "F"},
        {"target_column": "o_totalprice", "source_column": "o_totalprice",
         "target_datatype": "DECIMAL(15,2)", "transformation": "currency text to number"},
        {"target_column": "o_orderdate", "source_column": "o_orderdate", "target_datatype": "DATE"},
        {"target_column": "o_orderpriority", "source_column": "o_orderpriority",
         "target_datatype": "VARCHAR"}]}
CUSTOMERS = {"target_table": "customer_dim", "source_object": "customers",
             "key_columns": ["c_custkey"], "options": {"lineage_columns": []},
             "columns": [{"target_column": "c_custkey", "source_column": "c_custkey"},
                         {"target_column": "c_name", "source_column": "c_name"}]}
RULES = [
    {"rule_id": "B1", "target_table": "orders_dim", "rule_type": "range", "severity": "P2",
     "params": {"column": "o_totalprice", "min": 1}},
    {"rule_id": "B2", "target_table": "orders_dim", "rule_type": "not_null",
     "params": {"column": "o_orderpriority"}},
    {"rule_id": "B3", "target_table": "orders_dim", "rule_type": "unique",
     "params": {"columns": ["o_orderkey"]}},
    {"rule_id": "B4", "target_table": "orders_dim", "rule_type": "not_null",
     "params": {"column": "no_such_column"}}]
FOREIGN = [{"child_table": "orders_dim", "child_columns": ["o_custkey"],
            "parent_table": "customer_dim", "parent_columns": ["c_custkey"]}]
MAPPING = mapping_from_dict({"tables": [ORDERS, CUSTOMERS], "business_rules": RULES, "ref_integrity": FOREIGN})
TAB = tab_from_dict({
    "name": "Orders", "actual": {"table": "orders_dim"},
    "expected": {"table": "orders_feed", "connection": "source"},
    "key_columns": ["o_orderkey"], "compare_columns": ["o_custkey"]})


def suite(s, d) -> Suite:
    customers = table(s, d, "customer")
    return Suite(s, MAPPING,
                 frames_connection({"orders_dim": seeds.orders_target(s, d), "customer_dim": customers}),
                 frames_connection({"orders_feed": seeds.orders_source(s, d), "customers": customers}),
                 tabs=(TAB,))


CATEGORIES = ["row_count", "schema", "datatype", "completeness", "business_rules",
              "referential_integrity", "transformation", "deduplication", "null_handling",
              "reconciliation", "lineage", "report"]


def _suite_run(s, d):
    return suite(s, d).run(CATEGORIES).select("category", "name", "target_table", "status")


QUERIES["suite_run"] = _suite_run
# A rule on a column that does not exist is one ERROR row; the other rules still report.
QUERIES["check_isolation"] = lambda s, d: suite(s, d).run(
    ["business_rules"], ["orders_dim"]).select(
    "rule_id", "status", F.col("metrics")["checked_rows"].alias("checked_rows"),
    F.col("metrics")["violations"].alias("violations"))



def _same_id(s, d):
    """Two rules under one id, each with a verdict of its own."""
    rules = [{"rule_id": "B1", "target_table": "orders_dim", "rule_type": kind, "params": params} for kind, params in (
        ("range", {"column": "o_totalprice", "min": 1}), ("not_null", {"column": "o_orderpriority"}))]
    book = mapping_from_dict({"tables": [ORDERS], "business_rules": rules})
    both = Suite(s, book, frames_connection({"orders_dim": seeds.orders_target(s, d)}))
    return both.run(["business_rules"]).select(
        "rule_id", "name", "status", F.col("metrics")["violations"].cast("bigint").alias("violations"))


QUERIES["rule_same_id"] = _same_id
SQL["rule_same_id"] = f"""WITH {seeds.ORDERS_PAIR_SQL},
n AS (SELECT count(*) FILTER (o_totalprice IS NULL OR o_totalprice < 1) AS low,
  count(*) FILTER ({seeds.sql_nullish('o_orderpriority')}) AS nulls FROM tgt)
SELECT 'B1' AS rule_id, '[B1] range' AS name, CASE WHEN low > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  low AS violations FROM n
UNION ALL SELECT 'B1', '[B1] not_null', CASE WHEN nulls > 0 THEN 'FAIL' ELSE 'PASS' END, nulls FROM n"""


def _absent(s, d):
    """The type check of a feed in text that lacks a declared column."""
    feed = seeds.orders_source(s, d).drop("o_custkey").withColumn(
        "o_totalprice", F.when(seeds.every(41), F.lit("n.a.?")).otherwise(F.col("o_totalprice")))
    book = mapping_from_dict({"tables": [ORDERS | {"target_table": "feed"}]})
    found = Suite(s, book, frames_connection({"feed": feed})).run(["datatype"])
    metric = lambda name: F.col("metrics")[name]
    return found.select("status", *[metric(m).cast("bigint").alias(m) for m in ("typed_columns", "bad_columns", "bad_values")],
                        metric("absent_columns").alias("absent_columns"),
                        metric("bad:o_totalprice").cast("bigint").alias("bad_prices"))


QUERIES["datatype_absent_column"] = _absent
SQL["datatype_absent_column"] = f"""WITH {seeds.ORDERS_PAIR_SQL},
v AS (SELECT CASE WHEN o_orderkey % 41 = 0 THEN 'n.a.?' ELSE o_totalprice END AS price, o_orderdate AS day FROM src),
n AS (SELECT count(*) FILTER (NOT {seeds.sql_nullish('price')} AND {seeds.sql_number('price')} IS NULL) AS prices,
  count(*) FILTER (NOT {seeds.sql_nullish('day')} AND {seeds.sql_day('day')} IS NULL) AS days FROM v),
c AS (SELECT string_agg(c, ', ') AS absent FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderdate')) t(c)
  WHERE c NOT IN (SELECT column_name FROM (DESCRIBE SELECT * EXCLUDE (o_custkey) FROM orders)))
SELECT CASE WHEN prices + days > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(3 AS BIGINT) AS typed_columns,
  CAST((prices > 0)::INT + (days > 0)::INT AS BIGINT) AS bad_columns, prices + days AS bad_values,
  absent AS absent_columns, nullif(prices, 0) AS bad_prices FROM n, c"""


SNAPSHOT = {
    "target_table": "snap_dim", "source_object": "snap_feed", "key_columns": ["o_orderkey"],
    "columns": [{"target_column": c, "source_column": c} for c in ("o_orderkey", "o_orderstatus", "o_totalprice")],
    "options": {
        "historical": {"baseline": "before", "period_column": "period", "current_period": 2000,
                       "expected_periods": [1995, 1996, 2000, 2002]},
        "incremental": {"baseline": "before", "updatable_columns": ["o_totalprice"]},
        "cross_source": {"second_source": "second", "object": "other", "rename": {"order_no": "o_orderkey"}}}}


def _metrics(s, d):
    """All sixteen categories: status, severity, message and every metric of each check of one run."""
    base, now = snapshots(s, d)
    customers = table(s, d, "customer")
    rules = [r for r in RULES if r["rule_id"] != "B4"]
    whole = Suite(
        s, mapping_from_dict({"tables": [ORDERS, CUSTOMERS, SNAPSHOT], "business_rules": rules, "ref_integrity": FOREIGN}),
        frames_connection({"orders_dim": seeds.orders_target(s, d), "customer_dim": customers, "snap_dim": now}),
        frames_connection({"orders_feed": seeds.orders_source(s, d), "customers": customers, "snap_feed": base}),
        {"before": frames_connection({"snap_dim": base}),
         "second": frames_connection({"other": now.withColumnRenamed("o_orderkey", "order_no")})}, tabs=(TAB,))
    snapped = ["historical", "incremental", "cross_source"]
    rows = (whole.run([c for c in ALL_CATEGORIES if c not in snapped], ["orders_dim"])
            .unionByName(whole.run(snapped, ["snap_dim"])))
    pairs = F.transform(F.map_entries(F.map_filter("metrics", lambda k, _: ~k.isin("threshold", "worst_variance"))),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("category", "name", "status", "severity", "message",
                       F.array_join(F.array_sort(pairs), "; ").alias("metrics"),
                       F.round(F.col("metrics")["worst_variance"].cast("double"), 6).alias("worst_variance"))


QUERIES["suite_metrics"] = _metrics


# The same numbers by the oracle. ``o`` is the comparison of the orders pair, ``r`` that of the report tab, whose
# actual side is the target; ``h`` and ``i`` compare the snapshots,
# of closed periods and of all.
_NUMBERS = f"""{seeds.ORDERS_DIFF_SQL}, {SNAPSHOT_SQL.removeprefix("WITH ")},
one AS (SELECT (SELECT count(*) FROM src) AS source_total, (SELECT count(*) FROM tgt) AS target_total,
  (SELECT count(*) FROM d) AS matched_keys,
  (SELECT count(*) FROM su ANTI JOIN tu USING (o_orderkey)) AS source_only,
  (SELECT count(*) FROM tu ANTI JOIN su USING (o_orderkey)) AS target_only,
  (SELECT count(*) FROM (SELECT 1 FROM src GROUP BY o_orderkey HAVING count(*) > 1)) AS source_dup_keys,
  (SELECT count(*) FROM (SELECT 1 FROM tgt GROUP BY o_orderkey HAVING count(*) > 1)) AS target_dup_keys),
o AS (SELECT one.*, c.* FROM one, (SELECT count(*) FILTER (d0) AS o_custkey, count(*) FILTER (d1) AS o_orderstatus,
    count(*) FILTER (d2) AS o_totalprice, count(*) FILTER (d3) AS o_orderdate, count(*) FILTER (d4) AS o_orderpriority,
    count(*) FILTER (d0 OR d1 OR d2 OR d3 OR d4) AS mismatched_rows FROM d) c),
r AS (SELECT target_total AS source_total, source_total AS target_total, matched_keys, target_only AS source_only,
    source_only AS target_only, target_dup_keys AS source_dup_keys, source_dup_keys AS target_dup_keys, o_custkey FROM o),
g AS (SELECT count(*) AS groups, count(*) FILTER (coalesce(a.n, 0) <> coalesce(b.n, 0)) AS mismatched_groups
  FROM (SELECT o_orderpriority AS p, count(*) AS n FROM src GROUP BY 1) a
  FULL JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM tgt GROUP BY 1) b ON a.p IS NOT DISTINCT FROM b.p),
q AS (SELECT count(*) AS groups, count(*) FILTER (n > 1) AS bad_groups, coalesce(sum(n) FILTER (n > 1), 0) AS bad_rows
  FROM (SELECT count(*) AS n FROM tgt GROUP BY o_orderkey)),
t AS (SELECT count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS no_key,
  count(*) FILTER (o_totalprice IS NULL OR o_totalprice < 1) AS low,
  count(*) FILTER ({seeds.sql_nullish('o_orderpriority')}) AS blank, count(DISTINCT o_orderpriority) AS priorities,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '9-OLD') AS old,
  count(*) FILTER (o_custkey IS NULL) AS no_customer, count(*) FILTER (o_totalprice = 0) AS zeros,
  count(*) FILTER (o_totalprice IS NULL) AS nulls, avg((o_orderstatus = 'F')::INT) AS default_share,
  count(*) FILTER ({seeds.sql_nullish('o_orderstatus')}) AS no_status,
  count(*) FILTER (TRY_CAST(o_totalprice AS DOUBLE) IS NULL AND o_totalprice IS NOT NULL) AS bad_prices,
  (SELECT count(*) FROM tgt ANTI JOIN customer ON o_custkey = c_custkey) AS orphans,
  (SELECT count(*) FROM customer) AS parents,
  (SELECT count(*) FROM tgt SEMI JOIN (SELECT o_orderkey FROM src WHERE o_totalprice IS NULL) u USING (o_orderkey)
    WHERE tgt.o_totalprice = 0) AS zeroed FROM tgt),
v AS (SELECT list(abs(b - a) / abs(a)) AS apart FROM (
  SELECT (SELECT sum(o_orderkey) FROM src) AS a, (SELECT sum(o_orderkey) FROM tgt) AS b
  UNION ALL SELECT (SELECT sum(o_custkey) FROM src), (SELECT sum(o_custkey) FROM tgt)
  UNION ALL SELECT (SELECT sum({seeds.sql_number('o_totalprice')}) FROM src), (SELECT sum(o_totalprice) FROM tgt))),
w AS (SELECT count(*) FILTER (y NOT IN (SELECT period FROM n)) AS missing, count(*) AS expected
  FROM (VALUES (1995), (1996), (2000), (2002)) y(y))"""


def _snapped(name: str, where: str) -> str:
    return f""",
{name}_b AS (SELECT * FROM b {where}), {name}_n AS (SELECT * FROM n {where}),
{name} AS (SELECT (SELECT count(*) FROM {name}_b) AS source_total, (SELECT count(*) FROM {name}_n) AS target_total,
  count(*) AS matched_keys, count(*) FILTER (b.o_orderstatus <> n.o_orderstatus) AS o_orderstatus,
  count(*) FILTER (b.o_totalprice <> n.o_totalprice) AS o_totalprice,
  count(*) FILTER (b.o_orderstatus <> n.o_orderstatus OR b.o_totalprice <> n.o_totalprice) AS mismatched_rows,
  (SELECT count(*) FROM {name}_b ANTI JOIN {name}_n USING (o_orderkey)) AS source_only,
  (SELECT count(*) FROM {name}_n ANTI JOIN {name}_b USING (o_orderkey)) AS target_only,
  0 AS source_dup_keys, 0 AS target_dup_keys FROM {name}_b b JOIN {name}_n n USING (o_orderkey))"""


def _compared(f: str, columns: list[str], rows: str) -> dict[str, str]:
    """Metrics of a comparison: totals, and mismatches of the columns that have any."""
    total = " + ".join(f"{f}.{c}" for c in columns)
    same = {c: f"{f}.{c}" for c in ("source_total", "target_total", "matched_keys", "source_only", "target_only",
                                    "source_dup_keys", "target_dup_keys")}
    return same | {"value_mismatches": total, "mismatched_rows": rows, "values_matched": f"{f}.matched_keys - {rows}"} | {
        f"mismatches:{c}": f"nullif({f}.{c}, 0)" for c in columns}


def _expected(category, name, source, bad, severity, message, metrics, otherwise="FAIL", worst="NULL") -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    shown = ", ".join(f"'{k}=' || ({metrics[k]})" for k in sorted(metrics))
    return f"""SELECT {text(category)} AS category, {text(name)} AS name,
  CASE WHEN {bad} THEN '{otherwise}' ELSE 'PASS' END AS status, {severity} AS severity, {message} AS message,
  concat_ws('; ', {shown}) AS metrics, CAST({worst} AS DOUBLE) AS worst_variance FROM {source}"""


def _verdicts() -> list[str]:
    every, snap = list(seeds.ORDER_COLUMNS), ["o_orderstatus", "o_totalprice"]
    cells = lambda f, columns: " + ".join(f"{f}.{c}" for c in columns)
    apart = lambda f, columns: (
        f"{cells(f, columns)} + {f}.source_only + {f}.target_only + {f}.source_dup_keys + {f}.target_dup_keys > 0")
    told = lambda columns: (
        f"o.source_only || ' missing in target; ' || o.target_only || ' extra in target; ' || ({cells('o', columns)}) || "
        "' value mismatches; repeated keys s=' || o.source_dup_keys || '/t=' || o.target_dup_keys || '.'")
    report = [(phase, *rest) for phase, *rest in (
        ("structure", "r.source_total <> r.target_total", "WARN",
         "'rows ' || r.source_total || ' against ' || r.target_total || '; columns line up.'",
         {"actual_columns": "c.n", "expected_columns": "c.n", "actual_rows": "r.source_total", "expected_rows": "r.target_total",
          "only_in_actual": "''", "only_in_expected": "''", "problems": "''", "row_delta": "abs(r.source_total - r.target_total)"}),
        ("data", apart("r", ["o_custkey"]), "FAIL",
         "r.source_only || ' rows only in ACTUAL, ' || r.target_only || ' only in EXPECTED, ' || r.o_custkey || ' value mismatches.'",
         {k: x for k, x in _compared("r", ["o_custkey"], "r.o_custkey").items() if not k.startswith("mismatches:")}))]
    columns = "(SELECT count(*) AS n FROM (DESCRIBE orders)) c"
    out = [
        _expected("row_count", "Row count [orders_dim]", "o", "source_total <> target_total", "'P1'",
                  "CASE WHEN source_total = target_total THEN 'Counts match.' ELSE 'Count mismatch: target-source = ' || "
                  "(target_total - source_total) || '.' END",
                  {"source_rows": "source_total", "target_rows": "target_total", "difference": "target_total - source_total"}),
        _expected("row_count", "Row count by ['o_orderpriority'] [orders_dim]", "g", "mismatched_groups > 0", "'P1'",
                  "mismatched_groups || ' of ' || groups || ' groups differ in count.'",
                  {c: c for c in ("groups", "mismatched_groups")}),
        _expected("schema", "Schema [orders_dim]", columns, "false", "'P3'",
                  "'The table has the ' || c.n || ' declared columns and no others.'",
                  {"declared": "c.n", "actual": "c.n", "missing": "''", "extra": "''"}),
        _expected("datatype", "Data types [orders_dim]", "t", "bad_prices > 0", "'P3'",
                  "(bad_prices > 0)::INT || ' of 4 typed columns hold ' || bad_prices || ' values that do not match their declared type.'",
                  {"typed_columns": "4", "bad_columns": "(bad_prices > 0)::INT", "bad_values": "bad_prices",
                   "bad:o_totalprice": "nullif(bad_prices, 0)"}),
        _expected("completeness", "Mandatory completeness [orders_dim]", "t", "no_key > 0", "'P2'",
                  "(no_key > 0)::INT || ' of 1 mandatory columns contain nulls.'",
                  {"columns": "1", "rows": "rows", "nulls:o_orderkey": "nullif(no_key, 0)"}),
        _expected("completeness", "Completeness of o_orderpriority [orders_dim]", "t", "urgent = 0 OR old > 0", "'P2'",
                  "(urgent = 0)::INT || ' expected values missing, ' || (old > 0)::INT || ' forbidden values present.'",
                  {"missing": "(urgent = 0)::INT", "intruders": "(old > 0)::INT", "distinct_present": "priorities",
                   "missing_values": "CASE WHEN urgent = 0 THEN '1-URGENT' ELSE '' END",
                   "forbidden_values": "CASE WHEN old > 0 THEN '9-OLD' ELSE '' END"}),
        _expected("business_rules", "[B1] range", "t", "low > 0", "'P2'",
                  "'o_totalprice must be within [1, None]: ' || low || ' of ' || rows || ' rows violate.'",
                  {"checked_rows": "rows", "violations": "low"}),
        _expected("business_rules", "[B2] not_null", "t", "blank > 0", "'P3'",
                  "'o_orderpriority must not be null: ' || blank || ' of ' || rows || ' rows violate.'",
                  {"checked_rows": "rows", "violations": "blank"}),
        _expected("business_rules", "[B3] unique", "q, t", "bad_groups > 0", "'P3'",
                  "bad_groups || ' of ' || groups || ' groups violate the rule.'",
                  {"checked_rows": "t.rows", "groups": "groups", "bad_groups": "bad_groups", "violations": "bad_rows"}),
        _expected("referential_integrity", "FK orders_dim.['o_custkey'] -> customer_dim.['c_custkey']", "t", "orphans > 0",
                  "CASE WHEN orphans + no_customer = 0 THEN 'P4' ELSE 'P2' END",
                  "orphans || ' orphan child rows, ' || no_customer || ' child rows with a null key.'",
                  {"child_rows": "rows", "parent_rows": "parents", "orphans": "orphans", "null_child_keys": "no_customer"}),
        _expected("transformation", "Transformation [orders_dim]", "o", apart("o", ["o_totalprice"]), "'P2'", told(["o_totalprice"]),
                  _compared("o", ["o_totalprice"], "o.o_totalprice") | {"transformed_columns": "'o_totalprice'"}),
        _expected("deduplication", "Deduplication [orders_dim]", "q, t", "bad_groups > 0", "'P2'",
                  "bad_groups || ' repeated keys across ' || bad_rows || ' of ' || t.rows || ' rows.'",
                  {"rows": "t.rows", "duplicate_keys": "bad_groups", "duplicate_rows": "bad_rows"}),
        _expected("null_handling", "Default/null handling [orders_dim]", "t", f"default_share >= {DEFAULT_SHARE} AND no_status = 0", "'P3'",
                  f"(default_share >= {DEFAULT_SHARE} AND no_status = 0)::INT || ' columns are dominated by their default value with no nulls.'",
                  {"flagged": f"CASE WHEN default_share >= {DEFAULT_SHARE} AND no_status = 0 THEN 'o_orderstatus' ELSE '' END"}, "WARN"),
        _expected("null_handling", "Zero-vs-null [orders_dim]", "t", "zeroed > 0", "'P2'",
                  "zeroed || ' rows where the source is null but the target is 0.'",
                  {"target_zeros": "zeros", "target_nulls": "nulls", "null_source_zero_target": "zeroed"}),
        _expected("reconciliation", "Aggregate variance [orders_dim]", "v", "len(list_filter(apart, lambda a: a > 0.0001)) > 0", "'P1'",
                  "len(list_filter(apart, lambda a: a > 0.0001)) || ' of ' || len(apart) || ' numeric column sums exceed 0.0100% variance.'",
                  {"columns": "len(apart)", "breaches": "len(list_filter(apart, lambda a: a > 0.0001))"}, worst="round(list_max(apart), 6)"),
        _expected("reconciliation", "Reconciliation [orders_dim]", "o", apart("o", every), "'P1'", told(every),
                  _compared("o", every, "o.mismatched_rows")),
        _expected("lineage", "Lineage [orders_dim]", "t", "blank > 0", "'P3'",
                  "(blank > 0)::INT || ' of 1 lineage columns contain nulls.'",
                  {"columns": "1", "rows": "rows", "nulls:o_orderpriority": "nullif(blank, 0)"}),
        *[_expected(category, f"Report {phase} [Orders]", f"r, {columns}", bad, "'P2'", message, metrics, otherwise)
          for category in ("report", "gvc_report") for phase, bad, otherwise, message, metrics in report],
        _expected("historical", "Period continuity [snap_dim]", "w", "missing > 0", "'P2'",
                  "missing || ' of ' || expected || ' expected periods missing.'", {"expected": "expected", "missing": "missing"}),
        _expected("historical", "Historical immutability [snap_dim]", "h", f"{cells('h', snap)} + h.source_only > 0", "'P1'",
                  f"'Historical data: ' || h.source_only || ' rows disappeared, ' || ({cells('h', snap)}) || ' values drifted.'",
                  _compared("h", snap, "h.mismatched_rows")),
        _expected("incremental", "Incremental integrity [snap_dim]", "i", "i.o_orderstatus + i.source_only > 0", "'P2'",
                  "i.target_only || ' additions, ' || i.source_only || ' deletions, ' || i.o_orderstatus || ' unexpected changes.'",
                  _compared("i", ["o_orderstatus"], "i.o_orderstatus") | {
                      "additions": "i.target_only", "deletions": "i.source_only", "unexpected_mutations": "i.o_orderstatus",
                      "allow_deletes": "'false'", "updatable_columns": "'o_totalprice'"}),
        _expected("cross_source", "Cross-source [snap_dim]", "i", f"{cells('i', snap)} > 0", "'P2'",
                  f"i.matched_keys || ' overlapping keys, ' || ({cells('i', snap)}) || ' values disagree (' || i.source_only || "
                  "' keys only in the primary, ' || i.target_only || ' only in the second source).'",
                  _compared("i", snap, "i.mismatched_rows"))]
    return out


SQL["suite_metrics"] = (_NUMBERS + _snapped("h", "WHERE period < 2000") + _snapped("i", "") + "\n"
                        + "\nUNION ALL ".join(_verdicts()))


def _samples(s, d):
    """Sample rows that a run leaves beside its history: of each failed rule at most a hundred."""
    folder = shared_folder(s)
    suite(s, d).run(["business_rules"], ["orders_dim"], f"{folder}/history", f"{folder}/evidence")
    key = F.get_json_object("sample", "$.o_orderkey").cast("bigint")
    return sinks.read_samples(s, f"{folder}/history/samples").select(
        F.substring("check_name", 1, 4).alias("rule"), key.alias("o_orderkey"))


QUERIES["suite_samples"] = _samples
SQL["suite_samples"] = f"""WITH {seeds.ORDERS_PAIR_SQL},
o AS (SELECT '[B1]' AS rule, o_orderkey FROM tgt WHERE o_totalprice < 1
  UNION ALL SELECT '[B1]', o_orderkey FROM tgt WHERE o_totalprice IS NULL
  UNION ALL SELECT '[B2]', o_orderkey FROM tgt WHERE {seeds.sql_nullish('o_orderpriority')}
  UNION ALL SELECT '[B3]', o_orderkey FROM tgt
    WHERE o_orderkey IN (SELECT o_orderkey FROM tgt GROUP BY 1 HAVING count(*) > 1))
SELECT rule, o_orderkey FROM o
QUALIFY row_number() OVER (PARTITION BY rule ORDER BY CAST(o_orderkey AS VARCHAR)) <= 100"""

SQL["check_isolation"] = f"""WITH {seeds.ORDERS_PAIR_SQL},
n AS (SELECT count(*) AS rows, count(*) FILTER (o_totalprice IS NULL OR o_totalprice < 1) AS low,
  count(*) FILTER ({seeds.sql_nullish('o_orderpriority')}) AS nulls FROM tgt),
r AS (SELECT count(*) AS rows FROM tgt
  WHERE o_orderkey IN (SELECT o_orderkey FROM tgt GROUP BY 1 HAVING count(*) > 1))
SELECT 'B1' AS rule_id, CASE WHEN low > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CAST(rows AS VARCHAR) AS checked_rows, CAST(low AS VARCHAR) AS violations FROM n
UNION ALL SELECT 'B2', CASE WHEN nulls > 0 THEN 'FAIL' ELSE 'PASS' END, CAST(rows AS VARCHAR),
  CAST(nulls AS VARCHAR) FROM n
UNION ALL SELECT 'B3', CASE WHEN r.rows > 0 THEN 'FAIL' ELSE 'PASS' END,
  CAST(n.rows AS VARCHAR), CAST(r.rows AS VARCHAR) FROM n, r
UNION ALL SELECT 'B4', 'ERROR', NULL, NULL"""

# Verdicts of the whole run. What depends on the data is tested here by its own SQL: each
# check names the flag that makes it fail.
_FLAGS = f"""
  (SELECT count(*) FROM src) <> (SELECT count(*) FROM tgt) AS rows,
  EXISTS (SELECT o_orderpriority, count(*) FROM src GROUP BY 1
    EXCEPT SELECT o_orderpriority, count(*) FROM tgt GROUP BY 1) AS groups,
  EXISTS (SELECT 1 FROM tgt WHERE o_totalprice IS NULL OR o_totalprice < 1) AS low,
  EXISTS (SELECT 1 FROM tgt WHERE {seeds.sql_nullish('o_orderpriority')}) AS blank,
  EXISTS (SELECT 1 FROM tgt GROUP BY o_orderkey HAVING count(*) > 1) AS repeated,
  (SELECT avg((o_orderstatus = 'F')::INT) FROM tgt) >= 0.5 AS defaulted,
  EXISTS (SELECT 1 FROM src JOIN tgt USING (o_orderkey)
    WHERE src.o_totalprice IS NULL AND tgt.o_totalprice = 0) AS zeroed,
  EXISTS (SELECT 1 FROM src JOIN tgt USING (o_orderkey)
    WHERE {seeds.sql_number('src.o_totalprice')} IS DISTINCT FROM tgt.o_totalprice) AS changed,
  EXISTS (SELECT 1 FROM src JOIN tgt USING (o_orderkey) WHERE src.o_custkey <> tgt.o_custkey) AS moved,
  EXISTS (SELECT 1 FROM tgt ANTI JOIN customer ON o_custkey = c_custkey) AS orphans,
  (SELECT abs(sum(o_totalprice) - (SELECT sum({seeds.sql_number('o_totalprice')}) FROM src))
    / (SELECT sum({seeds.sql_number('o_totalprice')}) FROM src) FROM tgt) > 0.0001 AS drifted"""

_VERDICTS = [  # category, name, table, flag, status with the flag, status without
    ("row_count", "Row count [orders_dim]", "orders_dim", "rows", "FAIL", "PASS"),
    ("row_count", "Row count by ['o_orderpriority'] [orders_dim]", "orders_dim", "groups", "FAIL", "PASS"),
    ("row_count", "Row count [customer_dim]", "customer_dim", "false", "FAIL", "PASS"),
    ("schema", "Schema [orders_dim]", "orders_dim", "false", "FAIL", "PASS"),
    ("schema", "Schema [customer_dim]", "customer_dim", "true", "WARN", "PASS"),
    ("datatype", "Data types [orders_dim]", "orders_dim", "false", "FAIL", "PASS"),
    ("datatype", "Data types [customer_dim]", "customer_dim", "true", "SKIPPED", ""),
    ("completeness", "Mandatory completeness [orders_dim]", "orders_dim", "false", "FAIL", "PASS"),
    ("completeness", "Mandatory completeness [customer_dim]", "customer_dim", "true", "SKIPPED", ""),
    ("completeness", "Completeness of o_orderpriority [orders_dim]", "orders_dim", "false", "FAIL", "PASS"),
    ("business_rules", "[B1] range", "orders_dim", "low", "FAIL", "PASS"),
    ("business_rules", "[B2] not_null", "orders_dim", "blank", "FAIL", "PASS"),
    ("business_rules", "[B3] unique", "orders_dim", "repeated", "FAIL", "PASS"),
    ("business_rules", "[B4] not_null", "orders_dim", "true", "ERROR", ""),
    ("referential_integrity", "FK orders_dim.['o_custkey'] -> customer_dim.['c_custkey']", "orders_dim",
     "orphans", "FAIL", "PASS"),
    ("transformation", "Transformation [orders_dim]", "orders_dim", "changed OR rows OR repeated", "FAIL", "PASS"),
    ("transformation", "Transformation [customer_dim]", "customer_dim", "true", "SKIPPED", ""),
    ("deduplication", "Deduplication [orders_dim]", "orders_dim", "repeated", "FAIL", "PASS"),
    ("deduplication", "Deduplication [customer_dim]", "customer_dim", "false", "FAIL", "PASS"),
    ("null_handling", "Default/null handling [orders_dim]", "orders_dim", "defaulted", "WARN", "PASS"),
    ("null_handling", "Default/null handling [customer_dim]", "customer_dim", "true", "SKIPPED", ""),
    ("null_handling", "Zero-vs-null [orders_dim]", "orders_dim", "zeroed", "FAIL", "PASS"),
    ("reconciliation", "Reconciliation [orders_dim]", "orders_dim", "changed OR moved", "FAIL", "PASS"),
    ("reconciliation", "Aggregate variance [orders_dim]", "orders_dim", "drifted", "FAIL", "PASS"),
    ("reconciliation", "Reconciliation [customer_dim]", "customer_dim", "false", "FAIL", "PASS"),
    ("reconciliation", "Aggregate variance [customer_dim]", "customer_dim", "true", "SKIPPED", ""),
    ("lineage", "Lineage [orders_dim]", "orders_dim", "blank", "FAIL", "PASS"),
    ("lineage", "Lineage [customer_dim]", "customer_dim", "true", "SKIPPED", ""),
    ("report", "Report structure [Orders]", None, "rows", "WARN", "PASS"),
    ("report", "Report data [Orders]", None, "moved OR rows OR repeated", "FAIL", "PASS"),
]


def _text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


SQL["suite_run"] = f"WITH {seeds.ORDERS_PAIR_SQL}, f AS (SELECT {_FLAGS})" + " UNION ALL ".join(
    f"\nSELECT {_text(c)} AS category, {_text(n)} AS name, CAST({_text(t)} AS VARCHAR) AS target_table, "
    f"CASE WHEN {flag} THEN '{yes}' ELSE '{no}' END AS status FROM f"
    for c, n, t, flag, yes, no in _VERDICTS)
