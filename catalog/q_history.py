"""Registered queries over a run history derived from every event.

Forty events make a run; a third of all runs belong to one suite. Statuses change slowly
for half of the checks, so that streaks grow long, and fast for the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.seeds import table
from tallymark.operators import history
from tallymark.session import shared_folder
from tallymark.sources import ledger, sinks

QUERIES, SQL = {}, {}

CATEGORIES = ["reconciliation", "schema", "business_rules", "report", "lineage"]


def checks(s, d):
    run = F.floor(F.col("event_id") / 40)
    pos = F.col("event_id") % 40
    level = F.when(pos % 2 == 0, F.floor(run / 60)).otherwise(F.floor(run / 4))
    code = (level + pos * 3) % 10
    return table(s, d, "events").select(
        F.concat(F.lit("run_"), run.cast("string")).alias("run_id"),
        F.when(run % 3 == 0, "suite_0").otherwise(F.concat(F.lit("suite_"), (run % 7).cast("string")))
        .alias("suite"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=run.cast("int")))
        .alias("started_at"),
        F.concat(F.lit("member_"), (run % 3).cast("string")).alias("member"),
        F.when(run % 11 == 0, "fail").otherwise("pass").alias("expected"),
        pos.alias("position"),
        F.get(F.array(*map(F.lit, CATEGORIES)), (pos % 5).cast("int")).alias("category"),
        F.when((run + pos) % 17 == 0, F.concat(F.lit("Extra "), pos.cast("string")))
        .otherwise(F.concat(F.lit("Check "), (pos % 30).cast("string"), F.lit(" [t]"))).alias("name"),
        F.when(pos % 3 == 0, "orders").when(pos % 3 == 1, "lineitem").alias("target_table"),
        F.when(code.isin(6, 8), "FAIL").when(code == 7, "WARN").when(code == 9, "ERROR")
        .when(code == 0, "SKIPPED").otherwise("PASS").alias("status"),
        F.concat(F.lit("P"), (1 + F.floor(pos / 3) % 4).cast("string")).alias("severity"),
        F.when(pos % 4 == 0, F.concat(F.lit("BR"), pos.cast("string"))).alias("rule_id"),
        F.col("event_type").alias("message"))


CHECKS = """WITH b AS (SELECT *, event_id // 40 AS run, event_id % 40 AS pos FROM events),
k AS (SELECT *, ((CASE WHEN pos % 2 = 0 THEN run // 60 ELSE run // 4 END) + pos * 3) % 10 AS code FROM b),
checks AS (SELECT 'run_' || run AS run_id, run,
  CASE WHEN run % 3 = 0 THEN 'suite_0' ELSE 'suite_' || (run % 7) END AS suite,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(run AS INTEGER)) AS started_at,
  'member_' || (run % 3) AS member, CASE WHEN run % 11 = 0 THEN 'fail' ELSE 'pass' END AS expected,
  pos AS position,
  (['reconciliation', 'schema', 'business_rules', 'report', 'lineage'])[pos % 5 + 1] AS category,
  CASE WHEN (run + pos) % 17 = 0 THEN 'Extra ' || pos ELSE 'Check ' || (pos % 30) || ' [t]' END AS name,
  CASE WHEN pos % 3 = 0 THEN 'orders' WHEN pos % 3 = 1 THEN 'lineitem' END AS target_table,
  CASE WHEN code IN (6, 8) THEN 'FAIL' WHEN code = 7 THEN 'WARN' WHEN code = 9 THEN 'ERROR'
    WHEN code = 0 THEN 'SKIPPED' ELSE 'PASS' END AS status,
  'P' || (1 + (pos // 3) % 4) AS severity,
  CASE WHEN pos % 4 = 0 THEN 'BR' || pos END AS rule_id, event_type AS message FROM k),
counts AS (SELECT run_id, any_value(run) AS run, any_value(suite) AS suite,
  any_value(started_at) AS started_at, any_value(expected) AS expected,
  any_value(member) AS member,
  count(*) FILTER (status = 'FAIL') AS FAIL, count(*) FILTER (status = 'ERROR') AS ERROR,
  count(*) FILTER (status = 'WARN') AS WARN, count(*) FILTER (status = 'PASS') AS PASS,
  count(*) FILTER (status = 'SKIPPED') AS SKIPPED, count(*) AS TOTAL FROM checks GROUP BY run_id),
verdicts AS (SELECT *, expected = 'fail' AS negative,
  CAST(CASE WHEN ERROR > 0 THEN 2 WHEN expected = 'fail' THEN (CASE WHEN FAIL > 0 THEN 0 ELSE 1 END)
    WHEN FAIL > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM counts)"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = CHECKS + sql
        return fn
    return register


@query("history_status_counts", """
SELECT run_id, suite, FAIL, ERROR, WARN, PASS, SKIPPED, TOTAL FROM counts""")
def status_counts(s, d):
    return history.status_counts(checks(s, d)).drop("started_at")


@query("run_verdict", """
SELECT run_id, suite, negative, exit_code = 0 AS passed, exit_code, FAIL, ERROR, WARN, PASS, SKIPPED, TOTAL
FROM verdicts""")
def run_verdict(s, d):
    return history.run_verdicts(checks(s, d)).drop("started_at")


@query("history_pass_rate", """
SELECT run_id, suite, CAST(floor(PASS / TOTAL * 100 + 0.5) AS BIGINT) AS pass_rate,
  round(FAIL / TOTAL * 100, 6) AS fail_share, round(ERROR / TOTAL * 100, 6) AS error_share,
  round(WARN / TOTAL * 100, 6) AS warn_share, round(PASS / TOTAL * 100, 6) AS pass_share,
  round(SKIPPED / TOTAL * 100, 6) AS skipped_share FROM counts""")
def pass_rate(s, d):
    rates = history.pass_rates(checks(s, d)).drop("started_at")
    return rates.withColumns({c: F.round(c, 6) for c in rates.columns if c.endswith("_share")})


@query("history_pass_rate_delta", """,
r AS (SELECT *, CAST(floor(PASS / TOTAL * 100 + 0.5) AS BIGINT) AS pass_rate FROM counts)
SELECT run_id, suite, pass_rate, lag(run_id) OVER w AS prev_run_id,
  pass_rate - lag(pass_rate) OVER w AS delta_points FROM r
WINDOW w AS (PARTITION BY suite ORDER BY started_at)""")
def pass_rate_delta(s, d):
    return history.pass_rate_deltas(checks(s, d)).drop("started_at")


# Per failing check the unbroken failures in the runs before, looked up run by run.
_STREAKS = """,
numbered AS (SELECT run_id, suite, row_number() OVER (PARTITION BY suite ORDER BY started_at) AS no FROM counts),
named AS (SELECT c.*, n.no,
  coalesce(rule_id, category || '|' || name || '|' || coalesce(target_table, '')) AS check_id,
  coalesce(rule_id, trim(regexp_replace(name, '\\s*\\[[^\\]]*\\]\\s*$', ''))) AS label
  FROM checks c JOIN numbered n USING (run_id)),
lasts AS (SELECT suite, no, check_id, max_by(status, position) IN ('FAIL', 'ERROR') AS bad
  FROM named GROUP BY 1, 2, 3),
failed AS (SELECT * FROM named WHERE status IN ('FAIL', 'ERROR')),
back AS (SELECT f.run_id, f.position, g.step, coalesce(l.bad, false) AS bad
  FROM failed f CROSS JOIN range(1, 13) g(step)
  LEFT JOIN lasts l ON l.suite = f.suite AND l.check_id = f.check_id AND l.no = f.no - g.step),
streaks AS (SELECT f.run_id, f.suite, f.position, f.check_id, f.label,
  coalesce((SELECT min(step) FROM back b WHERE b.run_id = f.run_id AND b.position = f.position AND NOT b.bad), 13)
    AS streak FROM failed f)"""


@query("history_failure_streak", _STREAKS + """
SELECT run_id, suite, position, check_id, label, streak > 1 AS recurring, streak FROM streaks""")
def failure_streak(s, d):
    return history.failures(checks(s, d)).select(
        "run_id", "suite", "position", "check_id", "label", "recurring", "streak")


@query("history_new_vs_recurring", _STREAKS + """
SELECT run_id, suite, count(*) FILTER (streak = 1) AS new_failures,
  count(*) FILTER (streak > 1) AS recurring_failures,
  max_by(label, streak * 1000 - position) FILTER (streak > 1) AS oldest_label,
  coalesce(max(streak) FILTER (streak > 1), 0) AS oldest_streak FROM streaks GROUP BY 1, 2""")
def new_vs_recurring(s, d):
    return history.new_and_recurring(history.failures(checks(s, d))).drop("started_at")


@query("history_p1_blocker", """,
p AS (SELECT *, status IN ('FAIL', 'ERROR') AND severity = 'P1' AS hit FROM checks)
SELECT run_id, suite, count(*) FILTER (hit) AS p1_failures,
  CASE WHEN count(DISTINCT target_table) FILTER (hit) = 1 THEN min(target_table) FILTER (hit) END AS "table",
  CASE WHEN count(DISTINCT category) FILTER (hit) = 1 THEN min(category) FILTER (hit) END AS category
FROM p GROUP BY 1, 2""")
def p1_blocker(s, d):
    return history.p1_blockers(checks(s, d)).drop("started_at")


@query("history_category_health", """
SELECT run_id, suite, category, count(*) FILTER (status = 'PASS') AS pass,
  count(*) FILTER (status IN ('FAIL', 'ERROR')) AS fail, count(*) FILTER (status = 'WARN') AS warn,
  count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'SKIPPED') AS skipped
FROM checks GROUP BY 1, 2, 3""")
def category_health(s, d):
    return history.category_health(checks(s, d)).drop("started_at")


def _runs(s, d):
    return history.run_verdicts(checks(s, d))


@query("history_manifest", """
SELECT run_id, suite, exit_code = 0 AS passed, TOTAL AS checks, (SELECT count(*) FROM counts) AS runs_total,
  CAST(least((SELECT count(*) FROM counts), 50) AS BIGINT) AS runs_shown
FROM verdicts ORDER BY started_at DESC LIMIT 50""")
def manifest(s, d):
    return history.manifest(_runs(s, d)).select(
        "run_id", "suite", "passed", F.col("TOTAL").alias("checks"), "runs_total", "runs_shown")


@query("history_latest_per_suite", """
SELECT suite, run_id, exit_code = 0 AS passed, exit_code FROM verdicts
QUALIFY row_number() OVER (PARTITION BY suite ORDER BY started_at DESC) = 1""")
def latest_per_suite(s, d):
    return history.latest_per_suite(_runs(s, d)).select("suite", "run_id", "passed", "exit_code")


@query("history_triage", """
SELECT run_id, position, status, category, CAST(CASE status WHEN 'FAIL' THEN 0 WHEN 'ERROR' THEN 1
  WHEN 'WARN' THEN 2 WHEN 'PASS' THEN 3 ELSE 4 END AS BIGINT) AS urgency FROM checks
WHERE category IN ('schema', 'report') AND status IN ('FAIL', 'ERROR', 'WARN')""")
def triage(s, d):
    return history.triage(checks(s, d), ["FAIL", "ERROR", "WARN"], ["schema", "report"]).select(
        "run_id", "position", "status", "category", "urgency")


@query("history_search", """,
r AS (SELECT v.*, v.run % 4 <> 0 AND v.run % 5 IN (0, 3) AS by_list,
  v.run % 4 = 0 AND v.suite IN ('suite_3') AS by_name FROM verdicts v)
SELECT run_id, suite, member, (by_list OR by_name) AS is_report, exit_code = 0 AS passed FROM r
WHERE (by_list OR by_name) AND exit_code <> 0
  AND contains(lower(run_id || ' ' || suite || ' ' || member), 'member_1')""")
def search(s, d):
    # Categories of a run as indexed; every fourth run is of a time before they were.
    all_checks = checks(s, d)
    members = all_checks.groupBy("run_id").agg(F.first("member").alias("member"))
    no = F.regexp_extract("run_id", r"\d+", 0).cast("bigint")
    kinds = F.when(no % 5 == 0, F.array(F.lit("report"), F.lit("schema"))) \
        .when(no % 5 == 3, F.array(F.lit("gvc_report"))).otherwise(F.array(F.lit("schema")))
    runs = _runs(s, d).join(members, "run_id").withColumn(
        "categories", F.when(no % 4 != 0, kinds).otherwise(F.array().cast("array<string>")))
    named = runs.withColumn("suite", F.when(F.col("suite") == "suite_3", "report_3.yaml")
                            .otherwise(F.col("suite")))
    return history.search(named, "reports", False, " MEMBER_1", ["run_id", "suite", "member"]).select(
        "run_id", F.when(F.col("suite") == "report_3.yaml", "suite_3").otherwise(F.col("suite"))
        .alias("suite"), "member", "is_report", "passed")


@query("history_by_scenario", """,
l AS (SELECT suite, run_id, exit_code = 0 AS passed FROM verdicts
  QUALIFY row_number() OVER (PARTITION BY suite ORDER BY started_at DESC) = 1)
SELECT l.*, coalesce(r_name, 'Ungrouped') AS scenario FROM l
LEFT JOIN region ON r_regionkey = CAST(substring(suite, 7) AS INTEGER)""")
def by_scenario(s, d):
    latest = history.latest_per_suite(_runs(s, d)).select("suite", "run_id", "passed")
    suites = checks(s, d).select("suite").distinct().withColumn(
        "scenario_id", F.substring("suite", 7, 9).cast("int"))
    scenarios = table(s, d, "region").select(F.col("r_regionkey").alias("scenario_id"),
                                             F.col("r_name").alias("scenario"))
    return history.by_scenario(latest, suites, scenarios)


@query("alert_candidates", """,
t AS (SELECT *, status IN ('ERROR') OR severity IN ('P1') AS trip FROM checks
  WHERE suite IN ('suite_0', 'suite_1', 'suite_4'))
SELECT run_id, suite, count(*) FILTER (trip) AS tripped, count(*) FILTER (status = 'FAIL') AS failed,
  count(*) FILTER (status = 'ERROR') AS errored, count(*) AS total,
  min(severity) FILTER (trip) AS worst_severity,
  concat_ws(',', CASE WHEN bool_or(severity = 'P1') THEN 'P1' END,
    CASE WHEN bool_or(status = 'ERROR') THEN 'ERROR' END) AS triggered_by
FROM t GROUP BY 1, 2 HAVING count(*) FILTER (trip) > 0""")
def alert_candidates(s, d):
    return history.alerts(checks(s, d), ["P1", "ERROR"], ["suite_0", "suite_1", "suite_4"]) \
        .drop("started_at")


@query("alert_samples", """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY position) AS INTEGER) AS place,
  name, status, severity, message FROM checks WHERE status IN ('FAIL', 'ERROR')
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY position) <= 10""")
def alert_samples(s, d):
    return history.alert_samples(checks(s, d), ["FAIL", "ERROR"])


@query("batch_rollup", """,
c AS (SELECT 'batch_' || (run // 8) AS batch_id, exit_code FROM verdicts)
SELECT batch_id, count(*) AS cases, count(*) FILTER (exit_code = 0) AS cases_passed,
  count(*) FILTER (exit_code = 1) AS cases_failed, count(*) FILTER (exit_code = 2) AS cases_errored,
  CASE WHEN bool_or(exit_code = 2) THEN 'error' WHEN bool_or(exit_code = 1) THEN 'failed'
    ELSE 'passed' END AS status FROM c GROUP BY 1""")
def batch_rollup(s, d):
    no = F.floor(F.regexp_extract("run_id", r"\d+", 0).cast("bigint") / 8)
    return history.batch_rollup(_runs(s, d).withColumn(
        "batch_id", F.concat(F.lit("batch_"), no.cast("string"))))


@query("regression_totals", """
SELECT coalesce(suite, 'TOTAL') AS suite, suite IS NULL AS overall,
  CASE WHEN count(*) FILTER (exit_code <> 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS result,
  count(*) AS runs, count(*) FILTER (exit_code <> 0) AS not_passing,
  CAST(sum(FAIL) AS BIGINT) AS FAIL, CAST(sum(ERROR) AS BIGINT) AS ERROR,
  CAST(sum(WARN) AS BIGINT) AS WARN, CAST(sum(PASS) AS BIGINT) AS PASS,
  CAST(sum(SKIPPED) AS BIGINT) AS SKIPPED, CAST(sum(TOTAL) AS BIGINT) AS TOTAL
FROM verdicts GROUP BY ROLLUP (suite)""")
def regression_totals(s, d):
    return history.regression_totals(_runs(s, d))


def _files():
    """Evidence files of a check."""
    file = lambda label, path, rows: F.struct(
        F.lit(label).alias("label"), path.alias("path"), rows.alias("rows"))
    stem = F.concat(F.lit("evidence/"), F.col("position").cast("string"))
    one = file("Offenders", F.concat(stem, F.lit(".csv")), F.col("position"))
    two = file("Duplicate keys", F.concat(stem, F.lit("_dup.csv")), F.col("position") * 2)
    return F.when(F.col("status") == "FAIL", F.array(one, two)) \
        .when(F.col("status") == "ERROR", F.array(one))


@query("history_evidence", """
SELECT run_id, suite, category, name AS check_name, status, target_table, label, path, rows
FROM (SELECT *, 'Offenders' AS label, 'evidence/' || position || '.csv' AS path, position AS rows
    FROM checks WHERE status IN ('FAIL', 'ERROR')
  UNION ALL SELECT *, 'Duplicate keys', 'evidence/' || position || '_dup.csv', position * 2
    FROM checks WHERE status = 'FAIL')""")
def evidence(s, d):
    return history.evidence(checks(s, d).withColumn("evidence", _files()))


def _stored_rows(s, d):
    """Check rows as a run writes them."""
    return checks(s, d).select(
        "run_id", "suite", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), "expected",
        "position", "category", "name", "target_table", "status", "severity", "message",
        F.create_map(F.lit("rows"), F.col("position").cast("string")).alias("metrics"), "rule_id",
        F.lit(None).cast("string").alias("use_case"))


@query("history_roundtrip", """
SELECT run_id, suite, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, expected, position, category, name,
  target_table, status, severity, message, CAST(position AS VARCHAR) AS metric_rows, rule_id FROM checks""")
def roundtrip(s, d):
    """Check rows added to a stored history by two writers, one after the other, and read back."""
    folder = shared_folder(s)
    for half in (0, 1):
        sinks.write_checks(_stored_rows(s, d).where(F.crc32("run_id") % 2 == half), folder)
    return sinks.read_checks(s, folder).withColumn("metric_rows", F.col("metrics")["rows"]).drop("metrics", "use_case")


@query("history_documents", """
SELECT run_id, member, name AS check_name, status, label, path, rows
FROM (SELECT *, 'Offenders' AS label, 'evidence/' || position || '.csv' AS path, position AS rows
    FROM checks WHERE status IN ('FAIL', 'ERROR')
  UNION ALL SELECT *, 'Duplicate keys', 'evidence/' || position || '_dup.csv', position * 2
    FROM checks WHERE status = 'FAIL')""")
def documents(s, d):
    """Evidence unfolded from nested documents, a file per run, below a folder per writer."""
    folder = shared_folder(s)
    check = F.struct("position", "name", "category", "target_table", "status", "severity", "message", "rule_id",
                     _files().alias("evidence"))
    sinks.write_run_documents(checks(s, d).groupBy("member", "run_id", "suite").agg(
        F.sort_array(F.collect_list(check)).alias("checks")), folder)
    flat = history.checks_of_documents(sinks.read_run_documents(s, folder))
    return flat.select("run_id", "member", F.col("name").alias("check_name"), "status", F.inline("evidence"))


@query("history_streak_deep", """,
numbered AS (SELECT run_id, suite, row_number() OVER (PARTITION BY suite ORDER BY started_at) AS no FROM counts),
named AS (SELECT c.*, n.no, coalesce(rule_id, category || '|' || name || '|' || coalesce(target_table, '')) AS check_id
  FROM checks c JOIN numbered n USING (run_id)),
lasts AS (SELECT suite, no, check_id, max_by(status, position) IN ('FAIL', 'ERROR') AS bad FROM named GROUP BY 1, 2, 3),
islands AS (SELECT suite, check_id, no, no - row_number() OVER (PARTITION BY suite, check_id ORDER BY no) AS island
  FROM lasts WHERE bad),
lengths AS (SELECT suite, check_id, no, row_number() OVER (PARTITION BY suite, check_id, island ORDER BY no) AS n FROM islands)
SELECT f.run_id, f.suite, f.position, 1 + least(coalesce(b.n, 0), 500) AS streak FROM named f
LEFT JOIN lengths b ON b.suite = f.suite AND b.check_id = f.check_id AND b.no = f.no - 1
WHERE f.status IN ('FAIL', 'ERROR')""")
def streak_deep(s, d):
    """Streaks over five hundred runs back, told by where a run of failures began."""
    return history.failures(checks(s, d), depth=500).select("run_id", "suite", "position", "streak")


def _parts(s, d):
    """The history in three parts as it comes in: early runs, later ones, and runs that arrive late, out of order."""
    run = F.substring("run_id", 5, 20).cast("bigint")
    late = run % 13 == 5
    last = F.lit(table(s, d, "events").agg(F.max("event_id")).first()[0] // 40)
    every_run = checks(s, d).withColumn("run", run)
    return [every_run.where(part).drop("run", "member") for part in (
        ~late & (F.col("run") < last * 0.6), ~late & (F.col("run") >= last * 0.6), late)]


def _folded(s, d):
    book = ledger.ledger(s, shared_folder(s))
    for part in _parts(s, d):
        book.append(part)
        book.fold()
    return book


@query("history_streak_incremental", SQL["history_failure_streak"].removeprefix(CHECKS))
def streak_incremental(s, d):
    """Streaks kept up while the history arrives in three parts, the last of them late."""
    return _folded(s, d).failures().select(
        "run_id", "suite", "position", "check_id", "label", "recurring", "streak")


@query("history_state", """,
named AS (SELECT *, coalesce(rule_id, category || '|' || name || '|' || coalesce(target_table, '')) AS check_id FROM checks),
lasts AS (SELECT suite, check_id, run, run_id, max_by(status, position) AS status FROM named GROUP BY ALL)
SELECT suite, check_id, run_id, status FROM lasts
QUALIFY row_number() OVER (PARTITION BY suite, check_id ORDER BY run DESC) = 1""")
def history_state(s, d):
    """Last run and status of every check, as three folds left them."""
    return _folded(s, d).state().select("suite", "check_id", "run_id", "status")


@query("history_compacted", SQL["history_status_counts"].removeprefix(CHECKS))
def compacted(s, d):
    """Status counts from a history appended in parts, one of them twice, then compacted and cleaned."""
    book = ledger.ledger(s, shared_folder(s))
    parts = _parts(s, d)
    for part in (*parts, parts[1]):
        book.append(part)
    book.compact()
    book.vacuum()
    return history.status_counts(book.checks()).drop("started_at")
