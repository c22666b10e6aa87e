"""Run history: trends and rollups over the stored check results.

Input is the flat ``checks`` table, one row per check of a run, with the columns ``run_id,
suite, started_at, position, category, name, target_table, status, severity, rule_id``.
Per-run and per-suite numbers are aggregates with map-side combining. "The run before" is
found by a run number per suite, so steps back in time are equi joins on evenly spread keys
and a suite with most of the history is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses in order of urgency, severities from worst to mildest.
STATUSES = ("FAIL", "ERROR", "WARN", "PASS", "SKIPPED")
SEVERITIES = ("P1", "P2", "P3", "P4")
NEGATIVE_WORDS = ("fail", "negative", "neg", "true", "1", "yes")
REPORT_CATEGORIES = ("report", "gvc_report")

MANIFEST_RUNS = 50
STREAK_DEPTH = 12
ALERT_SAMPLE = 10
UNGROUPED = "Ungrouped"
_CHUNK = 1024

RUN = ("run_id", "suite", "started_at")


def failing() -> Column:
    return F.col("status").isin("FAIL", "ERROR")


def check_id() -> Column:
    """Identity of a check across runs: its rule, else category, name and table."""
    named = F.concat_ws("|", "category", "name", F.coalesce("target_table", F.lit("")))
    return F.coalesce(F.nullif("rule_id", F.lit("")), named)


def check_label() -> Column:
    """Short label: the rule, else the name without a trailing bracket."""
    short = F.trim(F.regexp_replace("name", r"\s*\[[^\]]*\]\s*$", ""))
    return F.coalesce(F.nullif("rule_id", F.lit("")), short)


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES] + [
        F.count(F.lit(1)).alias("TOTAL")]


# --- one row per run -----------------------------------------------------------------------

def status_counts(checks: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Checks per status and in total, per run or any other grouping."""
    return checks.groupBy(*by).agg(*_status_counts())


def run_verdicts(checks: DataFrame) -> DataFrame:
    """Pass flag and exit code per run. A run expected to fail passes by finding a FAIL."""
    negative = F.coalesce(F.lower(F.trim("expected")).isin(*NEGATIVE_WORDS), F.lit(False))
    per_run = checks.groupBy(*RUN).agg(*_status_counts(), F.max(negative).alias("negative"))
    failed, errored = F.col("FAIL") > 0, F.col("ERROR") > 0
    code = (F.when(errored, 2).when(F.col("negative"), F.when(failed, 0).otherwise(1))
            .when(failed, 1).otherwise(0))
    return per_run.select(*RUN, "negative", (code == 0).alias("passed"),
                          code.alias("exit_code"), *STATUSES, "TOTAL")


def _rate(counts: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(counts / total * 100 + 0.5)).otherwise(0).cast("bigint")


def pass_rates(checks: DataFrame) -> DataFrame:
    """Whole-percent pass rate and the share of every status, per run."""
    total = F.greatest(F.col("TOTAL"), F.lit(1))
    return status_counts(checks).select(
        *RUN, _rate(F.col("PASS"), F.col("TOTAL")).alias("pass_rate"),
        *[(F.col(s) / total * 100).alias(f"{s.lower()}_share") for s in STATUSES])


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Adds ``run_no``: the place of a run in its suite, by start.

    Runs are numbered within each hour of a suite; hours are then shifted by the runs of the
    hours before. Only hourly counts, never the runs of a suite, pass through one window.
    """
    hour = F.substring(F.col("started_at").cast("string"), 1, 13)
    hourly = runs.withColumns({"__suite": F.coalesce("suite", F.lit("")), "__hour": hour})
    in_hour = F.row_number().over(
        Window.partitionBy("__suite", "__hour").orderBy("started_at", "run_id"))
    so_far = F.sum("n").over(Window.partitionBy("__suite").orderBy("__hour")
                             .rowsBetween(Window.unboundedPreceding, -1))
    shifts = (hourly.groupBy("__suite", "__hour").agg(F.count(F.lit(1)).alias("n"))
              .select("__suite", "__hour", F.coalesce(so_far, F.lit(0)).alias("__shift")))
    return (hourly.withColumn("__place", in_hour).join(shifts, ["__suite", "__hour"])
            .withColumn("run_no", F.col("__shift") + F.col("__place"))
            .drop("__suite", "__hour", "__shift", "__place"))


def _numbered(runs: DataFrame) -> DataFrame:
    """One row per run with its number and ``suite_key``, a suite name that is never NULL."""
    return numbered_runs(runs.select(*RUN)).select(
        "run_id", F.coalesce("suite", F.lit("")).alias("suite_key"), "run_no")


def pass_rate_deltas(checks: DataFrame) -> DataFrame:
    """Pass rate against the run before of the same suite."""
    rates = numbered_runs(pass_rates(checks).select(*RUN, "pass_rate")).withColumn(
        "suite_key", F.coalesce("suite", F.lit("")))
    before = rates.select("suite_key", (F.col("run_no") + 1).alias("run_no"),
                          F.col("run_id").alias("prev_run_id"),
                          F.col("pass_rate").alias("prev_pass_rate"))
    return rates.join(before, ["suite_key", "run_no"], "left").select(
        *RUN, "pass_rate", "prev_run_id",
        (F.col("pass_rate") - F.col("prev_pass_rate")).alias("delta_points"))


# --- failures over time --------------------------------------------------------------------

def failures(checks: DataFrame, runs: DataFrame | None = None,
             depth: int = STREAK_DEPTH) -> DataFrame:
    """Every failing check with ``recurring`` (it failed in the run before) and ``streak``.

    ``runs`` is the small table of runs where one is stored, else they are found in the checks.

    The streak counts this run and the unbroken failures before it, ``depth`` runs back at
    most; a run of the suite without the check breaks it. Long histories are cut in chunks of
    run numbers that overlap by ``depth`` runs, so each chunk alone gives exact streaks.
    """
    runs = checks if runs is None else runs
    order = _numbered(runs.groupBy("run_id").agg(*[F.min(c).alias(c) for c in RUN if c != "run_id"]))
    numbered = checks.join(order, "run_id").withColumns(
        {"check_id": check_id(), "label": check_label()})
    # A check listed twice in a run counts by its last entry.
    last = numbered.groupBy("suite_key", "check_id", "run_no").agg(
        F.max_by(failing(), "position").alias("failed"))
    chunk = F.floor(F.col("run_no") / _CHUNK)
    copies = F.sequence(chunk, F.floor((F.col("run_no") + depth) / _CHUNK))
    spread = last.where("failed").select(
        "suite_key", "check_id", "run_no", chunk.alias("home"), F.explode(copies).alias("chunk"))
    part = ["suite_key", "check_id", "chunk"]
    island = F.col("run_no") - F.row_number().over(Window.partitionBy(*part).orderBy("run_no"))
    first = F.min("run_no").over(Window.partitionBy(*part, "island"))
    ending = (spread.withColumn("island", island)
              .withColumn("length", F.least(F.col("run_no") - first + 1, F.lit(depth)))
              .where("chunk = home")
              .select("suite_key", "check_id", (F.col("run_no") + 1).alias("run_no"), "length"))
    return (numbered.where(failing())
            .join(ending, ["suite_key", "check_id", "run_no"], "left")
            .select("run_id", "suite", "started_at", "position", "category", "name",
                    "target_table", "status", "severity", "check_id", "label",
                    F.col("length").isNotNull().alias("recurring"),
                    (F.lit(1) + F.coalesce("length", F.lit(0))).cast("bigint").alias("streak")))


def new_and_recurring(failed: DataFrame) -> DataFrame:
    """Per run, failures that are new and that recur, and the longest recurring one.

    Takes the result of :func:`failures`. Of equal streaks the first listed check counts.
    """
    order = F.when(F.col("recurring"), F.struct(F.col("streak"), -F.col("position")))
    return failed.groupBy(*RUN).agg(
        F.count_if(~F.col("recurring")).alias("new_failures"),
        F.count_if("recurring").alias("recurring_failures"),
        F.max_by("label", order).alias("oldest_label"),
        F.coalesce(F.max(F.when(F.col("recurring"), F.col("streak"))), F.lit(0))
        .alias("oldest_streak"))


def p1_blockers(checks: DataFrame) -> DataFrame:
    """Failing P1 checks per run; their table and category where there is only one."""
    hit = failing() & (F.col("severity") == "P1")
    table = F.when(hit, F.nullif("target_table", F.lit("")))
    category = F.when(hit, F.col("category"))

    def only(c: Column) -> Column:
        return F.when(F.min(c) == F.max(c), F.min(c))
    return checks.groupBy(*RUN).agg(F.count_if(hit).alias("p1_failures"),
                                    only(table).alias("table"), only(category).alias("category"))


def category_health(checks: DataFrame) -> DataFrame:
    """Status counts per run and category; errors count as failures too."""
    return status_counts(checks, [*RUN, "category"]).select(
        *RUN, "category", F.col("PASS").alias("pass"), (F.col("FAIL") + F.col("ERROR")).alias("fail"),
        F.col("WARN").alias("warn"), F.col("ERROR").alias("error"), F.col("SKIPPED").alias("skipped"))


# --- lists ---------------------------------------------------------------------------------

def latest_per_suite(runs: DataFrame) -> DataFrame:
    """The newest run of every suite."""
    newest = F.max_by(F.struct(*[F.col(c) for c in runs.columns if c != "suite"]),
                      F.struct("started_at", "run_id"))
    return runs.groupBy("suite").agg(newest.alias("newest")).select("suite", "newest.*")


def manifest(runs: DataFrame, newest: int = MANIFEST_RUNS) -> DataFrame:
    """The newest runs, with the number of all runs and of those shown."""
    total = runs.agg(F.count(F.lit(1))).scalar()
    return (runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc())
            .select("*", total.alias("runs_total"),
                    F.least(total, F.lit(newest)).alias("runs_shown")).limit(newest))


def triage(checks: DataFrame, statuses: Sequence[str] | None = None,
           categories: Sequence[str] | None = None) -> DataFrame:
    """Checks in order of urgency, optionally of some statuses and categories only."""
    if statuses:
        checks = checks.where(F.col("status").isin(*statuses))
    if categories:
        checks = checks.where(F.col("category").isin(*categories))
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")) - 1
    return checks.withColumn("urgency", rank).orderBy("urgency", "run_id", "position")


def search(runs: DataFrame, kind: str = "all", passed: bool | None = None,
           text: str = "", fields: Sequence[str] = ("run_id", "suite"),
           report_suites: Sequence[str] = ()) -> DataFrame:
    """Runs of a kind (all, data, reports), an outcome and a text in any of the fields.

    A run without recorded categories is told by the name of its suite: ``report_*``, or one of
    ``report_suites``.
    """
    stem = F.regexp_replace(F.coalesce("suite", F.lit("")), r"\.ya?ml$", "")
    by_name = stem.startswith("report_") | stem.isin(*report_suites)
    known = F.coalesce(F.size("categories") > 0, F.lit(False))
    is_report = F.when(known, F.arrays_overlap("categories", F.array(*map(F.lit, REPORT_CATEGORIES)))
                       ).otherwise(by_name)
    found = runs.withColumn("is_report", is_report)
    if kind in ("data", "reports"):
        found = found.where(F.col("is_report") == F.lit(kind == "reports"))
    if passed is not None:
        found = found.where(F.coalesce("passed", F.lit(False)) == F.lit(passed))
    wanted = text.strip().lower()
    if wanted:
        blob = F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
        found = found.where(F.contains(F.lower(blob), F.lit(wanted)))
    return found


def evidence(checks: DataFrame) -> DataFrame:
    """One row per evidence file of any check (``evidence``: array of label, path, rows)."""
    return checks.select("run_id", "suite", "category", F.col("name").alias("check_name"),
                         "status", "target_table", F.inline("evidence"))


def checks_of_documents(documents: DataFrame) -> DataFrame:
    """Flat checks from nested run documents (``run_id``, ``checks``: array of structs)."""
    return documents.select(*[c for c in documents.columns if c != "checks"],
                            F.posexplode("checks").alias("position", "check")) \
        .select("*", "check.*").drop("check")


# --- alerts and rollups ----------------------------------------------------------------------

def _trips(tokens: Sequence[str]) -> Column:
    return F.col("status").isin(*tokens) | F.coalesce(F.col("severity").isin(*tokens), F.lit(False))


def alerts(checks: DataFrame, tokens: Sequence[str], suites: Sequence[str] = ()) -> DataFrame:
    """Runs that trip an alert: the tokens hit, failures, errors and the worst severity."""
    if suites:
        checks = checks.where(F.col("suite").isin(*suites))
    trip = _trips(tokens)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = F.min(F.when(trip & (rank > 0), rank))
    hits = [F.bool_or((F.col("status") == t) | F.coalesce(F.col("severity") == t, F.lit(False)))
            .alias(f"hit_{i}") for i, t in enumerate(tokens)]
    per_run = checks.groupBy(*RUN).agg(
        F.count_if(trip).alias("tripped"), F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "ERROR").alias("errored"),
        F.count(F.lit(1)).alias("total"), worst.alias("worst"), *hits)
    named = F.concat_ws(",", *[F.when(F.col(f"hit_{i}"), F.lit(t)) for i, t in enumerate(tokens)])
    return per_run.where("tripped > 0").select(
        *RUN, "tripped", "failed", "errored", "total",
        F.concat(F.lit("P"), F.col("worst").cast("string")).alias("worst_severity"),
        named.alias("triggered_by"))


def alert_samples(checks: DataFrame, tokens: Sequence[str], first: int = ALERT_SAMPLE) -> DataFrame:
    """The first tripped checks per run; no map task sends more than that per run."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("position"))
    return (checks.where(_trips(tokens)).withColumn("place", place).where(F.col("place") <= first)
            .select("run_id", "place", "name", "status", "severity", "message"))


def batch_rollup(cases: DataFrame) -> DataFrame:
    """Outcome of batches from ``batch_id, exit_code, passed`` per case; code 2 is an error."""
    errored = F.coalesce(F.col("exit_code") == 2, F.lit(False))
    passed = ~errored & F.coalesce(F.col("passed"), F.col("exit_code") == 0, F.lit(False))
    counts = cases.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(passed).alias("cases_passed"),
        F.count_if(~errored & ~passed).alias("cases_failed"),
        F.count_if(errored).alias("cases_errored"))
    return counts.withColumn("status", F.when(F.col("cases_errored") > 0, "error")
                             .when(F.col("cases_failed") > 0, "failed").otherwise("passed"))


def regression_totals(verdicts: DataFrame) -> DataFrame:
    """Status counts and verdict per suite, and over all suites in a TOTAL row."""
    every = F.grouping("suite") == 1
    return verdicts.rollup("suite").agg(
        every.alias("overall"), F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col("passed")).alias("not_passing"),
        *[F.sum(s).alias(s) for s in (*STATUSES, "TOTAL")]).select(
        F.when(F.col("overall"), "TOTAL").otherwise(F.col("suite")).alias("suite"), "overall",
        F.when(F.col("not_passing") == 0, "PASS").otherwise("FAIL").alias("result"),
        "runs", "not_passing", *STATUSES, "TOTAL")


def by_scenario(latest: DataFrame, suites: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Newest run per suite under its scenario; unknown scenarios go to "Ungrouped".

    ``suites``: suite, scenario_id; ``scenarios``: scenario_id, scenario.
    """
    return (suites.join(latest, "suite", "left").join(scenarios, "scenario_id", "left")
            .withColumn("scenario", F.coalesce("scenario", F.lit(UNGROUPED))).drop("scenario_id"))
