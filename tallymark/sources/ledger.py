"""Committed run history: runs become visible all at once, and trends are kept up as runs arrive.

A ledger is a folder of Parquet tables:

* ``data/batch=../day=..`` has the check rows of runs, one folder per append;
* ``commits/`` has a row per run that names its batch. It is written last, in one file, and a run counts only
  through it: rows of an append that stopped half-way are never seen. Of several commits of one run_id the
  first counts, so appending a run again changes nothing. A compaction commits the same runs again, one
  level higher, from fewer files;
* ``failures/``, ``revised/``, ``state/`` and ``folds/`` have a folder per fold, again seen only once the
  last of them is there.

A fold takes up the runs committed since the last one. It reads only those, the later runs of their suites
and the ``depth`` runs before them, which is all that a streak can hang on, and writes streaks for the new
runs and for runs that a late arrival changed. Appends may come from several writers at once; folds and
compactions from one at a time.
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.operators import history
from tallymark.session import discard, stored
from tallymark.sources.sinks import CHECK_SCHEMA

#: Rows of a file that a compaction writes, at most.
FILE_ROWS = 2_000_000
COMMIT = "run_id string, suite string, started_at string, batch string, level int, seq long"
STATE = ("suite string, check_id string, run_id string, started_at string, status string, streak long, version int")
FAILURE = ("run_id string, suite string, started_at string, position long, category string, name string, "
           "target_table string, status string, severity string, check_id string, label string, recurring boolean, "
           "streak long, version int")
#: What a fold needs of a check row.
_LOOKED_AT = ("run_id", "suite", "started_at", "position", "category", "name", "target_table", "status", "severity", "rule_id")
_CHECKS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CHECK_SCHEMA)


def _suite() -> Column:
    return F.coalesce("suite", F.lit(""))


def _moment() -> Column:
    return F.struct("started_at", "run_id")


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    folder: str
    depth: int = history.STREAK_DEPTH

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table of the ledger, without rows as long as nothing has been written to it."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").drop("fold")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # --- runs ---
    def append(self, checks: DataFrame) -> str:
        """Adds runs with all their check rows (columns of the check history; absent ones are NULL); returns the batch.

        Every run of the frame is committed in one step at the end.
        """
        batch = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        names = set(checks.columns)
        rows = checks.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in CHECK_SCHEMA]).where("run_id IS NOT NULL")
        self._write(rows, batch)
        written = self._batch(batch)
        runs = written.groupBy("run_id").agg(F.min("suite").alias("suite"), F.min("started_at").alias("started_at"))
        self._commit(runs, batch, 0)
        return batch

    def _write(self, rows: DataFrame, batch: str) -> None:
        (rows.withColumn("day", F.coalesce(F.substring("started_at", 1, 10), F.lit("none"))).write
         .partitionBy("day").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.folder}/data/batch={batch}"))

    def _batch(self, batch: str) -> DataFrame:
        return self.spark.read.schema(_CHECKS).parquet(f"{self.folder}/data/batch={batch}")

    def _commit(self, runs: DataFrame, batch: str, level: int) -> None:
        (runs.select("run_id", "suite", "started_at", F.lit(batch).alias("batch"), F.lit(level).alias("level"),
                     F.lit(time.time_ns()).alias("seq"))
         .coalesce(1).write.mode("append").parquet(f"{self.folder}/commits"))

    def runs(self) -> DataFrame:
        """run_id, suite, started_at, batch and level of every committed run."""
        first = F.struct(-F.col("level"), F.col("seq"), F.col("batch"))
        return (self._read("commits", COMMIT).groupBy("run_id")
                .agg(F.min_by(F.struct("suite", "started_at", "batch", "level"), first).alias("c"))
                .select("run_id", "c.*"))

    def checks(self, runs: DataFrame | None = None) -> DataFrame:
        """The check rows of all committed runs, or of those given with their batches and, for pruning, their start."""
        rows = self._read("data", f"{_CHECKS}, batch string, day string")
        if runs is not None:
            first = runs.agg(F.min("started_at")).first()[0]
            rows = rows.where((F.col("day") >= (first or "")[:10]) | (F.col("day") == "none"))
        chosen = (self.runs() if runs is None else runs).select("run_id", "batch")
        return rows.join(chosen, ["run_id", "batch"], "left_semi").select(*[f.name for f in CHECK_SCHEMA])

    def compact(self) -> str | None:
        """Writes all committed runs into one batch of large files by day, and commits it; None if it would be the same."""
        runs = stored(self.runs())
        levels = runs.agg(F.max("level"), F.countDistinct("batch")).first()
        if levels[0] is None or levels[1] < 2:
            return None
        batch = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        rows = self.checks(runs.withColumn("started_at", F.lit("")))
        by_day = F.coalesce(F.substring("started_at", 1, 10), F.lit("none"))
        total = rows.count()
        # rows of a run lie together; a day is spread over as many tasks as it has files to fill
        files = max(1, -(-total // FILE_ROWS))
        self._write(rows.repartitionByRange(files, by_day, "run_id"), batch)
        self._commit(runs, batch, levels[0] + 1)
        return batch

    def vacuum(self) -> list[str]:
        """Deletes the folders of batches that were committed and of which no run is read any more."""
        live = self.runs().select("batch").distinct()
        gone = self._read("commits", COMMIT).select("batch").distinct().join(live, "batch", "left_anti").collect()
        for row in gone:  # a batch is an append, not a row
            discard(self.spark, f"{self.folder}/data/batch={row.batch}")
        return sorted(row.batch for row in gone)

    # --- trends ---
    def _folds(self) -> DataFrame:
        return self._read("folds", "run_id string, version int")

    def _seen(self, name: str, schema: str, version: int) -> DataFrame:
        """A table of folds, of those that were finished."""
        return self._read(name, schema).where(F.col("version") <= version)

    def version(self) -> int:
        return self._folds().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def fold(self) -> int:
        """Takes up the runs committed since the last fold; returns the number of the version that has them."""
        version = self.version()
        runs = stored(self.runs().withColumn("suite_key", _suite()))
        new = stored(runs.join(self._folds().select("run_id"), "run_id", "left_anti"))
        if new.isEmpty():
            return version
        version += 1
        since = new.groupBy("suite_key").agg(F.min(_moment()).alias("since"))
        marked = runs.join(since, "suite_key").withColumn("again", _moment() >= F.col("since"))
        back = Window.partitionBy("suite_key", "again").orderBy(_moment().desc())
        before = (marked.where("not again").withColumn("back", F.row_number().over(back))
                  .where(F.col("back") <= self.depth).drop("back"))
        window = stored(marked.where("again").unionByName(before))
        rows = stored(self.checks(window).select(*_LOOKED_AT))
        failures = f"{self.folder}/failures/fold={version}"
        (history.failures(rows, window, self.depth).join(window.where("again").select("run_id"), "run_id", "left_semi")
         .withColumn("version", F.lit(version)).select(*[c.split()[0] for c in FAILURE.split(", ")])
         .write.mode("overwrite").parquet(failures))
        failed = self.spark.read.schema(FAILURE).parquet(failures)
        window.where("again").select("run_id", F.lit(version).alias("version")) \
            .write.mode("overwrite").parquet(f"{self.folder}/revised/fold={version}")
        self._write_state(rows, failed, version)
        (new.select("run_id", F.lit(version).alias("version")).coalesce(1)
         .write.mode("append").parquet(f"{self.folder}/folds"))
        return version

    def _write_state(self, rows: DataFrame, failed: DataFrame, version: int) -> None:
        """The last state laid under the checks that were looked at now."""
        # A check listed twice in a run counts by its last entry; only a row per suite and check leaves a task.
        listed = rows.select(_suite().alias("suite"), history.check_id().alias("check_id"), "run_id", "started_at", "position",
                             F.when(F.col("position").isNotNull(), F.col("status")).alias("status"))
        last = F.max_by(F.struct("run_id", "started_at", "status"), F.struct("started_at", "run_id", "position"))
        newest = listed.groupBy("suite", "check_id").agg(last.alias("s")).select("suite", "check_id", "s.*")
        latest = (newest.join(failed.select("run_id", "check_id", "streak"), ["run_id", "check_id"], "left")
                  .groupBy("suite", "check_id", "run_id", "started_at", "status").agg(F.max("streak").alias("streak"))
                  .select("suite", "check_id", "run_id", "started_at", "status",
                          F.when(history.failing(), F.col("streak")).alias("streak"), F.lit(version).alias("version")))
        order = F.struct("started_at", "run_id", "version")
        both = self._state(version - 1).unionByName(latest)
        (both.groupBy("suite", "check_id").agg(F.max_by(F.struct("run_id", "started_at", "status", "streak"), order).alias("s"))
         .select("suite", "check_id", "s.*", F.lit(version).alias("version"))
         .write.mode("overwrite").parquet(f"{self.folder}/state/fold={version}"))

    def _state(self, version: int) -> DataFrame:
        return self._read("state", STATE).where(F.col("version") == version)

    def state(self) -> DataFrame:
        """Per suite and check its last run, its status there and, if it failed, its streak."""
        return self._state(self.version()).drop("version")

    def failures(self) -> DataFrame:
        """Failing checks of all folded runs with ``recurring`` and ``streak``, as :func:`history.failures` has them."""
        version = self.version()
        last = (self._seen("revised", "run_id string, version int", version).groupBy("run_id")
                .agg(F.max("version").alias("version")))
        return (self._seen("failures", FAILURE, version).join(last, ["run_id", "version"], "left_semi").drop("version"))


def ledger(spark: SparkSession, *folder: str, depth: int = history.STREAK_DEPTH) -> Ledger:
    return Ledger(spark, os.path.join(*folder), depth)
