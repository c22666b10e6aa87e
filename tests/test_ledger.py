"""Committed runs, compaction and trends that are kept up, against the history as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import history
from tallymark.session import discard_stored, shared_folder, stored
from tallymark.sources import ledger as lg

SCHEMA = ("run_id string, suite string, started_at string, position long, category string, name string, "
          "target_table string, status string, severity string, rule_id string")


def some_runs(seed, n=60):
    """run -> its check rows, in order of start; suites and checks come and go."""
    rng, runs = random.Random(seed), {}
    for i in range(n):
        suite = "hot" if i % 3 else rng.choice(["a", None])
        rows = [(f"c{j}", "FAIL" if rng.random() < (.9 if j else .5) else "PASS") for j in range(4) if rng.random() < .9]
        rows += [("c1", "PASS")] if i % 10 == 0 else []  # listed twice
        runs[i] = [(f"r{i:04d}", suite, f"2026-01-{1 + i // 24:02d}T{i % 24:02d}:00:00", at, "schema", name, "t", status,
                    "P1", None) for at, (name, status) in enumerate(rows)]
    return {i: rows for i, rows in runs.items() if rows}


def frame(spark, runs):
    return spark.createDataFrame([row for rows in runs for row in rows], SCHEMA)


def as_rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


FAILED = ("run_id", "suite", "position", "check_id", "label", "recurring", "streak")


@pytest.mark.parametrize("depth", [3, 12])
def test_folds_equal_the_whole_history(spark, depth):
    """Runs come in any order, some more than once; after every fold streaks are those of a full pass."""
    runs, book = some_runs(depth, 50), lg.ledger(spark, shared_folder(spark), depth=depth)
    order = list(runs)
    random.Random(1).shuffle(order)
    order = sorted(order[:35]) + order[35:]
    done = []
    for lo, hi in ((0, 25), (25, 35), (35, 50)):
        part = order[lo:hi]
        book.append(frame(spark, [runs[i] for i in part + done[:2]]))  # two runs are sent again
        done += part
        book.fold()
        whole = frame(spark, [runs[i] for i in done])
        assert as_rows(book.failures(), *FAILED) == as_rows(history.failures(whole, depth=depth), *FAILED)
    version = book.version()
    assert book.fold() == version  # nothing new, nothing done
    last = {}
    for i in sorted(done):
        for run_id, suite, _, _, _, name, table, status, *_ in runs[i]:
            last[suite or "", f"schema|{name}|{table}"] = (run_id, status)
    assert {(r.suite, r.check_id): (r.run_id, r.status) for r in book.state().collect()} == last
    streaks = {(r.run_id, r.check_id): r.streak for r in book.failures().collect()}
    assert all(r.streak == (streaks.get((r.run_id, r.check_id)) if r.status == "FAIL" else None)
               for r in book.state().collect())


def test_a_fold_reads_only_what_the_new_runs_hang_on(spark, monkeypatch):
    runs, book = some_runs(7, 90), lg.ledger(spark, shared_folder(spark), depth=3)
    order = sorted(runs)
    book.append(frame(spark, [runs[i] for i in order[:-1]]))
    book.fold()
    seen = []
    whole = history.failures
    monkeypatch.setattr(history, "failures", lambda rows, *a: (seen.append(rows.select("run_id").distinct().count()), whole(rows, *a))[1])
    book.append(frame(spark, [runs[order[-1]]]))
    book.fold()
    assert seen == [4]  # the new run and the three before it


def test_a_fold_settles_its_rows_once_and_narrow(spark, monkeypatch):
    """Only the columns that trends need are kept for a fold, and failures are written once; NULL positions have no say."""
    runs, book = some_runs(5, 12), lg.ledger(spark, shared_folder(spark))
    rows = frame(spark, runs.values()).withColumn("message", F.lit("long"))
    rows = rows.withColumn("position", F.when((F.col("run_id") != "r0011") | (F.col("name") != "c0"), F.col("position")))
    settled = []
    monkeypatch.setattr(lg, "stored", lambda df: (settled.append(df.columns), stored(df))[1])
    book.append(rows)
    book.fold()
    kept = [columns for columns in settled if "run_id" in columns]
    assert len(kept) == 4 and not any({"message", "metrics", "use_case", "expected"} & {*columns} for columns in kept)
    assert as_rows(book.failures(), *FAILED) == as_rows(history.failures(rows), *FAILED)
    last = {}
    for i in sorted(runs):
        for run_id, suite, _, _, _, name, table, status, *_ in runs[i]:
            last[suite or "", f"schema|{name}|{table}"] = (run_id, None if (run_id, name) == ("r0011", "c0") else status)
    assert {(r.suite, r.check_id): (r.run_id, r.status) for r in book.state().collect()} == last


def test_no_half_run_is_seen(spark, monkeypatch):
    runs, book = some_runs(2, 6), lg.ledger(spark, shared_folder(spark))
    assert book.runs().count() == book.checks().count() == book.failures().count() == 0 and book.fold() == 0
    one, two = [runs[0]], [runs[i] for i in sorted(runs)[1:]]
    book.append(frame(spark, one))
    with monkeypatch.context() as patch:
        patch.setattr(lg.Ledger, "_commit", lambda *_: (_ for _ in ()).throw(OSError("stopped between writes")))
        with pytest.raises(OSError):
            book.append(frame(spark, two))
    assert as_rows(book.checks(), *SCHEMA_NAMES) == as_rows(frame(spark, one), *SCHEMA_NAMES)
    book.fold()
    assert book.failures().select("run_id").distinct().count() <= 1
    book.append(frame(spark, two))
    book.append(frame(spark, two))  # once more changes nothing
    assert as_rows(book.checks(), *SCHEMA_NAMES) == as_rows(frame(spark, one + two), *SCHEMA_NAMES)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_a_fold_that_stops_is_not_seen(spark, monkeypatch):
    runs, book = some_runs(4, 20), lg.ledger(spark, shared_folder(spark))
    order = sorted(runs)
    book.append(frame(spark, [runs[i] for i in order[:10]]))
    book.fold()
    before = as_rows(book.failures(), *FAILED), as_rows(book.state(), "check_id", "run_id")
    book.append(frame(spark, [runs[i] for i in order[10:]]))
    with monkeypatch.context() as patch:
        patch.setattr(lg.Ledger, "_write_state", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            book.fold()
    assert (as_rows(book.failures(), *FAILED), as_rows(book.state(), "check_id", "run_id")) == before
    book.fold()
    assert as_rows(book.failures(), *FAILED) == as_rows(history.failures(frame(spark, runs.values())), *FAILED)


def test_compaction_keeps_all_rows_in_few_files(spark, monkeypatch):
    runs, book = some_runs(9, 8), lg.ledger(spark, shared_folder(spark))
    for i in sorted(runs):
        book.append(frame(spark, [runs[i]]))
    whole = as_rows(frame(spark, runs.values()), *SCHEMA_NAMES)
    with monkeypatch.context() as patch:
        patch.setattr(lg.Ledger, "_commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            book.compact()
    assert as_rows(book.checks(), *SCHEMA_NAMES) == whole
    batch = book.compact()
    assert book.compact() is None
    assert book.runs().select("batch").distinct().collect()[0].batch == batch and book.runs().count() == len(runs)
    assert len(book.checks().inputFiles()) > 8
    assert len(book.vacuum()) == len(runs)
    assert as_rows(book.checks(), *SCHEMA_NAMES) == whole
    assert len([f for f in book.checks().inputFiles() if batch in f]) <= 2
    book.append(frame(spark, [runs[sorted(runs)[0]]]))  # a run that a compaction has taken up is known too
    assert as_rows(book.checks(), *SCHEMA_NAMES) == whole
    book.fold()
    assert as_rows(book.failures(), *FAILED) == as_rows(history.failures(frame(spark, runs.values())), *FAILED)


def test_stored_folders_are_given_back(spark):
    import os

    df = stored(spark.range(10))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and df.agg(F.count("*")).first()[0] == 10
    assert discard_stored(spark) > 0 and not os.path.exists(path) and discard_stored(spark) == 0
