import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark.operators import history
from tallymark.session import shared_folder
from tallymark.sources import sinks

SCHEMA = ("run_id string, suite string, started_at string, position long, category string, "
          "name string, target_table string, status string, severity string, rule_id string")


def make(spark, runs):
    """runs: list of (suite, [(name, status)]) in order of start."""
    rows = [(f"r{n:04d}", suite, f"2026-01-01T{n // 60:02d}:{n % 60:02d}:00", i, "schema", name, "t",
             status, "P1", None)
            for n, (suite, checks) in enumerate(runs) for i, (name, status) in enumerate(checks)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_force(runs, depth=12):
    out, before = {}, {}
    for n, (suite, checks) in enumerate(runs):
        past = before.setdefault(suite, [])
        for i, (name, status) in enumerate(checks):
            if status in ("FAIL", "ERROR"):
                streak = 1
                for statuses in reversed(past[-depth:]):
                    if statuses.get(name) not in ("FAIL", "ERROR"):
                        break
                    streak += 1
                out[(f"r{n:04d}", i)] = streak
        past.append(dict(checks))  # the last entry of a name counts
    return out


@pytest.mark.parametrize("chunk", [16, 1024])
def test_streaks_match_brute_force_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(history, "_CHUNK", chunk)
    rng = random.Random(chunk)
    runs = []
    for n in range(150):
        suite = "hot" if n % 3 else rng.choice(["a", None])
        checks = [(f"c{j}", "FAIL" if rng.random() < (.97 if j else .6) else "PASS")
                  for j in range(3) if rng.random() < .97]
        if n % 10 == 0:
            checks.append(("c1", "PASS"))  # listed twice
        runs.append((suite, checks))
    got = {(r.run_id, r.position): r.streak for r in history.failures(make(spark, runs)).collect()}
    assert got == brute_force(runs)
    assert max(got.values()) == 13


def test_streaks_deeper_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(history, "_CHUNK", 8)
    runs = [("s", [("c", "FAIL")])] * 59
    got = history.failures(make(spark, runs), depth=40).collect()
    assert {(r.run_id, r.position): r.streak for r in got} == brute_force(runs, 40)


def test_new_and_recurring(spark):
    runs = [("s", [("a [t]", "FAIL"), ("b", "FAIL")]), ("s", [("a [t]", "ERROR"), ("b", "PASS"), ("c", "FAIL")]),
            ("s", [("a [t]", "FAIL"), ("c", "FAIL")])]
    got = {r.run_id: tuple(r)[3:] for r in
           history.new_and_recurring(history.failures(make(spark, runs))).collect()}
    assert got == {"r0000": (2, 0, None, 0), "r0001": (1, 1, "a", 2), "r0002": (0, 2, "a", 3)}


def test_negative_runs_invert(spark):
    from pyspark.sql import functions as F
    runs = make(spark, [("s", [("a", "FAIL")]), ("s", [("a", "PASS")]),
                        ("s", [("a", "ERROR"), ("b", "FAIL")])])
    for expected, codes in (("pass", [1, 0, 2]), (" Fail", [0, 1, 2])):
        got = history.run_verdicts(runs.withColumn("expected", F.lit(expected))).orderBy("run_id")
        assert [r.exit_code for r in got.collect()] == codes


def test_run_documents_of_several_writers(spark, tmp_path):
    for member, run in (("ann", "r1"), ("bob", "r2")):
        folder = tmp_path / f"member={member}" / "runs" / run
        folder.mkdir(parents=True)
        (folder / "result.json").write_text(
            '{"run_id": "%s", "suite": "s", "started_at": "2026", "checks": ['
            '{"name": "n", "category": "schema", "status": "FAIL", "evidence": '
            '[{"label": "x", "path": "p", "rows": 3}, {"label": "y", "path": "q"}]}, '
            '{"name": "m", "category": "schema", "status": "PASS"}]}' % run)
    broken = tmp_path / "member=bob" / "runs" / "r3"
    broken.mkdir()
    (broken / "result.json").write_text('{"run_id": ')
    docs = sinks.read_run_documents(spark, f"{tmp_path}/member=*/runs/*/result.json")
    flat = history.checks_of_documents(docs)
    assert flat.count() == 4
    assert sorted(tuple(r)[-3:] for r in history.evidence(flat).collect()) == [
        ("x", "p", 3), ("x", "p", 3), ("y", "q", None), ("y", "q", None)]


@pytest.mark.parametrize("reached", [True, False])
def test_run_documents_are_dealt_to_few_folders(spark, monkeypatch, reached):
    """A file per run, in folders whose number does not grow with the runs; a second write changes nothing."""
    if not reached:
        monkeypatch.setattr(sinks, "_reachable", lambda folder: False)
    runs = 700 if reached else 20
    check = F.struct(F.lit("n").alias("name"), F.col("id").cast("string").alias("status"))
    docs = spark.range(runs).select(
        F.get(F.array(F.lit("a b"), F.lit("c=d/é%"), F.lit(None)), (F.col("id") % 3).cast("int")).alias("member"),
        F.concat(F.lit("r/ü:"), "id").alias("run_id"), F.array(check, check).alias("checks"))
    folder = shared_folder(spark)
    for _ in range(2 if reached else 1):
        sinks.write_run_documents(docs, folder)
    files = [f"{at}/{f}" for at, _, names in os.walk(folder.removeprefix("file://")) for f in names if f.endswith(".json")]
    assert len(files) == runs
    if reached:
        assert max(Counter(f.split("/member=")[1].split("/")[0] for f in {os.path.dirname(f) for f in files}).values()) <= 256
    back = history.checks_of_documents(sinks.read_run_documents(spark, folder)).select("member", "run_id", "position", "status")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(
        [(("a b", "c=d/é%", None)[i % 3], f"r/ü:{i}", at, str(i)) for i in range(runs) for at in (0, 1)], key=repr)


def test_a_run_of_two_start_times_is_one_run(spark):
    checks = make(spark, [("s", [("a", "FAIL"), ("b", "FAIL")])] * 2)
    varied = checks.withColumn("started_at", history.F.concat("started_at", history.F.col("name")))
    assert history.failures(varied).count() == history.failures(checks).count() == 4
