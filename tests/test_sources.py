import collections
import csv
import gzip
import io
import statistics

import pytest
from pyspark.sql import functions as F

from tallymark.operators.checks import row_count
from tallymark.sources import readers, sinks
from tallymark.sources.connections import connect, count_query, jdbc_settings
from tallymark.sources.readers import Dataset, DatasetError


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a_1.csv").write_text('id,name\n1,"x, ""y"""\n2,NA\n')
    (tmp_path / "a_2.csv").write_text("name,city,id\nq,Rome,3\n")
    (tmp_path / "a_3.tsv").write_text("id\tcity\n4\t-\n")
    df = readers.read_delimited(spark, f"{tmp_path}/a_*", na_values=["-"])
    got = sorted((r.id, r.name, r.city, r[readers.SOURCE_FILE]) for r in df.collect())
    assert got == [("1", 'x, "y"', None, "a_1.csv"), ("2", None, None, "a_1.csv"),
                   ("3", "q", "Rome", "a_2.csv"), ("4", None, None, "a_3.tsv")]
    narrow = readers.read_dataset(spark, Dataset(path=f"{tmp_path}/a_*", columns=["id"], where="id > 2"))
    assert narrow.columns == ["id", readers.SOURCE_FILE] and narrow.count() == 2
    typed = readers.read_delimited(spark, f"{tmp_path}/a_1.csv", dtype_str=False)
    assert dict(typed.dtypes)["id"] == "int"


def test_many_files_are_looked_up_in_one_job(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"f_{i}.csv").write_text("id,name\n" if i == 7 else
                                             f"id,name\n{i},n{i}\n" if i % 2 else f"\nname,id\nn{i},{i}\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    df = readers.read_delimited(spark, f"{tmp_path}/f_*.csv")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) < 12
    got = sorted((int(r.id), r.name, r[readers.SOURCE_FILE]) for r in df.collect())
    assert got == [(i, f"n{i}", f"f_{i}.csv") for i in range(200) if i != 7]


def test_headers_by_their_first_bytes(tmp_path):
    """A header is found in 64 KB; more is read only while no line has ended."""
    def looked(data, encoding="utf-8"):
        stream, asked = io.BytesIO(data), []
        return readers.first_line(lambda n: (asked.append(n), stream.read(n))[1], encoding), sum(asked)

    rows = b"\n".join(b"1,2,3" for _ in range(100_000))
    assert looked(b"a,b\n" + rows) == ("a,b", readers.HEADER_BYTES)
    assert looked(b"\xef\xbb\xbfa,b\r\n" + rows)[0] == "a,b"
    assert looked(b"\n  \n\r\na,b\r" + rows)[0] == "a,b"
    assert looked("ä,b\n1".encode("utf-16"), "utf-16")[0] == "ä,b"
    assert looked("ä,b\n1".encode("latin-1"), "latin-1")[0] == "ä,b"
    wide = ",".join(f"column_{i}" for i in range(30_000)).encode()
    found, read = looked(wide + b"\n" + rows)
    assert found == wide.decode() and read <= 4 * len(wide)
    assert looked(b"only")[0] == "only" and looked(b"")[0] is None and looked(b"\n \n")[0] is None


def test_names_are_those_of_the_csv_source(spark, tmp_path):
    for number, line in enumerate(['a,,"b, ""c""",a,A,', "x", "é b,_c1,", '" q ",r']):
        path = tmp_path / f"{number}.csv"
        path.write_text(line + "\n1\n")
        cells = next(csv.reader([line]))
        assert readers.column_names(cells) == spark.read.option("header", True).option("escape", '"').csv(str(path)).columns


@pytest.mark.parametrize("ranges", [True, False])
def test_one_scan_for_any_number_of_headers(spark, tmp_path, monkeypatch, ranges):
    """Forty headers, odd file names, a compressed, an empty and a blank file; also where only Spark reads the store."""
    if not ranges:
        monkeypatch.setattr(readers, "_reachable", lambda path: False)
    want = []
    for i in range(40):
        names = ["id", "name", f"x{i}"]
        names = names[i % 3:] + names[:i % 3]
        lines = [",".join(names)] + [",".join({"id": f"{i}{k}", "name": "NA", f"x{i}": f"v {k}"}[n] for n in names) for k in range(3)]
        data = "\n".join(lines).encode()
        if i == 7 and ranges:
            (tmp_path / f"f {i}%.csv.gz").write_bytes(gzip.compress(data))
        else:
            (tmp_path / f"f {i}%.csv").write_bytes(data)
        want += [(f"{i}{k}", None, f"v {k}") for k in range(3)]
    (tmp_path / "f empty.csv").write_text("")
    (tmp_path / "f blank.csv").write_text("\n \n")
    df = readers.read_delimited(spark, f"{tmp_path}/f*")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Python" not in plan and "MapInArrow" not in plan
    cells = [c for c in df.columns if c.startswith("x")]
    got = [(r.id, r.name, next(r[c] for c in cells if r[c])) for r in df.collect()]
    assert sorted(got) == sorted(want) and len(cells) == 40
    assert df.where("id > 200").count() == sum(int(i) > 200 for i, *_ in want)
    one = df.select("id").where("id = '115'")._jdf.queryExecution().optimizedPlan().toString()
    assert "_c0" in one


def test_types_over_all_files(spark, tmp_path):
    (tmp_path / "t_1.csv").write_text("a,b,c,d,e,f\n1,1,true,2020-01-02,2020-01-02 10:00:00,\n")
    (tmp_path / "t_2.csv").write_text("b,a,c,d,e,f\n1.5,NA,false,2020-02-30,2020-01-02,x\n")
    df = readers.read_delimited(spark, f"{tmp_path}/t_*.csv", dtype_str=False).drop(readers.SOURCE_FILE)
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "boolean", "d": "string", "e": "string",
                               "f": "string"}
    assert sorted((r.a or 0, r.b) for r in df.collect()) == [(0, 1.5), (1, 1.0)]


def test_errors(spark, tmp_path):
    with pytest.raises(DatasetError):
        readers.read_delimited(spark, f"{tmp_path}/none*.csv")
    with pytest.raises(DatasetError):
        readers.pick_columns(spark.range(1), ["nope"])
    with pytest.raises(DatasetError):
        readers.read_dataset(spark, Dataset())
    with pytest.raises(DatasetError):
        readers.capped(spark.range(11), 10)
    assert readers.capped(spark.range(10), 10).count() == 10
    assert readers.capped(spark.range(11), 10, allow_truncation=True).count() == 10


def test_jdbc_options():
    assert readers.jdbc_options("u", "t") == {"url": "u", "fetchsize": "10000", "dbtable": "t"}
    assert readers.jdbc_options("u", query="select 1")["query"] == "select 1"
    ranged = readers.jdbc_options("u", query="select 1", partition_column="id", lower=0, upper=9,
                                  partitions=3)
    assert ranged["dbtable"] == "(select 1) q" and ranged["numPartitions"] == "3"
    with pytest.raises(DatasetError):
        readers.jdbc_options("u", "t", partition_column="id")


def test_databases_count_by_themselves():
    assert count_query(Dataset(table="d.s.t")) == "SELECT COUNT(*) AS row_total FROM d.s.t"
    assert count_query(Dataset(table="t", query="select 1")) == "SELECT COUNT(*) AS row_total FROM (select 1) q"
    assert count_query(Dataset(table="t", where="a > 1")) is None


def test_row_count_of_a_counted_side(spark):
    given = spark.range(1).selectExpr("7 AS row_total")
    row = row_count(spark.range(0), spark.range(3), (given, None)).first()
    assert (row.source_rows, row.target_rows, row.difference, row.status) == (7, 3, -4, "FAIL")


def test_encoding(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id;name\n1;Zoë\n".encode("latin-1"))
    df = readers.read_delimited(spark, f"{tmp_path}/l.csv", sep=";", encoding="latin1")
    assert df.first().name == "Zoë"


def test_preview(spark):
    got = sinks.preview(spark.range(7), 5).collect()
    assert len(got) == 5 and (got[0].preview_total, got[0].preview_truncated) == (7, True)
    assert sinks.preview(spark.range(3), 5).first().preview_truncated is False


def test_connections(spark, tmp_path):
    assert jdbc_settings({"type": "sqlserver", "host": "h", "port": 1433, "database": "d", "user": "u",
                          "password": "p"}) == (
        "jdbc:sqlserver://h:1433;databaseName=d;encrypt=true;trustServerCertificate=true",
        {"user": "u", "password": "p"})
    assert jdbc_settings({"type": "snowflake", "account": "a", "user": "u", "database": "d",
                          "schema": "s"})[0] == "jdbc:snowflake://a.snowflakecomputing.com/?db=d&schema=s"
    assert jdbc_settings({"type": "sqlite", "path": "f.db"}) == ("jdbc:sqlite:f.db", {})
    assert jdbc_settings({"type": "access", "path": "f.accdb", "password": "x"}) == (
        "jdbc:ucanaccess://f.accdb", {"password": "x"})
    for bad in ({"type": "nope"}, {"type": "sqlserver", "host": "h"}, {"type": "snowflake"}):
        with pytest.raises(DatasetError):
            connect(spark, bad)
    (tmp_path / "a.csv").write_text("id\n1\n2\n")
    read = connect(spark, {"type": "files", "base_dir": str(tmp_path), "max_rows": 1})
    with pytest.raises(DatasetError):
        read(Dataset(table="a.csv"))
    assert connect(spark, {"type": "Files", "base_dir": str(tmp_path)})(Dataset(table="a.csv")).count() == 2


def test_a_hot_key_fills_several_files_in_order(spark, tmp_path):
    """A third of all rows under one key, half of these wholly equal: no file holds over twice the median."""
    rows = spark.range(30_000).select(F.when(F.col("id") < 10_000, 15_000).otherwise(F.col("id")).alias("k"),
                                      F.when(F.col("id") < 5_000, 0).otherwise(F.col("id")).alias("v"))
    sinks.in_order(rows.repartition(5), ["k"], 9).write.parquet(str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e")).select(
        "k", "v", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    found = sorted(back.collect(), key=lambda r: (r.file, r["at"]))
    assert [r.k for r in found] == sorted(r.k for r in found) and len(found) == 30_000
    sizes = collections.Counter(r.file for r in found)
    assert len(sizes) == 9 and max(sizes.values()) <= 2 * statistics.median(sizes.values())
    assert len({r.file for r in found if r.k == 15_000}) >= 3
    assert len({r.file for r in found if r.k == 15_000 and r.v == 0}) >= 2


def test_samples_meet_the_table_in_one_shuffle(spark, tmp_path):
    """All samples are looked up in the table together, rows with equal or NULL keys among them."""
    from catalog.q_sources import QUERIES

    key = F.when(F.col("id") % 5 > 0, F.col("id") % 900)  # a fifth of the keys is NULL
    rows = spark.range(1500).select(key.alias("l_orderkey"), *[F.col("id").alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")],
                                    F.lit(None).cast("double").alias("l_extendedprice"))
    rows.unionByName(rows.limit(40)).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["capped_sample"](spark, str(tmp_path))
    assert sorted((r.cap, r.sampled, r.refused, r.known) for r in found.collect()) == [
        (1_000, 1_000, True, 1_000), (20_000, 1_540, False, 1_540), (10_000_000, 1_540, False, 1_540)]
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.count("FileScan") == 4 and plan.count("ENSURE_REQUIREMENTS") - plan.count("SinglePartition") == 1
