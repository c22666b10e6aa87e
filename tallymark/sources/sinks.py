"""Results on storage: offender rows, check rows and previews of them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.session import importable, stored
from tallymark.sources.readers import _reachable, headers

PREVIEW_ROWS = 500
SAMPLE_ROWS = 100

CHECK_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("suite", T.StringType()),
    T.StructField("started_at", T.StringType()), T.StructField("expected", T.StringType()),
    T.StructField("position", T.LongType()), T.StructField("category", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("target_table", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rule_id", T.StringType()), T.StructField("use_case", T.StringType())])

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("suite", T.StringType()),
    T.StructField("started_at", T.StringType()), T.StructField("finished_at", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("tables", T.ArrayType(T.StringType())),
    T.StructField("warnings", T.ArrayType(T.StringType()))])

EVIDENCE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("suite", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("check_name", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("target_table", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("rows", T.LongType())])

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("suite", T.StringType()),
    T.StructField("started_at", T.StringType()), T.StructField("finished_at", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("meta", T.StructType([
        T.StructField("categories", T.ArrayType(T.StringType()))])),
    T.StructField("checks", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("category", T.StringType()),
        T.StructField("target_table", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("severity", T.StringType()), T.StructField("message", T.StringType()),
        T.StructField("rule_id", T.StringType()), T.StructField("use_case", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("path", T.StringType()),
            T.StructField("rows", T.LongType())])))])))])


# Folders of writers are named as Spark names those of partitions.
_NO_WRITER = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def write_offenders(offenders: DataFrame, folder: str, format: str = "parquet") -> None:
    """Offender rows of many checks in one write, a folder per ``check_name``."""
    offenders.write.mode("append").partitionBy("check_name").format(format).save(folder)


def in_order(df: DataFrame, by: Sequence[str], files: int | None = None) -> DataFrame:
    """Rows in the order of ``by``, file after file of what is then written (names of files are in order too).

    Cut points are sampled over the key, a hash of the row and its place, so the rows of one key, even wholly
    equal ones, may fill several files and none holds much more than the others. Without ``files`` their number
    follows the size.
    """
    ties = {"__hash": F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]),
            "__place": F.monotonically_increasing_id()}
    order = [*[F.col(f"`{c}`") for c in by], *ties]
    marked = df.withColumns(ties)
    cut = marked.repartitionByRange(files, *order) if files else marked.repartitionByRange(*order)
    return cut.sortWithinPartitions(*order).drop(*ties)


def write_evidence(frames: Mapping[str, DataFrame], folder: str,
                   format: str = "csv") -> dict[str, tuple[str, int]]:
    """Offender frames of different shapes, each below its own name.

    Returns path and number of rows by name; rows are counted while they are written.
    """
    written = {}
    for name, df in frames.items():
        path, seen = f"{folder}/check_name={name}", Observation()
        writer = (df.observe(seen, F.count(F.lit(1)).alias("rows"))
                  .write.mode("overwrite").format(format))
        (writer.option("header", True) if format == "csv" else writer).save(path)
        written[name] = (path, seen.get["rows"])
    return written


def write_listing(listing: DataFrame, folder: str) -> None:
    """Rows on evidence files, added to the history."""
    listing.write.mode("append").json(folder)


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVIDENCE_SCHEMA).json(folder).where("path IS NOT NULL")


def samples(spark: SparkSession, listing: Sequence[tuple], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows, by all columns, of every listed evidence file, each as JSON.

    All files are read by place in one scan, whatever their columns; the names come from one look-up of their
    headers. Tasks keep ``rows`` rows of a file each before these meet, so a huge file costs no more than a small one.
    """
    told = spark.createDataFrame([(run, category, check, path, path.rstrip("/").rpartition("/")[2])
                                  for run, _, category, check, *_, path, _ in listing],
                                 "run_id string, category string, check_name string, path string, place string")
    folders = list(dict.fromkeys(entry[6] for entry in listing))
    found = headers(spark, folders)
    commas = F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))
    width = 1 + found.agg(F.coalesce(F.max(commas), F.lit(0))).first()[0]
    cells, quoting = [f"_c{i}" for i in range(width)], {"escape": '"'}
    schema = ", ".join(f"{c} string" for c in cells)
    folder = F.element_at(F.split("path", "/"), -2)
    names = F.from_csv("header", F.lit(schema), quoting)
    names = F.array_compact(F.array(*[names[c] for c in cells]))
    kinds = found.groupBy(folder.alias("place")).agg(F.min("header").alias("header")).select("place", names.alias("names"))
    first = Window.partitionBy("place").orderBy(*cells)
    lines = spark.read.schema(schema).option("header", True).options(**quoting).csv(folders)
    lines = lines.select(*cells, F.element_at(F.split("_metadata.file_path", "/"), -2).alias("place"))
    kept = lines.withColumn("__at", F.row_number().over(first)).where(F.col("__at") <= rows).join(kinds, "place")
    shown = F.map_from_arrays("names", F.slice(F.array(*cells), F.lit(1), F.size("names")))
    return kept.join(told, "place").select("run_id", "category", "check_name", "path", F.to_json(
        F.map_filter(shown, lambda _, v: v.isNotNull())).alias("sample"))


def write_samples(found: DataFrame, folder: str) -> None:
    """Sample rows of a run, added to the history."""
    found.write.mode("append").json(folder)


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    names = ("run_id", "category", "check_name", "path", "sample")
    return spark.read.schema(", ".join(f"{n} string" for n in names)).json(folder).where("path IS NOT NULL")


def write_checks(checks: DataFrame, folder: str, format: str = "json") -> None:
    """Check rows of a run, added to the history, a folder per day on which runs started."""
    (checks.withColumn("day", F.substring("started_at", 1, 10)).write.mode("append").partitionBy("day")
     .format(format).save(folder))


def write_runs(runs: DataFrame, folder: str) -> None:
    """Rows on runs, added to the history."""
    runs.write.mode("append").json(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.read.schema(RUN_SCHEMA).option("mode", "PERMISSIVE").json(folder)
            .where("run_id IS NOT NULL"))


def read_checks(spark: SparkSession, folder: str, format: str = "json") -> DataFrame:
    """The check history; rows that cannot be read are skipped."""
    reader = spark.read.schema(CHECK_SCHEMA).option("basePath", folder)
    if format == "json":
        reader = reader.option("mode", "PERMISSIVE")
    return reader.format(format).load(folder).where("name IS NOT NULL").drop("day")


def _to_files(folder: str, by: str):
    """Writes each document to a file of its own; the file takes its name once it is whole."""
    def work(batches):
        import pyarrow as pa
        import pyarrow.fs

        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for batch in batches:
            for writer, name, document in zip(*(batch.column(c).to_pylist() for c in ("writer", "name", "document"))):
                at = f"{root}/{by}={_NO_WRITER if not writer else _ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', writer)}/{name[:2]}"
                if at not in made:
                    files.create_dir(at, recursive=True)
                    made.add(at)
                with files.open_output_stream(pending := f"{at}/_{name}.{attempt}") as out:
                    out.write(document.encode())
                files.move(pending, f"{at}/{name}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["written"])

    return work


def write_run_documents(documents: DataFrame, folder: str, by: str = "member") -> None:
    """Nested run documents, one JSON file per run, below a folder per writer, for :func:`read_run_documents`.

    Tasks write the files themselves, named by a hash of the document and dealt to at most 256 folders a writer: the
    folders to be made, committed and listed do not grow with the runs, and a task that runs twice writes the same
    files again. Only where Arrow cannot open the store does Spark write them, with a folder per run.
    """
    if not _reachable(folder):
        documents.withColumn("of_run", F.col("run_id")).write.partitionBy(by, "of_run").json(folder)
        return
    importable(documents.sparkSession)
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != by]))
    told = documents.select(F.col(by).cast("string").alias("writer"), document.alias("document"))
    (told.select("writer", F.sha2("document", 256).alias("name"), "document")
     .mapInArrow(_to_files(folder, by), "written long").agg(F.sum("written")).first())


def read_run_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Nested run documents, one JSON file per run; unreadable files are skipped.

    Folders of several writers (``member=...``) add their column on their own.
    """
    return (spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True)
            .option("mode", "PERMISSIVE").json(pattern).where("run_id IS NOT NULL"))


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, by all columns, with the ``preview_total`` of all and whether some were left out.

    The rows are settled once, so what made them does not run again to be counted.
    """
    settled = stored(df)
    total = settled.agg(F.count(F.lit(1))).scalar()
    first = settled.orderBy(*[F.col(f"`{c}`") for c in df.columns]).limit(rows)
    return first.withColumn("preview_total", total).withColumn(
        "preview_truncated", F.col("preview_total") > rows)
