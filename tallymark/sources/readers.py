"""Datasets as DataFrames: delimited files, tagged parts, SQL text, tables and JDBC.

Filters are Spark SQL expressions. Column choice and filters are plain ``select``/``where``,
so they reach parquet scans and JDBC queries through the optimizer.
"""

from __future__ import annotations

import codecs
import csv
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.normalize import col
from tallymark.session import importable, stored

SOURCE_FILE = "__source_file"
PART_TAG = "__sheet"
PROVENANCE = (SOURCE_FILE, PART_TAG)

# Texts a delimited file uses for a missing value.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


# Charset names the CSV source takes; others need spark.sql.legacy.javaCharsets.
CHARSETS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")


def charset(encoding: str) -> str:
    """The name Spark knows an encoding by, whatever alias it is given under."""
    known = {codecs.lookup(name).name: name for name in CHARSETS}
    return known.get(codecs.lookup(encoding).name, encoding)


class DatasetError(ValueError):
    """A dataset cannot be read as declared."""


@dataclass(frozen=True)
class Dataset:
    """What to read. ``query`` wins over ``table``; ``path`` names files or a glob."""

    table: str | None = None
    query: str | None = None
    path: str | None = None
    columns: Sequence[str] | None = None
    where: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)


def pick_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The named columns, and the provenance columns that came with the data."""
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DatasetError(f"requested columns missing: {missing}; available: {df.columns}")
    kept = [*columns, *[c for c in PROVENANCE if c in df.columns and c not in columns]]
    return df.select(*[col(c) for c in kept])


def filtered(df: DataFrame, where: str | None) -> DataFrame:
    return df.where(F.expr(where)) if where else df


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_parts(parts: Mapping[str, DataFrame], tag: str = PART_TAG) -> DataFrame:
    """Named parts of one feed (tabs of a workbook) under one another, each row tagged."""
    if not parts:
        raise DatasetError("no parts to union")
    return union_by_name([df.withColumn(tag, F.lit(str(name))) for name, df in parts.items()])


#: Bytes that the look-up of a header reads of a file; more only while no line end has been seen.
HEADER_BYTES = 65_536
_LINE_END = re.compile("\r\n|\r|\n")
_BLANK = "".join(map(chr, range(33)))


def first_line(read: Callable[[int], bytes], encoding: str) -> str | None:
    """The first line that is not blank of what ``read`` gives piece by piece, without a byte order mark."""
    decode, seen, size = codecs.getincrementaldecoder(encoding)("replace").decode, "", HEADER_BYTES
    while True:
        data = read(size)
        seen += decode(data, not data)
        *whole, rest = _LINE_END.split(seen)
        lines = whole if data else [*whole, rest]
        found = next((x for x in (line.removeprefix("\ufeff") for line in lines) if x.strip(_BLANK)), None)
        if found is not None or not data:
            return found
        size = max(size, len(seen))  # the text doubles, so a long line is looked through twice


def _by_ranges(encoding: str):
    """Headers of listed files from their first bytes; a compressed file is read through its codec."""
    def work(batches):
        import pyarrow as pa
        import pyarrow.fs

        for batch in batches:
            headers = []
            for path in batch.column("path").to_pylist():
                files, at = pyarrow.fs.FileSystem.from_uri(path)
                with files.open_input_stream(at) as stream:
                    headers.append(first_line(stream.read, encoding))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(headers, pa.string())], names=["path", "header"])

    return work


def _by_lines(encoding: str):
    """Headers from the lines of files' first blocks: within a task the lines of a file follow one another."""
    def work(batches):
        import pyarrow as pa

        last = None
        for batch in batches:
            paths = batch.column("path").to_pylist()
            starts = [i for i, path in enumerate(paths) if path != (paths[i - 1] if i else last)]
            last = paths[-1] if paths else last
            values = batch.column("value").take(pa.array(starts, pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([paths[i] for i in starts], pa.string()), pa.array(
                [v.decode(encoding, "replace").removeprefix("\ufeff") for v in values], pa.string())], names=["path", "header"])

    return work


def _reachable(path: str) -> bool:
    """Whether tasks can open a file of this scheme by ranges."""
    import pyarrow as pa
    import pyarrow.fs

    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def headers(spark: SparkSession, pattern: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """``path``, ``tabs`` (a .tsv file) and ``header`` of every file of paths or a glob that has a line.

    Files are listed without their content; tasks then open each and read its first bytes. Only where the
    files lie in a store that Arrow cannot open are the lines of their first blocks looked through instead.
    """
    importable(spark)
    try:
        files = spark.read.format("binaryFile").load(pattern)
        some = files._jdf.inputFiles()  # the listing that the driver has made; no job
        if not len(some) or _reachable(some[0]):
            listed = files.select(F.col("_metadata.file_path").alias("path"))
            found = listed.mapInArrow(_by_ranges(encoding), "path string, header string")
        else:
            lines = (spark.read.text(pattern).where("_metadata.file_block_start = 0 AND trim(value) <> ''")
                     .select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")))
            found = lines.mapInArrow(_by_lines(encoding), "path string, header string")
    except AnalysisException as exc:
        raise DatasetError(f"no files matched: {pattern}") from exc
    return stored(found.where("header is not null")
                  .select("path", F.lower("path").endswith(".tsv").alias("tabs"), "header"))


def column_names(cells: Sequence[str]) -> list[str]:
    """Names as the CSV source gives them: an empty one is numbered, one that repeats has its place appended."""
    folded = [c.lower() for c in cells]
    return [f"{c}{i}" if c and folded.count(c.lower()) > 1 else c or f"_c{i}" for i, c in enumerate(cells)]


# What the text of a column must look like for it to be read as a type, narrowest type first.
TYPE_LADDER = (("int", r"^[+-]?\d+$"), ("bigint", r"^[+-]?\d+$"), ("double", r"^[+-]?[\d.]+([eE][+-]?\d+)?$"),
               ("boolean", r"^(?i:true|false)$"), ("date", r"^\d{4}-\d\d-\d\d$"),
               ("timestamp", r"^\d{4}-\d\d-\d\d[ T]"))


def typed(df: DataFrame, keep: Sequence[str] = PROVENANCE) -> DataFrame:
    """Text columns as the narrowest type that all their values have, found in one aggregate."""
    names = [c for c in df.columns if c not in keep]
    def fits(c: str, kind: str, shape: str) -> Column:
        text = F.trim(col(c))
        return F.coalesce(F.bool_and(text.isNull() | (text.rlike(shape) & text.try_cast(kind).isNotNull())),
                          F.lit(False)) & (F.count(col(c)) > 0)
    if not names:
        return df
    found = df.agg(*[F.coalesce(*[F.when(fits(c, kind, shape), kind) for kind, shape in TYPE_LADDER],
                                F.lit("string")).alias(f"t{i}") for i, c in enumerate(names)]).first()
    kinds = dict(zip(names, found))
    return df.select(*[F.trim(col(c)).cast(kinds[c]).alias(c) if kinds.get(c, "string") != "string" else col(c)
                       for c in df.columns])


def read_delimited(spark: SparkSession, pattern: str, sep: str | None = None,
                   encoding: str = "utf-8", na_values: Sequence[str] = (),
                   dtype_str: bool = True, multiline: bool = False,
                   same_header: bool = False) -> DataFrame:
    """Delimited files of a path or glob, by column name, with their file name per row.

    Everything is text unless ``dtype_str`` is false. The headers of all files are looked up in one job of
    ranged reads. One scan then reads the rows of all files by place, whatever number of headers there are,
    and a column is the place that its name has in the file's header, joined by the file's path; text with
    tabs beside text with commas takes one scan each. ``same_header`` says that there is only one header
    and saves the look-up; a file with another header is then an error.
    """
    def reader(tabs: bool, strict: bool):
        return (spark.read.option("header", True).option("enforceSchema", not strict)
                .option("sep", sep or ("\t" if tabs else ",")).option("encoding", charset(encoding))
                .option("escape", '"').option("multiLine", multiline))

    missing = list(dict.fromkeys([*MISSING_TEXTS, *map(str, na_values)]))

    def cleaned(raw: DataFrame) -> DataFrame:
        return raw.select(*[F.when(~col(c).isin(missing), col(c)).alias(c) for c in raw.columns],
                          F.col("_metadata.file_name").alias(SOURCE_FILE))

    def names_of(kind) -> list[str]:
        mark = sep or ("\t" if kind.tabs else ",")
        if len(mark) == 1:
            return column_names(next(csv.reader([kind.header], delimiter=mark)))
        return reader(kind.tabs, True).csv(kind.path).columns

    def placed() -> DataFrame:
        if same_header:
            return cleaned(reader(pattern.lower().endswith(".tsv"), True).csv(pattern))
        files = headers(spark, pattern, encoding)
        # as many rows as there are distinct headers
        kinds = files.groupBy("tabs", "header").agg(F.min("path").alias("path")).orderBy("path").collect()
        if len(kinds) < 2:
            return cleaned(reader(bool(kinds and kinds[0].tabs), True).csv(pattern))
        names = [names_of(kind) for kind in kinds]
        numbered = spark.createDataFrame([(k.tabs, k.header, i) for i, k in enumerate(kinds)],
                                         "tabs boolean, header string, kind int")
        index = stored(files.join(numbered, ["tabs", "header"]).select(F.col("path").alias("__path"), "kind"))
        spelled = {n.lower(): n for own in reversed(names) for n in reversed(own)}  # as the first file has it
        order = [*dict.fromkeys(n.lower() for own in names for n in own)]

        def scan(tabs: bool, mixed: bool) -> DataFrame:
            mine = [i for i, k in enumerate(kinds) if k.tabs == tabs]
            width = max(len(names[i]) for i in mine)
            source = reader(tabs, False).schema(", ".join(f"_c{i} string" for i in range(width)))
            source = source.option("pathGlobFilter", "*.[tT][sS][vV]") if tabs and mixed else source
            rows = source.csv(pattern).select("*", F.col("_metadata.file_path").alias("__path"),
                                              F.col("_metadata.file_name").alias(SOURCE_FILE))
            known = index.where(F.col("kind").isin(mine)) if mixed else index
            rows = rows.join(known, "__path")

            def value(name: str) -> Column:
                at: dict[int, list[int]] = {}
                for i in mine:
                    for place, n in enumerate(names[i]):
                        if n.lower() == name:
                            at.setdefault(place, []).append(i)
                # a value hangs on the file's kind too, so no later filter sees what stands there in other files
                found = [F.when((F.col("kind").isin(own) if len(own) < len(mine) else F.col("kind") >= 0)
                                & ~F.col(f"_c{place}").isin(missing), F.col(f"_c{place}")) for place, own in at.items()]
                return F.coalesce(*found) if found else F.lit(None).cast("string")

            columns = [value(n).alias(spelled[n]) for n in order]
            return rows.select(*columns[:len(names[0])], SOURCE_FILE, *columns[len(names[0]):])

        marks = sorted({k.tabs for k in kinds}) if not sep else [False]
        if sep:
            kinds = [type(k)(**{**k.asDict(), "tabs": False}) for k in kinds]
        return union_by_name([scan(tabs, len(marks) > 1) for tabs in marks])

    df = placed()
    return df if dtype_str else typed(df)


def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 partition_column: str | None = None, lower: object = None,
                 upper: object = None, partitions: int | None = None,
                 fetch_size: int = 10_000, **extra: object) -> dict[str, str]:
    """Options of a JDBC read. A partition column makes many connections read ranges."""
    options: dict[str, object] = {"url": url, "fetchsize": fetch_size, **extra}
    if partition_column:
        # ranges need a relation, so a query becomes a derived table
        options |= {"dbtable": f"({query}) q" if query else table,
                    "partitionColumn": partition_column, "lowerBound": lower,
                    "upperBound": upper, "numPartitions": partitions}
    elif query:
        options["query"] = query
    else:
        options["dbtable"] = table
    lacking = [k for k, v in options.items() if v is None]
    if lacking:
        raise DatasetError(f"JDBC read lacks {lacking}")
    return {k: str(v) for k, v in options.items()}


def read_jdbc(spark: SparkSession, url: str, **kwargs: object) -> DataFrame:
    """A database table or query; Spark pushes later filters and column choice into it."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **kwargs)).load()


def read_dataset(spark: SparkSession, ds: Dataset) -> DataFrame:
    """A declared dataset, narrowed to its columns and filter."""
    if ds.query:
        df = spark.sql(ds.query)
    elif ds.path:
        df = spark.read.parquet(ds.path) if ds.path.endswith(".parquet") \
            else read_delimited(spark, ds.path, **dict(ds.options))
    elif ds.table:
        df = spark.table(ds.table)
    else:
        raise DatasetError("a dataset needs a query, a table or a path")
    return pick_columns(filtered(df, ds.where), ds.columns)


def capped(df: DataFrame, max_rows: int, allow_truncation: bool = False) -> DataFrame:
    """Opt-in guard on size: an error beyond ``max_rows``, or a sample of that many rows.

    Spark needs no such cap; it is kept for feeds that must not be larger. The check reads
    one row more than allowed.
    """
    if allow_truncation:
        return df.limit(max_rows)
    if df.limit(max_rows + 1).count() > max_rows:
        raise DatasetError(f"more than {max_rows:,} rows; raise max_rows, narrow with a filter, "
                           "or allow truncation to get a sample")
    return df
