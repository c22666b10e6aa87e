"""Data checks on one dataset or a pair. Every function is lazy and returns plain columns.

Where a verdict belongs to the result it is the column ``status``: PASS, FAIL or WARN.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import normalize as nz
from tallymark.functions.normalize import Norm
from tallymark.operators.counters import Tally, tally_rows
from tallymark.operators.diff import (Keep, KeyedDiff, key_columns, keyed_diff, null_safe,
                                      repeated_keys, rows_with_repeated_keys)

VARIANCE_THRESHOLD = 0.0001
DEFAULT_SHARE = 0.5
TYPE_SAMPLES = 5
LINEAGE_COLUMNS = ("SOURCE_SYSTEM", "LOAD_TIMESTAMP")


def types_of(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def verdict(ok: Column, otherwise: str = "FAIL") -> Column:
    return F.when(ok, "PASS").otherwise(otherwise)


def need_columns(df: DataFrame, columns: Sequence[str], what: str = "column") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} not present: {missing} (have: {df.columns})")


def _sides(source: DataFrame, target: DataFrame, *columns: Column) -> DataFrame:
    """Both sides under one another, with ``in_source`` true for the source."""
    return (source.select(F.lit(True).alias("in_source"), *columns)
            .unionByName(target.select(F.lit(False).alias("in_source"), *columns)))


# --- counts ----------------------------------------------------------------------------

def row_count(source: DataFrame, target: DataFrame,
              known: Sequence[DataFrame | None] = (None, None)) -> DataFrame:
    """Row counts of both sides in one job that reads no column.

    ``known`` has a one-row ``row_total`` for a side that was counted elsewhere.
    """
    totals = [df.agg(F.count(F.lit(1)).alias("row_total")) if given is None else
              given.toDF("row_total") for df, given in zip((source, target), known)]
    rows = F.col("row_total").cast("bigint")
    counts = _sides(*totals, rows.alias("row_total")).agg(
        F.sum(F.when(F.col("in_source"), rows)).alias("source_rows"),
        F.sum(F.when(~F.col("in_source"), rows)).alias("target_rows"))
    difference = F.col("target_rows") - F.col("source_rows")
    return counts.select("*", difference.alias("difference"),
                         verdict(difference == 0).alias("status"))


def group_counts(source: DataFrame, target: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Row counts per group and side; a group absent on a side counts 0, NULL is a group."""
    for side, df in (("source", source), ("target", target)):
        need_columns(df, group_by, f"group_by column on the {side} side")
    groups = [nz.col(g) for g in group_by]
    counts = _sides(source, target, *groups).groupBy(*groups).agg(
        F.count_if("in_source").alias("source_rows"),
        F.count_if(~F.col("in_source")).alias("target_rows"))
    return counts.withColumn("difference", F.col("target_rows") - F.col("source_rows"))


def group_count_totals(source: DataFrame, target: DataFrame,
                       group_by: Sequence[str]) -> DataFrame:
    return (group_counts(source, target, group_by)
            .agg(F.count(F.lit(1)).alias("groups"),
                 F.count_if(F.col("difference") != 0).alias("mismatched_groups"))
            .withColumn("status", verdict(F.col("mismatched_groups") == 0)))


# --- schema ----------------------------------------------------------------------------

def compare_names(declared: Sequence[str], actual: Sequence[str],
                  case_sensitive: bool = False) -> tuple[list[str], list[str]]:
    """Names (missing from, extra in) the actual columns. Metadata only, no job.

    Of names that fold together the last spelling is told, in the place of the first.
    """
    spelled: dict[str, list] = {}
    for side, names in enumerate((declared, actual)):
        for name in names:
            spelled.setdefault(name if case_sensitive else name.lower(), [None, None])[side] = name
    pairs = spelled.values()
    return ([mine for mine, theirs in pairs if theirs is None],
            [theirs for mine, theirs in pairs if mine is None])


def schema_drift(df: DataFrame, declared: Sequence[str],
                 case_sensitive: bool = False) -> DataFrame:
    """One row per drifted column, with the number of rows an extra column fills."""
    missing, extra = compare_names(declared, df.columns, case_sensitive)
    def row(name: str, drift: str, status: str, filled: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), F.lit(drift).alias("drift"),
                        F.lit(status).alias("status"), filled.alias("filled_rows"))
    rows = Tally(
        {f"filled_{i}": F.count(nz.col(c)) for i, c in enumerate(extra)} | {"rows": F.count("*")},
        lambda n: [row(c, "missing", "FAIL", F.lit(0).cast("bigint")) for c in missing]
        + [row(c, "extra", "WARN", n[f"filled_{i}"]) for i, c in enumerate(extra)]
        + [row("*", "rows", "PASS", n["rows"])])
    return tally_rows(df, [rows]).where("drift <> 'rows'")


# --- value quality of one dataset --------------------------------------------------------

def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null-like values per column, in one scan."""
    need_columns(df, columns)
    types = types_of(df)
    counters = {f"n{i}": F.count_if(nz.nullish(nz.col(c), types[c]))
                for i, c in enumerate(columns)}
    return tally_rows(df, [Tally(counters | {"rows": F.count("*")}, lambda n: [
        F.struct(F.lit(c).alias("column"), n[f"n{i}"].alias("null_count"),
                 n["rows"].alias("rows")) for i, c in enumerate(columns)])])


def unfit(c: Column, dtype: T.DataType, kind: str) -> Column:
    """True for a value that is present but cannot be read as the kind. Never NULL."""
    present = ~nz.nullish(c, dtype)
    if kind == "numeric":
        if not isinstance(dtype, T.StringType):
            return F.lit(False)
        fits = nz.parsed_number(F.translate(nz.stripped(c), ",$", "")).isNotNull()
    elif kind in ("date", "datetime"):
        fits = nz.moment(c, dtype).isNotNull()
    elif kind == "bool":
        token = F.lower(nz.stripped(nz.as_text(c, dtype)))
        fits = token.isin(*nz.TRUE_TOKENS, *nz.FALSE_TOKENS)
    else:
        return F.lit(False)
    return F.coalesce(present & ~fits, F.lit(False))


def type_conformance(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Present values per column that do not fit its declared kind, in one scan."""
    need_columns(df, list(kinds))
    types = types_of(df)
    bad = {f"bad{i}": F.count_if(unfit(nz.col(c), types[c], k))
           for i, (c, k) in enumerate(kinds.items())}
    seen = {f"seen{i}": F.count_if(~nz.nullish(nz.col(c), types[c]))
            for i, c in enumerate(kinds)}
    return tally_rows(df, [Tally(bad | seen, lambda n: [
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("expected_kind"),
                 n[f"seen{i}"].alias("checked"), n[f"bad{i}"].alias("bad_count"),
                 verdict(n[f"bad{i}"] == 0).alias("status"))
        for i, (c, k) in enumerate(kinds.items())])])


def type_samples(df: DataFrame, kinds: Mapping[str, str], top: int = TYPE_SAMPLES) -> DataFrame:
    """The first bad values per column. Only ``top`` rows per column leave a map task."""
    types = types_of(df)
    tests = {c: unfit(nz.col(c), types[c], k) for c, k in kinds.items()}
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               nz.as_text(nz.col(c), types[c]).alias("value"),
                               test.alias("bad")) for c, test in tests.items()])
    bad = (df.where(reduce(Column.__or__, tests.values()))
           .select(F.inline(F.filter(cells, lambda x: x["bad"]))))
    values = bad.groupBy("column", "value").agg(F.count(F.lit(1)).alias("copies"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return values.withColumn("place", place).where(F.col("place") <= top)


def default_shares(df: DataFrame, defaults: Mapping[str, object],
                   share: float = DEFAULT_SHARE) -> DataFrame:
    """Share of a column that is its declared default; flagged when large with no null."""
    need_columns(df, list(defaults))
    types = types_of(df)
    counters = {"rows": F.count("*")}
    for i, (c, value) in enumerate(defaults.items()):
        text = nz.stripped(nz.as_text(nz.col(c), types[c]))
        counters[f"hit{i}"] = F.count_if(text == F.lit(str(value).strip()))
        counters[f"null{i}"] = F.count_if(nz.nullish(nz.col(c), types[c]))

    def row(n: Mapping[str, Column], i: int, c: str, value: object) -> Column:
        hit = n[f"hit{i}"] / F.nullif(n["rows"], F.lit(0))
        flagged = F.coalesce((hit >= share) & (n[f"null{i}"] == 0), F.lit(False))
        return F.struct(F.lit(c).alias("column"), F.lit(str(value)).alias("default_value"),
                        F.round(hit, 4).alias("default_share"), n[f"null{i}"].alias("null_count"),
                        flagged.alias("flagged"), verdict(~flagged, "WARN").alias("status"))
    return tally_rows(df, [Tally(counters, lambda n: [
        row(n, i, c, v) for i, (c, v) in enumerate(defaults.items())])])


def value_presence(df: DataFrame, column: str, expected: Sequence = (),
                   forbidden: Sequence = ()) -> DataFrame:
    """Per expected or forbidden value, whether it occurs (exact text).

    The column is reduced to its distinct values, which meet the listed ones in a join; the plan is
    as small for thousands of listed values as for one.
    """
    need_columns(df, [column])
    c, dtype = nz.col(column), types_of(df)[column]
    filled = c.isNotNull() if isinstance(dtype, T.StringType) else ~nz.nullish(c, dtype)
    present = df.where(filled).select(nz.as_text(c, dtype).alias("value")).distinct()
    wanted = [("expected", str(v)) for v in expected] + [("forbidden", str(v)) for v in forbidden]
    listed = F.from_json(F.lit(json.dumps([{"role": r, "value": v} for r, v in wanted])),
                         "array<struct<role:string,value:string>>")
    names = F.from_json(F.lit(json.dumps(sorted({v for _, v in wanted}))), "array<string>")
    names = df.sparkSession.range(1).select(F.explode(names).alias("value"), F.lit(True).alias("listed"))
    found = present.join(names, "value", "left").agg(
        F.count("*").alias("distinct_present"),
        F.collect_set(F.when(F.col("listed"), F.col("value"))).alias("hits"))  # listed values at most
    there = F.array_contains("hits", F.col("value"))
    return found.select("distinct_present", "hits", F.inline(listed)).select(
        "value", "role", there.alias("present"), "distinct_present",
        verdict(there == (F.col("role") == "expected")).alias("status"))


# --- keys --------------------------------------------------------------------------------

def dedup_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    need_columns(df, keys, "key column")
    per_key = df.groupBy(*[nz.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("copies"))
    repeated = F.col("copies") > 1
    return (per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.count_if(repeated).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("copies"))), F.lit(0)).alias("duplicate_rows"))
        .withColumn("status", verdict(F.col("duplicate_keys") == 0)))


def dedup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every repeated key once, with its number of copies."""
    need_columns(df, keys, "key column")
    return repeated_keys(df, keys)


def dedup_rows(df: DataFrame, keys: Sequence[str], keep: Keep | None = None) -> DataFrame:
    """Every row with a repeated key."""
    need_columns(df, keys, "key column")
    return rows_with_repeated_keys(df, keys, keep)


def _fk_keys(df: DataFrame, other: DataFrame, columns: Sequence[str],
             others: Sequence[str]) -> list[Column]:
    """Key columns as ``k0``.. in the form in which they meet the other side: stripped text,
    case kept; integers on both sides have the same text exactly when they are equal."""
    mine, theirs = types_of(df), types_of(other)
    keys = []
    for i, (c, o) in enumerate(zip(columns, others)):
        whole = all(isinstance(d, T.IntegralType) for d in (mine[c], theirs[o]))
        key = nz.col(c).cast("bigint") if whole else nz.stripped(nz.as_text(nz.col(c), mine[c]))
        keys.append(key.alias(f"k{i}"))
    return keys


def _any_nullish(df: DataFrame, columns: Sequence[str]) -> Column:
    types = types_of(df)
    return reduce(Column.__or__, (nz.nullish(nz.col(c), types[c]) for c in columns))


def _check_fk(child: DataFrame, parent: DataFrame, child_columns: Sequence[str],
              parent_columns: Sequence[str]) -> list[str]:
    if len(child_columns) != len(parent_columns):
        raise ValueError("child/parent column counts differ")
    need_columns(child, child_columns, "child column")
    need_columns(parent, parent_columns, "parent column")
    return [f"k{i}" for i in range(len(child_columns))]


def fk_orphans(child: DataFrame, parent: DataFrame, child_columns: Sequence[str],
               parent_columns: Sequence[str], keep: Keep | None = None) -> DataFrame:
    """Child rows whose full key has no parent; keys with a null part are no orphans.

    By itself one lazy anti join, which needs no distinct parents and whose hot keys adaptive
    execution splits. With ``keep`` the orphan keys are settled first, from folded keys only;
    where they are few, the child rows are then filtered without a shuffle.
    """
    keys = _check_fk(child, parent, child_columns, parent_columns)
    marks = [f"__fk_{k}" for k in keys]
    named = child.where(~_any_nullish(child, child_columns)).select(
        "*", *[c.alias(m) for c, m in
               zip(_fk_keys(child, parent, child_columns, parent_columns), marks)])
    parents = parent.select(*[c.alias(m) for c, m in
                              zip(_fk_keys(parent, child, parent_columns, child_columns), marks)])
    if keep is None:
        return named.join(parents, marks, "left_anti").drop(*marks)
    orphans = keep(named.select(*marks).distinct().join(parents, marks, "left_anti"))
    return named.join(orphans, marks, "left_semi").drop(*marks)


def fk_summary(child: DataFrame, parent: DataFrame, child_columns: Sequence[str],
               parent_columns: Sequence[str]) -> DataFrame:
    """Counts of a foreign key. Both sides fold to one row per key before they meet, so a hot
    key costs no more than any other."""
    keys = _check_fk(child, parent, child_columns, parent_columns)
    one = child.select(_any_nullish(child, child_columns).alias("empty"), F.lit(True).alias("c"),
                       *_fk_keys(child, parent, child_columns, parent_columns))
    two = parent.select(F.lit(False).alias("empty"), F.lit(False).alias("c"),
                        *_fk_keys(parent, child, parent_columns, child_columns))
    per_key = one.unionByName(two).groupBy("empty", *keys).agg(
        F.count_if("c").alias("children"), F.count_if(~F.col("c")).alias("parents"))
    orphan = ~F.col("empty") & (F.col("parents") == 0)
    totals = per_key.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in {
            "child_rows": F.col("children"), "parent_rows": F.col("parents"),
            "orphans": F.when(orphan, F.col("children")),
            "null_child_keys": F.when(F.col("empty"), F.col("children"))}.items()])
    return totals.withColumn("status", F.when(F.col("orphans") > 0, "FAIL").when(
        F.col("null_child_keys") > 0, "WARN").otherwise("PASS"))


# --- pairs -------------------------------------------------------------------------------

def _zero_tests(df: DataFrame, columns: Sequence[str], zero: bool) -> dict[str, Column]:
    types = types_of(df)
    if zero:
        return {c: F.coalesce(nz.number(nz.col(c), types[c]) == 0, F.lit(False)) for c in columns}
    return {c: nz.nullish(nz.col(c), types[c]) for c in columns}


def _zero_null_sides(source, target, keys, columns, norms) -> tuple[DataFrame, DataFrame]:
    """Null cells of the source and zero cells of the target as (key, column) rows."""
    need_columns(source, keys, "key column")
    need_columns(target, keys, "key column")
    shared = [c for c in columns if c in source.columns and c in target.columns]
    def cells(df: DataFrame, other: DataFrame, zero: bool) -> DataFrame:
        tests = _zero_tests(df, shared, zero)
        found = F.array(*[F.struct(F.lit(c).alias("column"), test.alias("hit"))
                          for c, test in tests.items()])
        return df.where(reduce(Column.__or__, tests.values(), F.lit(False))).select(
            *key_columns(df, other, keys, norms),
            F.inline(F.filter(found, lambda x: x["hit"]))).drop("hit")
    return cells(source, target, False), cells(target, source, True)


def zero_vs_null_rows(source: DataFrame, target: DataFrame, keys: Sequence[str],
                      columns: Sequence[str], norms: Mapping[str, Norm] | None = None) -> DataFrame:
    """Target cells that are zero where the source has null for the same key."""
    nulls, zeros = _zero_null_sides(source, target, keys, columns, norms)
    ids = [c for c in zeros.columns if c != "column"]
    marked = nulls.select(*[F.col(c).alias(f"__{c}") for c in nulls.columns])
    pairs = [(c, f"__{c}") for c in zeros.columns]
    return zeros.join(marked, null_safe(zeros, marked, pairs), "left_semi").select(
        *[F.col(i).alias(k) for i, k in zip(ids, keys)], "column")


def zeros_for_nulls(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str],
                    norms: Mapping[str, Norm] | None = None) -> DataFrame:
    """One row: ``null_source_zero_target``, the target cells that are zero where the source has null."""
    if not keys or not [c for c in columns if c in source.columns and c in target.columns]:
        return target.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("null_source_zero_target"))
    return _zeros_met(source, target, keys, columns, norms).agg(
        F.coalesce(F.sum("z"), F.lit(0)).alias("null_source_zero_target"))


def _zeros_met(source, target, keys, columns, norms) -> DataFrame:
    """Key, column and number ``z`` of target rows that are zero where a source row of the key has null."""
    nulls, zeros = _zero_null_sides(source, target, keys, columns, norms)
    return (zeros.withColumn("z", F.lit(1)).withColumn("n", F.lit(0))
            .unionByName(nulls.withColumn("z", F.lit(0)).withColumn("n", F.lit(1)))
            .groupBy(*zeros.columns).agg(F.sum("z").alias("z"), F.max("n").alias("n"))
            .where("n = 1 AND z > 0").drop("n"))


def zero_vs_null(source: DataFrame | None, target: DataFrame, keys: Sequence[str],
                 columns: Sequence[str], norms: Mapping[str, Norm] | None = None) -> DataFrame:
    """Zeros and nulls per target column, and zeros whose source value is null."""
    types = types_of(target)
    present = [c for c in columns if c in target.columns]
    if not present:
        raise ValueError(f"null_not_zero columns not found in target: {list(columns)}")
    counters = {}
    for i, c in enumerate(present):
        counters[f"z{i}"] = F.count_if(nz.number(nz.col(c), types[c]) == 0)
        counters[f"n{i}"] = F.count_if(nz.nullish(nz.col(c), types[c]))
    counts = tally_rows(target, [Tally(counters, lambda n: [
        F.struct(F.lit(c).alias("column"), n[f"z{i}"].alias("target_zeros"),
                 n[f"n{i}"].alias("target_nulls"), F.lit(0).cast("bigint")
                 .alias("null_source_zero_target")) for i, c in enumerate(present)])])
    if source is not None:
        shared = [c for c in present if c in source.columns]
        if shared and keys:
            bugs = _zeros_met(source, target, keys, shared, norms).select(
                "column", F.lit(0).cast("bigint").alias("target_zeros"),
                F.lit(0).cast("bigint").alias("target_nulls"),
                F.col("z").alias("null_source_zero_target"))
            counts = counts.unionByName(bugs)
    sums = counts.groupBy("column").agg(*[F.sum(c).alias(c) for c in (
        "target_zeros", "target_nulls", "null_source_zero_target")])
    bad = F.col("null_source_zero_target") > 0
    return sums.withColumn("status", F.lit("WARN") if source is None else verdict(~bad))


def relative_variance(reference: Column, other: Column) -> Column:
    """``|other-reference| / |reference|``, against ``|other|`` when the reference is 0."""
    base = F.when(reference != 0, F.abs(reference)).when(other != 0, F.abs(other))
    return F.coalesce(F.abs(other - reference) / base, F.lit(0.0))


def sums_by_side(source: DataFrame, target: DataFrame,
                 columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One row of row counts and of sums ``s0..``/``t0..``; one scan a side, no join."""
    shared = [c for c in columns if c in source.columns and c in target.columns]
    def amounts(df: DataFrame, mine: bool) -> DataFrame:
        types = types_of(df)
        return df.select(F.lit(mine).alias("in_source"), *[
            nz.number(nz.col(c), types[c]).alias(f"v{i}") for i, c in enumerate(shared)])
    both = amounts(source, True).unionByName(amounts(target, False))
    total = lambda when, v: F.coalesce(F.sum(F.when(when, F.col(v))), F.lit(0.0))
    return both.agg(
        F.count_if("in_source").alias("source_rows"), F.count_if(~F.col("in_source")).alias("target_rows"),
        *[total(F.col("in_source"), f"v{i}").alias(f"s{i}") for i in range(len(shared))],
        *[total(~F.col("in_source"), f"v{i}").alias(f"t{i}") for i in range(len(shared))]), shared


def shared_columns(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that both sides have; it is an error if there are none."""
    shared = [c for c in columns if c in source.columns and c in target.columns]
    if not shared:
        raise ValueError("numeric columns not present on both sides")
    return shared


def aggregate_variance(source: DataFrame, target: DataFrame, columns: Sequence[str],
                       threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """Sums per numeric column on both sides and their relative difference."""
    sums, shared = sums_by_side(source, target, shared_columns(source, target, columns))
    def row(i: int, name: str) -> Column:
        s, t = F.col(f"s{i}"), F.col(f"t{i}")
        variance = relative_variance(s, t)
        return F.struct(F.lit(name).alias("column"), s.alias("source_sum"), t.alias("target_sum"),
                        (t - s).alias("abs_diff"), variance.alias("rel_variance"),
                        (variance <= threshold).alias("within_threshold"))
    rows = F.array(*[row(i, c) for i, c in enumerate(shared)])
    return sums.select(F.inline(rows)).withColumn("status", verdict(F.col("within_threshold")))


# --- snapshots ---------------------------------------------------------------------------

def before(sides: Sequence[DataFrame], period_column: str, current) -> list[DataFrame]:
    """Rows of the periods before the current one, by one typed comparison for all sides.

    Periods are numbers if the current one or a side's column is a number, else moments if one of
    them is a date or time, else text. A period that cannot be read so is in no earlier period; a
    side without the column is an error.
    """
    for df in sides:
        need_columns(df, [period_column], "period column")
    types = [types_of(df)[period_column] for df in sides]
    c = nz.col(period_column)
    if isinstance(current, (int, float, Decimal)) or any(isinstance(t, T.NumericType) for t in types):
        limit = nz.number(F.lit(str(current)), T.StringType())
        read = nz.number
    elif isinstance(current, date) or any(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
                                          for t in types):
        limit = nz.moment(F.lit(str(current)), T.StringType(), False)
        read = lambda c, t: nz.moment(c, t, False)
    else:
        limit, read = F.lit(str(current)), lambda c, t: c
    return [df.where(read(c, t) < limit) for df, t in zip(sides, types)]


def immutability(baseline: DataFrame, current: DataFrame, keys: Sequence[str],
                 columns: Sequence[str] | None = None, period_column: str | None = None,
                 current_period=None, norms: Mapping[str, Norm] | None = None) -> KeyedDiff:
    """Diff of the periods before the current one: they must not change or vanish."""
    if period_column and current_period is not None:
        baseline, current = before([baseline, current], period_column, current_period)
    return keyed_diff(baseline, current, keys, columns, norms)


def immutability_verdict() -> Column:
    """Over ``totals``: new rows in old periods are allowed, changes and losses are not."""
    return verdict(F.col("value_mismatches") + F.col("source_only") == 0)


def incremental(baseline: DataFrame, current: DataFrame, keys: Sequence[str],
                columns: Sequence[str] | None = None, updatable: Sequence[str] = (),
                norms: Mapping[str, Norm] | None = None) -> KeyedDiff:
    """Diff of two snapshots outside the columns that may be updated."""
    chosen = [c for c in (baseline.columns if columns is None else columns)
              if c not in set(updatable)]
    return keyed_diff(baseline, current, keys, chosen, norms)


def incremental_verdict(allow_deletes: bool = False) -> Column:
    problems = F.col("value_mismatches") + (F.lit(0) if allow_deletes else F.col("source_only"))
    return verdict(problems == 0)


def cross_source(primary: DataFrame, second: DataFrame, keys: Sequence[str],
                 columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None,
                 norms: Mapping[str, Norm] | None = None) -> KeyedDiff:
    """Diff of two sources on the key columns both have, after renaming the second."""
    second = second.withColumnsRenamed(dict(rename or {}))
    shared = [k for k in keys if k in primary.columns and k in second.columns]
    if not shared:
        raise ValueError(f"no shared key columns between the sources for {list(keys)}")
    return keyed_diff(primary, second, shared, columns, norms)


def cross_source_verdict() -> Column:
    return verdict(F.col("value_mismatches") == 0)
