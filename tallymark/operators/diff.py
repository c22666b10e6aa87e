"""Keyed comparison of two datasets.

Both sides are normalised, tagged, unioned and grouped by key: one shuffle pairs every key
with its row counts and its values per side. Map-side combining folds copies of a key before
the shuffle, so a key that holds a third of all rows costs one row per map task. NULL keys
group together, and nothing is ever joined row by row, so repeated keys cannot explode.

A key is matched when it occurs exactly once on each side. A key repeated on a side is
counted there as repeated, and its single row on the other side counts as one-sided.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import normalize as nz
from tallymark.functions.normalize import Norm

SAMPLE_ROWS = 100
NULL_SHOWN = "(null)"
_KEY_SCALE = 10

METRICS = ("source_total", "target_total", "matched_keys", "values_matched",
           "value_mismatches", "source_only", "target_only",
           "source_dup_keys", "target_dup_keys")


# Settles an intermediate result on storage and reads it back.
Keep = Callable[[DataFrame], DataFrame]


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def _readable(norm: Norm, dtypes: Sequence[T.DataType]) -> Norm:
    """The kind both sides can be read as; text where a physical type rules the kind out."""
    norm = nz.resolved(norm, *dtypes)
    times = any(isinstance(d, (T.DateType, T.TimestampType, T.TimestampNTZType)) for d in dtypes)
    flags = any(isinstance(d, T.BooleanType) for d in dtypes)
    if (norm.kind == "numeric" and times) or (norm.kind in ("date", "datetime") and flags):
        return replace(norm, kind="string")
    return norm


def _comparable(c: Column, dtype: T.DataType, other: T.DataType, norm: Norm) -> Column:
    """Comparable form of a prepared value; integers on both sides stay exact beyond 2^53."""
    if norm.kind == "numeric" and norm.decimal_scale is None and norm.round_to is None:
        if isinstance(dtype, T.IntegralType) and isinstance(other, T.IntegralType):
            return c.cast("bigint")
    return nz.finished(c, dtype, norm)


def _comparable_key(name: str, dtype: T.DataType, other: T.DataType, norm: Norm) -> Column:
    """Comparable form of a key: numbers that are no floats on either side meet as decimals."""
    floats = any(isinstance(d, (T.FloatType, T.DoubleType)) for d in (dtype, other))
    whole = all(isinstance(d, T.IntegralType) for d in (dtype, other))
    if norm.kind == "numeric" and norm.decimal_scale is None and norm.round_to is None:
        if not floats and not whole:
            scales = [d.scale for d in (dtype, other) if isinstance(d, T.DecimalType)]
            norm = replace(norm, decimal_scale=max([_KEY_SCALE, *scales]))
    elif norm.kind in ("date", "datetime") and not all(isinstance(d, T.DateType) for d in (dtype, other)):
        norm = replace(norm, date_only=False)  # a key is the full moment, never its day
    c = nz.col(name)
    return _comparable(nz.prepared(c, dtype, norm), dtype, other, norm)


def key_columns(df: DataFrame, other: DataFrame, keys: Sequence[str],
                norms: Mapping[str, Norm] | None = None) -> list[Column]:
    """Keys of ``df`` as ``k0``.., in the form in which they meet the keys of ``other``."""
    mine, theirs = ({f.name: f.dataType for f in x.schema} for x in (df, other))
    return [_comparable_key(k, mine[k], theirs[k],
                            _readable((norms or {}).get(k, Norm()), (mine[k], theirs[k])))
            .alias(f"k{i}") for i, k in enumerate(keys)]


def shown(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text of a value for people, with NULL spelled out."""
    text = c.cast("string") if dtype is None else nz.as_text(c, dtype)
    if isinstance(dtype, T.DecimalType) and dtype.scale:
        text = F.regexp_replace(text, r"\.?0+$", "")
    return F.coalesce(text, F.lit(NULL_SHOWN))


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Join condition over column pairs in which NULL meets NULL."""
    return reduce(Column.__and__,
                  (left[f"`{a}`"].eqNullSafe(right[f"`{b}`"]) for a, b in pairs))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of ``copies``."""
    return (df.groupBy(*[nz.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("copies"))
            .where("copies > 1"))


def rows_with_repeated_keys(df: DataFrame, keys: Sequence[str],
                            keep: Keep | None = None) -> DataFrame:
    """All rows whose key occurs more than once (every copy is kept, NULL keys are equal).

    The keys are counted first; the rows are then only filtered by a semi join, so no group is
    ever gathered in one task. By itself the plan is lazy, and adaptive execution splits the
    partitions of a hot key. With ``keep`` (see :func:`tallymark.session.stored`) the repeated
    keys are settled first; where they are few, the rows are then filtered without a shuffle.
    """
    marks = {k: f"__repeated_{i}" for i, k in enumerate(keys)}
    repeated = repeated_keys(df, keys).select(*[nz.col(k).alias(m) for k, m in marks.items()])
    repeated = keep(repeated) if keep else repeated
    return df.join(repeated, null_safe(df, repeated, list(marks.items())), "left_semi")


#: Types that a hash aggregate updates in place.
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Folded:
    """Both sides with one row per key, in tables of the same buckets: the keys and ``nulls`` as they are stored, rows
    counted as ``n``, and values that count where ``n`` is one; and how a key is had from what is stored."""

    source: DataFrame
    target: DataFrame
    keys: Mapping[str, Column]

    def pairs(self, value_ids: Sequence[str]) -> DataFrame:
        met = [*self.keys, "nulls"]

        def side(df: DataFrame, name: str) -> DataFrame:
            values = F.struct(*[F.col(c) for c in value_ids]) if value_ids else F.lit(None)
            return df.select(*met, F.col("n").alias(f"n{name}"), F.when(F.col("n") == 1, values).alias(name))

        both = side(self.source, "s").join(side(self.target, "t"), met, "full_outer")
        return both.select(*[c.alias(k) for k, c in self.keys.items()],
                           *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("ns", "nt")],
                           *[c for c in ("s", "t") if value_ids])


@dataclass(frozen=True)
class KeyedDiff:
    """A lazy comparison; every method returns a DataFrame and runs nothing."""

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    norms: tuple[Norm, ...]
    source: DataFrame  # k0.. and c0.., normalised
    target: DataFrame
    #: Keys known to be on both sides once, with equal values, whose rows were left out of both.
    settled: int = 0
    folded: Folded | None = None

    @cached_property
    def _key_ids(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.keys))]

    @cached_property
    def _value_ids(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.columns))]

    def _shown_keys(self) -> list[Column]:
        types = self.source.schema
        return [shown(F.col(k), types[k].dataType).alias(name)
                for k, name in zip(self._key_ids, self.keys)]

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per key: ``ns``/``nt`` rows per side and, if columns are compared, values ``s``/``t``.

        Values only count for keys that a side holds once, so any aggregate that gives a single value
        back will do. Values of fixed width are told by their maximum, which a hash aggregate holds
        in place; with a text among them a side's values stay together.
        """
        if self.folded:
            return self.folded.pairs(self._value_ids)

        def tagged(df: DataFrame, mine: int) -> DataFrame:
            return df.select(*self._key_ids, F.lit(mine).cast("bigint").alias("ns"),
                             F.lit(1 - mine).cast("bigint").alias("nt"), *self._value_ids)

        both = tagged(self.source, 1).unionByName(tagged(self.target, 0))
        keys, rows = both.groupBy(*self._key_ids), [F.sum(n).alias(n) for n in ("ns", "nt")]
        sides = {"s": F.col("ns") == 1, "t": F.col("nt") == 1}
        if not self.columns:
            return keys.agg(*rows)
        if all(isinstance(f.dataType, FIXED_WIDTH) for f in both.schema if f.name in self._value_ids):
            found = keys.agg(*rows, *[F.max(F.when(mine, F.col(c))).alias(side + c)
                                      for side, mine in sides.items() for c in self._value_ids])
            return found.select(*self._key_ids, "ns", "nt", *[
                F.struct(*[F.col(side + c).alias(c) for c in self._value_ids]).alias(side) for side in sides])
        values = F.struct(*[F.col(c) for c in self._value_ids])
        return keys.agg(*rows, *[F.first(F.when(mine, values), ignorenulls=True).alias(side)
                                 for side, mine in sides.items()])

    # Conditions over ``pairs``.
    matched = property(lambda self: (F.col("ns") == 1) & (F.col("nt") == 1))
    only_source = property(lambda self: (F.col("ns") == 1) & (F.col("nt") != 1))
    only_target = property(lambda self: (F.col("nt") == 1) & (F.col("ns") != 1))

    def _differs(self, i: int) -> Column:
        return ~nz.same(F.col(f"s.c{i}"), F.col(f"t.c{i}"), self.norms[i])

    def totals(self, subset: Sequence[str] = ()) -> DataFrame:
        """One row with every count; ``m0``.. are mismatches per column.

        For a ``subset`` of the columns the row also has ``subset_mismatches`` and
        ``subset_rows``, so that a check on fewer columns needs no pass of its own.
        """
        one_row = self.pairs.select("ns", "nt", self.matched.alias("matched"), *self._marks())
        return self._with_sums(one_row.agg(*self._counts(subset)), subset)

    def _marks(self) -> list[Column]:
        return [(self.matched & self._differs(i)).alias(f"d{i}") for i in range(len(self.columns))]

    def _subset(self, subset: Sequence[str]) -> list[int]:
        return [i for i, c in enumerate(self.columns) if c in subset]

    def _counts(self, subset: Sequence[str]) -> list[Column]:
        """Aggregates over ``pairs`` with its marks ``matched`` and ``d0``.."""
        every = range(len(self.columns))
        return [
            (F.coalesce(F.sum("ns"), F.lit(0)) + self.settled).alias("source_total"),
            (F.coalesce(F.sum("nt"), F.lit(0)) + self.settled).alias("target_total"),
            (F.count_if("matched") + self.settled).alias("matched_keys"),
            F.count_if(_any([F.col(f"d{i}") for i in every])).alias("mismatched_rows"),
            F.count_if(self.only_source).alias("source_only"),
            F.count_if(self.only_target).alias("target_only"),
            F.count_if(F.col("ns") > 1).alias("source_dup_keys"),
            F.count_if(F.col("nt") > 1).alias("target_dup_keys"),
            F.count_if(_any([F.col(f"d{i}") for i in self._subset(subset)])).alias("subset_rows"),
            *[F.count_if(f"d{i}").alias(f"m{i}") for i in every]]

    def _with_sums(self, counts: DataFrame, subset: Sequence[str]) -> DataFrame:
        def cells(ids) -> Column:
            return reduce(Column.__add__, [F.col(f"m{i}") for i in ids], F.lit(0).cast("bigint"))
        return counts.withColumns({
            "value_mismatches": cells(range(len(self.columns))),
            "subset_mismatches": cells(self._subset(subset)),
            "values_matched": F.col("matched_keys") - F.col("mismatched_rows")})

    def write_findings(self, folder: str, subset: Sequence[str] = (),
                       format: str = "csv") -> DataFrame:
        """Writes :meth:`findings` and returns :meth:`totals`, both from one pass.

        The counts are observed on the way to the sink, in the stage that writes, so both
        sides are read and shuffled once for verdict and evidence together.
        """
        seen = Observation()
        watched = (self.pairs.withColumn("matched", self.matched)
                   .withColumns({f"d{i}": mark for i, mark in enumerate(self._marks())})
                   .observe(seen, *self._counts(subset)))
        writer = self._findings(watched).write.mode("overwrite").format(format)
        (writer.option("header", True) if format == "csv" else writer).save(folder)
        counts = seen.get
        schema = T.StructType([T.StructField(c, T.LongType()) for c in counts])
        local = self.source.sparkSession.createDataFrame([tuple(counts.values())], schema)
        return self._with_sums(local, subset)

    def is_clean(self, mismatches: str = "value_mismatches") -> Column:
        """Verdict over ``totals``: nothing missing, extra, different or repeated."""
        return reduce(Column.__and__, (F.col(c) == 0 for c in (
            "source_only", "target_only", mismatches, "source_dup_keys", "target_dup_keys")))

    def summary(self) -> DataFrame:
        """The metrics of the comparison and its verdict, one row."""
        return self.totals().select(*METRICS, "mismatched_rows",
                                    self.is_clean().alias("is_clean"))

    def column_counts(self) -> DataFrame:
        """Mismatches per compared column, columns without any left out."""
        if not self.columns:
            return self.totals().select(F.lit("").alias("column"),
                                        F.col("value_mismatches").alias("mismatches")).limit(0)
        rows = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"m{i}").alias("mismatches"))
                         for i, name in enumerate(self.columns)])
        return self.totals().select(F.inline(rows)).where("mismatches > 0")

    def _side_rows(self, condition: Column, side: str) -> DataFrame:
        types = self.source.schema
        return self.pairs.where(condition).select(
            *self._shown_keys(),
            *[shown(F.col(f"{side}.{c}"), types[c].dataType).alias(name)
              for c, name in zip(self._value_ids, self.columns)])

    def source_only(self) -> DataFrame:
        """Rows missing in the target."""
        return self._side_rows(self.only_source, "s")

    def target_only(self) -> DataFrame:
        """Rows the source does not have."""
        return self._side_rows(self.only_target, "t")

    def duplicates(self, keep: Keep | None = None) -> DataFrame:
        """All rows with a repeated key, labelled by ``side``."""
        def labelled(df: DataFrame, side: str) -> DataFrame:
            types = df.schema
            return rows_with_repeated_keys(df, self._key_ids, keep).select(
                F.lit(side).alias("side"), *self._shown_keys(),
                *[shown(F.col(c), types[c].dataType).alias(name)
                  for c, name in zip(self._value_ids, self.columns)])
        return labelled(self.source, "source").unionByName(labelled(self.target, "target"))

    def _mismatched(self) -> Column:
        return self.matched & _any([self._differs(i) for i in range(len(self.columns))])

    def _cell_array(self) -> Column:
        types = self.source.schema
        cells = [F.struct(F.lit("mismatch").alias("finding"), F.lit(name).alias("column"),
                          shown(F.col(f"s.c{i}"), types[f"c{i}"].dataType).alias("source_value"),
                          shown(F.col(f"t.c{i}"), types[f"c{i}"].dataType).alias("target_value"),
                          self._differs(i).alias("bad"))
                 for i, name in enumerate(self.columns)]
        return F.filter(F.array(*cells), lambda cell: cell["bad"])

    def cells(self) -> DataFrame:
        """One row per differing cell."""
        if not self.columns:
            return (self.pairs.where(F.lit(False)).select(
                *self._shown_keys(), F.lit("").alias("column"),
                F.lit("").alias("source_value"), F.lit("").alias("target_value")))
        return (self.pairs.where(self._mismatched())
                .select(*self._shown_keys(), F.inline(self._cell_array()))
                .drop("bad", "finding"))

    def findings(self) -> DataFrame:
        """Every mismatching cell and one-sided row in one pass, in one long shape.

        A one-sided row carries its values as JSON in the column of its side.
        """
        return self._findings(self.pairs)

    def _findings(self, pairs: DataFrame) -> DataFrame:
        def one_sided(finding: str, side: str) -> Column:
            row = F.to_json(F.struct(*[F.col(f"{side}.c{i}").alias(name)
                                       for i, name in enumerate(self.columns)])) \
                if self.columns else F.lit("{}")
            blank = F.lit(None).cast("string")
            return F.array(F.struct(
                F.lit(finding).alias("finding"), F.lit("*").alias("column"),
                (row if side == "s" else blank).alias("source_value"),
                (row if side == "t" else blank).alias("target_value"),
                F.lit(True).alias("bad")))
        found = F.when(self.only_source, one_sided("source_only", "s")) \
            .when(self.only_target, one_sided("target_only", "t"))
        if self.columns:
            found = found.when(self.matched, self._cell_array())
        some = self.only_source | self.only_target | self._mismatched()
        return pairs.where(some).select(*self._shown_keys(), F.inline(found)).drop("bad")

    def sample(self, rows: int = SAMPLE_ROWS) -> DataFrame:
        """First findings by key, of the most telling sort only: cells, else missing, else extra."""
        rank = (F.when(F.col("finding") == "mismatch", 0)
                .when(F.col("finding") == "source_only", 1).otherwise(2))
        first = (self.findings().withColumn("__rank", rank)
                 .orderBy("__rank", *[nz.col(k) for k in self.keys], "column").limit(rows))
        best = F.min("__rank").over(Window.partitionBy(F.lit(0)))  # over at most ``rows`` rows
        return first.withColumn("__best", best).where("__rank = __best").drop("__rank", "__best")


def keyed_diff(source: DataFrame, target: DataFrame, keys: Sequence[str],
               columns: Sequence[str] | None = None,
               norms: Mapping[str, Norm] | None = None) -> KeyedDiff:
    """Compare two frames by key.

    ``columns=None`` compares all shared columns, an empty list compares keys only; columns
    absent on a side are left out. Names are matched exactly, upper and lower case apart.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("a keyed comparison needs at least one key column")
    lost = {side: [k for k in keys if k not in df.columns]
            for side, df in (("source", source), ("target", target))}
    if any(lost.values()):
        raise ValueError(f"key columns missing: {lost}; source has {source.columns}, "
                         f"target has {target.columns}")
    wanted = source.columns if columns is None else columns
    usable = [c for c in dict.fromkeys(wanted)
              if c in source.columns and c in target.columns and c not in keys]
    norms = norms or {}
    source_types = {f.name: f.dataType for f in source.schema}
    target_types = {f.name: f.dataType for f in target.schema}

    def settings(name: str) -> Norm:
        return _readable(norms.get(name, Norm()), (source_types[name], target_types[name]))

    def side(df: DataFrame, other: DataFrame, mine: dict, theirs: dict) -> DataFrame:
        first = df.select(
            *key_columns(df, other, keys, norms),
            *[nz.prepared(nz.col(c), mine[c], settings(c)).alias(f"c{i}")
              for i, c in enumerate(usable)])
        return first.select(
            *[F.col(f"k{i}") for i in range(len(keys))],
            *[_comparable(F.col(f"c{i}"), mine[c], theirs[c], settings(c)).alias(f"c{i}")
              for i, c in enumerate(usable)])

    return KeyedDiff(tuple(keys), tuple(usable), tuple(settings(c) for c in usable),
                     side(source, target, source_types, target_types),
                     side(target, source, target_types, source_types))
