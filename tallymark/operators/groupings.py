"""Row counts of several groupings of a table from one scan, with those of the other side of a pair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import normalize as nz


@dataclass
class Groupings:
    """Grouping sets that checks ask for, and the one aggregate that has them all.

    ``counted`` has a row per set and group with ``nt`` rows of the table and ``ns`` of the other side, which
    is only read if some check asks for both. NULL is a group like any other. Every set folds on the map side.
    """

    df: DataFrame
    other: DataFrame | None = None
    sets: list[tuple[str, ...]] = field(default_factory=list)
    paired: list[str] = field(default_factory=list)

    def ask(self, columns: Sequence[str], both: bool = False) -> int:
        """The number of a grouping; the same columns give the same one."""
        key = tuple(dict.fromkeys(columns))
        if key not in self.sets:
            self.sets.append(key)
        if both:
            self.paired += [c for c in key if c not in self.paired]
        return self.sets.index(key)

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(c for key in self.sets for c in key))

    def value(self, column: str) -> Column:
        """A grouping column in ``counted``."""
        return F.col(f"g{self.names.index(column)}")

    def counted(self) -> DataFrame:
        names, types = self.names, {f.name: f.dataType for f in self.df.schema}

        def side(df: DataFrame, mine: bool) -> DataFrame:
            return df.select(F.lit(mine).alias("in_other"), *[
                (nz.col(c) if not mine or c in self.paired else F.lit(None).cast(types[c])).alias(f"g{i}")
                for i, c in enumerate(names)])

        rows = side(self.df, False)
        if self.paired and self.other is not None:
            rows = rows.unionByName(side(self.other, True))
        columns = [f"g{i}" for i in range(len(names))]
        sets = [[f"g{names.index(c)}" for c in key] for key in self.sets]
        # a set's number is told by which columns it leaves out
        left_out = [sum(1 << (len(names) - 1 - i) for i, c in enumerate(columns) if c not in key) for key in sets]
        number = F.array_position(F.array(*[F.lit(x).cast("bigint") for x in left_out]), F.col("gid")) - 1
        return (rows.groupingSets([[F.col(c) for c in key] for key in sets], *columns)
                .agg(F.grouping_id().cast("bigint").alias("gid"), F.count_if("in_other").alias("ns"),
                     F.count_if(~F.col("in_other")).alias("nt"))
                .select(*columns, number.cast("int").alias("set"), "ns", "nt"))


def comparable(dtype: T.DataType) -> bool:
    """Whether values of a type can be grouped."""
    return not isinstance(dtype, (T.MapType, T.VariantType))
