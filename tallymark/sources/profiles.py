"""Counters kept per file: a feed that grows by files is counted again without reading its old ones.

Counters of a file (rows, nulls, misfits, default values, sums) are stored under the file's path, length and time
of change. Counting the feed lists its files without content, scans only those that are not stored as they are
now, stores their counters and adds up those of all files listed. A file that was rewritten counts anew, one that
is gone no longer counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import normalize as nz
from tallymark.operators import checks as ck

_FILE = ("path", "length", "changed")
#: Files up to which new ones are read by name; with more, the feed is read whole and cut down to them.
NAMED_FILES = 10_000


def column_counters(df: DataFrame, nulls: Sequence[str] = (), kinds: Mapping[str, str] | None = None,
                    defaults: Mapping[str, object] | None = None, sums: Sequence[str] = ()) -> dict[str, Column]:
    """Counters as the checks have them, by name: ``rows``, ``null:c``, ``bad:c``, ``default:c`` and ``sum:c``."""
    types = ck.types_of(df)
    found = {"rows": F.count(F.lit(1))}
    found |= {f"null:{c}": F.count_if(nz.nullish(nz.col(c), types[c])) for c in nulls}
    found |= {f"bad:{c}": F.count_if(ck.unfit(nz.col(c), types[c], kind)) for c, kind in (kinds or {}).items()}
    found |= {f"default:{c}": F.count_if(nz.stripped(nz.as_text(nz.col(c), types[c])) == F.lit(str(v).strip()))
              for c, v in (defaults or {}).items()}
    return found | {f"sum:{c}": F.sum(nz.exact_number(nz.col(c), types[c], 4)) for c in sums}


@dataclass(frozen=True)
class FileProfile:
    """The counters of a feed of Parquet files below ``feed``, kept below ``store``.

    ``counters`` gives the aggregates for a frame of the feed's columns; what they count must add up over files.
    A store belongs to one set of counters: with others, take another folder.
    """

    spark: SparkSession
    feed: str
    store: str
    counters: Mapping[str, Column]

    def listed(self) -> DataFrame:
        """Path, length and time of change of every file, without content."""
        m = F.col("_metadata")
        return (self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.feed)
                .select(m["file_path"].alias("path"), m["file_size"].alias("length"),
                        m["file_modification_time"].alias("changed")))

    def _kept(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.store)
        except AnalysisException as exc:
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def new_files(self) -> DataFrame:
        """The listed files whose counters are not stored."""
        kept, listed = self._kept(), self.listed()
        return listed if kept is None else listed.join(kept.select(*_FILE), list(_FILE), "left_anti")

    def scan(self, new: Sequence[str]) -> DataFrame:
        """The rows of new files only."""
        if len(new) <= NAMED_FILES:
            return self.spark.read.parquet(*new)
        return self.spark.read.parquet(self.feed).where(F.col("_metadata.file_path").isin(list(new)))

    def refresh(self) -> int:
        """Stores the counters of new files; returns their number."""
        new = [r.path for r in self.new_files().select("path").collect()]  # files, not rows
        if not new:
            return 0
        m = F.col("_metadata")
        names = {f"n{i}": c for i, c in enumerate(self.counters.values())}
        rows = self.scan(new).withColumns({
            "__path": m["file_path"], "__length": m["file_size"], "__changed": m["file_modification_time"]})
        counted = rows.groupBy("__path", "__length", "__changed").agg(*[c.alias(n) for n, c in names.items()])
        counted = counted.withColumnsRenamed({f"__{c}": c for c in _FILE})
        # a file without rows is in no group; it is stored with nothing to add, so that it is not new again
        blank = self.new_files().join(counted.select(*_FILE), list(_FILE), "left_anti")
        (counted.unionByName(blank, allowMissingColumns=True).coalesce(1)  # a row per new file
         .write.mode("append").parquet(self.store))
        return len(new)

    def totals(self) -> DataFrame:
        """One row with the counters of all files there are now, after :meth:`refresh`."""
        self.refresh()
        kept = self._kept()
        types = {f.name: f.dataType for f in kept.schema} if kept is not None else {}
        if kept is None:
            return self.spark.createDataFrame([tuple(0 for _ in self.counters)],
                                              T.StructType([T.StructField(n, T.LongType()) for n in self.counters]))
        now = kept.join(self.listed(), list(_FILE), "left_semi").dropDuplicates(list(_FILE))
        return now.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).cast(types[f"n{i}"]).alias(name)
                         for i, name in enumerate(self.counters)])
