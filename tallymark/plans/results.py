"""Check rows: the one shape in which every check reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallymark.operators.counters import Tally, tally_rows
from tallymark.operators.diff import KeyedDiff
from tallymark.session import stored

COLUMNS = ("category", "name", "target_table", "status", "severity", "message", "metrics",
           "rule_id", "use_case")


@dataclass(frozen=True)
class Head:
    """What is known of a check before it runs."""

    category: str
    name: str
    table: str | None = None
    severity: str = "P3"
    rule_id: str | None = None
    use_case: str | None = None


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def check_struct(head: Head, status, message, metrics: Mapping[str, object] | None = None,
                 severity=None) -> Column:
    """A check row as a struct. Metrics become text; those that are NULL are left out."""
    pairs = [part for name, value in (metrics or {}).items()
             for part in (F.lit(name), _column(value).cast("string"))]
    shown = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(head.category).alias("category"), F.lit(head.name).alias("name"),
        (F.lit(head.table) if head.table else text).alias("target_table"),
        _column(status).alias("status"),
        _column(severity if severity is not None else head.severity).alias("severity"),
        _column(message).alias("message"),
        F.map_filter(shown, lambda _, v: v.isNotNull()).cast("map<string,string>").alias("metrics"),
        (F.lit(head.rule_id) if head.rule_id else text).alias("rule_id"),
        (F.lit(head.use_case) if head.use_case else text).alias("use_case"))


def words(*parts) -> Column:
    """A message from text and columns; numbers are written out."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("?")) if isinstance(p, Column)
                      else F.lit(str(p)) for p in parts])


def fixed_row(head: Head, status: str, message: str,
              metrics: Mapping[str, str] | None = None) -> Row:
    """A check decided without a job: skipped, failed at planning, or told by column names."""
    return Row(*COLUMNS)(head.category, head.name, head.table, status, head.severity, message,
                         dict(metrics or {}), head.rule_id, head.use_case)


@dataclass(frozen=True)
class Planned:
    """Checks that run as one piece: one frame of check rows, one row per head.

    ``alone`` gives the rows of one head by itself, for when the piece as a whole fails.
    ``offenders`` builds the offending rows of a head, to be written if the check fails.
    ``rows_and_evidence`` writes the offending rows to a folder and gives the check rows, from
    one pass over the data; ``duplicates`` are the rows it left out for their repeated keys.
    """

    heads: tuple[Head, ...]
    rows: DataFrame
    alone: Mapping[str, Callable[[], DataFrame]]
    offenders: Mapping[str, Callable[[], DataFrame]]
    rows_and_evidence: Callable[[str], DataFrame] | None = None
    duplicates: Callable[[], DataFrame] | None = None


def single(head: Head, frame: DataFrame, status, message, metrics=None, severity=None,
           offenders: Callable[[], DataFrame] | None = None) -> Planned:
    """A check from a one-row frame."""
    rows = frame.select(check_struct(head, status, message, metrics, severity).alias("c")) \
        .select("c.*")
    return Planned((head,), rows, {head.name: lambda: rows},
                   {head.name: offenders} if offenders else {})


def compared(diff: KeyedDiff, checks: Mapping[Head, Column],
             subset: Sequence[str] = ()) -> Planned:
    """Checks read off the totals of one comparison."""
    def rows(totals: DataFrame, structs) -> DataFrame:
        return totals.select(F.inline(F.array(*structs)))
    totals = diff.totals(subset)
    return Planned(
        tuple(checks), rows(totals, checks.values()),
        {h.name: (lambda c=c: rows(totals, [c])) for h, c in checks.items()},
        {h.name: diff.findings for h in checks},
        lambda folder: rows(diff.write_findings(folder, subset), checks.values()),
        lambda: diff.duplicates(stored))


def fused(df: DataFrame, tallies: Mapping[Head, Tally],
          offenders: Mapping[str, Callable[[], DataFrame]], other: DataFrame | None = None) -> Planned:
    """Checks counted together in one scan of a table, and one of the other side where they count that too."""
    return Planned(tuple(tallies), tally_rows(df, list(tallies.values()), other),
                   {h.name: (lambda t=t: tally_rows(df, [t], other)) for h, t in tallies.items()},
                   dict(offenders))
