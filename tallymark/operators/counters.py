"""Many checks from one pass: counters of several checks fused into one aggregate per table.

A :class:`Tally` names the aggregates a check needs and how its rows follow from them. All
tallies of a table run as one global aggregate (partial per task, then one tiny merge), so
the table is scanned once and nothing is shuffled; checks that also count the other side of a pair share
one scan of that. Wide sets are cut so that the generated
code of one aggregate stays below the JVM method limit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COUNTERS = 200


@dataclass(frozen=True)
class Tally:
    """Aggregates by name, and the result rows (structs of one shape) built from them.

    ``others`` are aggregates over the other side of a pair; ``given`` is a one-row frame of numbers that were
    found elsewhere. Names differ among all three.
    """

    counters: Mapping[str, Column]
    rows: Callable[[Mapping[str, Column]], Sequence[Column]]
    others: Mapping[str, Column] = field(default_factory=dict)
    given: DataFrame | None = None

    def __len__(self) -> int:
        return len(self.counters) + len(self.others)


def _batches(tallies: Sequence[Tally]) -> list[list[Tally]]:
    batches: list[list[Tally]] = [[]]
    width = 0
    for tally in tallies:
        if batches[-1] and width + len(tally) > MAX_COUNTERS:
            batches.append([])
            width = 0
        batches[-1].append(tally)
        width += len(tally)
    return batches


def tally_rows(df: DataFrame, tallies: Sequence[Tally], other: DataFrame | None = None) -> DataFrame:
    """Result rows of all tallies over one scan of ``df`` (one per 200 counters), and of ``other`` where one needs it.

    The single rows of both sides and of what is given are laid over one another, never joined.
    """
    def one(batch: Sequence[Tally]) -> DataFrame:
        mine, theirs, given, rows = [], [], [], []
        for i, tally in enumerate(batch):
            def alias(name: str, i: int = i) -> str:
                return f"__{i}_{name}"
            mine += [c.alias(alias(n)) for n, c in tally.counters.items()]
            theirs += [c.alias(alias(n)) for n, c in tally.others.items()]
            extra = tally.given.columns if tally.given is not None else []
            if extra:
                given.append(tally.given.select(*[F.col(c).alias(alias(c)) for c in extra]))
            rows += tally.rows({n: F.col(f"`{alias(n)}`") for n in (*tally.counters, *tally.others, *extra)})
        found = ([df.agg(*mine)] if mine else []) + ([other.agg(*theirs)] if theirs else []) + given
        if len(found) > 1:
            whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
            found = [whole.agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in whole.columns])]
        return found[0].select(F.inline(F.array(*rows)))
    return reduce(DataFrame.unionByName, [one(b) for b in _batches(tallies) if b])
