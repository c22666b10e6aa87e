"""A keyed comparison pruned by a tree of digests.

Each side is first told by digests: rows are dealt to buckets by a hash of their key, and a bucket's digest is
its number of rows and sums of two independent 64-bit hashes of the whole row, whatever the order. Sums fold
on the map side, so a level shuffles a row per task and bucket, not the data. Level one has a fixed number of
coarse buckets; level two cuts those that differ into leaves. Only the rows of leaves that differ, or in which
a key may repeat, go into the comparison of keys and cells; the others are known to be equal and are counted.

A bucket is wrongly taken as equal only if both hash sums agree by chance beside the row counts: about
2^-128 a bucket, so less than 2^-100 for any number of buckets that a job could have.

Pruning pays where changes are few or lie together. With changes in every leaf the whole comparison runs. Where
many coarse buckets differ, the leaves of some of them are therefore looked at first: if most of their rows lie in
open leaves, it leaves the comparison as it is after one narrow pass and a look at a share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import normalize as nz
from tallymark.operators.diff import Keep, KeyedDiff

#: Buckets of the first level; a task's share of the shuffle is at most a row for each.
COARSE = 4096
#: Rows of a leaf on average at least, and rows that a task is taken to read: leaves are never so many that
#: most of them meet less than LEAF_ROWS / 4 rows of a task.
LEAF_ROWS, TASK_ROWS = 32, 1_000_000
#: Open leaves up to which rows are told by a broadcast of their numbers; beyond, nothing is pruned.
OPEN_LEAVES = 500_000
#: Rows of a leaf up to which 32 bits of a key's hash tell its keys apart but for one leaf in a thousand.
NARROW_LEAF = 2048
#: Share of all rows in open leaves from which pruning would save too little.
WORTH = 0.5
#: Coarse buckets whose leaves are looked at first, where at least PROBED times as many differ.
PROBE, PROBED = 64, 16
_SEEDS = 1, 7_919


def _whole(columns: Sequence[Column]) -> list[Column]:
    """The columns and which of them are NULL: a hash passes over NULLs, so equal values in other columns would agree."""
    return [*columns, *[c.isNull() for c in columns]]


def _key_hash(diff: KeyedDiff, kinds: Mapping[str, T.DataType]) -> Column:
    """Hash of the key in the form in which both sides meet."""
    return F.xxhash64(*_whole([F.col(f"k{i}").cast(kinds[f"k{i}"]) for i in range(len(diff.keys))]))


def _sums(rows: Sequence[str], count: Column) -> list[Column]:
    """Number of rows, and the sums of both halves of each hash; a sum that leaves 64 bits is NULL."""
    halves = [F.shiftrightunsigned(F.col(h), 32) if high else F.col(h).bitwiseAND(0xFFFFFFFF)
              for h in rows for high in (False, True)]
    return [count, *[F.try_sum(half) for half in halves]]


@dataclass(frozen=True)
class Pruning:
    """What the tree found: the comparison that is left, and how much it had to look at."""

    diff: KeyedDiff
    rows: int  # of both sides
    coarse_open: int
    leaves: int
    leaves_open: int
    rows_open: int


def _hashed(diff: KeyedDiff, buckets: int) -> tuple[DataFrame, Mapping[str, T.DataType]]:
    """Both sides as bucket, key hash, two row hashes, side, and whether the row equals itself by the rules.

    An infinite value under a tolerance does not; such a row keeps its leaf open.
    """
    keys = [f"k{i}" for i in range(len(diff.keys))]
    values = [f"c{i}" for i in range(len(diff.columns))]
    tolerant = [(c, norm) for c, norm in zip(values, diff.norms) if norm.tolerant]
    itself = reduce(Column.__and__, [nz.same(F.col(c), F.col(c), norm) for c, norm in tolerant], F.lit(True))

    both = (diff.source.withColumn("in_source", F.lit(True))
            .unionByName(diff.target.withColumn("in_source", F.lit(False))))
    kinds = {f.name: f.dataType for f in both.schema}
    whole, key = _whole([F.col(c) for c in keys + values]), _key_hash(diff, kinds)
    return both.select(F.pmod(key, F.lit(buckets)).alias("bucket"), key.alias("key"),
                       *[F.xxhash64(F.lit(seed), *whole).alias(f"h{seed}") for seed in _SEEDS],
                       "in_source", itself.alias("itself")), kinds


def _digests(rows: DataFrame, *more: Column) -> DataFrame:
    """Per bucket: rows of both sides, and ``equal`` if their digests agree."""
    def of(mine: bool) -> list[Column]:
        return [F.when(F.col("in_source") == mine, F.col(f"h{seed}")) for seed in _SEEDS]

    marked = rows.select("bucket", "key", "in_source", "itself", *[
        c.alias(f"{'st'[not mine]}{i}") for mine in (True, False) for i, c in enumerate(of(mine))])
    columns = {}
    for name, mine in (("s", True), ("t", False)):
        sums = _sums([f"{name}{i}" for i in range(len(_SEEDS))], F.count_if(F.col("in_source") == mine))
        columns |= {f"{name}_{i}": c for i, c in enumerate(sums)}
    found = marked.groupBy("bucket").agg(*[c.alias(n) for n, c in columns.items()],
                                         F.count_if(~F.col("itself")).alias("odd"), *more)
    half = len(columns) // 2
    agree = reduce(Column.__and__, [F.coalesce(F.col(f"s_{i}") == F.col(f"t_{i}"), F.lit(False)) for i in range(half)])
    return found.withColumn("equal", agree & (F.col("odd") == 0))


def pruned(diff: KeyedDiff, keep: Keep, unique_keys: bool = False, coarse: int = COARSE,
           leaf_rows: int = LEAF_ROWS) -> Pruning:
    """The comparison without the rows that the digests settle; all its results are those of ``diff``.

    ``keep`` settles small intermediate results (see :func:`tallymark.session.stored`). A leaf counts as settled
    only if no key repeats in it, which is told by the set of its keys' hashes on one side; with
    ``unique_keys`` (keys that a deduplication check has passed) that set is not gathered. Copies of a key
    fold on the map side here too, and their leaf is open, so the comparison counts them as ever.
    """
    top = keep(_digests(_hashed(diff, coarse)[0]).select("bucket", "equal", "s_0", "t_0"))
    rows, left = top.agg(F.coalesce(F.sum(F.col("s_0") + F.col("t_0")), F.lit(0)),
                         F.coalesce(F.sum(F.when(~F.col("equal"), F.col("s_0") + F.col("t_0"))), F.lit(0))).first()
    nothing = Pruning(diff, rows, coarse, 0, 0, rows)
    differing = sorted(r["bucket"] for r in top.where("not equal").select("bucket").collect())  # COARSE at most
    if not rows:
        return nothing
    leaf_rows = max(leaf_rows, leaf_rows // 4 * (rows // TASK_ROWS))
    buckets = coarse * max(1, -(-rows // (coarse * leaf_rows)))
    low = F.col("bucket") % coarse
    if len(differing) >= PROBE * PROBED:
        probed = _digests(_hashed(diff, buckets)[0].where(low.isin(differing[:PROBE])))
        size = F.col("s_0") + F.col("t_0")
        seen, seen_open, n_open = probed.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("equal"), size)), F.lit(0)),
                                             F.count_if(~F.col("equal"))).first()
        n_open = n_open * len(differing) // PROBE  # carried on to all that differ
        if n_open > OPEN_LEAVES or seen_open * left > WORTH * rows * seen:
            return replace(nothing, coarse_open=len(differing), leaves=buckets, leaves_open=n_open)
    inside = low.isin(differing) if differing else F.lit(False)
    hashed, kinds = _hashed(diff, buckets)
    if unique_keys:
        hashed = hashed.where(inside)
    else:  # where a coarse bucket agrees only the source's keys are looked at, so nothing of its rows travels
        hashed = hashed.where(inside | F.col("in_source")).withColumns(
            {f"h{seed}": F.when(inside, F.col(f"h{seed}")) for seed in _SEEDS})
    # the low bits of the hash tell the leaf, so the high ones tell the keys in it
    mark = F.shiftright(F.col("key"), 32).cast("int") if leaf_rows <= NARROW_LEAF else F.col("key")
    more = [] if unique_keys else [F.size(F.collect_set(F.when(F.col("in_source"), mark))).alias("keys")]
    found = _digests(hashed, *more)
    if not unique_keys:
        found = found.withColumn("equal", (F.col("equal") | ~inside) & (F.col("keys") == F.col("s_0")))
    leaves = keep(found.select("bucket", "equal", "s_0", (low.isin(differing) if differing else F.lit(False)).alias("both"),
                               F.when(inside, F.col("t_0")).otherwise(F.col("s_0")).alias("t_0")))
    n, n_open, rows_open = leaves.agg(
        F.count("*"), F.count_if(~F.col("equal")),
        F.coalesce(F.sum(F.when(~F.col("equal"), F.col("s_0") + F.col("t_0"))), F.lit(0))).first()
    if n_open > OPEN_LEAVES or rows_open > WORTH * rows:
        return replace(nothing, coarse_open=len(differing), leaves=n, leaves_open=n_open)
    opened = keep(leaves.where("not equal").select("bucket"))  # small by its stored size, so it is broadcast

    def narrowed(df: DataFrame) -> DataFrame:
        at = F.pmod(_key_hash(diff, kinds), F.lit(buckets))
        return df.withColumn("bucket", at).join(opened, "bucket", "left_semi").drop("bucket")

    left_out = replace(diff, source=narrowed(diff.source), target=narrowed(diff.target),
                       settled=diff.settled + (rows - rows_open) // 2)
    return Pruning(left_out, rows, len(differing), n, n_open, rows_open)
