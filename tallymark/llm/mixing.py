"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, every source gets a target by weighted sharing under a ceiling, and
each document is emitted floor(rate) times plus one more copy by a seeded draw whose probability is
the fraction of its source's rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import BROADCAST_ROWS, stored

WORD = r"[^\x20\x09-\x0D]+"
DRAW_BITS = 52


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str) -> Column:
    """A number in [0, 1) fixed by the seed and the document's id (its text where that is NULL)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2 ** DRAW_BITS))


def source_targets(sized: DataFrame, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """One row per source: __source, source_size, target and rate.

    Sources are ranked by code point (NULL last) through a range partitioning and per-partition
    offsets, so that no task holds them all. The level that the open sources share by weight is
    found by repeating one aggregate: sources above their ceiling are fixed at it, the rest is
    shared anew; this ends after at most as many rounds as ceilings are reached.
    """
    spark = sized.sparkSession
    sums = sized.groupBy(F.col("source").alias("__source")).agg(F.sum("__size").alias("source_size"))
    order = F.col("__source").asc_nulls_last()
    placed = stored(sums.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order)
                    .withColumn("__part", F.spark_partition_id()))
    before = (placed.groupBy("__part").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.coalesce(
                  F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)))
              .select("__part", "__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1 + F.col("__before")
    cycle = F.array(*(F.lit(w) for w in weights))
    table = stored(placed.join(before, "__part")
                   .withColumn("__w", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
                   .withColumn("__cap", F.col("source_size") * ceiling)
                   .select("__source", "source_size", "__w", "__cap"))
    total, level, capped = None, float("inf"), -1
    while True:
        over = F.col("__cap") < F.lit(level) * F.col("__w") if total is not None else F.lit(False)
        row = table.agg(F.sum("source_size"), F.sum(F.when(over, F.col("__cap")).otherwise(0)),
                        F.sum(F.when(over, 0).otherwise(F.col("__w"))),
                        F.sum(F.when(over, 1).otherwise(0))).first()
        total = row[0] or 0
        if not row[2] or row[3] == capped:
            break
        level, capped = (total - row[1]) / row[2], row[3]
    share = F.lit(level if level != float("inf") else 0.0) * F.col("__w")
    target = F.least(F.col("__cap").cast("double"), share)
    return table.select("__source", "source_size", target.alias("target"),
                        F.when(F.col("source_size") > 0, target / F.col("source_size"))
                        .otherwise(0.0).alias("__rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3,
        seed: str = "mix") -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target`` and ``copies``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share the sum of all sizes;
    no target exceeds ``ceiling`` times its source's size. NULL and empty texts have size 0. A source
    without words has target 0 and is not emitted. Rows that repeat an id share its draw; a NULL id
    draws by its text. An empty table gives an empty result. The docs must have no columns of the
    four result names; ``mixed`` takes any extra columns.
    """
    sized = docs.withColumn("__size", word_count())
    targets = source_targets(sized.select("source", "__size"), weights, ceiling)
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)  # counted; else adaptive execution splits the hot source
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    whole = F.floor("__rate")
    copies = whole + (draw(seed) < F.col("__rate") - whole).cast("long")
    return (joined.withColumn("copies", copies).withColumnRenamed("__size", "size")
            .drop("__source", "__rate"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3,
          seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, columns unchanged."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    counted = mix(docs.select("doc_id", "text", "source", whole), weights, ceiling, seed)
    return (counted.select("__row", F.explode(F.sequence(F.lit(1), F.when(F.col("copies") > 0, F.col("copies"))
                                                         .otherwise(F.lit(None)).cast("int"))).alias("__copy"))
            .select("__row.*"))
