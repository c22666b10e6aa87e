"""Packing documents into token sequences, shortest pack first over the length histogram.

Documents are tokenised once and cut into pieces of at most a sequence's length. Only the histogram of
piece lengths, at most one row per length, reaches the driver. There lengths are placed longest first,
each into the emptiest packs that hold it, as counts of packing patterns. Pieces then find their slot
by their rank among the pieces of their length; ranks are counted in buckets, so that a length that
many pieces share is spread over tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import batch_column, stored
from tallymark.llm.tokens import Encoder, encoder  # noqa: F401 (Encoder is part of this module too)

SEQUENCE = 2048
END_ID = 1
#: Pieces of one length that one bucket of the ranking holds on average.
BUCKET_ROWS = 2_000
_RANK_BITS = 44


def _start(config):
    path, length, end_id = config
    encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()

    def work(texts):
        sizes, sums = [], []
        for text in texts:
            ids = encode(text) + end
            sizes.append(len(ids) // 4)
            sums.append([zlib.crc32(ids[lo:lo + 4 * length]) for lo in range(0, len(ids), 4 * length)])
        return sizes, sums

    return work


def pieces_of(docs: DataFrame, length: int = SEQUENCE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece; a document ends with end_id."""
    config = docs.sparkSession.sparkContext.broadcast((path, length, end_id))
    coded = docs.select("doc_id", batch_column(
        F.col("text"), "doc_tokens long, sums array<long>", {"doc_tokens": pa.int64(), "sums": pa.list_(pa.int64())},
        _start, config).alias("__coded"))
    start = F.col("__at").cast("long") * length
    return (coded.select("doc_id", F.col("__coded.doc_tokens").alias("doc_tokens"),
                         F.posexplode("__coded.sums").alias("__at", "ids_crc32"))
            .select("doc_id", start.alias("start"), F.least(F.lit(length), F.col("doc_tokens") - start)
                    .cast("long").alias("length"), "ids_crc32", "doc_tokens"))


def packing_patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in them) by shortest-pack-first over a histogram of lengths.

    Open patterns are kept by the room left in them. A length takes the patterns with most room first
    and opens packs of its own once none has room for it.
    """
    open_by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens does not fit into {size}")
        while left and (room := max((r for r in open_by_room if r >= length), default=None)) is not None:
            packs, lengths = open_by_room[room].pop()
            used = min(packs, left)
            left -= used
            if packs > used:
                open_by_room[room].append((packs - used, lengths))
            if not open_by_room[room]:
                del open_by_room[room]
            open_by_room[room - length].append((used, [*lengths, length]))
        per_pack = size // length
        while left:
            fitting = min(per_pack, left)
            packs = left // fitting
            open_by_room[size - fitting * length].append((packs, [length] * fitting))
            left -= packs * fitting
    return [p for patterns in open_by_room.values() for p in patterns]


def slot_table(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Per slot of a pattern: (length, first rank) as one number, first sequence, and offset; sorted."""
    ranks: dict[int, int] = defaultdict(int)
    keys, firsts, offsets, sequence = [], [], [], 0
    for packs, lengths in patterns:
        offset = 0
        for length in lengths:
            keys.append(length << _RANK_BITS | ranks[length])
            firsts.append(sequence)
            offsets.append(offset)
            ranks[length] += packs
            offset += length
        sequence += packs
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (keys, firsts, offsets))


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Stored pieces plus ``__rank`` from 0 among the pieces of their length."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index")  # copies of a row lie in different places
    dealt = (pieces.select("*", place.alias("__place"))
             .withColumn("__bucket", F.pmod(F.col("__place"), F.lit(buckets))))
    before = (dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(
                  Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("length", "__bucket", "__before"))
    within = Window.partitionBy("length", "__bucket").orderBy("__place", "doc_id", "start", "ids_crc32")
    return (dealt.withColumn("__row", F.row_number().over(within) - 1)
            .join(before, ["length", "__bucket"])
            .withColumn("__rank", (F.col("__row") + F.col("__before")).cast("long"))
            .drop("__row", "__before", "__bucket", "__place"))


def placed(ranked_pieces: DataFrame, patterns: list[tuple[int, list[int]]]) -> DataFrame:
    """Pieces with ``length`` and ``__rank`` plus ``__slot``: their sequence_id and offset by the patterns."""
    table = ranked_pieces.sparkSession.sparkContext.broadcast(slot_table(patterns))

    @F.arrow_udf("sequence_id long, offset long")
    def slot(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        keys, firsts, offsets = table.value
        for lengths, ranks in batches:
            key = lengths.to_numpy(zero_copy_only=False) << _RANK_BITS | ranks.to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.StructArray.from_arrays(
                [pa.array(firsts[at] + key - keys[at]), pa.array(offsets[at])], names=["sequence_id", "offset"])

    return ranked_pieces.withColumn("__slot", slot.asNondeterministic()("length", "__rank"))


def packed(docs: DataFrame, length: int = SEQUENCE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A NULL or empty text is the end id alone. A document longer than a sequence is cut every
    ``length`` ids. Sequences are gapless from 0 and hold at most ``length`` ids. Rows that repeat an
    id are documents of their own; equal pieces may swap places. An empty table gives no rows.
    """
    pieces = stored(pieces_of(docs, length, end_id, path))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    return placed(ranked(pieces, sum(histogram.values())), packing_patterns(histogram, length)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "__slot.sequence_id", "__slot.offset")
