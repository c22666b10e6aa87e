"""Packing documents into few sequences: Martello-Toth dominance reduction, then best fit.

Documents are tokenised once and cut into pieces of at most a sequence's length. Only the histogram of
piece lengths, at most one row per length, reaches the driver. There the reduction looks for sets of
pieces that provably dominate every other set that a piece could share a sequence with, fixes them, and
shrinks the histogram; what is left goes by best fit, longest first. Patterns of lengths are joined back
to the pieces by their rank among those of their length: a running number within the writing task plus
the pieces of earlier tasks, so that no length gathers its pieces in one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import sized, slices, stored
from tallymark.llm.packing import placed
from tallymark.llm.tokens import encoder

SEQUENCE = 2048
END_ID = 0


class _Instance:
    """Lengths still to be placed: how many of each, and the distinct ones in ascending order."""

    def __init__(self, histogram: dict[int, int], size: int):
        for length, n in histogram.items():
            if n and not 0 < length <= size:
                raise ValueError(f"a piece of {length} tokens does not fit into {size}")
        self.size = size
        self.count = {length: n for length, n in histogram.items() if n}
        self.lengths = sorted(self.count)

    def take(self, members: tuple[int, ...]) -> int:
        """Removes the set as often as it is there; returns how often."""
        need = Counter(members)
        times = min(self.count[x] // n for x, n in need.items())
        for x, n in need.items():
            self.count[x] -= times * n
            if not self.count[x]:
                del self.count[x]
                self.lengths.pop(bisect_left(self.lengths, x))
        return times

    def _left(self, length: int, without: tuple[int, ...]) -> int:
        return self.count.get(length, 0) - without.count(length)

    def smallest(self, n: int, without: tuple[int, ...], above: int = 0) -> list[int]:
        """The n smallest pieces over ``above``, repeats included."""
        found = []
        for length in self.lengths[bisect_right(self.lengths, above):]:
            found += [length] * min(n - len(found), self._left(length, without))
            if len(found) == n:
                break
        return found

    def largest(self, most: int, without: tuple[int, ...]) -> int | None:
        for at in range(bisect_right(self.lengths, most) - 1, -1, -1):
            if self._left(self.lengths[at], without):
                return self.lengths[at]
        return None

    def best_pair(self, room: int, without: tuple[int, ...]) -> int:
        """The largest sum of two pieces that is not above ``room``; 0 if none is."""
        best, low, high = 0, 0, bisect_right(self.lengths, room) - 1
        while low <= high:
            one, two = self.lengths[low], self.lengths[high]
            if not self._left(one, without):
                low += 1
            elif not self._left(two, without):
                high -= 1
            elif one + two > room:
                high -= 1
            elif low == high:
                best = max(best, one + two if self._left(one, without) > 1 else 0)
                break
            else:
                best = max(best, one + two)
                low += 1
        # two of the same length, in the upper half of which the pointers pass each once
        for length in self.lengths[bisect_right(self.lengths, best // 2):bisect_right(self.lengths, room // 2)]:
            if self._left(length, without) > 1:
                best = max(best, 2 * length)
        return best

    def dominating(self, piece: int) -> tuple[int, ...] | None:
        """A set with ``piece`` that dominates all feasible sets with it, or None if none is proved to.

        A set dominates another if the other's pieces fall into groups of which each is no longer than a
        piece of its own of the first: these may then change places in any packing. Proved are, with r
        the room beside the piece and k the longest other piece that r holds:

        * the piece alone, if r holds no other;
        * (piece, k), if k fills r, or r holds no two others, or no three and no two longer than k in sum;
        * (piece, k, b), b the longest that fits beside both, if r holds no three others, and no two that
          are both longer than b: the longer of any two is at most k, the shorter at most b.
        """
        room, own = self.size - piece, (piece,)
        first = self.smallest(3, own)
        if not first or first[0] > room:
            return own
        k = self.largest(room, own)
        if k == room or len(first) < 2 or sum(first[:2]) > room:
            return piece, k
        if len(first) == 3 and sum(first) <= room:
            return None
        if self.best_pair(room, own) <= k:
            return piece, k
        b = self.largest(room - k, (piece, k))
        if b is not None:
            above = self.smallest(2, own, b)
            if len(above) < 2 or sum(above) > room:
                return piece, k, b
        return None


def reduced(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """(number of packs, lengths in them) fixed by dominance, and the histogram of what is left.

    Some best packing of the whole holds the fixed packs: each is fixed when its set dominates all others
    of its longest piece. While copies of the set are left, fewer pieces remain to object, so the proof
    holds for as many packs as there are copies.
    """
    left, fixed, changed = _Instance(histogram, size), [], True
    while changed:
        changed = False
        for piece in reversed(list(left.lengths)):
            while left.count.get(piece) and (members := left.dominating(piece)):
                fixed.append((left.take(members), list(members)))
                changed = True
    return fixed, dict(left.count)


def best_fit(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in them), longest first, each into the fullest pack that holds it.

    Packs alike are kept as one pattern by the room left in them. A pack that takes a piece is fuller than
    before, so it takes the next of that length too while it can.
    """
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room, packs, lengths):
        if packs:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append((packs, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(size, -(-left // (size // length)), [])  # as many new packs as the rest of this length fills
                continue
            room = rooms[at]
            packs, lengths = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            each = room // length
            full = min(packs, left // each)
            put(room - each * length, full, lengths + [length] * each)
            left -= full * each
            packs -= full
            if packs and 0 < left < each:
                put(room - left * length, 1, lengths + [length] * left)
                packs, left = packs - 1, 0
            put(room, packs, lengths)
    return [p for patterns in by_room.values() for p in patterns]


def packing_patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in them): the sets fixed by dominance, then best fit of the rest."""
    fixed, rest = reduced(histogram, size)
    return fixed + best_fit(rest, size)


def _cut(path: str | None, length: int, end_id: int, names: list[str]):
    """Pieces of whole texts; each has its number among the pieces of its length that this task wrote."""
    def work(batches):
        encode, end, seen = encoder(path).encode, np.array([end_id], "<u4").tobytes(), Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in slices(batch.column(1)):
                rows = []
                for i, text in enumerate(texts, at):
                    data = encode(text) + end
                    total = len(data) // 4
                    first = total % length or min(total, length)
                    edges = [0, *range(first, total + 1, length)]
                    for piece, (lo, hi) in enumerate(zip(edges, edges[1:])):
                        rows.append((i, piece, lo, hi - lo, zlib.crc32(data[4 * lo:4 * hi]), seen[hi - lo]))
                        seen[hi - lo] += 1
                at += len(texts)
                columns = [np.array(c, np.int64) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)),
                     *map(pa.array, columns[2:]), pa.array(np.full(len(rows), part, np.int64))], names=names)

    return work


def pieces_of(docs: DataFrame, length: int = SEQUENCE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and where its task wrote it.

    A document ends with end_id. One longer than ``length`` is cut into pieces of just that; the first
    piece has what is left over, if anything is.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, __row long, __part long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "__row", "__part"]
    return docs.select("doc_id", "text").mapInArrow(_cut(path, length, end_id, names), schema)


def packed(docs: DataFrame, length: int = SEQUENCE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A NULL or empty text is the end id alone. Sequences are gapless and hold at most ``length`` ids. Rows
    that repeat an id, or have none, are documents of their own. An empty table gives no rows. Only doc_id
    and text are read, so further columns cannot clash.
    """
    pieces = stored(pieces_of(docs, length, end_id, path))
    counts = stored(pieces.groupBy("length", "__part").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(counts.select("length", "__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before")))
    ranked = (pieces.join(sized(before), ["length", "__part"])
              .withColumn("__rank", F.col("__row") + F.col("__before")))
    return placed(ranked, packing_patterns(histogram, length)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "__slot.sequence_id", "__slot.offset")
