"""Near-duplicates by MinHash: banded signatures, exact confirmation, alternating star contraction.

Texts with equal word sequences are one node, numbered when nodes are found. A node's signature is the minima of many universal
hashes over its distinct word shingles; nodes that agree on a whole band are candidates. Within a
bucket they first meet only a pivot, the same number of pairs as members. Links that the full sets
confirm are contracted to components. Buckets that still hold several components then compare the
members outside their largest component with all others, block by block inside tasks; only pairs of
different components whose signatures agree well enough leave a task, and are confirmed on full sets.
So every candidate pair is decided unless its ends are linked already, and no group is paired up.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import BROADCAST_ROWS, slices, stored, words

WIDTH, PERCENT = 5, 85
#: Probability at most that a pair of just the wanted similarity shares no band, or too few minima.
MISSED = 3e-7
#: Minima of a signature, and of a band, at most; a similarity that needs more takes bands of one.
MINIMA, ROWS = 200, 16
#: Shingles that are hashed at once, and members of a block of a bucket.
PIECE, BLOCK = 16_384, 512
_WORD_FACTORS = np.random.default_rng(20240229).integers(1, 2 ** 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
CACHE = 300_000


@functools.cache
def banding(percent: int) -> tuple[int, int]:
    """Bands and minima in each for a wanted similarity: the most selective that miss no more than MISSED."""
    if not 0 < percent <= 100:
        raise ValueError(f"a similarity of {percent} percent cannot be searched for")
    for rows in range(ROWS, 0, -1):
        agree = (percent / 100) ** rows
        bands = 1 if agree == 1 else math.ceil(math.log(MISSED) / math.log1p(-agree))
        if bands * rows <= MINIMA or rows == 1:
            return bands, rows


#: At the usual similarity: a pair shares no band with probability 2.6e-7.
BANDS, BAND_ROWS = banding(PERCENT)


@functools.cache
def _hashes(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of so many universal hashes."""
    rng = np.random.default_rng(20240301)
    return (rng.integers(1, 2 ** 63, size, dtype=np.uint64) << np.uint64(1) | np.uint64(1),
            rng.integers(0, 2 ** 63, size, dtype=np.uint64))


class Shingler:
    """Sorted distinct 64-bit fingerprints of a text's word shingles."""

    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}

    def _number(self, word: bytes) -> int:
        n = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return n

    def fingerprints(self, found: list[bytes]) -> np.ndarray:
        """Of windows of ``width`` words; with fewer words, of the whole sequence as one."""
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        get, new = self.known.get, self._number
        ids = np.array([n if (n := get(w)) is not None else new(w) for w in found], np.uint64)
        width = min(self.width, len(ids))
        n = len(ids) - width + 1
        key = np.full(n, width, np.uint64)
        for k in range(width):
            key = _mixed(key + ids[k:k + n] * _WORD_FACTORS[k])
        return np.unique(key)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def minima(sets: list[np.ndarray], size: int = BANDS * BAND_ROWS) -> np.ndarray:
    """Per set of shingles the smallest value of each multiply-add-shift hash, as 32 bits.

    No set may be empty. Sets are hashed together up to PIECE shingles, which stay in the cache.
    """
    (factors, shifts), out, lo = _hashes(size), np.empty((len(sets), size), np.uint32), 0
    while lo < len(sets):
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= PIECE):
            total += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo:hi - 1])])
        for k in range(size):
            out[lo:hi, k] = np.minimum.reduceat(flat * factors[k] + shifts[k], starts) >> np.uint64(32)
        lo = hi
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band."""
    rows = signature.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = _mixed(key * _WORD_FACTORS[k] + rows[:, k])
    return key.view(np.int64)


_MAPPED = pa.schema([("doc_id", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("n_shingles", pa.int64()),
                     ("sequence", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
#: Two hashes of a text, which with the doc_id tell its rows.
_TEXT_KEY = ("ka", "kb")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the hashes of its texts."""
    return docs.withColumns({k: F.xxhash64(F.lit(seed), "text") for seed, k in enumerate(_TEXT_KEY, 1)})


def _signed(percent: int):
    """Per document: set size, digest of the word sequence, signature (a byte of each minimum), bands."""
    bands, band_rows = banding(percent)

    def work(batches):
        shingler = Shingler()
        for batch in batches:
            keys, at = [batch.column(c) for c in ("doc_id", *_TEXT_KEY)], 0
            for held in slices(batch.column("text")):
                found = [words(t) for t in held]
                sets = [shingler.fingerprints(w) for w in found]
                some = [i for i, s in enumerate(sets) if len(s)]
                signatures = dict(zip(some, minima([sets[i] for i in some], bands * band_rows)))
                rows = []
                for i, (w, s) in enumerate(zip(found, sets)):
                    row = {"doc_id": keys[0][at + i].as_py(), "ka": keys[1][at + i].as_py(),
                           "kb": keys[2][at + i].as_py(), "n_shingles": len(s)}
                    if i in signatures:
                        row |= {"sequence": hashlib.blake2b(b" ".join(w), digest_size=16).digest(),
                                "signature": signatures[i].astype(np.uint8).tobytes(),
                                "bands": band_keys(signatures[i], bands).tolist()}
                    rows.append(row)
                at += len(held)
                yield pa.RecordBatch.from_pylist(rows, _MAPPED)

    return work


def _with_sets(batches):
    """Per node the full set, and its fingerprints' low 16 bits."""
    shingler = Shingler()
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary()), ("low", pa.binary())])
    for batch in batches:
        ids, at = batch.column("node"), 0
        for held in slices(batch.column("text")):
            sets = [shingler.fingerprints(words(t)) for t in held]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(held)), pa.array([s.tobytes() for s in sets]),
                 pa.array([s.astype(np.uint16).tobytes() for s in sets])], schema=schema)
            at += len(held)


def _agreement(percent: int) -> int:
    """Signature bytes that must agree: of minima that agree with the wanted similarity, fewer do with MISSED at most."""
    size, wanted = math.prod(banding(percent)), percent / 100
    total = 0.0
    for least in range(size + 1):
        total += math.comb(size, least) * wanted ** least * (1 - wanted) ** (size - least)
        if total > MISSED:
            return least
    return size


def _likely(percent: int):
    """Keeps the pairs whose signatures agree often enough."""
    least = _agreement(percent)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8)
                        .reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = pa.array((one == two).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)],
                                             names=["a", "b"])

    return work


def _confirmed(percent: int):
    """Keeps the pairs whose full sets are similar enough."""
    def work(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b")):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                same = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * same >= percent * (len(one) + len(two) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)],
                                             names=["a", "b"])

    return work


_SIDES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _crossed(percent: int):
    """Of one pair of blocks: pairs of different components that may be similar enough.

    First the signatures must agree often enough; then an upper bound of the similarity, from the low
    16 bits of all shingles, must reach the wanted one, which leaves hardly a pair that the full sets
    do not confirm. A pair is taken up only in the first band whose whole key, as the buckets have it,
    both have: signatures hold a byte of each minimum, and bytes may agree where minima do not.
    """
    least = _agreement(percent)

    def side(table, name):
        columns = {c: table.column(name + c) for c in ("node", "component", "signature", "low")}
        low = [np.frombuffer(x.as_buffer(), np.uint16) for x in columns["low"]]
        bands = np.concatenate([x.flatten().to_numpy() for x in table.column(name + "bands").chunks])
        return (columns["node"].to_numpy(), columns["component"].to_numpy(), low, np.array([len(x) for x in low]),
                np.frombuffer(b"".join(columns["signature"].to_pylist()), np.uint8).reshape(len(low), -1),
                bands.reshape(len(low), -1))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out, marks = [np.zeros((2, 0), np.int64)], np.zeros(65536, bool)
        if left.num_rows and right.num_rows:
            band = left.column("band")[0].as_py()
            nodes_l, comps_l, low_l, size_l, sigs_l, bands_l = side(left, "")
            nodes_r, comps_r, low_r, size_r, sigs_r, bands_r = side(right, "r_")
            for node, comp, low, size, sig, keys in zip(nodes_l, comps_l, low_l, size_l, sigs_l, bands_l):
                fit = 100 * np.minimum(size, size_r) >= percent * np.maximum(size, size_r)
                rows = np.flatnonzero((comps_r != comp) & fit)
                near = rows[(sigs_r[rows] == sig).sum(1) >= least]
                near = near[keys[(bands_r[near] == keys).argmax(1)] == band]
                if not len(near):
                    continue
                marks[low] = True
                edges = np.cumsum(size_r[near]) - size_r[near]
                shared = np.add.reduceat(marks[np.concatenate([low_r[r] for r in near])], edges, dtype=np.int64)
                marks[low] = False
                shared = np.minimum(shared, np.minimum(size, size_r[near]))
                near = near[100 * shared >= percent * (size + size_r[near] - shared)]
                out.append(np.stack([np.minimum(node, nodes_r[near]), np.maximum(node, nodes_r[near])]))
        pairs = np.unique(np.hstack(out), axis=1)
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_SIDES)

    return work


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of all nodes with an edge, by alternating stars.

    A large star hangs every larger neighbour of a node under its smallest neighbour, a small star
    every smaller one; the edges settle into stars around the smallest nodes. Minima are aggregates,
    each step is stored in the shared folder, and joins on a busy centre are split by adaptive
    execution.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a != b").distinct())
    mark = edges.agg(F.count("*")).first()
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stored(large.where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(low.select("a", F.col("low").alias("b"))))
        edges = stored(small.where("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 2 ** 31), F.countDistinct("a")).first()
        if now == mark and now[0] == now[2]:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def _sized(narrow: DataFrame) -> DataFrame:
    """A stored narrow table, broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def _renamed(heads: DataFrame) -> DataFrame:
    return heads.select(*[F.col(c).alias(f"h_{c}") for c in heads.columns])


def _same_row() -> Column:
    """Where a row has the id and the text of the one that stands for a node; rows that repeat wholly all do."""
    return F.expr("doc_id <=> h_doc_id and ka = h_ka and kb = h_kb")


class _Search:
    """The tables of one search: nodes, members of shared buckets, and full sets of those."""

    def __init__(self, docs: DataFrame, percent: int, unnamed: bool = False):
        """Texts of equal words are one node, whatever ids they have; with ``unnamed`` also those without an id."""
        self.percent = percent
        self.docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        self.mapped = stored(self.docs.mapInArrow(
            _signed(percent), "doc_id long, ka long, kb long, n_shingles long, sequence binary, signature binary, "
                              "bands array<long>"))
        some = self.mapped.where("n_shingles > 0" if unnamed else "doc_id is not null and n_shingles > 0")
        # the row of the smallest id stands for its node; an id with two texts is in two nodes
        row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *_TEXT_KEY)
        self.classes = stored(some.groupBy("sequence").agg(F.min(row).alias("head"))
                              .select("sequence", "head.doc_id", *[f"head.{k}" for k in _TEXT_KEY],
                                      F.monotonically_increasing_id().alias("node")))
        heads = self.classes.select("node", "doc_id", *_TEXT_KEY, "sequence")
        self.nodes = stored(some.drop("n_shingles").join(_renamed(heads), _same_row() & F.expr("sequence = h_sequence"))
                            .select(F.col("h_node").alias("node"), "signature", "bands").dropDuplicates(["node"]))
        keys = self.nodes.select("node", F.explode("bands").alias("band"))
        buckets = stored(keys.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n"))
                         .where("n > 1").select("band", "pivot"))
        self.members = stored(keys.join(_sized(buckets), "band"))
        inside = stored(heads.join(_sized(stored(self.members.select("node").distinct())), "node", "left_semi"))
        texts = self.docs.join(_sized(_renamed(inside)), _same_row()).select(F.col("h_node").alias("node"), "text")
        self.sets = stored(texts.mapInArrow(_with_sets, "node long, shingles binary, low binary")
                           .dropDuplicates(["node"]))
        self.signatures = stored(self.nodes.select("node", "signature", "bands")
                                 .join(self.sets.select("node", "low"), "node"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the full sets link."""
        def beside(df, table, column, name):
            for end in ("a", "b"):
                df = df.join(table.select(F.col("node").alias(end), F.col(column).alias(f"{name}_{end}")), end)
            return df

        return stored(beside(pairs, self.sets, "shingles", "set").select("a", "b", "set_a", "set_b")
                      .mapInArrow(_confirmed(self.percent), "a long, b long"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose signatures agree often enough."""
        for end in ("a", "b"):
            pairs = pairs.join(self.signatures.select(F.col("node").alias(end),
                                                      F.col("signature").alias(f"sig_{end}")), end)
        return stored(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(self.percent), "a long, b long"))

    def with_components(self, found: DataFrame) -> DataFrame:
        """Members with the component they belong to so far."""
        return self.members.select("band", "node").join(found, "node", "left").select(
            "band", "node", F.coalesce("component", "node").alias("component"))

    def open_members(self, found: DataFrame) -> DataFrame:
        """Members of buckets of several components, and which of those is the largest."""
        placed = stored(self.with_components(found))
        counts = placed.groupBy("band", "component").agg(F.count("*").alias("n"))
        mixed = (counts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"),
                                            F.sum("n").alias("n"), F.count("*").alias("parts"))
                 .where("parts > 1").select("band", F.col("top.component").alias("largest"),
                                            "n", (F.col("n") - F.col("top.n")).alias("outside")))
        return stored(placed.join(_sized(stored(mixed)), "band"))

    def cross_pairs(self, members: DataFrame) -> DataFrame:
        """Candidate pairs across components: blocks of the outside against blocks of all."""
        signed = members.join(self.signatures, "node")  # with all bands, to tell the first that a pair shares
        here = F.pmod(F.xxhash64("node"), F.lit(2 ** 31))
        n_left, n_right = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("outside", "n"))
        columns = ("node", "component", "signature", "low", "bands")
        left = (signed.where("component != largest")
                .select("band", *columns, F.pmod(here, n_left).cast("int").alias("i"),
                        F.explode(F.sequence(F.lit(0), n_right - 1)).alias("j")))
        right = signed.select("band", *columns, F.explode(F.sequence(F.lit(0), n_left - 1)).alias("i"),
                              F.pmod(here, n_right).cast("int").alias("j"))
        key = ("band", "i", "j")
        right = right.toDF(*(f"r_{c}" for c in right.columns))
        return stored(left.groupBy(*key).cogroup(right.groupBy(*(f"r_{c}" for c in key)))
                      .applyInArrow(_crossed(self.percent), "a long, b long").distinct())


def _found(search: _Search) -> DataFrame:
    """node and component (its smallest node) of every node that has a link."""
    pairs = (search.members.where("node != pivot")
             .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    links = search.confirmed(search.likely(pairs))
    found = stored(components(links))
    more = search.confirmed(search.cross_pairs(search.open_members(found)))
    return found if more.isEmpty() else stored(components(links.unionByName(more)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Linked are texts with 100 * |intersection| >= percent * |union| of their shingle sets. Rows with
    NULL, empty or blank text have no shingles and are linked with nothing: each is its own
    component. A row with a NULL doc_id takes no part; its component is NULL and it is kept. Rows
    that repeat a doc_id are documents of their own: with equal texts they fall together, with different
    texts each belongs where its text does. Only doc_id and text are read, so further columns cannot clash.
    """
    search = _Search(docs, percent)
    linked = stored(search.classes.join(_found(search), "node").select("sequence", "doc_id", "component"))
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    together = linked.join(lowest, "component").select("sequence", "component_id")
    labelled = stored(search.classes.select("sequence", "doc_id").join(together, "sequence", "left")
                      .select("sequence", F.coalesce("component_id", "doc_id").alias("component_id")))
    some = search.mapped.select("doc_id", "n_shingles", "sequence")
    alone = some.where("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = (some.where("doc_id is not null and n_shingles > 0").join(_sized(labelled), "sequence")
              .select("doc_id", "n_shingles", "component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of every component of near-duplicates, and all rows without a word.

    The row of the smallest doc_id stays, a NULL one after all others; among rows that repeat its id and text,
    one of the smallest hash of all columns. So copies go whatever ids they have, and a text that resembles no
    other stays, also if its id has another text too. Reruns keep the same rows.
    """
    search = _Search(docs, percent, unnamed=True)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", *_TEXT_KEY, "sequence")
    found = _found(search)
    linked = stored(search.classes.join(found, "node"))
    first = linked.groupBy("component").agg(F.min(rank).alias("first"))
    beaten = linked.join(first, "component").where(rank != F.col("first")).select("sequence")
    rows = search.mapped.where("n_shingles > 0").select("sequence", "doc_id", *_TEXT_KEY)
    # of a node that stays, rows other than the one that stands for it go; of the others, all
    held = search.classes.select("sequence", "doc_id", *_TEXT_KEY).join(beaten, "sequence", "left_anti")
    counted = stored(rows.groupBy("sequence", "doc_id", *_TEXT_KEY).agg(F.count("*").alias("n")))
    heads = _renamed(held)
    stays = _same_row() & F.expr("sequence = h_sequence")
    gone = stored(counted.join(heads, stays, "left_anti").select("doc_id", *_TEXT_KEY))
    copied = stored(counted.where("n > 1").join(heads, stays, "left_semi").select("doc_id", *_TEXT_KEY))
    mark = "__k"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    named = [f"{mark}{i}" for i in range(3)]  # names that no column of the input has
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_row_key(), named)])

    def met(table: DataFrame):
        return _sized(table.toDF(*[f"{n}_" for n in named])), F.expr(" and ".join(f"`{n}` <=> `{n}_`" for n in named))

    left = keyed.join(*met(gone), "left_anti")
    if copied.isEmpty():
        return left.select(*docs.columns)
    once = left.join(*met(copied), "left_anti").select(*docs.columns)
    order = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns])
    one = (left.join(*met(copied), "left_semi").groupBy(*named)
           .agg(F.min_by(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]), order).alias(mark))
           .select(*[F.col(f"`{mark}`.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
    return once.unionByName(one)


def _row_key() -> list[Column]:
    """doc_id and text hashes of a row."""
    return [F.col("doc_id").cast("long"), *[F.xxhash64(F.lit(seed), "text") for seed in (1, 2)]]
