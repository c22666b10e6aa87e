"""Centroid clustering over dictionaries of subvectors, in exact integers.

Vectors are quantised once and kept as blocks of rows. Within a block every few neighbouring dimensions
are dictionary-encoded without loss: the distinct subvectors, and a code for each row. A round computes
the squared distance of every distinct subvector to its part of each centroid once, sums these partial
distances by code, and takes the nearest centroid; the sums of its members come from the counts of codes
the same way. A task returns at most one row per cluster, so what a round shuffles does not grow with the
vectors, and only the centroids reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import stored

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Rows of a block, and dimensions of a subvector.
BLOCK, WIDTH = 8192, 2
#: Components that 64-bit distances of vectors of these dimensions hold; larger ones are refused.
_LIMIT = 2 ** 62
_BLOCKS = "ids binary, codes binary, entries binary, sizes array<int>"
_SCHEMA = pa.schema([("ids", pa.binary()), ("codes", pa.binary()), ("entries", pa.binary()),
                     ("sizes", pa.list_(pa.int32()))])


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none NULL or not finite; never NULL itself."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def quantised(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; what could make a squared distance overflow is refused."""
    floor = np.floor(scale * rows)
    if floor.size and float(np.abs(floor).max()) ** 2 * 4 * floor.shape[1] >= _LIMIT:
        raise ValueError("a component is too large: the squared distance would not fit into 64 bits")
    return floor.astype(np.int64)


def _encoded(scale: int, dims: int, width: int, most: int):
    """Blocks of rows: ids (with a flag for NULL), codes by subvector, and the dictionaries one after another."""
    def block(ids: list, rows: list) -> dict:
        values = quantised(np.concatenate(rows).reshape(-1, dims), scale)
        codes, entries, sizes = [], [], []
        for lo in range(0, dims, width):
            own, code = np.unique(values[:, lo:lo + width], axis=0, return_inverse=True)
            codes.append(code.reshape(-1).astype(np.uint16))
            entries.append(own.ravel())
            sizes.append(len(own))
        keys = np.array([(0, 1) if i is None else (i, 0) for i in ids], np.int64)
        return {"ids": keys.tobytes(), "codes": np.concatenate(codes).tobytes(),
                "entries": np.concatenate(entries).tobytes(), "sizes": sizes}

    def work(batches):
        ids, rows = [], []
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            keys, at = batch.column(0).to_pylist(), 0
            while at < len(keys):
                take = min(most - len(ids), len(keys) - at)
                ids += keys[at:at + take]
                rows.append(flat[at:at + take])
                at += take
                if len(ids) == most:
                    yield pa.RecordBatch.from_pylist([block(ids, rows)], _SCHEMA)
                    ids, rows = [], []
        if ids:
            yield pa.RecordBatch.from_pylist([block(ids, rows)], _SCHEMA)

    return work


def _opened(row: dict, dims: int, width: int):
    """ids and flags, and per subvector its first dimension, distinct values and codes by row."""
    ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
    codes = np.frombuffer(row["codes"], np.uint16).reshape(-1, len(ids))
    entries, at, parts = np.frombuffer(row["entries"], np.int64), 0, []
    for i, (lo, size) in enumerate(zip(range(0, dims, width), row["sizes"])):
        wide = min(width, dims - lo)
        parts.append((lo, entries[at:at + size * wide].reshape(size, wide), codes[i]))
        at += size * wide
    return ids, parts


def _nearest(parts: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row (ties: the smaller number) and its squared distance."""
    most = max(int(np.abs(centroids).max()), *(int(np.abs(own).max()) for _, own, _ in parts))
    kind = np.int32 if 4 * most * most * centroids.shape[1] < 2 ** 31 else np.int64
    total = np.zeros((len(parts[0][2]), len(centroids)), kind)
    for lo, own, code in parts:
        partial = np.zeros((len(own), len(centroids)), kind)
        for d in range(own.shape[1]):
            gap = (own[:, d, None] - centroids[None, :, lo + d]).astype(kind)
            partial += gap * gap
        total += partial[code]
    near = total.argmin(1)
    return near, total[np.arange(len(near)), near].astype(np.int64)


def _summed(centroids: np.ndarray, width: int):
    """Per cluster with members in this task: their number and the sum of their components."""
    k, dims = centroids.shape

    def work(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                _, parts = _opened(row, dims, width)
                near, _ = _nearest(parts, centroids)
                n += np.bincount(near, minlength=k)
                for lo, own, code in parts:
                    counts = np.bincount(near * len(own) + code, minlength=k * len(own)).reshape(k, -1)
                    sums[:, lo:lo + own.shape[1]] += counts @ own
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    return work


def _assigned(centroids: np.ndarray, width: int):
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, parts = _opened(row, centroids.shape[1], width)
                near, distance = _nearest(parts, centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[:, 0], mask=ids[:, 1] == 1), pa.array(near.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"])

    return work


def _moved(blocks: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The next centroids: the floor of the mean of every cluster's members; empty clusters stay."""
    found = blocks.mapInArrow(_summed(centroids, width), "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(centroids.shape[1])]
    after = centroids.copy()
    for row in found.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # one row per cluster
        after[row["cluster"]] = [int(row[f"d{d}"]) // row["n"] for d in range(centroids.shape[1])]
    return after


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS,
              scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding",
              width: int = WIDTH,
              block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    Vectors that are NULL, hold a NULL or non-finite component or have another number of components take no
    part. Centroids start as the vectors with the smallest sha256 of ``seed:vec_id``, ties by components; a
    row with a NULL id is clustered but starts none. With fewer vectors than clusters there are as many
    clusters as vectors with an id; rows that repeat are vectors of their own, so their clusters may stay
    empty. A table without a usable vector that has an id gives no rows. A component so large that a
    squared distance would leave 64 bits is an error. Further columns are not read.
    """
    if not 0 < block <= 65536:
        raise ValueError("codes have 16 bits: a block holds 1 to 65536 rows")
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    named = named.where(usable(F.col("v"), dims))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = named.where("vec_id is not null").orderBy(order, "v").limit(clusters).collect()  # the clusters' number
    if not first:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = quantised(np.array([r["v"] for r in first], np.float64), scale)
    blocks = stored(named.mapInArrow(_encoded(scale, dims, width, block), _BLOCKS))
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, width)
    rows = stored(blocks.mapInArrow(_assigned(centroids, width), "vec_id long, cluster int, distance long"))
    spread = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    about = rows.sparkSession.createDataFrame(
        [(c, d, sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, d in spread.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(  # a row per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
