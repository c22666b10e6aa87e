"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers. Candidates lie in blocks as postings by dimension (the "terms");
a block of queries scatters its weights times the postings into a dense score array, dimension by
dimension, keeps the best k of each query by partition selection, and the winners of all blocks are
merged by a window. Every candidate block meets every query block exactly once, through an equi join
on the candidate block's group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries, and of queries whose scores are dense at once.
BLOCK, QUERY_BLOCK, DENSE = 8192, 1024, 128
GROUP_ROWS = 4096
_BLOCKS = "__group int, ids binary, starts binary, dims binary, vals binary"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x taken as double; NULL if one is NULL or not finite.

    A value that no 64-bit integer holds is an error, as it would be cut silently.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != float("inf")))
    too_large = F.raise_error(F.lit("a component is too large to be quantised to 64 bits")).cast("long")
    return F.when(finite, F.transform(vector, lambda x: F.when(
        F.abs(x.cast("double") * scale) < 2.0 ** 62, F.floor(x.cast("double") * scale)).otherwise(too_large)))


def _packed(rows: list[tuple[int, list[int]]], group: int) -> dict:
    """A block in id order, repeated rows once, as arrays of its non-zero components by row."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    lengths = np.array([len(v) for _, v in rows], np.int64)
    flat = np.fromiter((x for _, v in rows for x in v), np.int64, int(lengths.sum()))
    dims = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(rows)), lengths)
    some = flat != 0
    starts = np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(rows)))])
    return {"__group": group, "ids": np.array([i for i, _ in rows], np.int64).tobytes(),
            "starts": starts.astype(np.int64).tobytes(), "dims": dims[some].astype(np.int32).tobytes(),
            "vals": flat[some].tobytes()}


def _blocks(size: int, groups: int):
    def pack(batches):
        held, made, part = [], 0, TaskContext.get().partitionId()

        def out():
            return pa.RecordBatch.from_pylist(
                [_packed(held, (part * 7919 + made) % groups)],
                schema=pa.schema([("__group", pa.int32()), *((n, pa.binary()) for n in ("ids", "starts", "dims", "vals"))]))

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((i, v))
                if len(held) == size:
                    yield out()
                    held, made = [], made + 1
        if held:
            yield out()

    return pack


def _matrix(block: dict, side: str):
    return (np.frombuffer(block[f"{side}ids"], np.int64), np.frombuffer(block[f"{side}starts"], np.int64),
            np.frombuffer(block[f"{side}dims"], np.int32), np.frombuffer(block[f"{side}vals"], np.int64))


def _accumulate(k: int):
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def postings(starts, dims, vals):
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.argsort(dims, kind="stable")
        terms, first = np.unique(dims[order], return_index=True)
        cut = np.append(first, len(order))
        return {int(t): (row[order[cut[j]:cut[j + 1]]], vals[order[cut[j]:cut[j + 1]]])
                for j, t in enumerate(terms)}

    def best(block: dict):
        ids, starts, dims, vals = _matrix(block, "")
        qids, qstarts, qdims, qvals = _matrix(block, "q_")
        term_postings = postings(starts, dims, vals)
        limit = (int(np.abs(vals).max(initial=0)) * int(np.abs(qvals).max(initial=0))
                 * max(1, len(term_postings)))
        if limit >= 2 ** 63:
            raise ValueError("components are too large: an inner product could leave 64 bits")
        dense = np.int32 if limit < 2 ** 31 else np.int64
        term_postings = {t: (None if len(p) == len(ids) else p, v.astype(dense))
                         for t, (p, v) in term_postings.items()}
        found = []
        for lo in range(0, len(qids), DENSE):
            n = min(DENSE, len(qids) - lo)
            scores, product = np.zeros((n, len(ids)), dense), np.empty((n, len(ids)), dense)
            a, b = qstarts[lo], qstarts[lo + n]
            weights = postings(qstarts[lo:lo + n + 1] - a, qdims[a:b], qvals[a:b].astype(dense))
            for term, (rows, weight) in weights.items():
                if term not in term_postings:
                    continue
                where, value = term_postings[term]
                if where is None and len(rows) == n:
                    np.multiply(weight[:, None], value[None, :], out=product)
                    scores += product
                elif where is None:
                    scores[rows] += weight[:, None] * value[None, :]
                else:
                    scores[np.ix_(rows, where)] += weight[:, None] * value[None, :]
            found.append(_select(ids, qids[lo:lo + n], scores, k, limit))
        return [np.concatenate(x) for x in zip(*found)]

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                columns = best(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=kind)

    return work


def _select(ids, qids, scores, k, limit):
    """The best k per query, ties to the smaller id (the block is in id order), never its own id."""
    n = len(ids)
    if limit < 2 ** 62 // max(1, n):
        keys = scores.astype(np.int64) * n + (n - 1 - np.arange(n))
        keys[qids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
        top = np.argpartition(keys, max(0, n - k), axis=1)[:, max(0, n - k):]
    else:
        top = np.stack([np.lexsort((ids, -scores[q], ids == qids[q]))[:k] for q in range(len(qids))])
    query = np.repeat(qids, top.shape[1])
    vec, score = ids[top].ravel(), np.take_along_axis(scores, top, axis=1).ravel()
    other = vec != query
    return query[other], vec[other], score[other].astype(np.int64)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256,
                vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Vectors that are NULL or hold a NULL or non-finite component, and rows without an id, take no
    part. Candidates with the query's own id are left out; rows that repeat an id with the same
    vector count once, with another vector they are candidates of their own. Missing components of a
    shorter vector count as 0. Ties go to the smaller id. An empty table gives no rows. Finite components so
    large that a score could leave 64 bits are an error.
    """
    def integers(df):
        return (df.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"))
                .where("id is not null and v is not null"))

    groups = max(1, -(-vectors.count() // GROUP_ROWS))
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    candidates = integers(vectors).mapInArrow(_blocks(BLOCK, groups), _BLOCKS)
    asked = (integers(queries).repartition(parts, F.xxhash64("id")).mapInArrow(_blocks(QUERY_BLOCK, 1), _BLOCKS)
             .select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "starts", "dims", "vals")),
                     F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group")))
    winners = (candidates.join(asked.hint("shuffle_hash"), "__group")
               .mapInArrow(_accumulate(k), "query_id long, vec_id long, score long"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (winners.distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
