"""Ranked lexical search by pipelined term partitioning, exact and in integers.

The documents' posting lists are cut into shards of documents, and the query terms are dealt to a few
owners of about equal numbers of postings, the rarest terms to the first. Bundles of items pass the owners
one after another: at every stage a cogroup brings a bundle's sparse accumulators over one shard together
with the postings that the stage's owner has there, and adds their contributions. An accumulator that
cannot reach the shard's present k-th best any more, whatever the later owners may add, is left behind; all
others travel on, so nothing that could be among the best is lost. The last stage selects each item's best
of the shard, and the best of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import sized, slices, stored

TOP, STAGES, BUNDLE = 20, 4, 32
#: Documents and postings of a shard, at most (a single document may exceed the latter).
SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
#: Query terms, and bytes of them, up to which tasks know them all and write no other postings.
KNOWN_TERMS, KNOWN_BYTES = 200_000, 8_000_000
#: Rows of the table of query terms by bundle up to which it is broadcast; a row has BUNDLE items at most.
BROADCAST_USES = 50_000
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and all beyond ASCII, A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode().translate(_TABLE).split()


_SHARDS = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("held", pa.int64()), ("most", pa.int64()),
                     ("docs", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary())])
_SHARD_DDL = "shard long, term binary, held long, most long, docs binary, counts binary, lengths binary"


def _shard(number: int, ids: list, lengths: list[int], words: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
    """Posting lists of one shard, documents numbered in the order of their ids, and a row of the documents.

    The documents' row has no term; ``held`` is its number of documents with a term, ``most`` their length in all.
    """
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    n = np.array(lengths, np.int64)
    keys, counts = np.unique(np.concatenate([w.astype(np.int64) << 32 | p for w, p in zip(words, place)]),
                             return_counts=True)
    term, doc = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(keys) else np.zeros(0, np.int64)
    by_place = n[order].astype(np.int32)
    known = np.array([(0, 1) if ids[i] is None else (ids[i], 0) for i in order], np.int64)
    rows = [{"shard": number, "term": None, "held": int((n > 0).sum()), "most": int(n.sum()), "docs": known.tobytes()}]
    for lo, hi in zip(starts, [*starts[1:], len(keys)]):
        rows.append({"shard": number, "term": names[term[lo]], "held": int(hi - lo), "most": int(counts[lo:hi].max()),
                     "docs": doc[lo:hi].tobytes(), "counts": counts[lo:hi].astype(np.int32).tobytes(),
                     "lengths": by_place[doc[lo:hi]].tobytes()})
    return pa.RecordBatch.from_pylist(rows, _SHARDS)


def _inverted(wanted, most_docs: int):
    """Shards of the documents of a task; with a broadcast list of terms, postings of these only."""
    def work(batches):
        known = None if wanted is None else wanted.value
        names = [] if known is None else list(known)
        own, part, made = {}, TaskContext.get().partitionId(), 0
        ids, lengths, found, postings = [], [], [], 0
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for texts in slices(batch.column("text")):
                for i, text in enumerate(texts, at):
                    words = terms(text)
                    if known is None:
                        numbers = np.array([own.setdefault(w, len(own)) for w in words], np.int64)
                    else:
                        numbers = np.array([x for x in map(known.get, words) if x is not None], np.int64)
                    ids.append(keys[i].as_py())
                    lengths.append(len(words))
                    found.append(numbers)
                    postings += len(numbers)
                    if len(ids) == most_docs or postings >= SHARD_POSTINGS:
                        yield _shard(part << 32 | made, ids, lengths, found, names if known is not None else list(own))
                        made, own, ids, lengths, found, postings = made + 1, {}, [], [], [], 0
                at += len(texts)
        if ids:
            yield _shard(part << 32 | made, ids, lengths, found, names if known is not None else list(own))

    return work


def _query_terms(batches):
    for batch in batches:
        for item, text in zip(batch.column("item"), batch.column("text")):
            words, n = np.unique(np.array(terms(text.as_py()), object), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item.as_py()] * len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(n, pa.int64())],
                names=["item", "term", "q"])


_TRAVELS = "bundle int, shard long, item long, rest long, docs binary, scores binary"
_BUNDLE = pa.schema([("bundle", pa.int32()), ("shard", pa.int64()), ("item", pa.int64()), ("rest", pa.int64()),
                     ("docs", pa.binary()), ("scores", pa.binary())])
_BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _unit(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term of weight 1 adds to a document of n terms that holds it tf times."""
    tf = tf.astype(np.int64)
    m = 75 + 25 * n.astype(np.int64) * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _stage(k: int, documents: int, total: int, last: bool):
    """Adds one owner's postings of a shard to a bundle's accumulators there.

    All but the last stage return accumulators that may still be among the best k; the last returns these.
    """
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        added, rest, known, key = {}, {}, None, None
        for row in left.to_pylist():
            key = row["bundle"], row["shard"]
            rest[row["item"]] = row["rest"]
            added[row["item"]] = [(np.frombuffer(row["docs"], np.int32), np.frombuffer(row["scores"], np.int64), 1)]
        for batch in right.to_batches(max_chunksize=64):
            for row in batch.to_pylist():
                key = row["bundle"], row["shard"]
                if row["weight"] is None:
                    known = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)
                    continue
                docs = np.frombuffer(row["docs"], np.int32)
                unit = row["weight"] * _unit(np.frombuffer(row["counts"], np.int32),
                                             np.frombuffer(row["lengths"], np.int32), documents, total)
                for use in row["uses"]:
                    rest[use["item"]] = use["rest"]
                    added.setdefault(use["item"], []).append((docs, unit, use["q"]))
        out = []
        for item, parts in added.items():
            dense = np.zeros(1 + max(int(docs.max(initial=-1)) for docs, _, _ in parts), np.int64)
            for docs, scores, q in parts:
                dense[docs] += q * scores  # a document is at most once in a list
            some = np.flatnonzero(dense)
            scores = dense[some]
            if len(some) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                some = some[scores + (0 if last else rest[item]) >= least]
                scores = dense[some]
            if not last:
                out.append((*key, item, rest[item], some.astype(np.int32).tobytes(), scores.tobytes()))
                continue
            for at in np.lexsort((some, -scores))[:k]:  # numbers within the shard are in the order of ids
                doc, unnamed = known[some[at]].tolist()
                out.append((item, None if unnamed else doc, int(scores[at])))
        kind = _BEST if last else _BUNDLE
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(kind), kind)],
                                    schema=kind)

    return work


def _weighted(postings: DataFrame, asked: DataFrame, documents: int, total: int) -> DataFrame:
    """Query terms that occur: term, weight, df, and the most that weight 1 of it can add to a document."""
    seen = (postings.where("term is not null").groupBy("term")
            .agg(F.sum("held").alias("df"), F.max("most").alias("tf"))
            .join(asked.select("term").distinct(), "term"))
    ratio = F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")
    return seen.select("term", "df", F.floor(F.log(ratio) * 1000.0).cast("long").alias("weight"),
                       F.expr("1000000000 * tf div (1000 * tf + 12 * 75)").alias("most"))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, stages: int = STAGES,
           shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k best documents of every item.

    N counts the documents with a term, L all terms. NULL, empty and term-free texts are in no result and no
    statistic. Every row is a document of its own, also if it repeats an id or has none; a NULL id comes last
    among equal scores. Every row of ``items`` is an item of its own; one without terms that occur, or with
    a NULL text, has no results. Empty tables give no rows. Only ids and texts are read.
    """
    items = stored(items.select(F.col("item_id"), "text").withColumn("item", F.monotonically_increasing_id()))
    asked = stored(items.mapInArrow(_query_terms, "item long, term binary, q long"))
    vocabulary = asked.select("term").distinct()
    n_terms, n_bytes = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    wanted = None
    if n_terms <= KNOWN_TERMS and n_bytes <= KNOWN_BYTES:
        wanted = docs.sparkSession.sparkContext.broadcast({r["term"]: i for i, r in enumerate(
            {"term": bytes(r["term"])} for r in vocabulary.collect())})
    shards = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                    .mapInArrow(_inverted(wanted, shard_docs), _SHARD_DDL))
    documents, total = shards.where("term is null").agg(F.coalesce(F.sum("held"), F.lit(0)),
                                                        F.coalesce(F.sum("most"), F.lit(0))).first()
    weights = stored(_weighted(shards, asked, max(documents, 1), max(total, 1)).where("weight > 0"))
    shares = ", ".join(str(1 - (s + 1) / stages) for s in range(stages - 1))
    cuts = (weights.agg(F.expr(f"percentile(weight, array({shares}), df)")).first()[0] if stages > 1 else None) or []
    owner = sum(((F.col("weight") < F.lit(c)).cast("int") for c in cuts), F.lit(0))
    bundles = max(1, -(-items.count() // BUNDLE))
    uses = (asked.join(weights, "term")
            .select("item", "term", "q", "weight", owner.alias("owner"), (F.col("q") * F.col("weight") * F.col("most")).alias("bound")))
    later = Window.partitionBy("item").orderBy(F.desc("owner")).rowsBetween(Window.unboundedPreceding, -1)
    rests = (uses.groupBy("item", "owner").agg(F.sum("bound").alias("own"))
             .select("item", "owner", F.coalesce(F.sum("own").over(later), F.lit(0)).alias("rest")))
    uses = stored(uses.join(rests, ["item", "owner"])
                  .withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
                  .groupBy("bundle", "owner", "term", "weight")
                  .agg(F.collect_list(F.struct("item", "q", "rest")).alias("uses")))  # a bundle's items at most
    key, travelling = ("bundle", "shard"), None
    for s in range(stages):
        last = s == stages - 1
        columns = ("bundle", "shard", "weight", "uses", "docs", "counts", "lengths")
        owned = shards.join(sized(uses.where(F.col("owner") == s), BROADCAST_USES), "term").select(*columns)
        if last:
            named = (shards.where("term is null")
                     .withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
                     .withColumn("weight", F.lit(None).cast("long"))
                     .withColumn("uses", F.lit(None).cast(uses.schema["uses"].dataType)))
            owned = owned.unionByName(named.select(*columns))
        if travelling is None:
            travelling = docs.sparkSession.createDataFrame([], _TRAVELS)
        travelling = (travelling.groupBy(*key).cogroup(owned.groupBy(*key))
                      .applyInArrow(_stage(k, documents, total, last),
                                    "item long, doc_id long, score long" if last else _TRAVELS))
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = travelling.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
