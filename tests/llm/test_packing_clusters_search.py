"""Best-fit packing, centroid clustering and ranked lexical search against brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from compare_oracle import TABLES, rows_of

from tallymark.llm import best_fit, centroids, common, lexical, tokens
from tallymark.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, piece string, __row int, shard long, term string"
ODD = [(1, "One two, two", "en", "a", 1, 1, "x"), (2, "one TWO é字", "en", "a", 1, 1, "x"), (2, "one TWO é字", "en", "a", 1, 1, "x"),
       (3, None, None, None, None, None, None), (4, "", "en", "b", 0, None, "x"), (5, " \t\n.,!", "de", None, 3, 2, "y"),
       (6, LONG, "en", "a", 1, 1, "z"), (None, "one two, two", "en", "c", 1, 1, "x"), (7, "\0two\x7ftwo　 \U0001f600", "fr", "a", 1, 1, "x")]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd(request, spark):
    common.on_path(spark)
    return spark.createDataFrame(ODD if request.param == "odd" else [], DOCS)


# tokens

@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a \n\n b", "it's 's x's", "\n", "  ", "a　b c\x1c d", "é́. a", "x\ty z",
                                  "<|endoftext|> a<|endoftext|>", "\U0001f600 字字​﻿", "a" * 5000, " " * 5000 + "x",
                                  "\n" * 5000 + "x", "0123456789" * 500])
def test_ids_are_those_of_tokenizers(text):
    encoder = tokens.Encoder()
    assert encoder._core is not None
    assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_every_tenth_code_point():
    encoder = tokens.Encoder()
    points = [c for c in range(0, 0x30000, 10) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}1 {chr(c)}. \n{chr(c)} x{chr(c)}" for c in points]
    for text, said in zip(texts, encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        assert encoder.encode(text) == np.array(said.ids, "<u4").tobytes(), ascii(text)


def test_another_vocabulary_is_read_by_tokenizers():
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder._core is None
    said = encoder.tokenizer.encode("Some words", add_special_tokens=False).ids
    assert encoder.encode("Some words") == np.array(said, "<u4").tobytes()


# best-fit packing

def check_best_fit(rows, texts, end=0):
    tokenizer, want = tokens.Encoder().tokenizer, collections.Counter()
    for doc_id, text in texts:
        ids = (tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [end]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        for piece, (lo, hi) in enumerate(itertools.pairwise(cuts)):
            want[doc_id, piece, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        ends = np.cumsum([n for _, n in sorted(slots)])
        assert [o for o, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * math.ceil(total / 2048) + 2


def test_best_fit(spark, con, odd):
    check_best_fit(QUERIES["op11_bestfit"](spark, SF_DIR).collect(),
                   con.execute("SELECT doc_id, text FROM documents").fetchall())
    check_best_fit(best_fit.packed(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_best_fit_keeps_other_ids(spark):
    common.on_path(spark)
    rows = best_fit.packed(spark.createDataFrame([("x", "some text"), (None, None)], "doc_id string, text string")).collect()
    check_best_fit(rows, [("x", "some text"), (None, None)])


def fewest(pieces, size):
    """Packs of a best packing, by trying every pack for every piece."""
    pieces, best = sorted(pieces, reverse=True), len(pieces)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best and at <= len(pieces):
            return
        if at == len(pieces):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= pieces[at]:
                after = list(rooms)
                after.remove(room)
                place(at + 1, [*after, room - pieces[at]])
        place(at + 1, [*rooms, size - pieces[at]])

    best += 1
    place(0, [])
    return best


@pytest.mark.parametrize("low", [1, 3, 6])
def test_fixed_sets_are_part_of_a_best_packing(low):
    rng, fixed_any = np.random.default_rng(low), 0
    for _ in range(300):
        pieces = rng.integers(low, 21, rng.integers(1, 10)).tolist()
        fixed, rest = best_fit.reduced(collections.Counter(pieces), 20)
        left = [x for x, n in rest.items() for _ in range(n)]
        placed = [x for packs, lengths in fixed for x in lengths * packs]
        assert sorted(placed + left) == sorted(pieces) and all(sum(lengths) <= 20 for _, lengths in fixed)
        assert sum(packs for packs, _ in fixed) + fewest(left, 20) == fewest(pieces, 20)
        fixed_any += len(fixed)
    assert fixed_any > 100


def test_best_fit_equals_piece_by_piece():
    rng = np.random.default_rng(5)
    for _ in range(100):
        pieces = sorted(rng.integers(1, 2049, 200).tolist() + rng.integers(1, 60, 100).tolist(), reverse=True)
        rooms = []
        for piece in pieces:
            fitting = [r for r in rooms if r >= piece]
            room = min(fitting) if fitting else 2048
            if fitting:
                rooms.remove(room)
            rooms.append(room - piece)
        patterns = best_fit.best_fit(collections.Counter(pieces))
        assert sorted(2048 - sum(x) for n, x in patterns for _ in range(n)) == sorted(rooms)
        everything = best_fit.packing_patterns(collections.Counter(pieces))
        assert collections.Counter(x for n, lengths in everything for x in lengths * n) == collections.Counter(pieces)
        assert sum(n for n, _ in everything) <= len(rooms)


# clustering

def plain_clusters(rows, clusters, rounds, scale=256):
    vectors = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:clusters]
    centres = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds if centres else 0):
        members = collections.defaultdict(list)
        for _, v in vectors:
            members[near(v)[1]].append(v)
        centres = [tuple(sum(x) // len(members[n]) for x in zip(*members[n])) if members[n] else c
                   for n, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in vectors] if centres else []
    inertia = collections.Counter()
    for _, d, n in found:
        inertia[n] += d
    return collections.Counter(
        (i, n, d, inertia[n], sum(inertia.values()),
         hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found)


@pytest.mark.parametrize("width", [1, 3, 7])
def test_clusters_against_brute_force(spark, width):
    common.on_path(spark)
    rng = np.random.default_rng(width)
    good = [(i, [float(x) for x in rng.normal(0, 2, 7)]) for i in range(150)]
    good += [good[3], good[3], (None, good[4][1]), (5, good[6][1]), (1000, [-1e6] * 7), (1001, [0.0] * 7)]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 6), (2003, [1.0] * 8), (2004, [1.0] * 6 + [None]),
           (2005, [math.nan] * 7), (2006, [math.inf] * 7)]
    table = spark.createDataFrame([(i, v, 9, 9) for i, v in good + bad],
                                  "vec_id long, embedding array<double>, cluster int, distance long")
    got = centroids.clustered(table, clusters=12, rounds=4, dims=7, width=width, block=40).collect()
    assert collections.Counter(map(tuple, got)) == plain_clusters(good, 12, 4)


def test_clusters_of_few_vectors(spark):
    common.on_path(spark)
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(None, [1.0, 2.0])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 9.0])]):
        got = centroids.clustered(spark.createDataFrame(rows, kind), dims=2).collect()
        assert collections.Counter(map(tuple, got)) == plain_clusters(rows, 40, 5)
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [1e20, 0.0])], kind), dims=2).collect()


# lexical search

def plain_ranking(docs, items, k=20):
    def split(text):
        return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))

    held = [(i, collections.Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    documents, total, df = len(held), sum(n for *_, n in held), collections.Counter(w for _, c, _ in held for w in c)
    out = collections.Counter()
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 75 + 25 * n * documents // total
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1)))
                        * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m)) for w in split(text) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out.update((item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("known", [True, False])
def test_search_against_brute_force(spark, monkeypatch, known):
    common.on_path(spark)
    if not known:
        monkeypatch.setattr(lexical, "KNOWN_TERMS", 0)
        monkeypatch.setattr(lexical, "BROADCAST_USES", 0)
    monkeypatch.setattr(lexical, "BUNDLE", 7)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    share = np.arange(1, 61) ** -1.1
    docs = [(i % 180, " ".join(rng.choice(words, rng.integers(1, 40), p=share / share.sum()))) for i in range(200)]
    docs += [(i, t) for i, t, *_ in ODD] + docs[:30]
    items = [(i % 18, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(20)]
    items += [(30, None), (31, ""), (32, "unheard of"), (None, "w1 W2 w2 w2"), (33, "two Two é字"), (34, LONG)]
    got = lexical.ranked(spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, shard int").repartition(3),
                         spark.createDataFrame([(*r, 1, 1) for r in items], "item_id long, text string, doc_id int, item int"),
                         shard_docs=16)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == plain_ranking(docs, items)


def test_search_of_odd_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for stages in (1, 4):
        got = lexical.ranked(odd, items, stages=stages).collect()
        assert collections.Counter(map(tuple, got)) == plain_ranking(rows, [(1, "one two"), (2, None)])
    assert lexical.ranked(odd, items.limit(0)).count() == 0


def test_stage_leaves_behind_only_what_cannot_be_best():
    """An accumulator travels on exactly if it and all that later owners may add reach the k-th best."""
    import pyarrow as pa

    unit = {tf: int(lexical._unit(np.array([tf]), np.array([4]), 10, 40)[0]) for tf in (1, 2, 3)}
    row = {"bundle": 0, "shard": 5, "weight": 10, "docs": np.arange(3, dtype=np.int32).tobytes(),
           "counts": np.array([3, 2, 1], np.int32).tobytes(), "lengths": np.array([4, 4, 4], np.int32).tobytes()}
    for rest, kept in ((10 * (unit[3] - unit[2]), [0, 1]), (10 * (unit[3] - unit[1]), [0, 1, 2]), (0, [0])):
        right = pa.Table.from_pylist([row | {"uses": [{"item": 1, "q": 1, "rest": rest}]}])
        out = lexical._stage(1, 10, 40, False)(lexical._BUNDLE.empty_table(), right).to_pylist()
        assert [np.frombuffer(r["docs"], np.int32).tolist() for r in out] == [kept]


@pytest.mark.parametrize("name", ["op12_centroids", "op13_lexical"])
def test_oracle(spark, con, name):
    frame, cursor = QUERIES[name](spark, SF_DIR), con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, cursor.fetchall())
