"""One registered query per operator, over whole tables, with oracle SQL where SQL can express it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import (best_fit, centroids, extract, langid, lexical, minhash, mixing, packing, quality, topk,
                           toxicity, urlfilter, warc)
from tallymark.llm.common import fold_of, on_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _registered(function):
    @functools.wraps(function)
    def query(spark, sf_dir):
        on_path(spark)
        return function(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[function.__name__] = query
    return query


@_registered
def op1_warc(table) -> DataFrame:
    """Archive every page, then read the archives back."""
    return warc.read_warc(warc.write_warc(table("pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op1_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
                 max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')
               AS payload_digest,
           CASE WHEN page_id IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = keeper THEN NULL WHEN page_id IS NOT NULL THEN keeper END AS refers_to
    FROM d"""


@_registered
def op2_extract(table) -> DataFrame:
    """Main text of every page."""
    return extract.extract(table("pages").select("page_id", "url", "html")).select(
        "page_id", "url", "extracted.text", "extracted.n_chars")


@_registered
def op3_toxicity(table) -> DataFrame:
    """Toxicity of every document; labels of the fold held out are not learnt from."""
    docs = table("documents")
    model = toxicity.fit_model(docs, table("labels"))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "scored.score", "scored.predicted", "scored.threshold")


@_registered
def op4_minhash(table) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash.near_duplicates(table("documents"))


SQL["op4_minhash"] = """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(l) - 4, 1) + 1),
                                                        lambda i: array_to_string(l[i:i + 4], ' '))) AS g
          FROM w WHERE len(l) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
          FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
          WHERE 100 * same >= 85 * (x.n + y.n - same)),
    e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents
                         UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON e2.a = r.other)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n.n"""


@_registered
def op5_langid(table) -> DataFrame:
    """Language of every document; the fold held out is not learnt from."""
    docs = table("documents")
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return langid.identified(docs.select("doc_id", "text"), langid.fit_model(docs)).select(
        "doc_id", held.alias("held_out"), "identified.lang_pred", "identified.score")


@_registered
def op6_urls(table) -> DataFrame:
    """Verdict on every URL."""
    return urlfilter.judge_urls(table("pages").select("page_id", "url")).select(
        "page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def _url_sql() -> str:
    hit = "{} * CAST(regexp_matches(u, '(^|[^\\pL\\pN]){}([^\\pL\\pN]|$)') AS INT)"
    weight = " + ".join(hit.format(weight, term) for term, weight in urlfilter.WEIGHTS)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH p AS (SELECT page_id, coalesce({lower.format('url_decode(url)')}, '') AS u,
                      coalesce({lower.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
                      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    m AS (SELECT *, CASE WHEN {weight} >= {urlfilter.LIMIT} THEN 'block' ELSE 'allow' END AS own FROM p),
    k(h, pre, v) AS (VALUES {rules})
    SELECT page_id, host, path, rule, coalesce(v, own) AS verdict FROM (
        SELECT m.*, h || pre AS rule, v,
               row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC NULLS LAST) AS r
        FROM m LEFT JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) WHERE r = 1"""


SQL["op6_urls"] = _url_sql()


@_registered
def op7_topk(table) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    vectors = table("embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL["op7_topk"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
               WHERE embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""


@_registered
def op8_quality(table) -> DataFrame:
    """Text statistics and quality verdict of every document."""
    docs = table("documents")
    model = quality.fit_model(docs, table("labels"))
    return quality.rated(docs.select("doc_id", "text"), model).select(
        "doc_id", *(f"rated.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                           "base_failed", "kept", "probability")))


@_registered
def op9_mixing(table) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(table("documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL["op9_mixing"] = """
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                      CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13)
                           AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
    s AS (SELECT source, sum(size) AS n, 3 * sum(size) AS cap,
                 ([1, 2, 3])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
    t AS (SELECT *, sum(n) OVER () AS total, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w,
                 coalesce(sum(cap) OVER before, 0) AS closed FROM s
          WINDOW before AS (ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, cap < (total - closed)::DOUBLE / open_w * w AS capped FROM t),
    l AS (SELECT (max(total) - coalesce(sum(cap) FILTER (capped), 0))::DOUBLE / sum(w) FILTER (NOT capped) AS level FROM c),
    g AS (SELECT source, n, least(cap::DOUBLE, level * w) AS target FROM c, l),
    r AS (SELECT d.*, g.n, g.target, CASE WHEN g.n > 0 THEN g.target / g.n ELSE 0 END AS rate
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
           CAST(size * (floor(rate) + CAST(u < rate - floor(rate) AS INT)) AS BIGINT) AS taken FROM r"""


@_registered
def op10_packing(table) -> DataFrame:
    """The place of every piece of every document."""
    return packing.packed(table("documents"))


@_registered
def op11_bestfit(table) -> DataFrame:
    """The place of every piece of every document, in few sequences."""
    return best_fit.packed(table("documents"))


@_registered
def op12_centroids(table) -> DataFrame:
    """Cluster of every vector of 64 components."""
    return centroids.clustered(table("embeddings"))


def _cluster_sql(clusters: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    def assigned(number: int) -> str:
        return f"""a{number} AS MATERIALIZED (SELECT row, vec_id, e, cluster, distance FROM (
            SELECT v.row, v.vec_id, v.e, c.cluster, CAST(list_sum(list_transform(range(1, {dims} + 1),
                       lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS distance,
                   row_number() OVER (PARTITION BY v.row ORDER BY distance, c.cluster) AS place
            FROM v, c{number} c) WHERE place = 1)"""

    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding,
            lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INT) AS cluster, e FROM (
            SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v WHERE vec_id IS NOT NULL
            ORDER BY h, e LIMIT {clusters}))"""]
    for r in range(rounds):
        steps += [assigned(r), f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM (
                SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
                    SELECT cluster, unnest(e) AS x, unnest(range(1, {dims} + 1)) AS i FROM a{r}) GROUP BY cluster, i)
            GROUP BY cluster) m USING (cluster))"""]
    return f"""WITH {", ".join([*steps, assigned(rounds)])}
    SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.e, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


SQL["op12_centroids"] = _cluster_sql(centroids.CLUSTERS, centroids.ROUNDS, centroids.DIMS, centroids.SCALE, centroids.SEED)


@_registered
def op13_lexical(table) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    return lexical.ranked(table("documents"), table("benchmark"))


SQL["op13_lexical"] = """
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
    q AS (SELECT item, item_id, w, count(*) AS q FROM (SELECT item, item_id, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
              FROM (SELECT row_number() OVER () AS item, * FROM benchmark)) GROUP BY ALL),
    n AS (SELECT row, doc_id, len(l) AS n FROM d WHERE len(l) > 0),
    a AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
    t AS (SELECT row, w, count(*) AS tf FROM (SELECT row, unnest(l) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
    f AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
          FROM t, a GROUP BY w),
    m AS (SELECT row, doc_id, 75 + (25 * n * big_n) // big_l AS m FROM n, a),
    s AS (SELECT q.item, q.item_id, m.row, m.doc_id,
                 CAST(sum(q.q * f.weight * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m))) AS BIGINT) AS score
          FROM q JOIN f USING (w) JOIN t USING (w) JOIN m USING (row) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
