"""The training-data operators against DuckDB, brute force, round trips and held-out labels."""

import collections
import io
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from compare_oracle import TABLES, rows_of
from pyspark.sql import types as T

import corpus_pipeline
from tallymark.llm import (common, extract, langid, minhash, mixing, packing, quality, topk, toxicity, urlfilter,
                           warc)
from tallymark.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, __row int, kept int"
LONG = " ".join(f"word{i}" for i in range(60_000))
TEXT = "one two three four five six seven eight nine ten eleven twelve"
ODD = [(1, TEXT, "en", "a", 1, "x", 1, 1), (2, TEXT, "en", "a", 1, "x", 1, 1), (2, TEXT, "en", "a", 1, "x", 1, 1),
       (3, None, None, None, None, None, None, None), (4, "", "en", "b", 0, None, 1, 1),
       (5, " \t\n ", "de", None, 3, "y", 1, 1), (6, LONG, "en", "a", 1, "z", 1, 1), (None, TEXT, "en", "c", 1, "x", 1, 1),
       (7, "éß 　 \U0001f600 <|endoftext|>", "fr", "a", 1, "x", 1, 1)]


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


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT * FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", SQL)
def test_oracle(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, cursor.fetchall())


def test_native_mixing_runs_no_python(spark):
    plan = QUERIES["op9_mixing"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# WARC

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to long")


def test_warc_round_trip(spark):
    common.on_path(spark)
    rows = [(1, "http://a/ b\n", "same", 9), (2, None, "same", 9), (3, "http://c", None, None), (4, "u", "", None),
            (None, "u", "same", None), (5, "u", "x" * 3_000_000, None), (2, None, "same", 9)]
    manifest = warc.write_warc(pages_of(spark, rows))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(manifest).collect()}
    assert got == {(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0),
                   (None, "response", None, 4), (5, "response", None, 3_000_000)}
    assert warc.read_warc(warc.write_warc(pages_of(spark, []))).count() == 0
    with pytest.raises(ValueError):
        warc.parsed(warc._record(1, "u", b"abc", None, "").replace(b"abc", b"abd"))


def test_warc_layout():
    data = b"word list " * 40
    record = warc._record(1, "u", b"payload", None, "2024")
    frame = zstandard.ZstdCompressor(dict_data=warc._dictionary(data)).compress(record)
    archive = struct.pack("<II", 0x184D2A5D, len(data)) + data + frame + frame
    assert list(warc.records_of(io.BytesIO(archive))) == [record, record]


def test_warc_threshold_leaves_small_payloads_alone(spark):
    marked = warc.marked_revisits(pages_of(spark, [(1, "", "ab", 0), (2, "", "ab", 0)]), min_bytes=3)
    assert [r.refers_to for r in marked.collect()] == [None, None]


# extraction

def test_extract_takes_the_article():
    page = ("<html><head><title>t</title></head><body><header>Top</header><nav><ul><li><a>m</a></ul></nav>"
            "<div class='cookie-notice'><p>We use cookies, really, we do.</div><article><header><h1>Head &amp; more</h1>"
            "by me</header><p>First, long   enough <b>text</b>\n here &lt;x&gt;.<p>Second<br>line.<ul><li>one<li>two</ul>"
            "<form><input><p>send</p></form><script>var p='</p>';</script></article>"
            "<div id=comments><p>Nice, very nice, so nice, too nice.</p></div><aside><p>more</p></aside><footer>f</footer>")
    assert extract.main_text(page) == ("Head & more\n\nFirst, long enough text here <x>.\n\nSecond line.\n\none\n\ntwo")
    for nothing in (None, "", "   ", "<p></p>", "<script>x"):
        assert extract.main_text(nothing) == ""
    assert extract.main_text("plain, text") == "plain, text"
    assert len(extract.main_text("<p>" + "a, " * 400_000)) == 3 * 400_000 - 1


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("paragraphs", [3, 30])
def test_extract_takes_all_parts_of_a_split_article(tag, paragraphs):
    long, short = "One, two, three, four " + "and so on " * 30, "A last, short, part, of it, all."
    page = (f"<body><nav><a>m</a></nav><{tag}>" + f"<p>{long}</p>" * paragraphs + f"</{tag}><{tag}><p>{short}</p></{tag}>"
            f"<{tag} class=sidebar><p>Not, wanted, here, at, all.</p></{tag}><{tag}><a>More, more, and, more</a></{tag}>"
            f"<{tag}>The end.</{tag}></body>")
    assert extract.main_text(page) == "\n\n".join([long.strip()] * paragraphs + [short, "The end."])


ARTICLE = ["First, a paragraph of the article, long enough, with commas.", "Second, one more, of the same, kind."]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in ARTICLE)


@pytest.mark.parametrize("name", ["has-sidebar", "content has-sidebar", "content-sidebar-wrap", "no-comments post",
                                  "header-fixed layout", "with-footer", "legal-news", "search-result-page",
                                  "ad-free content", "page search", "widget"])
def test_extract_keeps_an_article_in_a_wrapper_of_any_name(name):
    page = (f"<body><nav><a>m</a></nav><div class='{name}'>{PARAGRAPHS}</div><div class='site-footer'>Imprint, contact.</div>"
            "<div class='comments-area'><p>Nice.</p></div><div id=cookieNotice>We use cookies.</div></body>")
    assert extract.main_text(page) == "\n\n".join(ARTICLE)


def test_extract_reads_again_if_names_leave_nothing():
    assert extract.main_text(f"<body><div class=sidebar>{PARAGRAPHS}</div></body>") == "\n\n".join(ARTICLE)


def test_extract_leaves_comments_even_if_they_are_most_of_the_page():
    page = f"<body><div>{PARAGRAPHS}</div><div class=comments>" + "<p>So nice, so very nice, indeed, it is.</p>" * 50
    assert extract.main_text(page) == "\n\n".join(ARTICLE)


def test_extract_leaves_bylines_and_notices_beside_the_article():
    page = (f"<body><div>Posted by me</div><div>{PARAGRAPHS}</div><div>Copyright 2020 Someone</div>"
            "<div>Some Company. All rights reserved.</div><div>The end.</div></body>")
    assert extract.main_text(page) == "\n\n".join([*ARTICLE, "The end."])


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + PARAGRAPHS, "<div>x, y." * 100_000, "<div>" * 100 + "</p>" * 250_000, "<div>" * 100_000 + "</p>" * 100_000,
    "<u><div>" + "<i>" * 50_000 + "</u>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000 + "</b>" * 50_000,
    "<ul><li>" * 30_000 + "<li>" * 30_000, "<ul>" + "<li><a href=x>abc</a>" * 50_000, "<a" * 300_000, "<a '" * 100_000,
    "<" * 300_000, "<!--" * 100_000, "<div " + "class=a " * 100_000 + ">x", "<table>" * 5000 + "<tr><td>x" * 5000],
    ids=lambda page: page[:12])
def test_extract_takes_deep_and_broken_pages_in_time(page):
    """Quadratic work over any of these would take minutes."""
    import time

    started = time.process_time()
    extract.main_text(page)
    assert time.process_time() - started < 20
    assert extract.main_text("<div>" * 100_000 + PARAGRAPHS) == "\n\n".join(ARTICLE)


def test_extract_odd_tables(spark):
    common.on_path(spark)
    kind = "html string, extracted int, text string"
    rows = extract.extract(spark.createDataFrame([(None, 1, "t"), ("", 1, "t"), ("<p>a</p>", 1, "t"), ("<p>a</p>", 1, "t")], kind))
    assert sorted(r.extracted.text for r in rows.collect()) == ["", "", "a", "a"] and rows.columns == ["html", "extracted", "text"]
    other = extract.extract(rows.drop("extracted").withColumn("extracted", rows.html), into="main")
    assert other.columns == ["html", "text", "extracted", "main"] and other.count() == 4
    assert extract.extract(spark.createDataFrame([], kind)).count() == 0


def test_extract_whole_table(spark, con):
    for page_id, _, text, n in QUERIES["op2_extract"](spark, SF_DIR).collect():
        page = con.execute("SELECT html FROM pages WHERE page_id = ?", [page_id]).fetchone()[0]
        body = re.sub(r"<footer>.*", "", page.split("<article>")[1], flags=re.S).replace("<b>", "").replace("<br>", " ")
        import html
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|article)>", body)]
        assert text == "\n\n".join(p for p in parts if p) and n == len(text)


# classifiers

def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_toxicity_on_held_out_labels(spark, con):
    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = con.execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i].score, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    score, y = map(np.array, zip(*held))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all((r.score >= 0.5) == bool(r.predicted) for r in got.values()) and auc(score, y) > 0.9


def test_long_text_in_pieces_scores_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "calm"], 30)) + (" vile scum" if i % 2 else "") for i in range(60)]
    model = toxicity.fit(texts, np.arange(60) % 2 * 1.0, ["en"] * 60)
    want = [toxicity.Scorer(model).margin_and_tongue(t) for t in texts + [None, "", "123"]]
    monkeypatch.setattr(toxicity, "PIECE", 7)
    got = [toxicity.Scorer(model).margin_and_tongue(t) for t in texts + [None, "", "123"]]
    assert np.allclose([m for m, _ in want], [m for m, _ in got], atol=1e-4)
    assert auc(np.array([m for m, _ in want[:60]]), np.arange(60) % 2) == 1


def test_toxicity_thresholds_come_from_all_labels(spark, monkeypatch):
    """Long texts are no part of the fit; each threshold is settled by the histogram of all labelled texts."""
    common.on_path(spark)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 40)
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(300):
        y.append(i % 2)
        words = list(rng.choice(["good", "fine", "calm"], 30 if i % 3 else 3000)) + ["vile scum"] * y[-1]
        rows.append((i, " ".join(words), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    seen, settle = [], toxicity._settle
    monkeypatch.setattr(toxicity, "_settle", lambda *a: (seen.append((a[3].sum(), a[4].sum())), settle(*a)))
    model = toxicity.fit_model(docs, labels)
    learnt = [v for i, v in enumerate(y) if zlib.crc32(str(i).encode()) % 5]
    assert seen[-1] == (len(learnt) - sum(learnt), sum(learnt))
    scorer = toxicity.Scorer(model)
    margins = np.array([scorer.margin_and_tongue(t)[0] for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5])
    toxic = np.array(learnt) * 1.0
    assert abs(model.thresholds[0] - toxicity._threshold(margins, 1 - toxic, toxic)) < 2 * toxicity.STEP


def plain_margin(model, text):
    """The forward pass word by word and filter by filter."""
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    vectors = [model.embed[list(toxicity.features(w))].sum(0).astype(float) for w in found]
    value = model.out_bias
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -np.inf
            for start in range(max(1, len(vectors))):
                total = 0.0
                for k in range(width):
                    at = toxicity._OFFSETS.index((width, k))
                    if start + k < len(vectors):
                        total += float(vectors[start + k] @ model.filters[at][:, f])
                best = max(best, total)
            unit = i * toxicity.FILTERS + f
            value += max(best + float(model.filter_bias[unit]), 0) * float(model.out[unit])
    return value


def test_toxicity_forward_pass_against_plain_loops(con):
    rows = con.execute("SELECT d.text, l.toxic, d.lang FROM documents d JOIN labels l USING (doc_id) ORDER BY doc_id").fetchall()
    rows = [r for r in rows if r[0] and r[1] is not None]
    model = toxicity.fit([r[0] for r in rows], np.array([float(r[1]) for r in rows]), [r[2] for r in rows])
    scorer = toxicity.Scorer(model)
    for text in [r[0] for r in rows if len(r[0]) < 2500][:15] + [None, "", "one", "one two", "12 34"]:
        assert abs(scorer.margin_and_tongue(text)[0] - plain_margin(model, text)) < 1e-3


def test_toxicity_thresholds_without_languages(spark, monkeypatch):
    """Where no row names a language the threshold still comes from all labels, and an id labelled twice counts once."""
    common.on_path(spark)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 20)
    rows = [(i, " ".join(["calm", "fine", "good"] * (i % 5 + 1)) + " vile scum" * (i % 2), None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2, "doc_id long, toxic int")
    seen, settle = [], toxicity._settle
    monkeypatch.setattr(toxicity, "_settle", lambda *a: (seen.append(a[3].sum() + a[4].sum()), settle(*a)))
    toxicity.fit_model(docs, labels)
    assert seen[-1] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_model(odd, labels)
    rows = toxicity.scored(odd, model, "__s").select("__s.*").collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)


def test_langid(spark, con, odd):
    got = QUERIES["op5_langid"](spark, "/root/testdata/sf0.01").collect()
    lang = dict(con.execute("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.95
    rows = langid.identified(odd, langid.fit_model(odd)).select("text", "identified.*").collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)


def test_langid_learns_a_rare_language(spark):
    """Four texts in Greek letters among 8,000 others; both texts held out are found."""
    common.on_path(spark)
    rows = [(i, f"the {'abcdef'[i % 6]} word of text {i} and more of it", "en" if i % 2 else "xx") for i in range(8000)]
    rare = [(10_000 + i, "και η γλώσσα είναι άλλη από τις άλλες " * 3, "el") for i in range(12)]
    table = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string")
    got = langid.identified(table.where("doc_id >= 10000"), langid.fit_model(table), into="lang").collect()
    assert {r["lang"].lang_pred for r in got} == {"el"}


def plain_language(model, text):
    """The forward pass window by window and position by position, without batches."""
    probabilities, shares = [], []
    cuts, share = langid.windows(text.encode())
    for window, part in zip(cuts, share):
        pooled = []
        at = 0
        for width in langid.WIDTHS:
            best = np.full(langid.FILTERS, -np.inf)
            for start in range(langid._STEPS):
                total = sum(model.responses[window[start + k], (at + k) * langid.FILTERS:(at + k + 1) * langid.FILTERS].astype(float)
                            for k in range(width))
                best = np.maximum(best, total)
            pooled += best.tolist()
            at += width
        active = np.maximum(np.array(pooled) + model.bias, 0)
        scores = active @ model.weights.astype(float) + model.out_bias
        probabilities.append(np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum())
        shares.append(part)
    mean = np.average(probabilities, axis=0, weights=shares)
    return model.languages[int(mean.argmax())], float(mean.max())


def test_langid_forward_pass_against_plain_loops(docs):
    texts = [(d[1], d[2]) for d in docs if d[1] and d[2] and len(d[1]) < 3000][:120]
    model = langid.fit([t for t, _ in texts[:80]], [x for _, x in texts[:80]])
    tried = [t for t, _ in texts[80:95]] + ["a", "kurz", "é" * 700]
    got = list(zip(*langid.Scorer(model).many(tried)))
    for text, (lang, score) in zip(tried, got):
        want = plain_language(model, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_langid_windows_hold_every_gram():
    data = bytes(range(256)) * 5
    cut, share = langid.windows(data)
    grams = {bytes(w[i:i + 4]) for w in cut for i in range(langid.WINDOW - 3)}
    assert {data[i:i + 4] for i in range(len(data) - 3)} <= grams and len(langid.windows(b"")[0]) == 1


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(inside))


def test_quality_counts_and_verdicts(spark, docs, con, odd):
    got = {r.doc_id: r for r in QUERIES["op8_quality"](spark, SF_DIR).collect()}
    for doc_id, text, *_ in docs:
        r, want = got[doc_id], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.rated(odd, quality.fit_model(odd, labels), into="__r").select("text", "__r.*").collect()
    assert len(rows) == odd.count() and all(r.n_words == plain_counts(r.text)[0] for r in rows)


def plain_char_buckets(text):
    """Code point by code point: four of them, each turned by a byte more."""
    text, out = text.ljust(4), collections.Counter()
    for at in range(len(text) - 3):
        key = 0
        for k, c in enumerate(text[at:at + 4]):
            point = ord(c) if ord(c) < 128 else ord(c) * 0x85EBCA6B % 2 ** 32
            key ^= (point << 8 * k | point >> 32 - 8 * k) % 2 ** 32
        out[(key * 0x9E3779B1 % 2 ** 32) >> 16] += 1
    return out


@pytest.mark.parametrize("piece", [1 << 20, 8])
@pytest.mark.parametrize("text", ["a", "abc", "abcd", "plain text of ASCII only", "Größe, é́ und mehr", "字字字字字字字字字字",
                                  "\U0001f600 a \U0001f601", "é"])
def test_quality_grams_are_of_characters(monkeypatch, text, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    got = collections.Counter(int(x) for part in quality.char_buckets(text.encode()) for x in part)
    assert got == plain_char_buckets(text)


def test_quality_separates_held_out_labels(con):
    rows = con.execute("""SELECT d.text, l.quality FROM '/root/testdata/sf0.01/documents.parquet' d
                          JOIN '/root/testdata/sf0.01/labels.parquet' l USING (doc_id) ORDER BY doc_id""").fetchall()
    half = len(rows) // 2
    model = quality.fit([t for t, _ in rows[:half]], np.array([float(y) for _, y in rows[:half]]))
    p = np.array(quality._start((model, quality.THRESHOLD))([t for t, _ in rows[half:]])[6])
    assert auc(p, np.array([y for _, y in rows[half:]])) > 0.9


def test_quality_means_the_same_when_a_class_is_cut(spark, monkeypatch):
    """Two kinds of text, 95% and 30% of them good: the verdict does not move with the bound of the sample."""
    common.on_path(spark)
    kinds = ["calm words of a good page that reads well", "buy cheap stuff now click here to win"]
    weights = quality._descend(*quality._rows(kinds), np.array([1.0, 0.0]))
    weights = weights[0] / 20, weights[1]
    monkeypatch.setattr(quality, "_descend", lambda *_: weights)
    rows = [(i, kinds[i % 5 == 4], "en", int(i // 5 % 10 < 3) if i % 5 == 4 else int(i // 5 % 20 > 0)) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    found = []
    for bound in (1000, 150):
        monkeypatch.setattr(quality, "FIT_ROWS", bound)
        model = quality.fit_model(table.drop("quality"), table.select("doc_id", "quality"))
        found.append(quality._start((model, quality.THRESHOLD))(kinds)[6])
    assert np.allclose(*found, atol=0.1)


def test_calibration_does_not_run_away_over_wide_margins():
    margin, y = np.repeat([30.0, -30.0, 30.0, -30.0], [760, 140, 40, 60]), np.repeat([1.0, 0.0, 0.0, 1.0], [760, 140, 40, 60])
    slope, shift = quality._platt(margin, y, np.ones(1000))
    p = 1 / (1 + np.exp(-(slope * np.array([30, -30]) + shift)))
    assert np.allclose(p, [0.95, 0.3], atol=0.05)


# URLs and top-k

def test_url_rules_and_vocabulary():
    judge = urlfilter._judge((urlfilter.RULES, urlfilter.Vocabulary()))
    urls = [None, "", "no scheme", "http://X.Example.ORG/es/a?b", "http://org", "http://torg/es", "https://a.com/de/x#y",
            "http://b.net/casino", "http://b.net/casino-POKER/", "http://b.net/casinopoker", "http://xxx.net/",
            "http://a.org/xxx", "http://example.org/en/12", "http://b.net/casino/casino"]
    host, path, rule, verdict, *_ = judge(urls)
    assert list(rule) == [None, None, None, "example.org/es/", None, None, "com/de/", None, None, None, None, "org/",
                          "example.org/en/1", None]
    assert list(verdict) == ["allow", "allow", "allow", "block", "allow", "allow", "block", "allow", "block", "allow",
                             "block", "allow", "block", "allow"]
    assert (host[3], path[3], host[4], path[4]) == ("x.example.org", "/es/a", "org", "")


def test_url_weights_add_up_over_different_terms():
    judge = urlfilter._judge((urlfilter.RULES, urlfilter.Vocabulary()))
    urls = {"http://b.net/casino/gratis": "allow", "http://b.net/casino?gratis=bonus": "block", "http://b.net/bonus-gratis": "allow",
            "http://b.net/bonus-gratis-webcam": "block", "http://b.net/erotik/nackt": "block", "http://b.net/erotik/erotik": "allow",
            "http://b.net/%63asino/p%6Fker": "block", "http://b.net/a%2Fxxx%2F": "block", "http://b.net/%C3%A9xxx": "allow",
            "http://b.net/%": "allow", "http://b.net/" + "x" * 1_000_000 + "/porno": "block"}
    assert dict(zip(urls, judge(list(urls))[3])) == urls


def test_url_odd_tables(spark):
    common.on_path(spark)
    kind = "url string, judged int, path string"
    table = spark.createDataFrame([(None, 1, "p"), ("", 1, "p"), ("http://xxx.net/" + "a" * 100_000, 1, "p"), (None, 1, "p")], kind)
    rows = urlfilter.judge_urls(table).collect()
    assert sorted((r.judged.verdict, len(r.judged.path), r.path) for r in rows) == [("allow", 0, "p")] * 3 + [("block", 100_001, "p")]
    assert urlfilter.judge_urls(table, into="found").columns == ["url", "judged", "path", "found"]
    assert urlfilter.judge_urls(table.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [256, 2 ** 28])
def test_topk_against_brute_force(spark, scale):
    common.on_path(spark)
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(300)]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(50, vectors[50], 1), (7, vectors[7], 1), (1000, None, 1),
            (1001, [1.0, None], 1), (1002, [math.nan, 1.0], 1), (1003, [math.inf], 1), (None, vectors[0], 1), (1100, [1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score)
           for r in topk.exact_top_k(table, table.where("vec_id % 50 = 0"), scale=scale).collect()}
    whole = {**dict(enumerate(vectors)), 1100: [1.0]}
    for q in [*range(0, 300, 50), 1100]:
        scores = sorted((-sum(math.floor(scale * a) * math.floor(scale * b) for a, b in zip(whole[q], v)), i)
                        for i, v in whole.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in scores]
    assert len(got) == 35
    assert topk.exact_top_k(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e300, 1e12])
def test_topk_refuses_scores_beyond_64_bits(spark, size):
    common.on_path(spark)
    table = spark.createDataFrame([(0, [size, 1.0]), (1, [size, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(table, table).collect()


# near-duplicates

def brute_components(rows, percent=85):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        if words:
            sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets.get(i, ())), find(i)) for i in root}


def test_near_duplicates_of_a_drifting_group(spark, monkeypatch):
    """Copies that drift apart: links run along the chain, most pairs of the group are no links."""
    common.on_path(spark)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(2)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(120):
        words = list(words)
        words[rng.integers(150)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[5][1].upper()), (201, ""), (202, None), (203, "a b"), (204, "A  b"), (205, "a b c")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_pair_whose_bytes_agree_in_an_earlier_band():
    """Bands 0 to 2 agree in the low bytes of their minima only, band 3 wholly: the pair is taken up there."""
    sets = [np.arange(1, 101, dtype=np.uint64)] * 2
    one = minhash.minima(sets)[0]
    two = one.copy()
    two[:3 * minhash.BAND_ROWS:minhash.BAND_ROWS] += np.uint32(256)
    keys = [minhash.band_keys(x) for x in (one, two)]
    shared = np.flatnonzero(keys[0] == keys[1])
    assert shared[0] == 3 and len(shared) > 1
    low = sets[0].astype(np.uint16).tobytes()
    tables = [pa.table({"node": [i], "component": [i], "signature": [x.astype(np.uint8).tobytes()], "low": [low],
                        "bands": pa.array([k.tolist()], pa.list_(pa.int64()))}) for i, (x, k) in enumerate(zip((one, two), keys))]
    found = []
    for number in shared.tolist():
        left, right = (t.append_column("band", pa.array([int(keys[0][number])])).append_column("number", pa.array([number]))
                       for t in tables)
        right = right.rename_columns([f"r_{c}" for c in right.column_names])
        found.append(minhash._crossed(85)(left, right).num_rows)
    assert found == [1] + [0] * (len(found) - 1)


def test_near_duplicates_at_another_similarity(spark):
    """Pairs of just 0.5 share bands of 6 minima seldom: bands follow the similarity."""
    common.on_path(spark)
    rows = []
    for i in range(15):
        words = [f"w{i}x{k}" for k in range(64)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:44] + [f"v{i}x{k}" for k in range(20)]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    want = brute_components(rows, 50)
    assert len({c for _, c in want.values()}) == 15
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_odd_rows(spark, odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    left = minhash.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted({r.doc_id for r in left.collect() if r.doc_id}) == ([1, 3, 4, 5, 6, 7] if rows else [])


def test_deduplicated_keeps_one_row_of_each_group(spark):
    """Rows that repeat, copies without an id, ids with two texts; a rerun over other partitions keeps the same rows."""
    common.on_path(spark)
    base = [f"w{i}" for i in range(60)]
    text, near = " ".join(base), " ".join(base[:58] + ["x", "y"])  # 54 of 58 shingles: 0.93
    other, third = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(5, text, "a"), (5, text, "a"), (5, text, "b"), (9, text.upper(), "a"), (None, text, "a"), (7, near, "a"),
            (3, other, "a"), (3, text, "a"), (None, third, "a"), (None, third, "a"), (None, third.upper(), "z"),
            (8, "", "a"), (8, "", "a"), (None, None, "a"), (10, "a b", "a"), (11, "A  b", "a"), (12, "a b c", "a")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, __k0 string, sequence int, ka int")
    left = sorted(map(repr, minhash.deduplicated(table, 80).collect()))
    kept = {(r[0], r[1].lower() if r[1] else r[1]) for r in minhash.deduplicated(table, 80).collect()}
    assert kept == {(3, text), (3, other), (None, third), (8, ""), (None, None), (10, "a b"), (12, "a b c")}
    assert len(left) == len(kept) + 1  # of the rows without a word all stay
    assert left == sorted(map(repr, minhash.deduplicated(table.repartition(7), 80).collect()))
    by = collections.defaultdict(set)
    for r in minhash.near_duplicates(table).collect():
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[3] == {(3, True)} and by[5] == by[7] == by[9] == {(3, False)} and by[None] == {(None, True)}


# mixing and packing

def test_mix_targets_and_copies(spark, odd):
    rows = mixing.mix(odd.select("doc_id", "text", "source")).collect()
    assert len(rows) == odd.count()
    by = {r.source: r for r in rows}
    assert abs(sum(r.target for r in by.values()) - sum(r.source_size for r in by.values())) < 1e-6
    assert all(r.target <= 3 * r.source_size and r["copies"] <= 3 for r in rows)
    again = mixing.mixed(odd)
    assert again.columns == odd.columns and again.count() == sum(r["copies"] for r in rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mixed(odd).collect()))


def check_packed(rows, texts):
    encoder = packing.Encoder()
    whole = collections.Counter()
    for doc_id, text in texts:
        ids = (encoder.tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [1]
        for start in range(0, len(ids), 2048):
            piece = np.array(ids[start:start + 2048], "<u4")
            whole[doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == whole
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for slots in sequences.values():
        ends = np.cumsum([n for _, n in sorted(slots)])
        assert [o for o, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_packing(spark, docs, odd):
    check_packed(QUERIES["op10_packing"](spark, SF_DIR).collect(), [(d[0], d[1]) for d in docs])
    check_packed(packing.packed(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "a \n\n b", "it's 's x's", "\n", "  ", "a　b c\x1c d",
                                  "a\n\nb c\n\n d\n", "\nx y\n", ".\n.\n, a. b.. c?! d1. é. ", "x\ty z", "é́. a"])
def test_chunked_encoding_equals_whole(text):
    encoder = packing.Encoder()
    want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(text) == want == encoder.encode(text)


@pytest.mark.parametrize("text", ["a\tb\tc\n\n\nd", "a\tb\tc\n\n", "a\u3000b\u3000c  d", "a\tb\n\t\tc\td\n\n\n\n"])
def test_other_white_space_does_not_hide_line_ends(text):
    encoder = packing.Encoder()
    assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_patterns_place_every_length():
    rng = np.random.default_rng(4)
    for _ in range(100):
        histogram = {int(n): int(rng.integers(1, 90)) for n in rng.integers(1, 2049, 30)}
        patterns, placed = packing.packing_patterns(histogram), collections.Counter()
        for packs, lengths in patterns:
            assert packs > 0 and sum(lengths) <= 2048
            for n in lengths:
                placed[n] += packs
        assert placed == histogram


# the pipeline

def test_pipeline_stages(spark, docs):
    frame, kept = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, frame, SF_DIR))
        assert after.columns == frame.columns
        kept.append((name, frame.collect(), after.collect()))
        frame = after
    toxic, rated, unique, mixed = kept
    ids = {r.doc_id for r in rated[2]}
    assert all(plain_counts(r.text)[0] >= 50 for r in rated[2]) and len(ids) > 0.7 * len(rated[1])
    parts = brute_components([(r.doc_id, r.text) for r in unique[1]], 80)
    assert {r.doc_id for r in unique[2]} == {i for i, (_, c) in parts.items() if i == c}
    assert {r.doc_id for r in mixed[2]} <= {r.doc_id for r in mixed[1]}
    rows = corpus_pipeline.pack(spark, frame, SF_DIR).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in mixed[2]])
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(key, rows))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, stage):
    stage(spark, odd, SF_DIR).collect()
