"""LM scores, classifiers, page text and the pipeline against brute force and held-out labels."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import corpus, html_text, learning, lm, packing, quality, registry, toxicity, trie
from logwarden.llm.common import table, words

from .conftest import AWKWARD
from .test_similar import brute_groups

HELD = "crc32(cast(doc_id AS string)) % 7 = 2"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_scores(rows, prior):
    """Exact, without quantisation."""
    split = [(i, held(i), [*words(text or ""), b"\n"]) for i, text in rows]
    count, pairs, begins = Counter(), Counter(), 0
    for _, out, own in split:
        if not out:
            count.update(own)
            pairs.update(zip([None, *own[:-1]], own, strict=True))
            begins += 1
    total, distinct = sum(count.values()), len(count)
    result = []
    for i, out, own in split:
        word = [(count[w] + 1) / (total + distinct + 1) for w in own]
        score = sum(
            math.log10((pairs[v, w] + prior * p) / ((begins if v is None else count[v]) + prior))
            for v, w, p in zip([None, *own[:-1]], own, word, strict=True)
        )
        result.append((i, out, len(own), sum(count[w] > 0 for w in own), total, sum(map(math.log10, word)), score))
    return sorted(result, key=str)


def same_scores(got, expected, tolerance):
    got = sorted((tuple(r) for r in got), key=str)
    assert [(*r[:5],) for r in got] == [(*r[:5],) for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=tolerance)


def test_lm_query(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = registry.lm_scores(spark, sf_dir).collect()
    same_scores(got, brute_scores(rows, lm.PRIOR), 1e-3)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_in_many_shards(spark, texts, monkeypatch):
    """Small shards split frequent contexts; small chunks spread documents."""
    monkeypatch.setattr(lm, "SHARD_PAIRS", 300)
    monkeypatch.setattr(corpus, "CHUNK_BYTES", 500)
    rows = [(i, f"a b a b c{i % 7} the x the y") for i in range(200)] + AWKWARD
    same_scores(lm.score_corpus(spark, texts(rows), F.expr(HELD)).collect(), brute_scores(rows, lm.PRIOR), 1e-6)
    assert lm.score_corpus(spark, texts(rows).limit(0), F.expr(HELD)).count() == 0


def test_contexts_sum_to_one():
    """Over all known words and one unknown, a context's probabilities sum to 1."""
    total, distinct, prior = 10, 3, 5.0
    count = np.array([5, 3, 2])
    p = np.append((count + 1) / (total + distinct + 1), 1 / (total + distinct + 1))
    follows = np.array([2, 1, 0, 0])
    assert p.sum() == pytest.approx(1)
    assert ((follows + prior * p) / (follows.sum() + prior)).sum() == pytest.approx(1)


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, top in ((1, 1), (50, 40), (300, 10**6), (2000, 2**40), (64, 63)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        sequence = trie.EliasFano(*trie.EliasFano.pack(values))
        assert (sequence.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top + 5, 200).astype(np.uint64)])
        begin = rng.integers(0, n + 1, len(asked))
        end = np.minimum(begin + rng.integers(0, n + 1, len(asked)), n)
        place, same = sequence.successor(asked, begin, end)
        for x, a, b, got, equal in zip(asked, begin, end, place, same, strict=True):
            expected = a + int(np.searchsorted(values[a:b], x))
            assert got == expected
            assert equal == (expected < b and values[min(expected, n - 1)] == x)


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))})
    context, word = np.array(pairs).T
    present, starts = np.unique(context, return_index=True)
    log_p = -rng.uniform(0.1, 7, len(pairs))
    own = trie.Trie(present, np.append(starts, len(pairs)), word, log_p, -rng.uniform(0, 1, len(present)))
    a, b = np.meshgrid(np.arange(65), np.arange(65))
    found, got, _ = own.find(a.ravel(), b.ravel())
    known = dict(zip(pairs, log_p, strict=True))
    for x, y, f, p in zip(a.ravel(), b.ravel(), found, got, strict=True):
        assert f == ((x, y) in known)
        if f:
            assert p == pytest.approx(known[x, y], abs=1e-3)
    own.close()


def test_many_values_are_quantised_closely():
    values = -np.random.default_rng(6).exponential(2, 100_000)
    book, code = trie.quantised(values)
    assert len(book) <= trie.CODES
    assert np.abs(book[code] - values).max() <= np.ptp(values) / trie.CODES


def labelled(spark, sf_dir):
    """Tables of a size that a classifier can learn from, and labels for a fit and for a test."""
    sf = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs, labels.where("doc_id % 3 != 0"), {r.doc_id: r for r in labels.where("doc_id % 3 = 0").collect()}


def test_toxicity_on_held_out_labels(spark, sf_dir):
    docs, fit, test = labelled(spark, sf_dir)
    graded = [r for r in toxicity.grade_texts(docs, toxicity.fit_toxicity(docs, fit)).collect() if r.doc_id in test]
    toxic = [r.toxic for r in graded if test[r.doc_id].toxic]
    clean = [r.toxic for r in graded if not test[r.doc_id].toxic]
    assert np.mean(toxic) > 0.9
    assert np.mean(clean) < 0.01
    assert {r.grade for r in graded} == {0, 1, 2, 3}
    assert all(0 <= r.expected_severity <= 3 and r.p_severe <= r.p_toxic for r in graded)


def test_toxicity_cases(spark, texts):
    rows = [(i, f"fine words about thing{i % 5} here") for i in range(60)] + [(100 + i, f"you idiot idiot fool{i % 5}") for i in range(60)]
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = texts(rows + AWKWARD)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.grade_texts(docs, model).collect()}
    assert all(got[100 + i].toxic and not got[i].toxic for i in range(60) if i not in (1, 2, 3, 4, 5, 6, 7))
    assert toxicity.grade_texts(docs, model).count() == len(rows) + len(AWKWARD)
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns
    assert left.where("doc_id between 100 and 200").count() == 0
    unfitted = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.grade_texts(docs, unfitted).where("toxic").count() == 0
    assert toxicity.grade_texts(docs.limit(0), unfitted).count() == 0


def test_telling_features_are_found_where_the_rows_are(spark, texts):
    rows = [(i, f"fine words about thing{i % 5} here") for i in range(60)] + [(100 + i, f"you idiot idiot fool{i % 5}") for i in range(60)] + AWKWARD
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(60), *range(100, 160)]], "doc_id long, toxic int")
    found = []
    for parts in (1, 7):
        sample = learning.featured(learning.labelled_texts(texts(rows, parts), labels, "toxic"), toxicity.text_features, "f4")
        whole, toxic = learning.collected(sample, "f4")
        whole = [r.reshape(2, -1) for r in whole]
        errors = toxicity.log_odds(whole, toxic)[1]
        found.append(toxicity.telling_features(sample).tolist())
        assert found[-1] == np.flatnonzero(np.abs(errors) >= toxicity.LEAST_ERRORS).tolist()
        slim, again = learning.collected(toxicity._only(sample, np.array(found[-1])), "f4")
        same = [toxicity.fit_ordinal(r, toxicity.severity_grades(r, toxic)) for r in (whole, [r.reshape(2, -1) for r in slim])]
        assert again.tolist() == toxic.tolist() and all((a == b).all() for a, b in zip(*same, strict=True))
    assert found[0] == found[1] != []


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(7)
    rows, grades = [], []
    for _ in range(600):
        grade = int(rng.integers(0, 4))
        rows.append(np.array([[1, 2], [grade / 3, rng.uniform()]]))
        grades.append(grade)
    features, weights, cuts = toxicity.fit_ordinal(rows, np.array(grades))
    assert (np.diff(cuts) > 0).all()
    model = toxicity.OrdinalModel(features, weights, cuts)
    score = np.array([weights[features == 1].sum() * g / 3 for g in range(4)])
    assert (np.diff(model.above(score).sum(axis=1)) > 0.3).all()


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, fit, test = labelled(spark, sf_dir)
    judged = [r for r in quality.quality_scores(docs, fit, F.col("source"), F.col("lang")).collect() if r.doc_id in test]
    assert np.mean([r.keep for r in judged if test[r.doc_id].quality]) > 0.98
    assert np.mean([r.keep for r in judged if not test[r.doc_id].quality]) < 0.1


def test_sites_shrink(spark):
    """Three hosts with different means: a sparse path is pulled to its host, a sparse host to the corpus."""
    rows = [("good", "big", 0.9)] * 300 + [("good", "small", 0.1)] * 2 + [("bad", "big", 0.2)] * 300 + [("new", "one", 0.05)] + [("other", "x", 0.6)] * 200
    scored = spark.createDataFrame(rows, "site_host string, site_path string, site_p double")
    sites = quality.site_evidence(scored)
    got = {(r.site_host, r.site_path): r for r in quality.with_posteriors(scored, sites).collect()}
    mean = np.mean([p for _, _, p in rows])
    assert sites.mean == pytest.approx(mean)
    assert abs(got["good", "big"].site_path_mean - 0.9) < 0.02
    assert abs(got["bad", "big"].site_path_mean - 0.2) < 0.02
    assert 0.1 < got["good", "small"].site_path_mean < 0.9
    assert got["new", "one"].site_host_mean == pytest.approx(mean, abs=0.02)


def test_quality_cases(spark, texts):
    docs = texts(AWKWARD).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    args = labels, F.col("source"), F.col("lang")
    assert quality.quality_scores(docs, *args).count() == len(AWKWARD)
    assert quality.keep_good(docs, *args).columns == docs.columns
    assert quality.quality_scores(docs.limit(0), *args).count() == 0
    assert quality.keep_good(docs.limit(0), *args).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).coalesce(1)
    return {r.page_id: r.text for r in html_text.main_text(df).collect()}


def page(body, more=""):
    return (
        f"<html><head><title>T</title><style>p{{}}</style></head><body class='with-sidebar'><div><a href=/>Home</a></div><div>About us</div>"
        f"{more}<div>{body}</div><p class='cookie-notice'>We use cookies</p><div>All rights reserved</div></body></html>"
    )


def test_shared_lines_go(spark):
    got = extracted(spark, [
        (1, "http://a.com/x/1", page("<p>One text here &amp; more</p><p>second\n para</p>")),
        (2, "http://a.com/x/2", page("<p>Two text</p>")), (3, "http://a.com/x/3", page("<p>Two text</p>")),
        (4, "http://b.com/x/3", page("<p>Alone</p>")),
    ])
    assert got == {1: "One text here & more second para", 2: "Two text", 3: "Two text", 4: "Home About us Alone All rights reserved"}


def test_marked_parts_go(spark):
    got = extracted(spark, [
        (1, "http://d.com/1", "<main><h1>T</h1><p>a<b>b</b>\n c</p><section id=comments><p>bad</p></section></main><div class=ad>x</div>"),
        (2, "http://d.com/2", "<article><header><h1>T</h1></header><p>u<p>v <aside>zz</aside> w<form><p>f</form></article><article class='comment'>no</article>"),
        (3, "u", "<nav><ul><li>Menu</ul></nav><article><p><b>open<br><p>cut &am"),
        (4, None, "x &lt;b&gt; &copy;<script>var t='</p>';</script><!-- c --> y"),
        (5, None, None), (6, "http://e.com", ""), (7, "http://e.com", "<div hidden>h</div><div style='display: none'>i</div>z"),
    ])
    assert got == {1: "T ab c", 2: "T u v w", 3: "open cut &am", 4: "x <b> © y", 5: "", 6: "", 7: "z"}


def test_pages_table(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").collect()
    got = {r.page_id: r for r in registry.page_text(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for row in rows:
        own = got[row.page_id]
        assert own.url == row.url and own.n_chars == len(own.text)
        assert "track(" not in own.text and "©" not in own.text
        title = row.html.split("<h1>")[1].split("</h1>")[0]
        assert own.text.startswith(" ".join(unescape(title).split()))
    assert html_text.main_text(table(spark, sf_dir, "pages").limit(0)).count() == 0


def test_article_is_differenced(spark):
    """Frame inside ``article`` goes, a line that one neighbour quotes stays."""
    box = "<div>Share this</div><p>Licensed to all readers</p>"
    quoted = {1: "<p>A sentence that two quote</p>", 2: "<p>A sentence that two quote</p>"}
    got = extracted(spark, [
        (i, f"http://a.com/x/{i}", f"<article><h1>Title {i}</h1>{quoted.get(i, '')}<p>own words of number {i} {'abcde'[i] * 9}</p>{box}</article>")
        for i in range(5)
    ] + [(9, "http://b.com/1", f"<article><p>alone</p>{box}</article>"), (10, "http://b.com/2", f"<article><p>both of two</p>{box}</article>")])
    for i in range(5):
        said = "A sentence that two quote " if i in quoted else ""
        assert got[i] == f"Title {i} {said}own words of number {i} {'abcde'[i] * 9}"
    assert got[9] == "alone Share this Licensed to all readers" and "Share this" in got[10]


def test_frame_behind_copies_and_large_frames(spark):
    """A run of copies does not hide the frame, nor does a frame larger than the text, nor a long notice."""
    notice = "<div>" + " ".join(f"clause{i}" for i in range(60)) + "</div>"
    bodies = [f"<p>{c * 6}</p>" for c in "abcd"]
    got = extracted(spark, [(i, f"http://a.com/{i:03d}", page("<p>copied text</p>")) for i in range(40)] + [(99, "http://a.com/099", page("<p>other words</p>"))]
                    + [(100 + i, f"http://c.com/{i}", page(b, notice)) for i, b in enumerate(bodies)])
    assert {got[i] for i in range(40)} == {"copied text"} and got[99] == "other words"
    assert [got[100 + i] for i in range(4)] == [c * 6 for c in "abcd"]


def test_near_copies_tell_nothing(spark):
    prose = ["first paragraph with some words", "second paragraph goes on here", "third one ends the text of it"]
    text = lambda n: "".join(f"<p>{line}</p>" for line in prose) + f"<p>a last line that was edited in place {n} and then goes on</p>"
    got = extracted(spark, [(i, f"http://a.com/{i}", page(text(i))) for i in range(5)] + [(9, "http://a.com/9", page("<p>other words</p>"))])
    assert got[3] == " ".join(prose) + " a last line that was edited in place 3 and then goes on"


def test_common_lines():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html_text.common_lines(list(a), list(b))) == best[-1][-1]


def test_pipeline(spark, sf_dir):
    """Each stage against its own input: verdicts of the operators, brute-force groups, whole packing."""
    docs = table(spark, sf_dir, "documents").withColumn("score", F.lit(1)).withColumn("kept", F.lit("x"))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    labels = table(spark, sf_dir, "labels")

    good = stages["quality"](spark, docs, sf_dir)
    keep = {r.doc_id for r in quality.quality_scores(docs, labels, F.col("source"), F.col("lang")).collect() if r.keep}
    assert good.columns == columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(keep)

    clean = stages["toxicity"](spark, good, sf_dir)
    toxic = {r.doc_id for r in toxicity.grade_texts(good, toxicity.fit_toxicity(good, labels)).collect() if r.toxic}
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == keep - toxic

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    different = stages["near_duplicates"](spark, clean, sf_dir)
    assert different.columns == columns
    assert sorted(r.doc_id for r in different.collect()) == sorted({c for _, _, c in brute_groups(rows, 5, 80)})

    placed = stages["packing"](spark, different, sf_dir).collect()
    assert {r.doc_id for r in placed} == {r.doc_id for r in different.collect()}
    whole = sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert whole == sorted((r.doc_id, r.piece, r.length) for r in placed)
    assert max(Counter({r.sequence_id: r.offset + r.length for r in placed}).values()) <= 4096
    assert packing.best_patterns({}, 4096) == []


def test_chunks_are_numbered_without_gaps(spark, texts, monkeypatch):
    from logwarden.llm import corpus

    rows = [(i, f"w{i} " * 30) for i in range(60)]
    df = texts(rows, parts=13).withColumn("mark", F.lit(0).cast("long")).select("doc_id", "text", "mark")
    chunks = corpus.token_chunks(df, chunk_bytes=200).select("chunk", "doc_ids").collect()
    assert sorted(r["chunk"] for r in chunks) == list(range(len(chunks)))
    assert sorted(i for r in chunks for i in r["doc_ids"]) == list(range(60))


def test_scores_do_not_depend_on_how_high_chunk_numbers_are(spark, texts, monkeypatch):
    """Chunks as of partitions 0, 16,384, 70,000 and beyond, without closing the gaps: their words stay apart."""
    from logwarden.llm import corpus

    rows = [(i, f"only{i} shared words here {'x' * (i % 3)} again only{i}") for i in range(30)]
    close = corpus.token_chunks
    numbers = F.expr("element_at(array(0L, 16384L, 70000L, 536870911L), int(chunk) + 1)")
    monkeypatch.setattr(lm, "token_chunks", lambda docs: close(docs).withColumn("chunk", numbers))
    docs = texts(rows, parts=4)
    same_scores(lm.score_corpus(spark, docs, F.expr(HELD)).collect(), brute_scores(rows, lm.PRIOR), 1e-6)


def test_pairs_of_a_large_chunk_are_those_of_a_packed_one():
    draw = np.random.default_rng(0)
    context, word, doc = (draw.integers(0, 9, 500).astype(kind) for kind in (np.uint64, np.uint32, np.int64))
    packed, sorted_ = (lm._distinct(context, word, doc, how) for how in (True, False))
    for a, b in zip(packed, sorted_, strict=True):
        assert a.astype(np.int64).tolist() == b.astype(np.int64).tolist()


def test_toxic_passage_in_long_clean_texts(spark):
    """A toxic text among thousands of clean words is found; the clean words alone are not flagged."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 3 != 0"))
    held = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").orderBy("doc_id").collect()
    clean = [r["text"] for r in held if not r["toxic"] and r["text"]]
    short = [r["text"] for r in held if r["toxic"] and 60 <= len((r["text"] or "").split()) <= 400]
    score = model.scorer()
    flagged = lambda texts: model.above(np.array([score(t) for t in texts]))[:, 0] >= model.cut
    found = [t for t, f in zip(short, flagged(short), strict=True) if f][:60]
    assert len(found) >= 40
    assert flagged(clean).mean() < 0.01
    for n in (500, 2_000, 20_000):
        planted = []
        for i, text in enumerate(found):
            words, k = [], i
            while len(words) < 2 * n:
                words += clean[k % len(clean)].split()
                k += 1
            planted.append(" ".join([*words[:n], *text.split(), *words[n : 2 * n]]))
        assert flagged(planted).mean() >= 0.9


def article(html):
    page = html_text.Page(1, "u", "h", "/p", html_text.page_lines(html))
    return " ".join(line.text for line in html_text._own_lines(page, html_text._top(page)))


def test_class_names_drop_parts_of_the_site_but_no_prose():
    html = (
        '<article><h1>T</h1><p id="share-of-market">The share.</p><p class="reply">Reply prose.</p>'
        '<div class="notice">Cookies!</div><div class="share-links">Send</div><div id="comments"><p>First!</p></div><p>End</p></article>'
    )
    assert article(html) == "T The share. Reply prose. End"


def test_a_teaser_does_not_hide_the_story():
    html = '<div id="content"><h1>Story</h1><p>The long story of this page goes on here.</p></div><article class="teaser">More</article>'
    assert article(html) == "Story The long story of this page goes on here. More"


def test_unclosed_quotes_leave_no_markup_in_the_text():
    assert article('<p title="a > b">one <a title="open>two</a> three</p>') == "one two three"


@pytest.mark.parametrize(
    "part", ["<a ", '<a href="x>', "<div>", "<b></section>", "<p><b></i>", "<li><div></p>", "<!-- <", "<script>", "<x y='", "</", "<b><i></p>"]
)
def test_hostile_pages_take_linear_time(part):
    import time

    html = "<article>" + part * (1_000_000 // len(part)) + '"'
    start = time.process_time()
    html_text.page_lines(html)
    assert time.process_time() - start < 6


def site_pages(seed, n=700):
    """Pages of few hosts: exact copies in runs and strewn, near copies, alternating ones, frames, null urls, repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        host = ["big.com", "big.com", "big.com", "b.org", "c.net"][rng.integers(5)]
        kind = rng.integers(6)
        if kind == 0:
            body = "<p>the copied text of this host</p>"
        elif kind == 1:
            body = f"<p>{' '.join('near copies of one text that differ in one word only'.split())} {rng.integers(50)}</p>"
        else:
            body = "".join(f"<p>{' '.join(rng.choice(list('abcdefghij'), 6))}</p>" for _ in range(rng.integers(1, 4)))
        path = f"/{'z' if kind == 0 and i % 3 else 'abc'[rng.integers(3)]}/{rng.integers(400)}"
        rows.append((i if i % 50 else None, f"http://{host}{path}" if i % 41 else None, page(body, f"<div>{host} menu</div>")))
    return rows + [(n + i, f"http://alt.com/{i:03d}", page(f"<p>{'one two three' if i % 2 else 'four five six'}</p>")) for i in range(60)] + rows[:5]


def local_texts(rows):
    """The definition of ``Nearest`` by looking from every page outward, without ranges or state."""
    import re

    pages = []
    for page_id, url, html in rows:
        host, path = re.match(r"(?:[a-z]+://([^/?#]*))?([^?#]*)", url or "").groups()
        pages.append(html_text.Page(page_id, url, host or "", path, html_text.page_lines(html or ""), zlib.crc32((html or "").encode())))
    pages.sort(key=lambda p: (p.host, p.path, -(1 << 63) if p.page_id is None else p.page_id))
    out = Counter()
    for i, own in enumerate(pages):
        others = {}
        for side in (pages[:i][::-1], pages[i + 1 :]):
            seen, chosen = {own.digest}, []
            for p in side:
                if p.host != own.host or len(seen) > html_text.NEAR:
                    break
                if p.digest in seen:
                    continue
                seen.add(p.digest)
                if len(chosen) < html_text.REACH and not any(html_text.is_copy(p, q) for q in (own, *chosen)):
                    chosen.append(p)
            others |= {p.digest: p for p in chosen}
        near = sorted(others.values(), key=lambda p: -html_text._nearness(own, p))
        out[own.page_id, own.url, " ".join(line.text for line in html_text.kept_lines(own, near))] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_text_does_not_depend_on_how_pages_are_split(spark, monkeypatch, partitions):
    monkeypatch.setattr(html_text, "RANGE_PAGES", 1)
    rows = site_pages(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
        got = Counter((r.page_id, r.url, r.text) for r in html_text.main_text(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == local_texts(rows)


def test_pages_around_are_passed_through_ranges_of_copies():
    """A range takes the nearest distinct pages of its host, through ranges that hold copies of one page only."""
    key = lambda host, path, digest: Row(host=host, path=path, page_key=0, digest=digest)
    a, b, c, d, e = key("a", "/1", 1), key("a", "/2", 2), key("a", "/5", 2), key("a", "/7", 3), key("b", "/1", 4)
    ranges = [
        {"one_host": True, "heads": [a, b], "tails": [b, a]}, {"one_host": True, "heads": [c], "tails": [c]},
        {"one_host": False, "heads": [d], "tails": [e]}, {"one_host": True, "heads": [e], "tails": [e]},
    ]
    assert html_text._around(ranges) == {
        tuple(a): {1, 2}, tuple(b): {1}, tuple(c): {0, 2}, tuple(d): {0, 1}, tuple(e): {2, 3},
    }
