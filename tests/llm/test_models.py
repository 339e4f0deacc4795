"""The trained models against brute force and on held-out rows."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajecta.llm import hmm, html, language, quality, queries
from trajecta.llm.boost import Boosted
from trajecta.llm.common import bounded_sample, flat_bytes, held_out, padded_rows


@pytest.fixture
def tiny():
    rng = np.random.default_rng(0)
    m = hmm.HMM(np.full(10, 0.1), 3)
    m.start, m.move, m.emit = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 10, 3).T
    return m, [rng.integers(0, 10, n) for n in (1, 5, 30, 7, 8, 14, 50)]


def test_likelihood_of_pieces_is_exact(tiny, monkeypatch):
    m, seqs = tiny
    monkeypatch.setattr(hmm, "PIECE", 7)

    def plain(s):
        a = m.start * m.emit[s[0]]
        for x in s[1:]:
            a = (a @ m.move) * m.emit[x]
        return math.log10(a.sum())

    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    assert m.log10_likelihood(np.concatenate(seqs), offsets) == pytest.approx([plain(s) for s in seqs], abs=1e-10)


def test_scaling_after_few_symbols_changes_no_likelihood(monkeypatch):
    rng = np.random.default_rng(4)
    m = hmm.HMM(np.array([1 - 3e-30, 1e-30, 1e-30, 1e-30]), 3)
    lengths = [0, 1, 7, 8, 9, 16, 40, 3000]
    flat, offsets = rng.integers(1, 4, sum(lengths)).astype(np.int32), np.cumsum([0, *lengths])
    assert hmm.UNSCALED > 1
    got = m.log10_likelihood(flat, offsets)
    monkeypatch.setattr(hmm, "UNSCALED", 1)
    assert np.isfinite(got).all() and np.allclose(got, m.log10_likelihood(flat, offsets), rtol=1e-12, atol=0)
    for k, n in enumerate(lengths[:7]):
        own, log = m.start, 0.0
        for t, s in enumerate(flat[offsets[k] : offsets[k] + n]):
            own = (own if t == 0 else own @ m.move) * m.emit[s]
            log, own = log + np.log10(own.sum()), own / own.sum()
        assert abs(got[k] - log) <= 1e-10 * max(1, abs(log))



def test_expected_counts_equal_all_paths(tiny):
    m, seqs = tiny
    s, total = seqs[1], 0.0
    move, emit = np.zeros((3, 3)), np.zeros((10, 3))
    for path in itertools.product(range(3), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(path, path[1:], s[1:], strict=False))
        total += p
        for x, k in zip(s, path, strict=True):
            emit[x, k] += p
        for a, b in zip(path, path[1:], strict=False):
            move[a, b] += p
    got = m.expected(s, np.array([0, len(s)]))
    assert got["move"] == pytest.approx(move / total, abs=1e-5) and got["emit"] == pytest.approx(emit / total, abs=1e-5)


def test_expected_counts_across_pieces(tiny, monkeypatch):
    m, seqs = tiny
    flat, offsets = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    whole = m.expected(flat, offsets)
    for piece in (1, 4, 7):
        monkeypatch.setattr(hmm, "PIECE", piece)
        got = m.expected(flat, offsets)
        for k in whole:
            assert got[k] == pytest.approx(whole[k], abs=1e-4), (piece, k)
    assert whole["start"].sum() == pytest.approx(len(seqs), abs=1e-4) and whole["move"].sum() == pytest.approx(len(flat) - len(seqs), abs=1e-3)


def test_vocabulary_takes_just_as_many_words(spark):
    rows = spark.range(40_000).selectExpr("CAST(CAST(id + 100000 AS string) AS binary) AS word", "CAST(7 AS long) AS c")
    more = spark.createDataFrame([(bytearray(b"often"), 50), (bytearray(b"once"), 1)], "word binary, c long")
    model = hmm.vocabulary(rows.unionByName(more), 3)
    assert len(model.frequent) == hmm.FREQUENT and model.frequent[0] == b"often" and model.frequent[1:] == [str(100_000 + k).encode() for k in range(hmm.FREQUENT - 1)]
    assert model.class_words.sum() == 40_002 - hmm.FREQUENT and model.tokens == 40_000 * 7 + 51 + 3
    assert len(hmm.vocabulary(more, 1).frequent) == 2


def test_score_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model, counts = hmm.fit(docs.where(~held_out("doc_id", 7, 2)))
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    rows = {r["doc_id"]: r["score"] for r in hmm.score(docs, model, counts).collect()}
    place, h = {w: k for k, w in enumerate(model.frequent, 1)}, model.hmm
    for r in docs.collect():
        words = (r["text"] or "").encode().lower().split()
        # the plain forward recursion, one token at a time, in logarithms
        alpha, log = h.start, 0.0
        for t, w in enumerate([*words, None]):
            k = 0 if w is None else place.get(w, 1 + len(place) + hmm.class_of(w))
            alpha = (alpha if t == 0 else alpha @ h.move) * h.emit[k]
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w is not None and w not in place:
                own = hmm.class_of(w)
                log += math.log10((c.get(w, 0) + 1) / (model.class_tokens[own] + model.class_words[own] + 1))
        assert rows[r["doc_id"]] == pytest.approx(log, rel=1e-6)


def test_rounds_never_lose_likelihood(tiny):
    m, seqs = tiny
    flat, offsets = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    logs = []
    for _ in range(6):
        counts = m.expected(flat, offsets)
        logs.append(counts["log"][0])
        m.start, m.move, m.emit = counts["start"] / counts["start"].sum(), counts["move"] / counts["move"].sum(axis=1, keepdims=True), counts["emit"] / counts["emit"].sum(axis=0)
    assert all(b >= a - 1e-4 for a, b in zip(logs, logs[1:], strict=False))


def test_scores_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in hmm.held_out_scores(docs).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in docs.collect()}
    c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        assert rows[i]["n_known"] == sum(c[w] > 0 for w in t) and rows[i]["train_tokens"] == n
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)


def test_first_guess_reads_whole_texts(spark):
    texts = ["a b " * 6000 + "c d e " * 3000, "b a c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = lambda: hmm.Model([b"a", b"b", b"c", b"d", b"e"], np.array([6001, 6001, 3001, 3000, 3000]), np.zeros(hmm.CLASSES, np.int64), np.zeros(hmm.CLASSES, np.int64), 2)
    got, own = hmm.baum_welch(docs, start(), 0).hmm, start().hmm
    flat, offsets = hmm.encoded(texts, hmm.Symbols(start().frequent))
    for _ in range(hmm.GUESS_ROUNDS):
        own.update(own.expected(flat, offsets))
    assert np.allclose(got.move, own.move) and np.allclose(got.emit, own.emit) and np.allclose(got.start, own.start)


def test_shares_of_a_class_sum_to_one():
    model = hmm.Model([b"a"], np.array([5]), np.bincount([3, 3, 7], minlength=hmm.CLASSES) * 2, np.bincount([3, 3, 7], minlength=hmm.CLASSES), 4)
    # two words seen twice each in class 3, and the share left for words not seen
    den = model.class_tokens[3] + model.class_words[3] + 1
    assert 2 * (2 + 1) / den + 1 / den == 1
    assert model.tokens == 5 + 6 + 4 and model.distinct == 1 + 3 + 1


def gradient_error(loss, w, grads, names, tries=6):
    rng = np.random.default_rng(1)
    worst = 0.0
    for name in names:
        for _ in range(tries):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            old = w[name][at]
            w[name][at] = old + 1e-3
            up = loss()
            w[name][at] = old - 1e-3
            down = loss()
            w[name][at] = old
            worst = max(worst, abs((up - down) / 2e-3 - grads[name][at]))
    return worst


def test_backpropagation_through_time():
    rows = np.random.default_rng(2).integers(1, 5, (6, 9)).astype(np.uint8)
    mask, target = rows > 0, np.array([0, 1, 2, 0, 1, 2])
    net = language.BiGRU(3, 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, grads = net.gradients(rows, mask, target)
    assert gradient_error(lambda: net.gradients(rows, mask, target)[0], net.w, grads, ["U0", "U1", "V0", "V1", "c"]) < 1e-3


def test_fast_forward_equals_training_forward():
    rows = np.random.default_rng(3).integers(0, 256, (5, 12)).astype(np.uint8)
    net = language.BiGRU(4)
    p = net.probabilities(rows)
    loss, _ = net.gradients(rows, np.ones_like(rows, bool), np.zeros(5, int))
    assert -np.log(p[0] + 1e-9).mean() == pytest.approx(loss, rel=1e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_language_scores_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model, langs = language.fit(docs.where(~held_out("doc_id", 5, 0)), documents=30, epochs=2)
    odd = spark.createDataFrame([(10**6, "é"), (10**6 + 1, "12 !"), (10**6 + 2, None), (10**6 + 3, "ab " * 100)], "doc_id long, text string")
    some = docs.where("doc_id % 17 = 0").select("doc_id", "text").unionByName(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(some, (model, langs)).collect()}
    w, h = {k: v.astype(float) for k, v in model.w.items()}, model.h
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for r in some.collect():
        text = r["text"] or ""
        if not language.LETTER.search(text):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        raw = text.encode()
        total = np.zeros(len(langs))
        for at in range(0, len(raw), language.CHUNK):
            own = raw[at : at + language.CHUNK]
            padded = own + bytes(language.CHUNK - len(own))
            logits = np.zeros((language.CHUNK, len(langs))) + w["c"]
            for d in (0, 1):
                state = np.zeros(h)
                for t in range(language.CHUNK) if d == 0 else range(language.CHUNK - 1, -1, -1):
                    x, u = w[f"X{d}"][padded[t]], state @ w[f"U{d}"]
                    reset, keep = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
                    new = np.tanh(x[2 * h :] + reset * u[2 * h :])
                    state = (1 - keep) * new + keep * state
                    logits[t] += state @ w[f"V{d}"]
            p = np.exp(logits[: len(own)])
            total += (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
        total /= total.sum()
        assert got[r["doc_id"]][0] == langs[total.argmax()] and got[r["doc_id"]][1] == pytest.approx(total.max(), abs=1e-3)


def test_every_language_is_sampled(spark):
    known = spark.createDataFrame([(3 * k + j, f"l{k:03d}") for k in range(130) for j in range(3)], "doc_id long, lang string").coalesce(1)
    rows, counts = bounded_sample(known, known.select("doc_id"), "lang", 2)
    assert Counter(r["lang"] for r in rows.collect()) == {f"l{k:03d}": 2 for k in range(130)}
    assert counts == {f"l{k:03d}": 3 for k in range(130)}


def test_sample_of_many_rows_is_full(spark):
    known = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS quality")
    rows, counts = bounded_sample(known, known.select("doc_id"), "quality", 300)
    assert Counter(r["quality"] for r in rows.collect()) == {0: 300, 1: 300} and counts == {1: 6667, 0: 13333}


def test_held_out_labels_change_no_score(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(held_out("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = other.unionByName(spark.createDataFrame([(10**9 + k, 1, 0) for k in range(50)], labels.schema))
    scores = [{r["doc_id"]: r["score"] for r in quality.classify(docs, marks).collect()} for marks in (labels, other)]
    assert scores[0] == scores[1]


def test_long_texts_are_learned_from(spark):
    good, bad = "plain words of a good text. " * 400, "zzz !! xx 99 " * 900
    docs = spark.createDataFrame([(k, f"{k} " + (good if k % 2 else bad)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows)


def test_spread_reaches_both_ends(spark):
    text = "".join(chr(0x4E00 + k) for k in range(9000))
    rows = spark.createDataFrame([(text,), ("short",), (None,)], "text string").select(quality.spread(F.col("text")).alias("s")).collect()
    assert rows[0]["s"][0] == text[0] and rows[0]["s"][-1] == text[-1] and len(rows[0]["s"]) == quality.SAMPLE_CHARS
    assert rows[1]["s"] == "short" and rows[2]["s"] is None


def test_convolution_equals_brute_force():
    net = quality.ByteCNN()
    texts = ["", "abc", "x" * 300, "some words " * 40]
    got = net.probability(*flat_bytes(pa.array(texts)))
    for text, p in zip(texts, got, strict=True):
        data = np.frombuffer(text.encode() + bytes(quality.SPAN - 1), np.uint8)
        n = len(data) - quality.SPAN + 1
        acts = np.stack([sum(net.w["E"][data[i + j]] @ net.w["W"][j] for j in range(quality.SPAN)) + net.w["b"] for i in range(n)]) if n else np.zeros((0, quality.FILTERS))
        units = max(1, -(-(n + quality.SPAN - 1) // quality.CHUNK))
        pooled = np.stack([np.maximum(0, acts[k * quality.CHUNK : (k + 1) * quality.CHUNK].max(axis=0, initial=0)) for k in range(units)])
        x = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)]) @ net.w["v"] + net.w["c"][0]
        assert p == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-5)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9


def test_boosting_learns():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosted(30, 3)
    model.fit(x[:1500], y[:1500])
    assert ((model.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_decoding_keeps_only_within_kept():
    rng = np.random.default_rng(5)
    page = html.parse(html.Layout(random.Random(1)).page())
    for _ in range(20):
        kept = html.decode(page, rng.normal(0, 3, len(page.tag)))
        assert all(kept[page.parent[k]] for k in np.flatnonzero(kept) if k)


def test_decoding_is_the_likeliest_choice():
    page = html.parse("<div><p>a</p><p>b</p></div><ul><li>c</li></ul>")
    n = len(page.tag)
    odds = np.random.default_rng(6).normal(0, 2, n)
    weight = np.array([1.0 + min(4.0, len(t) / 100) for t in page.text])
    best = None
    for choice in itertools.product([False, True], repeat=n - 1):
        kept = (True, *choice)
        if any(kept[k] and not kept[page.parent[k]] for k in range(1, n)):
            continue
        value = sum(weight[k] * -np.logaddexp(0, -odds[k] if kept[k] else odds[k]) for k in range(1, n) if kept[page.parent[k]])
        best = max(best, (value, kept)) if best else (value, kept)
    assert tuple(html.decode(page, odds)) == best[1]


def test_pages_of_new_layouts():
    model, exact = html.trained(), 0
    for k in range(60):
        page = html.parse(html.Layout(random.Random(7_000_000 + k)).page())
        marks = html.labelled(page)
        truth = " ".join(t for t, m in zip(page.text, marks, strict=True) if m and t)
        exact += truth == html.main_text(page, html.decode(page, model.log_odds(html.features(page))))
    assert exact >= 50


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><h1>T</h1><p>One&amp;two<br>three <b>bo</b>ld</p><script>no</script></article>", "T One&two three bold"),
        ("<article><p>a&nbsp; b<p>c</article>", "a b c"),
        ("<nav><a href=x>m</a></nav><article><p>Long enough text of an article, with words. And more of them.</p></article><footer>&copy; f</footer>", "Long enough text of an article, with words. And more of them."),
        ("<article><p>x</p><!-- no", "x"),
        ("<article><p>a < b</p><p class='cut", "a < b"),
        ('<article><p title="x>three</p><p>four</p>', "three four"),
        ('<article><p title="x>three</p><p title="y">four</p>', "three four"),
        ('<article><p data-x="<b>no</b>" title=\'a > b\'>five</p>', "five"),
        ("<article><p>x <math><mi>y</mi></math> <noscript>z</noscript><svg><text>u</text></svg></p><template>v</template></article>", "x y zu v"),
        ("<article><p>a<wbr>b<my-word>c</my-word></p>d</p>e<hr>f<textarea>no</textarea></article>", "abc d e f"),
        ("<article>&lt;p&gt; &#x41;&eacute;<![CDATA[ no ]]><? no ?></ no>yes</article>", "<p> A\u00e9yes"),
    ],
)
def test_parsing(source, text):
    page = html.parse(source)
    article = next(k for k, t in enumerate(page.tag) if t == "article")
    kept = np.array([k == 0 or article in ancestors(page, k) for k in range(len(page.tag))])
    assert html.main_text(page, kept) == text


@pytest.mark.parametrize("source", ["<div>" * 80_000 + "</foo>" * 80_000, "<a x='y " * 120_000, '<a x="y ' * 120_000, "<p title='x>" * 80_000, "<li><div>" + "<h1>" * 80_000 + "</li>" * 80_000, "<" * 1_000_000, "<!-- " * 200_000, "<script>" * 100_000, "</" * 400_000, "&amp" * 250_000, "<a =" * 250_000, "<p " + " " * 1_000_000, "<b" + "/ =" * 300_000], ids=lambda s: s[:12])
def test_hostile_pages_take_linear_time(source):
    start = time.process_time()
    page = html.parse(source)
    html.decode(page, np.zeros(len(page.tag)))
    html.features(page)
    assert time.process_time() - start < 30


def test_nothing_of_a_deep_page_is_lost():
    page = html.parse("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after</p>")
    assert [t for t in page.text if t] == ["deep", "after"]


PAGES_BY_HAND = [
    (
        """<!doctype html><html><head><title>Baking | Bread club</title><style>b{}</style></head><body class="home page-template">
<header id="masthead"><a href="/">Bread club</a><nav class="main-navigation"><ul><li><a href="/a">Recipes</a><li><a href="/b">About us</a><li><a href="/c">Contact</a></ul></nav></header>
<div id="cookie-notice"><p>We use cookies to make this site better. By going on you agree to that.</p><button>Fine</button></div>
<div class="content-area"><article class="post"><h1>How to bake a loaf</h1>
<p>Mix the flour with water, and leave it for an hour. Then add salt &amp; yeast, and knead it well until it is smooth.</p>
<ul><li>500 g of flour</li><li>350 g of water</li></ul>
<p>Bake it at 230&deg;C, for <b>forty</b> minutes, in a pot with its lid on. It is done when it sounds hollow.</p>
<script>ga('send')</script></article></div>
<section class="comments"><h3>2 comments</h3><ol><li class="comment"><p>Ann</p><p>Mine came out flat, what did I do wrong with it?</p></li><li class="comment"><p>Bob</p><p>Too little yeast, I would think, or a cold kitchen.</p></li></ol></section>
<aside class="sidebar widget-area"><h3>Popular posts</h3><ul><li><a href="/x">Ten cakes for spring</a></li><li><a href="/y">All about rye</a></li></ul></aside>
<footer class="site-footer"><p>&copy; 2020 Bread club. All rights reserved.</p></footer></body></html>""",
        "How to bake a loaf Mix the flour with water, and leave it for an hour. Then add salt & yeast, and knead it well until it is smooth. 500 g of flour 350 g of water Bake it at 230\u00b0C, for forty minutes, in a pot with its lid on. It is done when it sounds hollow.",
    ),
    (
        """<html><body><div class="topbar"><a href="/">Home</a> | <a href="/news">News</a> | <a href="/sport">Sport</a></div>
<div class="ad-banner"><p>Buy two, get one free. Only today at Shoeland.</p></div>
<main><h1>River rises after rain</h1><p>The river rose by two metres on Monday, said the council, and the lower road is closed.</p>
<blockquote>We have not seen such water in years, said a farmer who lives by the bridge.</blockquote>
<p>More rain is likely on Tuesday. Schools stay open, and buses go by the upper road for now.</p></main>
<form class="newsletter-signup"><label>Get our letter every week</label><input name="m"><button>Sign up</button></form>
<div class="footer"><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a> <p>All rights reserved by the paper.</p></div></body></html>""",
        "River rises after rain The river rose by two metres on Monday, said the council, and the lower road is closed. We have not seen such water in years, said a farmer who lives by the bridge. More rain is likely on Tuesday. Schools stay open, and buses go by the upper road for now.",
    ),
    ("<article><p>Only one paragraph of a page, which has nothing around it at all.</p></article>", "Only one paragraph of a page, which has nothing around it at all."),
]


def test_pages_by_hand(spark):
    rows = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(PAGES_BY_HAND)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(rows).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(PAGES_BY_HAND)}


def test_query_equals_the_articles_of_the_pages(spark):
    # a second reading of the table: between the article's tags, all markup taken out by plain patterns
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    same = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)
        inner = re.sub(r"<[^>]*\Z", "", inner[1]) if inner else ""
        blocks = re.sub(r"<[^>]*>", lambda m: "" if m[0].strip("</>") == "b" else " ", inner)
        same += got[r["page_id"]] == " ".join(unescape(blocks).split())
    assert same / len(rows) > 0.97


def ancestors(page, k):
    while k > 0:
        yield k
        k = page.parent[k]


def test_padded_rows():
    rows, units = padded_rows(*flat_bytes(pa.array(["abc", None, "x" * 5])), 4, 1)
    assert units.tolist() == [1, 1, 2] and bytes(rows.reshape(-1)) == b"abc\0" + b"\0" * 4 + b"xxxxx\0\0\0"


def test_quality_query_equals_a_plain_convolution(spark):
    """The fitted network's scores, byte by byte and filter by filter."""
    root = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where(~held_out("doc_id", 5, 0)), labels)
    e, w, b, v, c = (model.w[k] for k in "EWbvc")
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_quality"](spark, root).collect()}
    rows = sorted(docs.collect(), key=lambda r: len(r["text"] or ""))[:40]
    for r in rows:
        data = (r["text"] or "").encode()
        padded = data + bytes(quality.CHUNK + quality.SPAN)
        pooled = []
        for a in range(0, max(1, len(data) + quality.SPAN - 1), quality.CHUNK):
            best = np.full(quality.FILTERS, -np.inf)
            for k in range(a, min(a + quality.CHUNK, len(data))):
                best = np.maximum(best, sum(e[padded[k + j]] @ w[j] for j in range(quality.SPAN)))
            pooled.append(np.maximum(best + b, 0))
        features = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)])
        score = 1 / (1 + np.exp(-np.clip(features @ v + c, -60, 60)))[0]
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-4 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)
