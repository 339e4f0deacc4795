"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm import decontaminate, hmm, html, jaccard, language, licenses, media, packing, pii, quality
from trajecta.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, key string"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ROWS = [(1, "one two three four", "en", "a", 4, 0.0, "x", "y"), (2, None, None, None, None, None, None, None), (3, "", "de", "a", 0, 1.0, "", ""), (4, LONG, "en", "b", 9, 0.5, "x", "y"), (5, "one two three four", "en", "a", 4, 0.0, "x", "y"), (5, "one two three four", "en", "a", 4, 0.0, "x", "y"), (None, "one two three four", "en", "a", 4, 0.0, "x", "y"), (6, " \n\t", "fr", "a", 3, 0.0, "x", "y"), (7, "é", "fr", "a", 1, 0.0, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 3, 4, 5, 5, 6, 7, None]


def test_hmm(docs, none):
    out = hmm.held_out_scores(docs)
    assert ids(out) == ALL
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["n_tokens"] == rows[3]["n_tokens"] == rows[6]["n_tokens"] == 1 and rows[4]["n_tokens"] == 60_001
    assert rows[1]["score"] == rows[5]["score"] and all(r["score"] < 0 for r in rows.values())
    assert rows[5]["n_tokens"] == 5 and rows[None]["held_out"] is True
    assert hmm.held_out_scores(none).count() == 0


def test_hmm_without_training_rows(spark):
    only = spark.createDataFrame([(k, "a b") for k in range(200)], "doc_id long, text string").where(hmm.held_out("doc_id", 7, 2))
    rows = hmm.held_out_scores(only).collect()
    assert rows and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in rows)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (None, 1), (5, None), (99, 0)], "doc_id long, quality int")
    assert ids(quality.classify(docs, labels)) == ALL
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.schema == docs.schema and kept.count() == 9


def test_language(docs, none):
    rows = language.identify(docs).collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ALL
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[6]["lang_pred"] == "und" and by[7]["lang_pred"] != "und"
    assert language.identify(none).count() == 0
    assert [language.has_letter(t) for t in ("\u00b2\u00bd", "\u2460", "\u2167", "12_", "", None, "\u00e9", "\u0436", "\u4e00", "1x")] == [False] * 6 + [True] * 4


def test_contamination(docs, none, spark):
    items = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10"), (2, None), (3, ""), (4, "One, two three FOUR"), (1, "w5 w6 w7 w8 w9 w10"), (None, "w5 w6 w7 w8 w9"), (5, "two three four one"), (6, "w8 w9 w10")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 4, 1.0), (4, 1, 1.0), (4, 6, 1.0), (5, 4, 1.0)]
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert ids(decontaminate.clean(docs, items.where("item_id < 4"))) == [1, 2, 3, 5, 5, 6, 7, None]


def test_contamination_by_items_with_ties_and_other_columns(docs, spark):
    items = spark.createDataFrame([(1, "w5 w6 w7 w8 w9", 7, "x"), (2, "w5 w6 w7 w8 w9", 7, "x"), (2, "nothing like it in there", 7, "x")], "item_id long, text string, doc_id int, shingle string")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(4, 1, 1)]  # item 2 has two sets under one id, of which no document holds 0.8
    assert ids(decontaminate.clean(docs, items.where("item_id IS NULL"))) == ALL


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (None, "u", "plain words", 3), (4, "u", "<article><p>" + "Some words here. " * 20_000, 4), (4, "u", "<a href='x", 5)], "page_id long, url string, html string, text int")
    rows = {(r["page_id"], r["n_chars"] > 0) for r in html.extract(pages).collect()}
    assert {(1, False), (2, False), (4, True), (4, False)} <= rows
    assert html.extract(pages.limit(0)).count() == 0


def test_html_of_deep_pages():
    deep = "<div id=page><article>" + "<div>" * 600 + "deep" + "</div>" * 600 + "<p>tail</p></article></div><p>after</p>"
    page = html.parse(deep)

    def above(text):
        k, out = page.text.index(text), []
        while k > 0:
            out.append(page.tag[k])
            k = page.parent[k]
        return out

    assert above("tail") == ["#text", "p", "article", "div"] and above("after") == ["#text", "p"] and above("deep").count("div") == 601
    assert len(html.features(page)) == len(page.tag)


@pytest.mark.parametrize("source", ["<div>" + "<h1>" * 60_000 + "</li>" * 60_000, "<li>" + "<h1>" * 60_000 + "</li>" * 60_000, "<tbody>" * 60_000 + "<p>" * 60_000])
def test_html_takes_linear_time_however_deep(source):
    import time

    began = time.time()
    html.parse(source)
    assert time.time() - began < 15


def test_pii(docs, none):
    key = b"k"
    assert pii.protect(docs, key).schema == docs.schema and ids(pii.protect(docs, key)) == ALL
    assert {r["n_values"] for r in pii.protect(docs, key, report=True).collect()} == {0}
    assert pii.protect(none, key).count() == 0
    some = [(1, "ann@example.com and ann@example.com, 123-45-6789"), (1, "ann@example.com and ann@example.com, 123-45-6789"), (2, "123-45-6789"), (None, "ann@example.com"), (3, None), (4, "x " * 50_000 + "ann@example.com")]
    rows = sorted(map(tuple, pii.protect(docs.sparkSession.createDataFrame(some, "doc_id long, text string"), key, report=True).collect()), key=str)
    mail, number = pii.email("ann@example.com", key), pii.ssn("123-45-6789", key)
    assert rows == sorted([(1, f"{mail} and {mail}, {number}", 3, "email,ssn")] * 2 + [(2, number, 1, "ssn"), (None, mail, 1, "email"), (3, None, 0, ""), (4, "x " * 50_000 + mail, 1, "email")], key=str)


def test_licenses(docs, none, spark):
    rows = {r["doc_id"]: r for r in licenses.summary(docs).collect()}
    assert rows[4]["n_words"] == 60_000 and rows[2]["n_words"] == 0 and rows[1]["labels"] == "" and rows[1]["first_word"] is None
    some = [(1, "x under the mit license y"), (1, "x under the mit license y"), (None, "under the mit license"), (None, "no word of it"), (2, "cc by nc cc by nc"), (2, "nothing here")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["base_labels"]) for r in licenses.summary(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 4, 0, ""), (0, 4, 1, "mit"), (1, 6, 1, "mit"), (1, 6, 1, "mit"), (2, 2, 0, ""), (2, 6, 2, "cc-by-nc")]
    assert licenses.summary(none).count() == 0


def test_packing(docs, none, spark):
    out = packing.pack(docs, tokenizer())
    per_doc = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in per_doc}[2] == 1 and {r["doc_id"]: r["n"] for r in per_doc}[3] == 1
    assert packing.pack(none, tokenizer()).count() == 0 and packing.padding(out) == 0.0


def test_jaccard(docs, none):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()]
    assert sorted(rows, key=str) == sorted([(1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 977, 4), (5, 2, 1), (5, 2, 1), (None, 2, None), (6, 0, 6), (7, 1, 7)], key=str)
    assert jaccard.join(none).count() == 0
    assert ids(jaccard.keep_one(docs)) == [1, 2, 3, 4, 6, 7, None]


@pytest.mark.parametrize("order", [1, -1])
def test_jaccard_of_ids_with_several_texts(spark, order):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a), (5, a + " z"), (5, b), (9, b + " q"), (7, a), (5, a), (12, "x y"), (12, None), (None, a), (13, "u v w")]
    docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()), key=str)
    assert got == sorted([(1, 58, 1), (5, 59, 1), (5, 48, 1), (9, 49, 1), (7, 58, 1), (5, 58, 1), (12, 1, 12), (12, 0, 12), (None, 58, None), (13, 1, 13)], key=str)
    assert ids(jaccard.keep_one(docs)) == [1, 12, 12, 13, None]


def test_media(docs, none):
    rows = {r["doc_id"]: r for r in media.describe(media.encode_texts(docs)).collect()}
    assert rows[2]["payload_bytes"] == 64 and rows[2]["payload_sha256"] == rows[3]["payload_sha256"]
    assert rows[1]["media_sha256"] == rows[5]["media_sha256"] and rows[4]["n_bytes"] == len(LONG)
    assert media.describe(media.encode_texts(none)).count() == 0
    empty = docs.sparkSession.createDataFrame([(1, 2, None)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))
    assert media.describe(empty).first()["payload_bytes"] is None
