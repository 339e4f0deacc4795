"""Shared passages against SQL, against brute force on made rows, and on rows out of the ordinary."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tests.oracle import duck, spark_rows
from trajecta.llm import queries, substrings

DOCS = "doc_id long, text string"


def brute(rows, n):
    """What without_repeats() gives for (doc_id, text) rows, window by window."""
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(i, first.get(tuple(w[k : k + n]), i))
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = {j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def test_query_equals_sql(spark, data):
    assert spark_rows(queries.QUERIES["op13_substrings"](spark, data)) == duck(data, queries.ORACLES["op13_substrings"])


@pytest.mark.parametrize(("seed", "n", "vocabulary"), [(1, 50, 400), (2, 8, 30), (3, 3, 4), (4, 1, 9), (5, 21, 1)])
def test_equals_brute_force(spark, seed, n, vocabulary):
    rng = np.random.default_rng(seed)
    shared = [[f"é{rng.integers(vocabulary)}" for _ in range(2 * n + 1)] for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [[f"w{rng.integers(vocabulary)}" for _ in range(rng.integers(0, n + 2))]]
        for _ in range(rng.integers(0, 3)):
            passage = shared[rng.integers(4)]
            a = rng.integers(0, n + 1)
            parts += [passage[a : a + rng.integers(n - 1, n + 2)], [f"w{rng.integers(vocabulary)}"]]
        rows.append((int(rng.integers(0, 50)) if k % 9 else None, "\t ".join(" ".join(p) for p in parts if p)))
    assert got(substrings.without_repeats(spark.createDataFrame(rows, DOCS).repartition(4), n)) == brute(rows, n)


def test_rows_out_of_the_ordinary(spark):
    passage = " ".join(f"p{k}" for k in range(50))
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, f"a {passage} b"), (2, None), (3, ""), (4, " \n\t"), (5, f"{passage}\x0b{passage}"), (5, f"c\xa0{passage}"), (5, f"{passage}\x0b{passage}"), (None, passage), (None, passage), (6, long), (7, long + " end"), (8, " ".join(f"p{k}" for k in range(49))), (-3, f"{passage} z")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS + ", row string, first int, starts int").repartition(3)
    out = got(substrings.without_repeats(docs))
    assert out == brute(rows, 50)
    assert (None, 50, 0, passage) in out and (5, 100, 100, "") in out and (-3, 51, 0, f"{passage} z") in out and (7, 60_001, 60_000, "end") in out
    assert (1, 52, 50, "a b") in out and (5, 50, 0, rows[5][1]) in out  # a no-break space is part of a word
    spans = {(r["doc_id"], tuple(map(tuple, r["removed"]))) for r in substrings.without_repeats(docs).collect()}
    assert (1, ((1, 50),)) in spans and (5, ((0, 100),)) in spans
    assert substrings.summary(docs.limit(0)).count() == 0
    empty = substrings.summary(docs.where("doc_id = 3")).first()
    assert empty["kept_sha256"] == hashlib.sha256(b"").hexdigest() and empty["n_words"] == 0


def test_one_text_in_a_third_of_all_rows(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 1 THEN '{passage}' ELSE concat(id, ' ', repeat('x ', 60), id) END AS text")
    rows = [tuple(r) for r in substrings.summary(docs).select("doc_id", "n_removed").collect()]
    assert dict(rows) == {i: (70 if i % 3 == 1 else 60) if i > 1 else 0 for i in range(3000)}


def test_sketch_never_counts_too_few():
    rng = np.random.default_rng(7)
    parts = [rng.integers(0, 1 << 63, 3000, np.uint64) for _ in range(3)]
    parts[1][:500], parts[2][100:300] = parts[0][:500], parts[0][900:1100]
    merged = np.zeros((2, substrings.DEPTH, 1 << 11), np.uint8)
    for values in parts:
        sketch = substrings.Sketch(1 << 14)
        sketch.add(values)
        merged[1] |= sketch.twice | (merged[0] & sketch.once)
        merged[0] |= sketch.once
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    estimate = substrings.repeated(merged[1], values)
    assert estimate[counts > 1].all() and estimate[counts == 1].mean() < 0.5


def test_word_hashes_are_of_words():
    texts = ["one two", None, "", " two\none  ", "onetwo", "two", " two", "two"]
    h, counts = substrings.WordHashes()(pa.array(texts, pa.string()))
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    words = [w for t in texts for w in (t or "").encode().split()]
    assert len(set(h.tolist())) == len(set(words)) and all((h[a] == h[b]) == (words[a] == words[b]) for a in range(len(h)) for b in range(len(h)))


def test_a_saturated_sketch_changes_nothing(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = spark_rows(substrings.summary(docs))
    monkeypatch.setattr(substrings, "LEAST_CELLS", 64)
    monkeypatch.setattr(substrings, "MOST_CELLS", 64)
    assert spark_rows(substrings.summary(docs)) == expected


def test_many_repeated_texts_change_nothing(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = spark_rows(substrings.summary(docs))
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 1)
    assert spark_rows(substrings.summary(docs)) == expected
