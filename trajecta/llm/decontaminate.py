"""Benchmark decontamination: short test items found inside long documents.

Words are runs of digits, letters and non-ASCII characters after lowering A-Z, so case and punctuation don't matter.
An item's set is its distinct five-word shingles; an item of fewer words has one shingle, its whole sequence of words,
so it is contained where its words stand consecutively. A document contains an item if it has at least `threshold` of
its set.

The search is by MinHash sketches of the items, in size partitions. Items whose sets have 2^c to 2^(c+1)-1 shingles
form partition c; its sketches hold the k(c) shingles with the smallest hashes, where k(c) is one more than the most
shingles that a contained item of that partition can miss. Hence every true pair shares at least one shingle of the
sketch: the sketch search loses none, and most documents share none and end there. What it finds is verified by exact
containment on the shingles' texts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import alnum_words, cut, gram_hashes, gram_texts, small

WORDS = 5
THRESHOLD = 0.8
#: Partitions of items by the size of their sets, as powers of two.
CLASSES = 40


def sketch_size(size_class: int, threshold: float) -> int:
    """Smallest hashes kept of each item of a size partition."""
    largest = 2 ** (size_class + 1) - 1
    return math.floor(largest * (1 - threshold) + 1e-9) + 1


def short_lengths(items: DataFrame, words: int) -> list[int]:
    """The lengths of items that have fewer words than a shingle; fewer than `words` numbers."""
    n = F.size(alnum_words(F.col("text")))
    return sorted(r[0] for r in items.select(n.alias("n")).where(F.col("n").between(1, words - 1)).distinct().collect())


def item_shingles(items: DataFrame, words: int) -> DataFrame:
    """(item_id, n_item, shingle): distinct shingles of each item and their number."""
    own = F.when(F.size("w") >= words, F.array_distinct(gram_texts("w", words))).when(F.size("w") > 0, F.array(F.array_join("w", " ")))
    shingled = items.select("item_id", alnum_words(F.col("text")).alias("w")).select("item_id", own.alias("s"))
    return shingled.select("item_id", F.size("s").cast("long").alias("n_item"), F.explode_outer("s").alias("shingle")).where(F.col("shingle").isNotNull())


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment of at least the threshold.

    Null or empty texts on either side, and items without words, are in no pair. Rows that repeat a (doc_id, text) or
    an (item_id, text) give one pair; different texts under one id are taken together. Columns other than the ids and
    texts are ignored. Empty tables give no rows. The items' sketches are broadcast only up to a counted number of rows.
    """
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull())
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    lengths = [words, *short_lengths(items, words)]
    shingles = cut(item_shingles(items, words).groupBy("item_id", "shingle").agg(F.max("n_item").alias("n_item")))
    limits = F.element_at(F.array(*(F.lit(sketch_size(c, threshold)) for c in range(CLASSES))), F.floor(F.log2("n_item")).cast("int") + 1)
    # a missing word changes no hash, so short shingles hash as the runs of their length do
    hashed = F.expr(f"xxhash64({', '.join(f'get(p, {k})' for k in range(words))})")
    ranked = shingles.withColumn("p", F.split("shingle", " ")).withColumn("h", hashed).drop("p").withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    per_item = ranked.groupBy("item_id", "n_item", "size_class").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    sketches = cut(per_item.select("item_id", "n_item", F.explode_outer(F.slice("hs", F.lit(1), limits)).alias("h")))

    hashes = docs.select("doc_id", alnum_words(F.col("text")).alias("w")).select("doc_id", F.concat(*(gram_hashes("w", n) for n in lengths)).alias("hs"))
    # explode_outer: of explode, Spark infers a filter that would split the text again for every word
    rolled = hashes.select("doc_id", F.size("hs").alias("n_doc"), F.explode_outer("hs").alias("h"))
    # a document with fewer shingles than the threshold asks for cannot contain the item
    found = rolled.join(small(sketches), "h").where(F.col("n_doc") >= F.col("n_item") * threshold - 1e-9)
    candidates = cut(found.select("doc_id", "item_id").distinct())

    texts = docs.join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    runs = F.concat(*(F.array_distinct(gram_texts("w", n)) for n in lengths))
    inside = texts.select("doc_id", alnum_words(F.col("text")).alias("w")).select("doc_id", F.explode_outer(runs).alias("shingle"))
    shared = inside.join(small(shingles), "shingle").groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    exact = shared.where(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    return exact.join(candidates, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The documents that contain no item, with all their columns; null ids and texts stay. Rows that repeat a doc_id
    stay or go together; equal texts under other ids are each judged, and alike."""
    bad = contaminated(docs, items, threshold, words).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
