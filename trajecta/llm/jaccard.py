"""Similarity join on word n-grams by multiple global orders.

A document's set has its distinct word shingles. Two sets of Jaccard similarity s or more share a token among their
first tokens (the prefix) under any order of all tokens. So a pair is a candidate only if its prefixes meet under
several different orders; that intersection is taken before any set is compared. Frequent tokens come last in every
order, which keeps prefixes to rare tokens; which tokens count as frequent changes the work, never the result.

Only what connects documents is needed, so pairs inside a group of copies aren't spelled out: documents of equal sets
form a class, each class is first compared with the most central document that it shares a prefix token with, and
only then are classes compared that share a prefix token and aren't connected yet, all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from trajecta.llm.common import blocks, cut, released, scratch, small, small_batches, stored, swept
from trajecta.llm.components import components

WORDS = 3
#: The similarity as a share of two whole numbers, so that it is compared exactly.
NUMERATOR, DENOMINATOR = 90, 100
#: Global orders under which prefixes have to meet.
ORDERS = 3
#: Most tokens that are put last as frequent; the most frequent ones are chosen.
FREQUENT = 200_000
#: Tokens that one task keeps while it looks for frequent ones; rarer ones are let go beyond it.
COUNTED = 1_000_000
#: Least rows with a token, in one task, for it to count as frequent.
LEAST = 4
#: Parts of the tokens' hashes, of which so many are taken as make up a share.
SHARES = 1_000_003
_ONE = np.uint64(1)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser; every salt gives another order of the tokens."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space."""
    return text.encode().lower().split() if text else []


def shingles(tokens: list[bytes], n: int, cache: WordHashes) -> np.ndarray:
    """Hashes of all runs of n words; with fewer words the whole sequence is one run; without words there is none."""
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    runs = max(1, len(h) - n + 1)
    out = np.full(runs, min(n, len(h)), np.uint64)
    for k in range(min(n, len(h))):
        out = mix(out + h[k : k + runs], k)
    return out


def exact_set(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return set()
    return set(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else {tuple(w)}


def prefix_length(size: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    return size - -(-num * size // den) + 1


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def frequent_tokens(docs: DataFrame, n: int = WORDS, most: int = FREQUENT) -> np.ndarray:
    """Hashes of frequent tokens, the rarest first: at most `most`, found by lossy counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in blocks(batches, 4_000_000):
            sets = [np.unique(shingles(words(t), n, cache)) for t in batch.column(0).to_pylist()]
            own = np.concatenate(sets) if sets else keys[:0]
            keys, counts = _merged(np.concatenate([keys, own]), np.concatenate([counts, np.ones(len(own), np.int64)]))
            floor = 1
            while len(keys) > COUNTED:
                kept = counts > floor
                keys, counts, floor = keys[kept], counts[kept], floor + 1
        kept = counts >= LEAST
        yield pa.RecordBatch.from_arrays([pa.array(keys[kept].view(np.int64)), pa.array(counts[kept])], ["token", "count"])

    found = cut(docs.select("text").where("text IS NOT NULL").mapInArrow(released(run), "token long, count long").groupBy("token").agg(F.sum("count").alias("count")))
    sizes = {r[0]: r[1] for r in found.groupBy(F.floor(F.log2("count")).alias("b")).count().collect()}
    total, chosen = 0, F.lit(False)
    for b in sorted(sizes, reverse=True):
        band = F.floor(F.log2("count")) == b
        if total + sizes[b] > most:
            # of a band that is too large, an even share by the tokens' hashes, a tenth short of the room that is left
            chosen = chosen | (band & (F.pmod("token", F.lit(SHARES)) < int(0.9 * SHARES * (most - total) / sizes[b])))
            break
        total, chosen = total + sizes[b], chosen | band
    rows = found.where(chosen).orderBy("count", "token").select("token").toPandas()
    return rows.token.to_numpy(np.int64).view(np.uint64)[-most:] if most else np.empty(0, np.uint64)


def features(docs: DataFrame, frequent: np.ndarray, n: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n, key, p0, p1, ...): size and digest of the set, and its prefix under each order.

    p0 holds the tokens in order; of the others 32 bits of each token do, since they only decide whether sets meet.
    """
    by_hash = np.argsort(frequent)
    known, rank = frequent[by_hash], (by_hash + 1).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        low = (_ONE << np.uint64(45)) - _ONE
        for batch in blocks(batches, 2_000_000):
            sets = [np.unique(shingles(words(t), n, cache)) for t in batch.column(1).to_pylist()]
            flat = np.concatenate([*sets, np.empty(0, np.uint64)])
            place = np.searchsorted(known, flat)
            place[place == len(known)] = 0
            last = np.where(known[place] == flat, rank[place], 0).astype(np.uint64) if len(known) else np.zeros(len(flat), np.uint64)
            keys = [(last << np.uint64(45)) | (mix(flat, 101) & low)]
            keys += [((last >> np.uint64(12)) + (last > 0) << np.uint64(45)) | (mix(flat, 101 + k) & low) for k in range(1, ORDERS)]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            lengths = [prefix_length(len(s), num, den) if len(s) else 0 for s in sets]
            heads: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
            for s, a, p in zip(sets, starts, lengths, strict=False):
                for k in range(ORDERS):
                    heads[k].append(s[np.argsort(keys[k][a : a + len(s)], kind="stable")[:p]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())]
            for k in range(ORDERS):
                values = np.concatenate([*heads[k], np.empty(0, np.uint64)])
                typed = pa.array(values.view(np.int64)) if k == 0 else pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32))
                cols.append(pa.ListArray.from_arrays(offsets, typed))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "key", *(f"p{k}" for k in range(ORDERS))])

    rest = ", ".join(f"p{k} array<int>" for k in range(1, ORDERS))
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id long, n long, key binary, p0 array<long>, {rest}")


def _possible(num: int, den: int) -> Column:
    """Whether two prefix entries (n, at, before; n2, at2, before2) leave room for enough shared tokens.

    `before` counts earlier tokens of the prefix that some other set's prefix has too: only those can be shared.
    """
    room = F.least("before", "before2") + 1 + F.least(F.col("n") - F.col("at") - 1, F.col("n2") - F.col("at2") - 1)
    return (room * (num + den) >= (F.col("n") + F.col("n2")) * num) & (F.least("n", "n2") * den >= F.greatest("n", "n2") * num)


def meet(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (x, y) whose prefixes share a token under every further order."""
    orders = [f"p{k}" for k in range(1, ORDERS)]
    left = reps.select(F.col("doc_id").alias("x"), *orders)
    right = reps.select(F.col("doc_id").alias("y"), *(F.col(p).alias(f"{p}y") for p in orders))
    both = pairs.join(left, "x").join(right, "y")
    for p in orders:
        both = both.where(F.arrays_overlap(p, f"{p}y"))
    return both.select("x", "y")


def verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose sets, made of the words themselves, are similar enough; as a table without lineage."""
    with scratch() as keep:
        return _verified(pairs, docs, n, num, den, keep)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    pairs = keep(pairs)
    ids = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct()
    # written first, so that both sides of the joins are plain exchanges and a document of very many pairs can be split
    digests = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    named = docs.where("text IS NOT NULL").select("doc_id", "text", *digests).join(small(ids), "doc_id", "left_semi")
    # of an id with several texts all count, each once
    texts = keep(named.dropDuplicates(["doc_id", "t1", "t2"]).select("doc_id", "text"))
    both = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("a")), "x").join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("b")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            kept = []
            # row by row: the texts of a batch are many times the size of its ids, and most repeat the row before
            for y, a, b in zip(batch.column(1).to_pylist(), *((x.as_py() for x in batch.column(k)) for k in (2, 3)), strict=True):
                if (y, b) != last:
                    last, known = (y, b), exact_set(b, n)
                own = exact_set(a, n)
                shared = len(own & known)
                kept.append(shared > 0 and den * shared >= num * (len(own) + len(known) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(kept, pa.bool_()))

    return cut(both.select("x", "y", "a", "b").mapInArrow(released(run), "x long, y long"))


def linked(docs: DataFrame, n: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_id, n and class of each row, and links (x, y) that connect the classes as all links would.

    A class holds the documents of equal sets and goes by the smallest doc_id. Null and empty texts have empty sets
    and no class; rows without a doc_id have no class either. Rows that repeat a doc_id are one document, which is linked
    with what any of its texts is linked with.
    """
    small_batches(docs.sparkSession)
    with scratch() as keep:
        return _linked(docs, n, num, den, keep)


def _linked(docs: DataFrame, n: int, num: int, den: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    # the prefixes of all rows are the widest table; once the classes' own are copied, it goes
    with scratch() as first:
        feats = first(features(docs, frequent_tokens(docs, n), n, num, den))
        full = feats.where("n > 0 AND doc_id IS NOT NULL")
        classes = full.groupBy("key", "n").agg(F.min("doc_id").alias("class"))
        placed = feats.select("doc_id", "n", "key").join(classes.drop("n"), "key", "left")
        sets = stored(placed.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class")))
        # ids with several sets: their classes belong together, and their sets are told apart by a part of their digests
        several = keep(full.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("doc_id"))
        own = sets.where("class IS NOT NULL").join(small(several), "doc_id", "left_semi").select("doc_id", "class").distinct()
        together = keep(own.join(own.groupBy("doc_id").agg(F.min("class").alias("x")), "doc_id").where("x <> class").select("x", F.col("class").alias("y")))
        reps = keep(full.join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").join(small(several.withColumn("some", F.lit(True))), "doc_id", "left").withColumn("which", F.when(F.col("some"), F.xxhash64("key")).otherwise(F.lit(0).cast("long"))).drop("some", "key"))

    entries = reps.select(F.col("doc_id").alias("x"), "n", "which", F.posexplode_outer("p0").alias("at", "token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    by_doc = Window.partitionBy("x", "which").orderBy("at")
    posted = keep(entries.join(shared, "token").withColumn("before", F.row_number().over(by_doc) - 1).drop("which"))

    # the document with the fewest tokens of its own before a token stands for all that have the token
    centres = posted.groupBy("token").agg(F.min(F.struct((F.col("at") - F.col("before")).alias("own"), F.col("x").alias("y"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("before").alias("before2"))).alias("c")).select("token", "c.*")
    near = posted.join(centres, "token").where(F.col("x") != F.col("y")).where(_possible(num, den))
    first = near.groupBy("x").agg(F.min(F.struct("own", "y")).alias("c")).select("x", F.col("c.y").alias("y"))
    links = cut(verified(meet(first, reps), docs, n, num, den).unionByName(together))
    swept(docs.sparkSession)

    found = cut(components(links, "x", "y"))
    placed = posted.join(found.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token")
    rest = keep(placed.join(open_tokens, "token"))
    other = rest.select("token", *(F.col(c).alias(f"{c}2") for c in ("x", "n", "at", "before", "component")))
    pairs = rest.join(other, "token").where((F.col("x") < F.col("x2")) & (F.col("component") != F.col("component2"))).where(_possible(num, den))
    more = verified(meet(pairs.select("x", F.col("x2").alias("y")).distinct(), reps), docs, n, num, den)
    return sets, cut(links.unionByName(more))


def join(docs: DataFrame, n: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the smallest doc_id reachable by links of similarity num/den.

    Empty sets are linked with nothing and are their own component; see linked() for nulls and repeated rows.
    """
    sets, links = linked(docs, n, num, den)
    found = components(links, "x", "y").withColumnRenamed("node", "class")
    placed = sets.join(found, "class", "left")
    return placed.select("doc_id", "n_shingles", F.coalesce("component", "class", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """The documents without those that a document of smaller id in their group stands for, with all their columns.

    Of equal documents the smallest id stays. Rows that repeat a doc_id stay or go together: they go if any of their
    texts is linked with a smaller id. Rows without a doc_id, and null, empty and blank texts, are in no group and stay.
    """
    gone = cut(join(docs, n, num, den).where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
