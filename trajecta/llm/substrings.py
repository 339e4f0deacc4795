"""Passages that other documents have too, found word by word behind a count-min sketch.

A window is a run of consecutive words. Two passes find the windows that documents share:

Texts that an earlier document has as a whole are told first, by digests of the texts: they lose every window, and no
other document needs theirs. For the rest:

1. Every task counts its windows in a count-min sketch; the sketches are merged into one, whose estimates are never less
   than the true counts.
2. Windows estimated to be in one document alone are let go. The others, and nothing else, are grouped exactly.

A window is counted under its anchor, which is the smallest hash of a short run of words in it. Equal windows have equal
anchors, so the number of documents with the anchor is at least the number of documents with the window, and the sketch
has to hold one value for about twenty windows. Its cells count to two, since more is never asked for.

The sketch grows with the text up to a fixed size, which bounds what a task builds and what is sent to all. Beyond it the
estimates get coarser and more windows reach the exact pass; no result changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import BROADCAST_ROWS, blocks, flat_bytes, released, scratch, small_batches, stored
from trajecta.llm.jaccard import mix

WORDS = 50
#: Words of a run of which the smallest hash in a window is its anchor.
ANCHOR = 8
#: Rows of the sketch; a window's estimate is the least of its cells.
DEPTH = 2
#: Cells of a row for each anchor expected, and bytes of text for which one anchor is.
CELLS, BYTES = 4, 128
#: Least and most cells of a row (powers of two). At most, a task's sketch has 128 MB and the merged one is sent as 64 MB.
LEAST_CELLS, MOST_CELLS = 1 << 19, 1 << 28
#: Bytes of a row of the sketch that are merged as one value.
CHUNK = 1 << 15
#: Tasks that build a sketch, at most: each has a sketch's size to write.
MOST_TASKS = 4096
#: Texts are handled in blocks of so many bytes.
BLOCK = 2_000_000


class Sketch:
    """A count-min sketch whose cells count to two, as two bits: seen, and seen again."""

    def __init__(self, cells: int) -> None:
        self.cells = cells
        self.once, self.twice = np.zeros((2, DEPTH, cells // 8), np.uint8)

    def places(self, values: np.ndarray, row: int) -> np.ndarray:
        return (values >> np.uint64(32 * row)) & np.uint64(self.cells - 1)

    def add(self, values: np.ndarray) -> None:
        for row in range(DEPTH):
            cells, counts = np.unique(self.places(values, row), return_counts=True)
            at, bit = cells >> np.uint64(3), np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8)
            again = (counts > 1) | (self.once[row][at] & bit > 0)
            np.bitwise_or.at(self.once[row], at, bit)
            np.bitwise_or.at(self.twice[row], at[again], bit[again])

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(place, seen, seen again) of the parts that aren't empty."""
        size = min(CHUNK, self.cells // 8)
        once, twice = self.once.reshape(-1, size), self.twice.reshape(-1, size)
        for k in np.flatnonzero(once.any(axis=1)):
            yield int(k), once[k].tobytes(), twice[k].tobytes()


def repeated(twice: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the sketch estimates two or more for each value."""
    out = np.ones(len(values), bool)
    for row in range(DEPTH):
        cell = (values >> np.uint64(32 * row)) & np.uint64(twice.shape[1] * 8 - 1)
        out &= twice[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0
    return out


def runs(h: np.ndarray, have: int, n: int, powers: dict[int, np.ndarray], salt: int) -> np.ndarray:
    """Hashes of all runs of n words, from those of `have` words and of the powers of two up to it (also kept there)."""
    while have * 2 <= n:
        longer = powers[have]
        powers[have * 2] = mix(longer[:-have] * np.uint64(0x9FB21C651E98DF25) + longer[have:], salt)
        have *= 2
    out, done = powers[have], have
    while done < n:
        have = next(p for p in sorted(powers, reverse=True) if p <= n - done)
        count = len(h) - done - have + 1
        out = mix(out[:count] * np.uint64(0x9FB21C651E98DF25) + powers[have][done : done + count], salt)
        done += have
    return out


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """Hashes of the words of texts, whole blocks at a time: every word is a polynomial in a base over its bytes, taken
    from running sums, and then mixed."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20_220_731)
        self.values = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up, self.down = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, how many each text has); a null text has none."""
        data, offsets = flat_bytes(texts)
        if len(data) >= len(self.up):
            base = 0x9E3779B97F4A7C15
            self.up, self.down = _powers(base, len(data) + 1), _powers(pow(base, -1, 1 << 64), len(data) + 1)
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(self.space[data], out=inside[1:-1])
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edges = offsets[:-1][offsets[:-1] < len(data)]  # words don't run on from one text to the next
        first[edges] = inside[1:-1][edges]
        edges = offsets[1:][offsets[1:] > 0] - 1
        last[edges] = inside[1:-1][edges]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[data] * self.up[: len(data)])])
        words = (sums[end] - sums[start]) * self.down[start]
        counts = np.searchsorted(start, offsets)
        return mix(words + (end - start).astype(np.uint64), 7), np.diff(counts)


class Block:
    """The words of some texts one after the other, and their windows."""

    def __init__(self, texts: pa.Array, n: int, hashes: WordHashes) -> None:
        self.h, lengths = hashes(texts)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.n = n
        self.powers = {1: self.h}
        count = max(0, len(self.h) - n + 1)
        text = np.repeat(np.arange(len(texts)), lengths)[:count]
        whole = np.arange(count) + n <= self.ends[text]
        #: where windows that lie in one text begin, and in which text
        self.at, self.text = np.flatnonzero(whole), text[whole]

    def anchors(self) -> np.ndarray:
        """The anchor of every window."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        short = min(ANCHOR, self.n)
        low = runs(self.h, 1, short, self.powers, 1)
        left, span = self.n - short + 1, 1
        while span * 2 <= left:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < left:
            low = np.minimum(low[: span - left], low[left - span :])
        return low[self.at]

    def by_document(self, anchors: np.ndarray) -> np.ndarray:
        """Every anchor once for each text that has it."""
        if not len(anchors):
            return anchors
        new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (self.text[1:] != self.text[:-1])])
        values, text = anchors[new], self.text[new]
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        return values[np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])])]

    def digests(self, which: np.ndarray) -> list[np.ndarray]:
        """128 bits of the windows at these places, as two numbers."""
        out = []
        for salt in (2, 3):
            out.append(runs(self.h, 1, self.n, {1: mix(self.h, salt)}, salt)[self.at[which]])
        return out


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text, copy): `row` is a hash of the text, so that rows that repeat a doc_id are told apart, and `copy`
    says whether a document of smaller doc_id has the same text (by 128 bits)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("more"))
    several = docs.where("text IS NOT NULL").groupBy("row", "more").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    several = stored(several.where("first < last").drop("last"))
    few = several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(several) if few else several, ["row", "more"], "left").select("doc_id", "row", "text", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy"))
    return joined if few else stored(joined)  # with the texts shuffled, once is enough


def sketched(docs: DataFrame, n: int) -> np.ndarray:
    """The merged sketch of all windows: for every cell, whether two or more were counted there."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = LEAST_CELLS
    while cells < MOST_CELLS and cells < CELLS * total / BYTES:
        cells *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, hashes = Sketch(cells), WordHashes()
        for batch in blocks(batches, BLOCK):
            block = Block(batch.column(0), n, hashes)
            sketch.add(block.by_document(block.anchors()))
        for part in sketch.chunks():
            yield pa.RecordBatch.from_pylist([dict(zip(("place", "once", "twice"), part, strict=True))], schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if place in once:
                    twice[place] |= b | (once[place] & a)
                    once[place] |= a
                else:
                    once[place], twice[place] = a.copy(), b.copy()
        for place, b in twice.items():
            if b.any():
                yield pa.RecordBatch.from_pylist([{"place": place, "twice": b.tobytes()}], merged)

    schema = pa.schema([("place", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    merged = pa.schema([("place", pa.int32()), ("twice", pa.binary())])
    parts = docs.select("text").coalesce(MOST_TASKS).mapInArrow(released(build), "place int, once binary, twice binary")
    out = np.zeros((DEPTH, cells // 8), np.uint8)
    flat = out.reshape(-1)
    for place, bits in parts.repartition("place").mapInArrow(merge, "place int, twice binary").toLocalIterator():
        flat[place * min(CHUNK, cells // 8) :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def candidates(docs: DataFrame, n: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, row, at, h1, h2): windows estimated to be in several documents, with 128 bits of their words."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, twice = WordHashes(), sent.value
        for batch in blocks(batches, BLOCK):
            block = Block(batch.column(2), n, hashes)
            anchors = block.anchors()
            new = np.concatenate([[True], anchors[1:] != anchors[:-1]]) if len(anchors) else np.empty(0, bool)
            which = np.flatnonzero(repeated(twice, anchors[new])[np.cumsum(new) - 1])
            if not len(which):
                continue
            text = block.text[which]
            cols = [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array((block.at[which] - block.starts[text]).astype(np.int32))]
            cols += [pa.array(h.view(np.int64)) for h in block.digests(which)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "at", "h1", "h2"])

    return docs.select("doc_id", "row", "text").mapInArrow(released(run), "doc_id long, row long, at int, h1 long, h2 long")


def marks(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, row, starts): where windows of the keyed documents begin that also begin in a document of smaller doc_id,
    but for copies; a table of its own."""
    docs = docs.where("text IS NOT NULL AND doc_id IS NOT NULL AND NOT copy")
    with scratch() as keep:
        found = keep(candidates(docs, n, sketched(docs, n)))
        # a table of its own, so that both sides of the join are plain exchanges and a passage of very many documents is split
        firsts = keep(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
        later = found.join(firsts, ["h1", "h2"]).where("doc_id > first")
        # a set, since rows may repeat as a whole; it has at most the words of one text
        return stored(later.groupBy("doc_id", "row").agg(F.collect_set("at").alias("starts")))


def without_repeats(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of each row: its text without the words of windows of n words that also
    begin in a document of smaller doc_id; `removed` has the runs taken out as (first word, how many).

    Words are what ASCII white space separates; kept words are joined by one space. All windows are judged on the texts
    as given. A null or blank text has no words and keeps the empty text. Texts of fewer than n words stay whole. Rows
    that repeat a doc_id are judged one by one and take nothing from each other; rows without a doc_id take nothing from
    any other row and lose nothing. Other columns of docs don't matter. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    docs = keyed(docs)
    joined = docs.join(marks(docs, n), ["doc_id", "row"], "left").select("doc_id", "text", "copy", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK):
            rows = []
            for text, copy, starts in zip(*(batch.column(k).to_pylist() for k in (1, 2)), batch.column(3), strict=True):
                words = text.encode().split() if text else []
                total, gone = len(words), []
                if copy and total >= n:
                    words, gone = [], [{"start": 0, "length": total}]
                elif starts.is_valid:
                    edge = np.zeros(total + 1, np.int64)
                    at = np.asarray(starts.values)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n, -1)
                    free = np.cumsum(edge)[:-1] == 0
                    ends = np.flatnonzero(np.diff(np.concatenate([[True], free, [True]]).astype(np.int8)))
                    gone = [{"start": int(a), "length": int(b - a)} for a, b in zip(ends[::2], ends[1::2], strict=True)]
                    words = list(compress(words, free))
                rows.append((total, total - len(words), gone, b" ".join(words).decode()))
            values = [list(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names)

    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    types, names = [pa.int64(), pa.int64(), span, pa.string()], ["doc_id", "n_words", "n_removed", "removed", "kept"]
    return joined.mapInArrow(released(run), "doc_id long, n_words long, n_removed long, removed array<struct<start: long, length: long>>, kept string")


def summary(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; see without_repeats."""
    return without_repeats(docs, n).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
