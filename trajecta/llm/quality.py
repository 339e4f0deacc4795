"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over all bytes of a text, in overlapping chunks that cover the whole of it. Each filter is
max-pooled over a chunk; over the chunks of a document, the largest and the mean of those maxima are combined into one
probability. Memory depends on the chunk, not on the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import blocks, bounded_sample, flat_bytes, held_out, padded_rows, released, small_batches

#: Bytes that a chunk begins at its own place; its last filters read into the next chunk (the overlap).
CHUNK = 128
FILTERS, SPAN = 16, 6
#: Most documents of either label that the network is fitted on, and the most characters of one; a longer one gives so
#: many pieces, spread evenly from its first to its last character.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_PIECES = 1600, 8192, 8
EPOCHS = 14
#: A document is kept if its score reaches this.
KEEP = 0.3
#: Chunks that run through the filters at once.
WIDTH = 512


class ByteCNN:
    """E byte embeddings, W filters over SPAN embedded bytes, b their bias, v and c the combination."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = {"E": rng.normal(0, 0.5, (256, 8)), "W": rng.normal(0, 0.2, (SPAN, 8, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1)}

    def tables(self) -> list[np.ndarray]:
        """What each byte adds to the filters at each place of the span."""
        return [np.ascontiguousarray(self.w["E"] @ self.w["W"][j], dtype=np.float32) for j in range(SPAN)]

    def maxima(self, rows: np.ndarray, real: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest activation of each filter in each chunk (0 at least), and its place. real: the chunk's own bytes.

        `rows` are the chunks of whole documents one after the other; every document ends in SPAN - 1 zeros at least.
        """
        flat = np.concatenate([rows.reshape(-1), np.zeros(SPAN - 1, np.uint8)]).astype(np.intp)
        tables, n = self.tables(), len(rows)
        out = np.empty((n, FILTERS), np.float32)
        at = np.empty((n, FILTERS), np.int32) if where else None
        acc, part = (np.empty((min(n, WIDTH) * CHUNK, FILTERS), np.float32) for _ in range(2))
        for k in range(0, n, WIDTH):
            m = min(WIDTH, n - k)
            a, p = acc[: m * CHUNK], part[: m * CHUNK]
            np.take(tables[0], flat[k * CHUNK : (k + m) * CHUNK], axis=0, out=a, mode="clip")
            for j in range(1, SPAN):
                np.take(tables[j], flat[k * CHUNK + j : (k + m) * CHUNK + j], axis=0, out=p, mode="clip")
                a += p
            for short in np.flatnonzero(real[k : k + m] < CHUNK):
                a[short * CHUNK + real[k + short] : (short + 1) * CHUNK] = -np.inf
            a = a.reshape(m, CHUNK, FILTERS)
            if at is None:
                half = CHUNK
                while half > 1:  # pairwise, so that each step runs over contiguous memory
                    half //= 2
                    np.maximum(a[:, :half], a[:, half : 2 * half], out=a[:, :half])
                out[k : k + m] = a[:, 0]
            else:
                at[k : k + m] = a.argmax(axis=1)
                out[k : k + m] = np.take_along_axis(a, at[k : k + m, None].astype(np.intp), 1)[:, 0]
        out += self.w["b"].astype(np.float32)
        np.maximum(out, 0, out=out)
        return out, at

    def features(self, pooled: np.ndarray, units: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(units)[:-1]])
        return np.concatenate([np.maximum.reduceat(pooled, starts), np.add.reduceat(pooled, starts) / units[:, None]], axis=1)

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability for each row of bytes."""
        rows, units, real = chunked(data, offsets)
        pooled, _ = self.maxima(rows, real)
        x = self.features(pooled.astype(np.float64), units) @ self.w["v"] + self.w["c"]
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def fit(self, data: np.ndarray, offsets: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int, batch: int = 48, rate: float = 0.01, seed: int = 3) -> None:
        rows, units, real = chunked(data, offsets)
        first_row = np.concatenate([[0], np.cumsum(units)])
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        total = max(1, epochs * -(-len(units) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(units))
            for k in range(0, len(units), batch):
                own = order[k : k + batch]
                chosen = np.concatenate([np.arange(first_row[d], first_row[d + 1]) for d in own])
                grads = self.gradients(rows[chosen], units[own], real[chosen], target[own], weight[own])
                step += 1
                now = rate * (1 - (step - 1) / total) + 1e-5
                for name, g in grads.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.w[name] -= now * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)

    def gradients(self, rows: np.ndarray, units: np.ndarray, real: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Of the weighted log loss; a maximum passes its gradient to the bytes under its place."""
        pooled, at = self.maxima(rows, real, where=True)
        feats = self.features(pooled.astype(np.float64), units)
        p = 1 / (1 + np.exp(-np.clip(feats @ self.w["v"] + self.w["c"], -60, 60)))
        delta = (p - target) * weight / max(1e-9, weight.sum())
        grads = {"v": feats.T @ delta + 1e-4 * self.w["v"], "c": np.array([delta.sum()])}
        owner = np.repeat(np.arange(len(units)), units)
        back = delta[owner, None] * self.w["v"][None, FILTERS:] / units[owner, None]
        largest = pooled == feats[owner, :FILTERS]
        back += largest * delta[owner, None] * self.w["v"][None, :FILTERS]
        back *= pooled > 0
        grads["b"] = back.sum(axis=0)
        flat = np.concatenate([rows.reshape(-1), np.zeros(SPAN - 1, np.uint8)])
        base = (np.arange(len(rows)) * CHUNK)[:, None] + at
        grads["E"], grads["W"] = np.zeros_like(self.w["E"]), np.zeros_like(self.w["W"])
        for j in range(SPAN):
            under = flat[base + j]
            table = np.stack([np.bincount(under[:, f], back[:, f], 256) for f in range(FILTERS)], axis=1)
            grads["W"][j] = self.w["E"].T @ table
            grads["E"] += table @ self.w["W"][j].T
        return grads


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of each row, their number by row, and each chunk's own bytes."""
    rows, units = padded_rows(data, offsets, CHUNK, SPAN - 1)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(units) - units, units)
    real = np.clip(np.repeat(np.diff(offsets), units) - place * CHUNK, 0, CHUNK)
    return rows, units, real


def spread(text: Column, chars: int = SAMPLE_CHARS, pieces: int = SAMPLE_PIECES) -> Column:
    """The text, or of a text over `chars` characters, `pieces` pieces from all over it that make up as many."""
    size, n = chars // pieces, F.length(text)
    parts = [F.substring(text, (F.floor((n - size) * F.lit(k) / max(1, pieces - 1)) + 1).cast("int"), F.lit(size)) for k in range(pieces)]
    return F.when(n <= chars, text).otherwise(F.concat(*parts))


def fit(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> ByteCNN | None:
    """A network fitted on a bounded sample of labelled rows; None if no row is labelled 0 or 1.

    The bound: `documents` rows of each label, `chars` characters of each, spread over longer texts. They are weighted
    so that the labels keep their proportion among all rows of docs that have one; labels of other documents play no
    part. Repeated label rows of a document count once (1 before 0); null labels not at all.
    """
    marks = labels.select("doc_id", "quality").where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.where(F.col("text").isNotNull())
    rows, n = bounded_sample(texts.select("doc_id").join(marks, "doc_id"), texts.select("doc_id", spread(F.col("text"), chars).alias("text")), "quality", documents)
    rows = rows.orderBy("doc_id", "text").select("text", "quality").toPandas()
    if not len(rows):
        return None
    target = rows.quality.to_numpy().astype(float)
    model = ByteCNN()
    data, offsets = flat_bytes(pa.array(rows.text.tolist(), pa.string()))
    weight = np.array([n[int(y)] / max(1, (target == y).sum()) for y in (0.0, 1.0)] if len(n) == 2 else [1.0, 1.0])
    model.fit(data, offsets, target, weight[target.astype(int)], epochs)
    return model


def score(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """(doc_id, score) for every row, null texts as empty ones; 0.5 if nothing could be learned. Rows that repeat a
    doc_id each get a row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1_000_000):
            p = model.probability(*flat_bytes(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled rows outside the held-out fold (crc32 of doc_id mod 5 is 0) and score every row. Rows without a
    doc_id aren't learned from, so they count as held out."""
    scored = score(docs, fit(docs.where(~held_out("doc_id", 5, 0)), labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject; it is fitted as in classify().

    Every row is judged on its own text: rows that repeat a doc_id may fare differently, and equal texts fare alike. A
    null text is judged as an empty one. Without a label nothing is rejected. All columns stay as they are.
    """
    model = fit(docs.where(~held_out("doc_id", 5, 0)), labels)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1_000_000):
            kept = model.probability(*flat_bytes(batch.column(names.index("text")))) >= KEEP if model else np.ones(batch.num_rows, bool)
            yield batch.filter(pa.array(kept))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), schema)
