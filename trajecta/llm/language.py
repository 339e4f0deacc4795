"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read each chunk of a text from either end; at every byte their states give one distribution over the learned
languages. A document's distribution is the mean over all its bytes. The network is trained here by backpropagation
through time, in numpy. Chunks of CHUNK bytes cover the whole text, so long texts need no more memory than short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import blocks, bounded_sample, flat_bytes, held_out, padded_rows, released, small_batches

CHUNK = 128
HIDDEN = 8
#: Chunks that run through the network at once: their states stay in the processor's cache.
WIDTH = 1024
#: Most documents of a language, and most chunks of a document, that the network is fitted on.
SAMPLE_DOCUMENTS, SAMPLE_CHUNKS = 300, 6
EPOCHS = 9
LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category (superscripts, fractions and other numbers have none)."""
    return bool(text) and (LETTER.search(text) is not None or any(map(str.isalpha, text)))


class BiGRU:
    """Weights by direction (0: left to right, 1: right to left): X byte table, U recurrent, B bias, V output; c output bias.

    Gates are laid out as reset, update, candidate, HIDDEN columns each.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h, self.classes = hidden, classes
        self.w = {"c": np.zeros(classes, np.float32)}
        for d in (0, 1):
            self.w[f"X{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[f"U{d}"] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.w[f"V{d}"] = rng.normal(0, 0.3, (hidden, classes)).astype(np.float32)

    def states(self, rows: np.ndarray) -> np.ndarray:
        """Hidden states of every position, [direction, length, rows, hidden]."""
        n, length = rows.shape
        h = self.h
        out = np.empty((2, length, n, h), np.float32)
        by_step = np.ascontiguousarray(rows.T).astype(np.intp)
        x, u = np.empty((3, n, h), np.float32), np.empty((3, n, h), np.float32)
        for d in (0, 1):
            # a sigmoid is a tanh of half its argument, so the halves go into the weights
            table, rec = (np.ascontiguousarray(np.stack(np.split(self.w[f"{k}{d}"], 3, axis=1)) * np.float32([[[0.5]], [[0.5]], [[1]]])) for k in "XU")
            old = np.zeros((n, h), np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                np.matmul(old, rec, out=u)
                for gate in range(3):
                    np.take(table[gate], by_step[t], axis=0, out=x[gate], mode="clip")
                gates, candidate, new = x[:2], x[2], out[d, t]
                gates += u[:2]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                u[2] *= gates[0]
                candidate += u[2]
                np.tanh(candidate, out=candidate)
                np.subtract(old, candidate, out=new)
                new *= gates[1]
                new += candidate
                old = new
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """The distribution of every position, [classes, length, rows]."""
        n, length = rows.shape
        s = self.states(rows).reshape(2, length * n, self.h)
        logits = np.matmul(self.w["V0"].T, s[0].T)
        logits += np.matmul(self.w["V1"].T, s[1].T)
        logits += self.w["c"][:, None]
        np.minimum(logits, 80, out=logits)  # states lie in -1..1, so only extreme weights come near what exp can hold
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0) + np.float32(1e-30)
        return logits.reshape(self.classes, length, n)

    def gradients(self, rows: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the unmasked positions, and its gradients by backpropagation through time."""
        n, length = rows.shape
        h, w = self.h, self.w
        tapes, logits = [], np.zeros((length, n, self.classes), np.float32) + w["c"]
        for d in (0, 1):
            state, tape = np.zeros((n, h), np.float32), []
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                x, u = w[f"X{d}"][rows[:, t]], state @ w[f"U{d}"]
                gates = 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + u[:, : 2 * h])) + 0.5
                r, z = gates[:, :h], gates[:, h:]
                cand = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                new = cand + z * (state - cand)
                tape.append((t, state, r, z, cand, u[:, 2 * h :], new))
                state = new
                logits[t] += state @ w[f"V{d}"]
            tapes.append(tape)
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        weight = (mask.T / max(1, mask.sum())).astype(np.float32)
        loss = -float((np.log(p[:, np.arange(n), target] + 1e-9) * weight).sum())
        p[:, np.arange(n), target] -= 1
        delta = p * weight[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["c"] = delta.sum(axis=(0, 1))
        flat = rows.T.ravel()
        order = np.argsort(flat, kind="stable")
        for d in (0, 1):
            back, pres = np.zeros((n, h), np.float32), np.empty((length, n, 3 * h), np.float32)
            for t, old, r, z, cand, uc, new in reversed(tapes[d]):
                grads[f"V{d}"] += new.T @ delta[t]
                back = back + delta[t] @ w[f"V{d}"].T
                dz, dc = back * (old - cand), back * (1 - z)
                dc *= 1 - cand**2
                dr = dc * uc
                pre = np.concatenate([dr * r * (1 - r), dz * z * (1 - z), dc], axis=1)
                pres[t] = pre
                pre[:, 2 * h :] *= r
                grads[f"U{d}"] += old.T @ pre
                back = back * z + pre @ w[f"U{d}"].T
            seen, starts = np.unique(flat[order], return_index=True)
            grads[f"X{d}"][seen] = np.add.reduceat(pres.reshape(-1, 3 * h)[order], starts)
        return loss, grads

    def fit(self, rows: np.ndarray, mask: np.ndarray, target: np.ndarray, epochs: int, batch: int = 256, rate: float = 0.02, seed: int = 11) -> None:
        """Adam over shuffled batches with a falling rate."""
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        total = max(1, epochs * -(-len(rows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), batch):
                own = order[k : k + batch]
                _, grads = self.gradients(rows[own], mask[own], target[own])
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                step += 1
                now = rate * (1 - (step - 1) / total) + 1e-4
                for name, g in grads.items():
                    g = g / max(1.0, norm)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    self.w[name] -= (now * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, chunks: int = SAMPLE_CHUNKS, epochs: int = EPOCHS) -> tuple[BiGRU, list[str]] | None:
    """A network fitted on a bounded sample of rows with text and lang; None if no row has both.

    The bound: `documents` rows of each language, `chunks` chunks spread over each of them.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    n = F.octet_length("text")
    size = CHUNK * chunks
    # a long text gives its first and last bytes and some between, so the sample's size is bounded too
    picked = F.when(n <= size, F.col("text")).otherwise(F.concat(*(F.substring("text", (F.length("text") * F.lit(k) / chunks).cast("int") + 1, F.lit(CHUNK)) for k in range(chunks))))
    rows, _ = bounded_sample(known.select("doc_id", "lang"), known.select("doc_id", picked.alias("text")), "lang", documents)
    rows = rows.orderBy("doc_id", "text").toPandas()
    if not len(rows):
        return None
    langs = sorted(rows.lang.unique())
    column = pa.array(rows.text.tolist(), pa.string())
    data, offsets = flat_bytes(column)
    chunked, units = padded_rows(data, offsets, CHUNK)
    target = np.repeat([langs.index(x) for x in rows.lang], units)
    model = BiGRU(len(langs))
    model.fit(chunked, chunked > 0, target, epochs)
    return model, langs


def document_probabilities(model: BiGRU, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean distribution over the bytes of each row; rows without bytes get zeros."""
    chunked, units = padded_rows(data, offsets, CHUNK)
    owner = np.repeat(np.arange(len(units)), units)
    sums = np.zeros((len(chunked), model.classes))
    real = chunked > 0
    for k in range(0, len(chunked), WIDTH):
        p = model.probabilities(chunked[k : k + WIDTH])
        p *= real[k : k + WIDTH].T
        sums[k : k + WIDTH] = p.sum(axis=1).T
    out = np.stack([np.bincount(owner, sums[:, c], len(units)) for c in range(model.classes)], axis=1)
    return out / np.maximum(1e-9, out.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, fitted: tuple[BiGRU, list[str]] | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; `und` with score 0 if the text is null or has no letter, or if nothing
    could be learned. Rows that repeat a doc_id each get a row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1_000_000):
            ids, texts = batch.column(0), batch.column(1)
            if fitted is None:
                best, top = ["und"] * len(ids), np.zeros(len(ids))
            else:
                model, langs = fitted
                p = document_probabilities(model, *flat_bytes(texts))
                letters = np.array([has_letter(x) for x in texts.to_pylist()], bool)
                best = [langs[c] if ok else "und" for c, ok in zip(p.argmax(axis=1), letters, strict=True)]
                top = np.where(letters, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.string()), pa.array(top, pa.float64())], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside the held-out fold (crc32 of doc_id mod 5 is 0) and predict every row. Rows without a
    doc_id aren't learned from, so they count as held out."""
    fitted = fit(docs.where(~held_out("doc_id", 5, 0)))
    return predict(docs, fitted).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
