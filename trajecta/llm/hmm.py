"""Language-model scoring with a hidden Markov model over words.

A hidden state moves at every token and emits a symbol: a frequent word, a class of rarer words (those with the same
hash of their last letters), or the end of the text. A class word then comes by its own smoothed share of its class.
The parameters are trained by Baum-Welch: every task runs forward and backward over its documents and gives expected
counts, which are summed across tasks. The likelihood of a text is exact, by the scaled forward recursion over all of
it. Tokens are words between ASCII white space with A-Z lowered, then one end.

What grows with the corpus (the counts of all words) stays in a table and is joined; the model holds a bounded number
of symbols.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import blocks, held_out, released, stored

STATES = 8
#: Most words that are symbols of their own, and the classes of all others.
FREQUENT, CLASSES = 30_000, 1024
SUFFIX = 3
#: Documents of which a first guess is made (the bound of the only sample), its rounds, and the rounds over all.
GUESS_DOCUMENTS, GUESS_ROUNDS, ROUNDS = 400, 12, 3
#: Longer texts run as pieces of so many tokens at the same time, whose messages are combined exactly.
PIECE = 1024
#: Symbols after which double messages that aren't kept are scaled: in double precision so many factors are far from underflow.
UNSCALED = 8
#: Weight of the corpus-wide distribution in each state's, in tokens.
SMOOTH = 50.0
#: Distinct words that a counting task keeps before it hands them on.
HELD = 300_000
FOLD, HELD_OUT = 7, 2
END = 0


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def class_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-SUFFIX:]) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of each word in all rows; texts may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words(text))
                if len(found) > HELD:
                    yield out()
                    found.clear()
        yield out()

    return docs.select("text").mapInArrow(released(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Symbols(dict):
    """Symbol of a word: 0 is the end, then the frequent words, then the classes."""

    def __init__(self, frequent: list[bytes]):
        super().__init__({w: k for k, w in enumerate(frequent, 1)})
        self.frequent = self.known = len(frequent)
        self.size = 1 + self.frequent + CLASSES

    def __missing__(self, word: bytes) -> int:
        symbol = 1 + self.frequent + class_of(word)
        if self.known < self.frequent + HELD:  # rarer words are looked up once, as long as there is room
            self.known += 1
            self[word] = symbol
        return symbol


class HMM:
    """start [states], move [states, states], emit [symbols, states]."""

    def __init__(self, unigram: np.ndarray, states: int = STATES, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.unigram = unigram
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9 if states > 1 else 1.0)
        emit = unigram[:, None] * np.exp(rng.normal(0, 0.5, (len(unigram), states)))
        self.emit = emit / emit.sum(axis=0)

    def update(self, counts: dict[str, np.ndarray]) -> None:
        """The most likely parameters for expected counts, drawn a little to the corpus-wide distribution."""
        start, move, emit = counts["start"] + 1e-3, counts["move"] + 1e-3, counts["emit"] + SMOOTH * self.unigram[:, None]
        self.start, self.move, self.emit = start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)

    def _forward(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, keep: bool):
        """Scaled forward messages of many sequences at once, the longest first; first: distributions before each. They
        are as precise as those are. Double ones that aren't kept are scaled after every few symbols and at the end, which
        changes no result: what is scaled by cancels out."""
        move, emit = self.move.astype(first.dtype), self.emit.astype(first.dtype)
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        logs = np.zeros(len(lengths))
        total = int(lengths.sum())
        messages = np.empty((total, len(self.start)), np.float32) if keep else None
        scales, seen = (np.empty(total, np.float32), np.empty(total, np.int64)) if keep else (None, None)
        alpha, base = first, 0
        last, one = np.empty((len(lengths), len(self.start)), first.dtype), np.ones(len(self.start), first.dtype)
        for t in range(steps):
            n = active[t]
            if n < len(alpha):
                last[n : len(alpha)] = alpha[n:]
            symbols = flat[starts[:n] + t]
            alpha = alpha[:n] * emit.take(symbols, 0) if t == 0 else alpha[:n] @ move
            if t:
                alpha *= emit.take(symbols, 0)
            if keep or first.dtype == np.float32 or t % UNSCALED == UNSCALED - 1:
                scale = alpha @ one
                alpha /= scale[:, None]
                logs[:n] += np.log(scale)
            if keep:
                messages[base : base + n], scales[base : base + n], seen[base : base + n] = alpha, scale, symbols
            base += n
        if steps:
            last[: len(alpha)] = alpha
        if steps and not keep:
            scale = last @ one
            last /= scale[:, None]
            logs += np.log(scale)
        return logs, last, messages, scales, seen, active

    def _pieces(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequences cut into pieces of at most PIECE symbols: where each begins, its length, its sequence, and whether
        another piece of the sequence comes before it."""
        lengths = np.diff(offsets).astype(np.int64)
        count = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(lengths)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts = offsets[:-1][owner].astype(np.int64) + place * PIECE
        return starts, np.minimum(PIECE, offsets[1:][owner] - starts).astype(np.int64), owner, place > 0

    def _across(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, later: np.ndarray, precise: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces run at the same time, a first one from the start and a later one from each state: (logs, last
        messages) of all runs, and where each piece's runs begin."""
        copies = np.where(later, len(self.start), 1)
        first = np.concatenate([self.move if x else self.start[None] for x in later] or [np.empty((0, len(self.start)))])
        starts, lengths = np.repeat(starts, copies), np.repeat(lengths, copies)
        order = np.argsort(-lengths, kind="stable")
        logs, last = np.empty(len(order)), np.empty((len(order), len(self.start)))
        logs[order], last[order] = self._forward(flat, starts[order], lengths[order], first[order].astype(precise), False)[:2]
        return logs, last, np.cumsum(copies) - copies

    def log10_likelihood(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each sequence of symbols, exactly. Long ones run in pieces at the same time: a later piece is run once
        from each state, and the pieces' results are combined in order."""
        states, out = len(self.start), np.zeros(len(offsets) - 1)
        starts, lengths, owner, later = self._pieces(offsets)
        logs, last, where = self._across(flat, starts, lengths, later)
        out[owner[~later]] = logs[where[~later]]
        for p in np.flatnonzero(later):
            if not later[p - 1]:
                state = last[where[p - 1]]
            rows = slice(where[p], where[p] + states)
            top = logs[rows].max()
            weights = state * np.exp(logs[rows] - top)
            state = weights @ last[rows]
            out[owner[p]] += top + math.log(weights.sum())
            state = state / weights.sum()
        return out / math.log(10)

    def expected(self, flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Expected counts of starts, moves and emissions (the E step) over sequences of symbols, up to single precision:
        nothing is left out, but messages within and across pieces have about seven digits.

        Pieces of a long sequence run at the same time here too: the messages at their borders come first, from what
        each piece does to every state, and then each piece runs once between the messages on its two sides.
        """
        states, symbols = len(self.start), len(self.emit)
        starts, lengths, owner, later = self._pieces(offsets)
        counts = {"start": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((symbols, states)), "log": np.zeros(1)}
        if not len(starts):
            return counts
        # of each piece: the distribution before its first symbol, that at the end of the piece before, and the backward
        # message at its end
        initial, before, final = np.tile(self.start, (len(starts), 1)), np.zeros((len(starts), states)), np.ones((len(starts), states))
        cut_up = np.flatnonzero(np.bincount(owner)[owner] > 1)
        if len(cut_up):
            logs, last, where = self._across(flat, starts[cut_up], lengths[cut_up], later[cut_up], np.float32)
            ends, steps = {}, {}
            for p, at in zip(cut_up.tolist(), where.tolist(), strict=True):
                if not later[p]:
                    ends[p] = last[at]
                    continue
                rows = slice(at, at + states)
                steps[p] = np.exp(logs[rows] - logs[rows].max())[:, None] * last[rows]
                before[p], initial[p] = ends[p - 1], ends[p - 1] @ self.move
                ends[p] = ends[p - 1] @ steps[p]
                ends[p] /= ends[p].sum()
            ahead = np.ones(states)
            for p in cut_up[::-1].tolist():
                final[p] = ahead / (ends[p] @ ahead)
                ahead = steps[p] @ ahead if later[p] else np.ones(states)
                ahead = ahead / ahead.sum()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, later, initial, before, final = (x[order] for x in (starts, lengths, later, initial, before, final))
        # single precision does for messages of counts, which are summed in double precision
        logs, _, messages, scales, seen, active = self._forward(flat, starts, lengths, initial.astype(np.float32), True)
        move, emit, final = self.move.T.astype(np.float32), self.emit.astype(np.float32), final.astype(np.float32)
        counts["log"][0] = logs.sum()
        base = np.concatenate([[0], np.cumsum(active)])
        beta = np.ones((0, states), np.float32)
        pairs = np.zeros((states, states))
        for t in range(len(active) - 1, -1, -1):
            n, a = active[t], base[t]
            new = final[:n].copy()
            if len(beta):
                m = len(beta)
                ahead = beta * emit[seen[base[t + 1] : base[t + 1] + m]] / scales[base[t + 1] : base[t + 1] + m, None]
                pairs += messages[a : a + m].T @ ahead
                new[:m] = ahead @ move
            beta = new
            messages[a : a + n] *= beta
        n = active[0]
        if later.any():  # the moves from one piece into the next
            pairs += before[later].T @ (beta * emit[seen[:n]] / scales[:n, None])[later]
        counts["move"] = pairs * self.move
        counts["start"] = messages[:n][~later].sum(axis=0, dtype=np.float64)
        for s in range(states):
            counts["emit"][:, s] = np.bincount(seen, messages[:, s], symbols)
        return counts


def encoded(texts: list[str | None], symbols: Symbols, rare: list[Counter] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with its end, and where each begins. rare takes each text's words without a symbol of
    their own."""
    lists = []
    for text in texts:
        w = words(text)
        row = np.full(len(w) + 1, END, np.int32)
        row[:-1] = np.fromiter(map(symbols.__getitem__, w), np.int32, len(w))
        lists.append(row)
        if rare is not None:
            rare.append(Counter([w[i] for i in np.flatnonzero(row > symbols.frequent).tolist()]))
    return np.concatenate([*lists, np.empty(0, np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


class Model:
    """What scoring needs: the symbols with their counts, the HMM, and the classes' sizes."""

    def __init__(self, frequent: list[bytes], counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, documents: int):
        self.frequent, self.counts, self.class_tokens, self.class_words, self.documents = frequent, counts, class_tokens, class_words, documents
        # the end is a token, and a distinct one as soon as there is a document
        self.tokens = int(counts.sum() + class_tokens.sum()) + documents
        self.distinct = len(frequent) + int(class_words.sum()) + (documents > 0)
        mass = np.concatenate([[documents], counts, class_tokens]) + 1.0
        self.hmm = HMM(mass / mass.sum())


def most_frequent(counts: DataFrame, most: int) -> Column:
    """Whether a row (word, c) is among the `most` with the largest counts, of equal counts the first by their bytes."""
    band = F.floor(F.log2("c") * 8)
    sizes = {r[0]: r[1] for r in counts.groupBy(band.alias("b")).count().collect()}
    above = 0
    for b in sorted(sizes, reverse=True):
        if above + sizes[b] > most:
            break
        above += sizes[b]
    else:
        return F.lit(True)
    # the counts within the band in which the bound is passed, then the words with just that count
    for r in counts.where(band == b).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        if above + r["n"] > most:
            break
        above += r["n"]
    ties = counts.where(F.col("c") == r["c"]).select("word").orderBy("word").limit(most - above).agg(F.max("word")).first()[0]
    more = F.col("c") > r["c"]
    return more if ties is None else more | ((F.col("c") == r["c"]) & (F.col("word") <= F.lit(bytearray(ties))))


def vocabulary(counts: DataFrame, documents: int, most: int = FREQUENT) -> Model:
    """The most frequent words, at most `most`, and the number of tokens and words in each class of the others."""
    chosen = most_frequent(counts, most)
    top = counts.where(chosen).orderBy(F.desc("c"), "word").toPandas()
    frequent = [bytes(w) for w in top.word]
    rest = counts.where(~chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            own = np.fromiter(map(class_of, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            tokens += np.bincount(own, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            kinds += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(kinds)], ["k", "tokens", "kinds"])

    sums = {r[0]: r for r in rest.mapInArrow(released(run), "k long, tokens long, kinds long").groupBy("k").agg(F.sum("tokens"), F.sum("kinds")).collect()}
    class_tokens, class_words = (np.array([sums[k][c] if k in sums else 0 for k in range(CLASSES)], np.int64) for c in (1, 2))
    return Model(frequent, top.c.to_numpy(np.int64), class_tokens, class_words, documents)


def sequence_blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many symbols, one row at least."""
    for batch in batches:
        lengths = np.diff(np.asarray(batch.column(0).offsets, np.int64))
        group = (np.cumsum(lengths) - 1) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def total_counts(hmm: HMM, batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """Expected counts of all rows; None without rows."""
    total = None
    for batch in sequence_blocks(batches, 1_000_000):
        column = batch.column(0)
        offsets = np.asarray(column.offsets, np.int64)
        own = hmm.expected(np.asarray(column.flatten()), offsets - offsets[0])
        total = own if total is None else {k: total[k] + own[k] for k in own}
    return total


def baum_welch(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Expected counts over all rows, summed across tasks, `rounds` times; the first guess comes from
    the whole texts of at most GUESS_DOCUMENTS documents."""
    hmm, frequent = model.hmm, model.frequent
    ids = [r[0] for r in docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(GUESS_DOCUMENTS).collect()]
    guess = docs.where(F.col("doc_id").isin(ids)).orderBy("doc_id", "text").select("text").toPandas().text.tolist()
    flat, offsets = encoded(guess, Symbols(frequent))
    # whole texts, some at a time, to bound what one pass holds at once
    table = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], ["symbols"])
    for _ in range(GUESS_ROUNDS if len(offsets) > 1 else 0):
        hmm.update(total_counts(hmm, [table]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(frequent)
        for batch in blocks(batches, 6_000_000):
            flat, offsets = encoded(batch.column(0).to_pylist(), symbols)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))], ["symbols"])

    # every round reads the symbols, which are smaller than the texts and need no look-up
    sequences = stored(docs.select("text").mapInArrow(released(encode), "symbols array<int>"))
    states = len(hmm.start)
    columns = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        # row -1 has the starts, rows -2-k the moves from state k, others the symbols

        def run(batches: Iterator[pa.RecordBatch], hmm: HMM = hmm) -> Iterator[pa.RecordBatch]:
            total = total_counts(hmm, batches)
            if total is None:
                return
            used = np.flatnonzero(total["emit"].any(axis=1))
            key = np.concatenate([[-1], -2 - np.arange(states), used])
            rows = np.concatenate([total["start"][None], total["move"], total["emit"][used]])
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(rows[:, k]) for k in range(states))], ["key", *columns])

        sums = sequences.mapInArrow(released(run), "key long, " + ", ".join(f"{c} double" for c in columns)).groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
        if not len(sums):
            break
        key, rows = sums.key.to_numpy(), sums[columns].to_numpy()
        counts = {"start": rows[key == -1][0], "move": np.zeros((states, states)), "emit": np.zeros((len(hmm.emit), states))}
        counts["move"][-2 - key[key < -1]] = rows[key < -1]
        counts["emit"][key[key >= 0]] = rows[key >= 0]
        hmm.update(counts)
    return model


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the rows' texts, and the table (word, c) of all their words."""
    counts = stored(word_counts(docs))
    model = vocabulary(counts, docs.count())
    return (baum_welch(docs, model, rounds) if model.documents else model), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row, the scores as log10 probabilities.

    A null text is an empty one and has only its end. base_score is the add-one unigram model's. Rows that repeat a
    doc_id each get a row; other columns are ignored. Without training text every word is unknown.

    A document's parts are brought together by its id and a hash of its text, which don't depend on the order in which
    a task reads, so a task that is run again gives the same parts. Rows that repeat both are counted and spelled out
    again at the end.
    """
    den = math.log10(model.tokens + model.distinct + 1)
    shares = np.log10(model.class_tokens + model.class_words + 1.0)
    known = np.concatenate([[model.documents], model.counts])
    base_of = np.log10(known + 1.0) - den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, own = Symbols(model.frequent), len(model.frequent)
        names = ["row", "doc_id", "word", "tf", "n_tokens", "n_known", "base", "score"]

        def table(row: np.ndarray, docs: pa.Array, word: list[bytes], tf: np.ndarray, n: np.ndarray, seen: np.ndarray, base: np.ndarray, likely: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row), docs, pa.array(word, pa.binary()), pa.array(tf), pa.array(n), pa.array(seen), pa.array(base), pa.array(likely)], names)

        for batch in blocks(batches, 6_000_000):
            rare: list[Counter] = []
            texts = batch.column(1).to_pylist()
            flat, offsets = encoded(texts, symbols, rare)
            likelihood = model.hmm.log10_likelihood(flat, offsets)
            n = np.diff(offsets)
            common = flat <= own
            starts = offsets[:-1]  # every text has its end, so no range is empty
            seen = np.add.reduceat(common & (known[np.where(common, flat, 0)] > 0), starts, dtype=np.int64)
            base = np.add.reduceat(np.where(common, base_of[np.where(common, flat, 0)], 0.0), starts)
            likelihood -= np.add.reduceat(np.where(common, 0.0, shares[np.where(common, 0, flat - own - 1)]), starts)
            rows = np.array([xxhash.xxh3_64_intdigest(t or "") for t in texts], np.uint64).view(np.int64)
            # the key of the document's own row is no word, since words have no blanks
            yield table(rows, batch.column(0), [b" %d" % r for r in rows], np.zeros(len(n), np.int64), n, seen, base, likelihood)
            sizes = np.array([len(c) for c in rare])
            at = np.repeat(np.arange(len(n)), sizes)
            zero, none = np.zeros(len(at), np.int64), np.zeros(len(at))
            tf = np.fromiter(chain.from_iterable(c.values() for c in rare), np.int64, len(at))
            yield table(rows[at], batch.column(0).take(pa.array(at)), list(chain.from_iterable(rare)), tf, zero, zero, none, none)

    parts = docs.select("doc_id", "text").mapInArrow(released(run), "row long, doc_id long, word binary, tf long, n_tokens long, n_known long, base double, score double").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    gain = F.col("tf") * F.log10(c + 1)
    sums = {"copies": F.when(F.col("n_tokens") > 0, 1), "n_tokens": F.col("n_tokens"), "n_known": F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0), "base_score": F.col("base") + gain - F.col("tf") * den, "score": F.col("score") + gain}
    summed = parts.groupBy("row", "doc_id").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    each = summed.select("*", F.explode(F.expr("array_repeat(0, CAST(copies AS int))")))
    return each.select("doc_id", F.expr("n_tokens div copies").alias("n_tokens"), F.expr("n_known div copies").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.expr("base_score / copies").alias("base_score"), F.expr("score / copies").alias("score"))


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold (crc32 of doc_id mod 7 is 2) and score every row. Rows without a
    doc_id aren't learned from, so they count as held out."""
    model, counts = fit(docs.where(~held_out("doc_id", FOLD, HELD_OUT)))
    scored = score(docs, model, counts)
    return scored.select("doc_id", held_out("doc_id", FOLD, HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
