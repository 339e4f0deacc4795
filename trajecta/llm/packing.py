"""Packing of documents into token sequences along a space-filling curve.

A document's hashed vector (byte 4-grams, signed) is projected to a few dimensions; their Hilbert key orders the
documents so that neighbours on the curve are alike. The range-sorted documents are laid end to end and cut at the
sequence length, so every sequence is full. What is left at the end of a range is cut into powers of two, which need
no padding either.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import blocks, flat_bytes, released, small_batches

LENGTH = 2048
END = 1
_END = END.to_bytes(4, "little")
#: Dimensions and bits of the curve; their product is under 63.
DIMENSIONS, BITS = 4, 12
BUCKETS = 4096
#: Bytes of input for which a range of the curve is cut, where that makes more ranges than the session's partitions.
RANGE_BYTES, MOST_RANGES = 64 << 20, 100_000
#: Rows of a range in the sample that shares out the ranges.
BOUND_ROWS = 60
#: Rows of the sample that bounds are taken from, about, where ranges are many; and the least a range.
SAMPLE_ROWS, LEAST_ROWS = 600_000, 6
#: Stands for a missing id in the order of the ranges.
NO_ID = -(1 << 63)
#: Words whose ids a worker process remembers; if there are more, the first half stays, which has the frequent ones.
REMEMBERED = 200_000


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points [rows, dimensions] with integer coordinates under 2^bits.

    Rotates and reflects each level of the grid into the frame of the curve, then takes the Gray code's rank.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(dims):
            upper = (x[d] & level) > 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) > 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


def coordinates(data: np.ndarray, offsets: np.ndarray, dims: int = DIMENSIONS, seed: int = 17) -> np.ndarray:
    """Projections of the hashed byte 4-grams of each row, as shares of the unit interval; empty rows lie in the middle."""
    directions = np.random.default_rng(seed).normal(0, 1, (dims, BUCKETS)).astype(np.float32)
    out = np.zeros((len(offsets) - 1, dims))
    if len(data) >= 4:
        d = data.astype(np.uint32)
        grams = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
        hashed = (grams * np.uint32(2654435761)) >> np.uint32(20)
        for k in range(len(offsets) - 1):
            own = hashed[offsets[k] : max(offsets[k], offsets[k + 1] - 3)]
            if len(own):
                counts = np.bincount(own, minlength=BUCKETS).astype(np.float32)
                out[k] = directions @ (counts / np.linalg.norm(counts))
    # the projection of a unit vector on a normal direction is normal, so this spreads it over the unit interval
    return 1 / (1 + np.exp(-1.702 * out))


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return hilbert_keys(np.minimum((coordinates(data, offsets) * 2**BITS).astype(np.int64), 2**BITS - 1))


#: ASCII signs that the tokenizer takes as runs of their own; the apostrophe isn't one, since it begins contractions.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


#: Letters beyond ASCII that are taken apart from signs: Latin, Greek and Cyrillic, which all Unicode tables agree on.
_PLAIN = [(0xAA, 0x24F), (0x370, 0x52F)]

# How the one tokenizer reads texts whose words are looked up one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "end_of_word_suffix": "</w>", "unk_token": None},
}


#: A text of ASCII and the letters of Latin-1 alone: normal forms change nothing in it, and what is a letter is plain.
PLAIN = re.compile(rb"(?:[\x00-\x7f]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*+")
#: How WORDWISE splits such a text once A-Z are lowered, as bytes.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^a-z0-9\s\x80-\xff]+")


def wordwise(spec: str) -> bool:
    """Whether a text's ids are known to be its words' ids one after the other: so of a tokenizer that is read as WORDWISE
    and has no added tokens with white space. Texts of any other are encoded whole."""
    read = json.loads(spec)
    added = [t["content"] for t in read.get("added_tokens") or []]
    model = {k: read["model"].get(k) for k in WORDWISE["model"]}
    return all((read | {"model": model}).get(k) == v for k, v in WORDWISE.items()) and not any(t.split() != [t] for t in added)


def parts(word: bytes) -> tuple[bytes, ...]:
    """A word of letters with signs at its end as the two, and ASCII letters in lower case: the tokenizer takes letters
    and signs apart and lowers them, so their ids are known from other words. Any other word is its own part, such as
    one whose lower-cased letters aren't all letters (a dot over an i is a sign to the tokenizer, and joins others)."""
    text = word.decode()
    letters = text.rstrip(SIGNS)
    if not letters.isalpha():
        return (word,)
    if letters.isascii():
        base = letters.lower().encode()
    elif letters.lower().isalpha() and all(c < "\x80" or any(a <= ord(c) <= b for a, b in _PLAIN) for c in letters):
        base = letters.encode()
    else:
        return (word,)
    signs = text[len(letters) :].encode()
    return (base, signs) if signs else (base,)


class Ids(dict):
    """Token ids by word, as bytes. If words: tokens don't cross ASCII white space, so a text's ids are its words' ids one
    after the other, and the new words of a text can be looked up as one text of their own. A plain text is split into
    the tokenizer's own pieces, of which there are fewer."""

    def __init__(self, tokenizer, words: bool):
        super().__init__()
        self.tokenizer, self.words = tokenizer, words
        tokens = tokenizer.get_vocab(with_added_tokens=False) if words else {}
        self.last = np.zeros(max(tokens.values(), default=-1) + 1, bool)
        self.last[[k for t, k in tokens.items() if t.endswith(WORDWISE["model"]["end_of_word_suffix"])]] = True
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]

    def learn(self, words: set[bytes], pieces: bool) -> None:
        """Looks up the words that aren't known; pieces are the tokenizer's own, others may come in parts."""
        new = list(itertools.filterfalse(self.__contains__, words))
        if not new:
            return
        if len(self) + len(new) > REMEMBERED:
            for word in list(itertools.islice(self, REMEMBERED // 2, None)):
                del self[word]
            new = list(itertools.filterfalse(self.__contains__, words))
        if pieces:
            self._encode_pieces(new)
            return
        made = [(w, parts(w)) for w in new]
        self._encode(list({p for _, ps in made for p in ps if p not in self}))
        for word, ps in made:
            if len(ps) > 1 or ps[0] != word:
                self[word] = b"".join([self[p] for p in ps])

    def _encode_pieces(self, new: list[bytes]) -> None:
        """Each piece ends with its first token that is marked as the end of a piece, so places in the text aren't needed."""
        found = self.tokenizer.encode_batch_fast([b" ".join(new).decode()], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(new):
            return self._encode(new)
        raw = ids.tobytes()
        self.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _encode(self, new: list[bytes]) -> None:
        if not new:
            return
        texts = b" ".join(new).decode().split(" ")
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        owner = np.searchsorted(begins, [at for at, _ in found.offsets], side="right") - 1
        ends = (4 * np.cumsum(np.bincount(owner.astype(np.int64), minlength=len(new)))).tolist()
        raw = np.array(found.ids, "<u4").tobytes()
        for word, begin, end in zip(new, [0, *ends], ends, strict=False):
            self[word] = raw[begin:end]

    def of_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text with its end; the new words of all texts are looked up together."""
        if not self.words:
            return [np.array([*self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, END], "<u4") for t in texts]
        out: list[np.ndarray] = [None] * len(texts)
        plain = [bool(PLAIN.fullmatch(t)) and not any(a in t for a in self.added) for t in texts]
        for pieces in (True, False):
            own = [k for k, p in enumerate(plain) if p == pieces]
            split = [PIECES.findall(texts[k].decode().lower().encode() if b"\xc3" in texts[k] else texts[k].lower()) if pieces else texts[k].split() for k in own]
            self.learn(set().union(*split), pieces)
            for k, words in zip(own, split, strict=True):
                out[k] = np.frombuffer(b"".join([*map(self.__getitem__, words), _END]), "<u4")
        return out

    def of(self, text: bytes) -> np.ndarray:
        return self.of_many([text])[0]


@lru_cache(maxsize=1)
def _known(spec: str) -> Ids:
    """What a worker process has learned of a tokenizer stays for its next tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Ids(Tokenizer.from_str(spec), wordwise(spec))


def powers(n: int) -> list[int]:
    """The powers of two that make up n, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Cuts ids into pieces and numbers the sequences of one task."""

    def __init__(self, length: int, task: int):
        self.length, self.sequence = length, task << 40
        self.open: list[tuple] = []  # pieces of the sequence that isn't full yet
        self.filled = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            n = min(self.length - self.filled, len(ids) - start)
            self.open.append((doc, start, ids[start : start + n], len(ids)))
            self.filled += n
            start += n
            if self.filled == self.length:
                yield from self.close(self.open)
                self.open, self.filled = [], 0

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset, ids
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences whose lengths are powers of two."""
        rest = self.open
        for size in powers(self.filled):
            taken = []
            while size:
                doc, start, ids, total = rest[0]
                n = min(size, len(ids))
                taken.append((doc, start, ids[:n], total))
                size -= n
                rest = ([(doc, start + n, ids[n:], total)] if n < len(ids) else []) + rest[1:]
            yield from self.close(taken)


def ranges(docs: DataFrame) -> int:
    """The number of ranges: that of the session's shuffles, or more if the input's size asks for it; by the sizes of the
    files or tables that are read, without reading rows. Inputs of unknown size leave it to the session."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, min(MOST_RANGES, -(-size // RANGE_BYTES))) if size < 1 << 60 else n


def bounds(docs: DataFrame, n: int, each: int = BOUND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Where n ranges of the curve begin, as (curve, doc_id): quantiles of a sample of about `each` rows a range, by the
    hash of their ids; fewer a range where there are very many ranges, so that the driver's sample stays bounded. The
    bounds only share out the work; every row lies in one range, whatever they are."""
    each = min(each, max(LEAST_ROWS, SAMPLE_ROWS // max(1, n)))
    total = docs.select(F.count("*")).first()[0]
    share = min(1.0, each * n / max(1, total))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)
    sample = docs.select("doc_id", "text").where(place < int(share * (1 << 40)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(*flat_bytes(batch.column(1))), pa.int64())], ["doc_id", "curve"])

    rows = sample.mapInArrow(released(keyed), "doc_id long, curve long").toPandas().sort_values(["curve", "doc_id"], na_position="first")
    picked = rows.iloc[[len(rows) * k // n for k in range(1, n)]] if len(rows) else rows
    return picked.curve.to_numpy(np.int64), picked.doc_id.fillna(NO_ID).to_numpy(np.int64)


def range_of(curve: np.ndarray, ids: np.ndarray, curves: np.ndarray, first_ids: np.ndarray) -> np.ndarray:
    """The range of each (curve, id): the number of bounds that aren't above it."""
    low, high = np.searchsorted(curves, curve, "left"), np.searchsorted(curves, curve, "right")
    out = low.copy()
    for k in np.flatnonzero(low < high):  # bounds within equal keys: copies are parted by their ids
        out[k] += np.searchsorted(first_ids[low[k] : high[k]], ids[k], "right")
    return out


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: where it begins in the document, its length and checksum, its sequence and the
    place there, and (with_ids) the ids themselves.

    tokenizer: path of a tokenizers file, read here and sent to the tasks. Null and empty texts have only the end id,
    and so does a text without tokens. Every row is packed, rows that repeat a doc_id each on their own; other columns
    are ignored. Sequence ids are unique, but not gapless; a sequence never crosses a range of the curve. The ranges are
    fixed here, by a sample of their keys, so keys are made once for every row and once more for the sample.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    small_batches(docs.sparkSession)
    n = ranges(docs)
    curves, first_ids = bounds(docs, n)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2_000_000):
            keys = curve_keys(*flat_bytes(batch.column(1)))
            ids = pa.compute.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
            place = range_of(keys, ids, curves, first_ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(place)], ["doc_id", "text", "curve", "place"])

    # equal documents have equal keys; the id lets the ranges part them, so that many copies don't meet in one task
    placed = docs.select("doc_id", "text").mapInArrow(released(keyed), "doc_id long, text string, curve long, place int")
    ordered = placed.repartitionById(n, "place").drop("place").sortWithinPartitions("curve", "doc_id", "text")

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*pieces, strict=True))[:7]]
        names = [x.split()[0] for x in FIELDS.split(", ")]
        if with_ids:
            lists = [p[7] for p in pieces]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer, done, size = _known(spec), Packer(length, TaskContext.get().partitionId()), [], 0
        for batch in blocks(batches, 500_000):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), known.of_many(texts), strict=True):
                for piece in packer.add(doc, ids):
                    done.append(piece)
                    size += piece[2]
                if size > 1_000_000:
                    yield rows(done)
                    done, size = [], 0
        done.extend(packer.finish())
        if done:
            yield rows(done)

    return ordered.mapInArrow(released(cut), FIELDS + (", ids array<int>" if with_ids else ""))


def padding(pieces: DataFrame, length: int = LENGTH) -> float:
    """Share of padding if sequences are padded to the length, except those whose length is a power of two."""
    total = pieces.selectExpr("sequence_id", "length").groupBy("sequence_id").sum("length").toDF("s", "n")
    full = f"CASE WHEN n & (n - 1) = 0 THEN n ELSE {length} END"
    used, room = total.selectExpr("sum(n)", f"sum({full})").first()
    return 1 - used / room if room else math.nan
