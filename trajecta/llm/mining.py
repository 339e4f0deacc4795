"""Hard negatives by distributed radix selection.

For an anchor and one of its positives, hard negatives are the rows of other labels that score just below the positive.
The k best of such a window of scores are found without ordering or moving the rows in it: every task counts the scores
of its rows by their highest digit, the counts are added up, and the bucket that holds the kth score is looked at again
by its next digit, and so on; scores that many rows share go on by digits of their ids. When few enough rows are left
above the limit that this gives, those are gathered, and nothing else.

Anchors are handled in groups of a bounded size, which are sent to the tasks; every group reads all rows in each pass.
The positives of an anchor are the k best of another window, the rows of its own label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.common import new_table, released, scratch

#: Anchors of a group: so many at most, and so many bytes of vectors.
MOST_ANCHORS, MOST_BYTES = 4096, 32 << 20
#: Buckets of all windows that a task counts in one pass (a power of two), and of one window at most.
BUCKETS, WINDOW_BUCKETS = 1 << 21, 1 << 11
#: A window whose limit lets at most so many rows through isn't narrowed further.
ENOUGH = 32
#: Scores are kept within this bound on either side.
FAR = 1 << 61
#: Anchors and rows whose scores are computed at once.
TILE_ANCHORS, TILE_ROWS = 128, 2048


class Windows:
    """Windows of scores of a group's anchors, each with the limit for its k best rows as far as it is known.

    A window asks for rows of the anchor's own label or of any other, with scores from `bottom` to `top`. While it is
    open, the limit lies among `width` keys from `low` on; a key is how far the score is below `top`, or, once the
    score of the kth row is known and has too many rows, a quarter of the id of rows with that score (so that differences
    of ids fit a long; four rows more are few enough).
    """

    def __init__(self, anchor: np.ndarray, bottom: np.ndarray, top: np.ndarray, same: bool, k: int, ids: tuple[int, int]) -> None:
        self.anchor, self.bottom, self.top, self.same, self.k, self.ids = anchor, bottom, top, same, k, ids
        self.low = np.zeros(len(anchor), np.int64)
        self.width = np.maximum(0, top - bottom + 1)
        self.need = np.full(len(anchor), k, np.int64)
        self.by_id = np.zeros(len(anchor), bool)
        #: Rows qualify with a higher score, or with this one and an id up to `cut_id`.
        self.cut = bottom.copy()
        self.cut_id = np.full(len(anchor), ids[1], np.int64)
        self.open = self.width > 0
        self.shift = np.zeros(len(anchor), np.int64)

    def plan(self) -> int:
        """Sets how many bits of the keys a pass leaves aside; returns the buckets of a window."""
        n = int(self.open.sum())
        buckets = min(WINDOW_BUCKETS, 1 << max(3, (BUCKETS // max(1, n)).bit_length() - 1))
        most = int(self.width[self.open].max())
        for w in np.flatnonzero(self.open):
            self.shift[w] = max(0, (int(self.width[w]) - 1).bit_length() - (buckets.bit_length() - 1))
        return min(buckets, most)

    def narrow(self, w: int, bucket: int, before: int, count: int) -> None:
        """Takes in that the kth row is in this bucket, with `before` rows in earlier ones and `count` in it."""
        size = 1 << int(self.shift[w])
        first = int(self.low[w]) + (bucket << int(self.shift[w]))
        width = min(size, int(self.low[w]) + int(self.width[w]) - first)
        last = first + width - 1
        enough = self.k - int(self.need[w]) + before + count <= ENOUGH
        self.need[w] -= before
        self.low[w], self.width[w] = first, width
        if self.by_id[w]:
            self.cut_id[w] = last * 4 + 3
            self.open[w] = not (enough or size == 1)
        elif enough:
            self.cut[w], self.open[w] = int(self.top[w]) - last, False
        elif size == 1:
            self.cut[w], self.by_id[w] = int(self.top[w]) - first, True
            self.low[w], self.width[w] = self.ids[0] >> 2, (self.ids[1] >> 2) - (self.ids[0] >> 2) + 1


class Anchors:
    """Ids, labels and vectors of a group's anchors, and how scores are computed without error."""

    def __init__(self, rows: pa.Table, bound: float) -> None:
        self.ids = rows["vec_id"].to_numpy()
        self.labels = rows["label"].to_numpy()
        self.vectors = [np.array(v, np.int64) for v in rows["v"].to_pylist()]
        self.lengths = np.array([len(v) for v in self.vectors], np.int64)
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < FAR else object

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, ids, labels, scores), a part of the anchors by a part of the rows at a time."""
        ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        flat, ends = vectors.flatten().to_numpy(), np.cumsum(vectors.value_lengths().to_numpy())
        lengths = np.diff(ends, prepend=0)
        for length in np.unique(self.lengths):
            rows, anchors = np.flatnonzero(lengths == length), np.flatnonzero(self.lengths == length)
            for a in range(0, len(rows), TILE_ROWS):
                at = rows[a : a + TILE_ROWS]
                right = flat[(ends[at] - length)[:, None] + np.arange(length)].astype(self.kind)
                for b in range(0, len(anchors), TILE_ANCHORS):
                    own = anchors[b : b + TILE_ANCHORS]
                    left = np.array([self.vectors[k] for k in own]).reshape(len(own), length).astype(self.kind)
                    scores = left @ right.T if length else np.zeros((len(own), len(at)), np.int64)
                    yield own, ids[at], labels[at], np.clip(scores, -FAR, FAR).astype(np.int64)

    def parts(self, batch: pa.RecordBatch, windows: Windows, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, ids, scores): chosen windows by rows; rows that a window can't take have a score of the least long."""
        first = np.searchsorted(windows.anchor[which], np.arange(len(self.ids) + 1))
        for own, ids, labels, scores in self.tiles(batch):
            counts = first[own + 1] - first[own]
            if counts.any():
                at = np.repeat(first[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                line = np.repeat(np.arange(len(own)), counts)
                fits = (labels[None, :] == self.labels[own][:, None]) == windows.same
                fits &= ids[None, :] != self.ids[own][:, None]
                yield which[at], ids, np.where(fits, scores, np.iinfo(np.int64).min)[line]


def prepared(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, one for each vec_id; see hard_negatives."""
    fine = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    whole = F.expr(f"transform(embedding, x -> floor(cast(x AS double) * {scale}))")
    return rows.where(fine).select("vec_id", F.struct(F.col("label").cast("long").alias("label"), whole.alias("v")).alias("s")).groupBy("vec_id").agg(F.min("s").alias("s")).select("vec_id", "s.label", "s.v")


def counted(rows: DataFrame, anchors: Anchors, windows: Windows) -> DataFrame:
    """(w, bucket, n, need): for every open window, how many rows have a key in each bucket; buckets without rows are
    left out."""
    buckets = windows.plan()
    which = np.flatnonzero(windows.open)
    place = np.full(len(windows.open), -1, np.int64)
    place[which] = np.arange(len(which))
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = sent.value
        counts = np.zeros(len(which) * buckets, np.int64)
        for batch in batches:
            for w, ids, scores in anchors.parts(batch, windows, which):
                by_id = windows.by_id[w][:, None]
                top, bottom = windows.top[w][:, None], windows.bottom[w][:, None]
                inside = (scores <= top) & (scores >= bottom) & (~by_id | (scores == windows.cut[w][:, None]))
                line, column = np.nonzero(inside)
                keys = np.where(by_id[line, 0], ids[column] >> 2, top[line, 0] - scores[line, column]) - windows.low[w][line]
                held = (keys >= 0) & (keys < windows.width[w][line])
                line, keys = line[held], keys[held]
                np.add.at(counts, place[w][line] * buckets + (keys >> windows.shift[w][line]), 1)
        found = np.flatnonzero(counts)
        at = which[found // buckets]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found % buckets), pa.array(counts[found]), pa.array(windows.need[at])], ["w", "bucket", "n", "need"])

    return rows.mapInArrow(released(run), "w long, bucket long, n long, need long").groupBy("w", "bucket").agg(F.sum("n").alias("n"), F.max("need").alias("need"))


def select(rows: DataFrame, anchors: Anchors, windows: Windows) -> None:
    """Narrows all windows until each lets few rows through beyond its k best."""
    while windows.open.any():
        before = F.sum("n").over(Window.partitionBy("w").orderBy("bucket")) - F.col("n")
        located = counted(rows, anchors, windows).withColumn("before", before).where("before < need AND before + n >= need")
        found = {r["w"]: r for r in located.select("w", "bucket", "before", "n").collect()}  # one row a window
        for w in np.flatnonzero(windows.open):
            if w in found:
                windows.narrow(w, found[w]["bucket"], found[w]["before"], found[w]["n"])
            else:
                windows.open[w] = False  # it has fewer rows than it needs: all qualify


def gathered(rows: DataFrame, anchors: Anchors, windows: Windows) -> DataFrame:
    """(w, vec_id, score, rank): the k best rows of every window, by score and then by the smaller id."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = sent.value
        which = np.flatnonzero(windows.width > 0)
        for batch in batches:
            for w, ids, scores in anchors.parts(batch, windows, which):
                cut = windows.cut[w][:, None]
                line, column = np.nonzero((scores <= windows.top[w][:, None]) & ((scores > cut) | ((scores == cut) & (ids[None, :] <= windows.cut_id[w][:, None]))))
                yield pa.RecordBatch.from_arrays([pa.array(w[line]), pa.array(ids[column]), pa.array(scores[line, column])], ["w", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return rows.mapInArrow(released(run), "w long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= windows.k)


def hard_negatives(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, out_of: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchors` chooses.

    Vectors are scaled, floored and compared by their inner product; of equal scores the smaller vec_id comes first. An
    anchor's positives are its best other rows of the same label; a positive's hard negatives are the best rows of other
    labels with low * positive <= out_of * score <= high * positive. Fewer are returned where there are fewer.

    Rows with a null vec_id, label or vector, or a null or non-finite entry take no part. Rows that repeat a vec_id count
    as one, the smallest by label and then vector. Vectors of different lengths have no score with each other; an empty
    one scores 0. Entries that don't fit a long count as its ends, and scores stay within 2^61 on either side. Other
    columns don't matter. Without anchors, positives or negatives there are no rows.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = new_table(spark)
    with scratch() as keep:
        whole = keep(prepared(rows.select("vec_id", "label", "embedding"), scale))
        chosen = whole.where(anchors)
        most = F.max(F.expr("aggregate(v, 0D, (a, x) -> a + cast(x AS double) * cast(x AS double))"))
        n, length = chosen.agg(F.count("*"), F.max(F.size("v"))).first()
        bound, *ids = whole.agg(most, F.min("vec_id"), F.max("vec_id")).first()
        groups = -(-n // min(MOST_ANCHORS // 2, max(1, MOST_BYTES // (16 * max(1, length or 1)))))
        for g in range(groups):
            own = Anchors(chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).orderBy("vec_id").toArrow(), bound * 1.001)
            if not len(own.ids):
                continue
            edge = int(min(FAR, bound * 1.001 + 1))
            every = np.arange(len(own.ids))
            near = Windows(every, np.full(len(every), -edge), np.full(len(every), edge), True, positives, tuple(ids))
            select(whole, own, near)
            pairs = sorted((r["w"], r["rank"], r["vec_id"], r["score"]) for r in gathered(whole, own, near).collect())
            if not pairs:
                continue
            anchor, _, positive, score = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
            limits = [(max(-FAR, -(-low * s // out_of)), min(FAR, high * s // out_of)) for s in score.tolist()]
            hard = Windows(anchor, *(np.array(c, np.int64) for c in zip(*limits, strict=True)), False, negatives, tuple(ids))
            select(whole, own, hard)
            names = spark.createDataFrame(pa.table({"w": np.arange(len(anchor)), "anchor_id": own.ids[anchor], "positive_id": positive, "positive_score": score}))
            found = gathered(whole, own, hard).join(F.broadcast(names), "w")  # a window for each positive of the group
            found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            found.write.mode("append").parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 7 get another label, so that labels don't follow the vectors everywhere."""
    return rows.select("vec_id", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"), "embedding")
