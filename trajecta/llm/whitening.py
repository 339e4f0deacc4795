"""Embedding whitening by a one-sided Jacobi singular value decomposition.

Entries are scaled and floored to whole numbers, so that sums, and with them the centre, are exact. Blocks of centred rows
are compressed to upper triangles by QR; triangles stacked on each other are compressed again until one is left (TSQR).
Its columns are made orthogonal by plane rotations: their lengths are the deviations along the components, and the
rotations, accumulated, are the components. The covariance matrix is never formed, so small deviations keep the accuracy
that squaring would lose.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import cut, released

SCALE, SHIFT, MOST = 1024, 100_000, 8
#: Tasks that compress the triangles of all others, before the last one compresses theirs.
MIDDLE = 16
#: Rows whose QR is taken at once, in multiples of the dimensions.
TALL = 16
LONG = (1 << 63) - 1


def whole(rows: DataFrame, scale: int) -> DataFrame:
    """All columns of the rows whose vector has finite entries alone, with `whole_`, its entries as whole numbers (without the shift)."""
    fine = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    return rows.where(fine).withColumn("whole_", F.expr(f"transform(embedding, x -> floor(cast(x AS double) * {scale}))"))


def matrix(column: pa.Array, length: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have this length, their entries as a matrix); of Python's whole numbers where those could overflow."""
    flat, lengths = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    at = np.flatnonzero(lengths == length)
    x = flat[(np.cumsum(lengths) - lengths)[at][:, None] + np.arange(length)]
    if x.size and (x.max() > 1 << 40 or x.min() < -(1 << 40)):
        x = x.astype(object)
    return at, x + shift


def totals(vectors: DataFrame, shift: int) -> tuple[int, list[int]]:
    """(n, sums of each dimension) of the vectors of the commonest length; of several such, the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for length in set(batch.column(0).value_lengths().to_pylist()):
                at, x = matrix(batch.column(0), length, shift)
                n, old = sums.get(length, (0, np.zeros(length, object)))
                sums[length] = n + len(at), old + x.sum(axis=0).astype(object)
        for length, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()), pa.array([Decimal(n), *map(Decimal, s)], pa.decimal128(38, 0))], ["length", "dim", "total"])

    # one row for each dimension and length of a task, and one for the number of its vectors
    found = cut(vectors.select("whole_").mapInArrow(released(run), "length int, dim int, total decimal(38,0)").groupBy("length", "dim").agg(F.sum("total").alias("total")))
    best = found.where("dim = -1").orderBy(F.desc("total"), F.desc("length")).first()
    if best is None:
        return 0, []
    sums = {r["dim"]: int(r["total"]) for r in found.where(F.col("length") == best["length"]).collect()}
    return sums[-1], [sums[k] for k in range(best["length"])]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x minus the mean, rounded once: n*x - sum is exact."""
    return deviations(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    most = max([abs(s) for s in sums], default=0)
    safe = x.dtype != object and (not x.size or n * max(abs(int(x.max())), abs(int(x.min()))) + most < 1 << 62)
    return n * x - np.array(sums, np.int64) if safe else n * x.astype(object) - np.array(sums, object)


def triangle(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    """The upper triangle (d by d) of the QR decomposition of all rows, a block at a time."""
    r = np.zeros((d, d))
    for block in blocks:
        for k in range(0, len(block), TALL * d):
            r = np.linalg.qr(np.vstack([r, block[k : k + TALL * d]]), mode="r")
    return r


def compressed(vectors: DataFrame, n: int, sums: list[int], shift: int) -> np.ndarray:
    """The triangle of all centred vectors: by tasks, by a few tasks, and by one; d rows come from each."""
    d = len(sums)
    cells = pa.schema([("row", pa.int32()), ("r", pa.list_(pa.float64()))])

    def rows_of(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(r), pa.list_(pa.float64()))], schema=cells)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield rows_of(triangle((centred(matrix(b.column(0), d, shift)[1], n, sums) for b in batches), d))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield rows_of(triangle((np.array(b.column(1).flatten().to_numpy()).reshape(-1, d) for b in batches), d))

    cells_sql = "row int, r array<double>"
    several = vectors.select("whole_").mapInArrow(released(first), cells_sql).repartition(MIDDLE, F.rand(1)).mapInArrow(again, cells_sql)
    return np.array([r["r"] for r in several.coalesce(1).mapInArrow(again, cells_sql).orderBy("row").collect()]).reshape(d, d)


def pairings(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of columns in which every two columns meet once, as in a tournament."""
    seats = list(range(d + d % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], reversed(seats), strict=False) if max(a, b) < d]
        rounds.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations): plane rotations of columns, until all are orthogonal to double precision; the lengths fall."""
    a, v = r.copy(), np.eye(r.shape[1])
    rounds = pairings(r.shape[1])
    eps = np.finfo(float).eps * max(1, r.shape[0]) ** 0.5
    for _ in range(sweeps):
        turned = False
        for i, j in rounds:
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > eps * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            i, j = i[turn], j[turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                p, q = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = c * p - s * q, s * p + c * q
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def identity_error(vectors: DataFrame, n: int, sums: list[int], shift: int, project: np.ndarray) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    d, k = project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = centred(matrix(b.column(0), d, shift)[1], n, sums) @ project
            second, first = second + w.T @ w, first + w.sum(axis=0)
        at = np.arange(k * k + k)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate([second.ravel(), first]))], ["at", "total"])

    sums_ = vectors.select("whole_").mapInArrow(released(run), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    flat = np.array([r["total"] for r in sums_])
    mean = flat[k * k :] / n
    return float(np.abs(flat[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT, most: int = MOST) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and its first components.

    An entry c counts as floor(scale * c) + shift. Components are numbered from 1 by falling variance, `most` at most;
    those without variance (to double precision) can't be whitened and are left out, so that vectors that are all equal
    give no rows. `deviation` is the squared distance from the mean times n^2, exactly, and null where that doesn't fit
    a long. Rows with a null vector, or null or non-finite entries, take no part. All others count, repeated rows and ties
    too, and a null vec_id stays null; but of vectors of several lengths only the commonest length takes part (of ties
    the longest). Entries that don't fit a long count as its ends. Other columns don't matter; an empty table gives an
    empty one.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = whole(rows.select("vec_id", "embedding"), scale).select("vec_id", "whole_")
    n, sums = totals(vectors, shift)
    d = len(sums)
    if not d:
        return spark.createDataFrame([], schema)
    lengths, rotations = jacobi(compressed(vectors, n, sums, shift))
    k = int((lengths[:most] > lengths[0] * np.finfo(float).eps * max(d, 16) * 4).sum())
    if not k:
        return spark.createDataFrame([], schema)
    project = rotations[:, :k] / (lengths[:k] / np.sqrt(n))
    explained = lengths[:k] ** 2 / (lengths**2).sum()
    error = identity_error(vectors, n, sums, shift, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = matrix(b.column(1), d, shift)
            away = deviations(x, n, sums)
            big = away.dtype == object or (away.size and int(np.abs(away).max()) ** 2 * d >= 1 << 62)
            squares = [s if s <= LONG else None for s in (away.astype(object) ** 2).sum(axis=1)] if big else (away**2).sum(axis=1)
            whitened = (away.astype(np.float64) / n) @ project
            cols = [b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(at) * k, n))]
            cols += [pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(whitened.ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(at) * k, error))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(released(run), schema)
