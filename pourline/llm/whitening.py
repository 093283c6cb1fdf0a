"""Whitening of embeddings by principal components of an exact integer covariance.

Entries become integers x = floor(64 c) + 1000000, so counts, sums and products over the different
vectors are integers too, and so is n * n * V for their covariance V.  Its characteristic
polynomial is found modulo primes in tasks (some primes each) and joined by Chinese remaindering;
its largest roots are isolated by exact counts and refined to hundreds of digits; tasks find the
vectors of each root by inverse iteration in fixed point.  Rows are then projected in one more
scan.  Only sums over all vectors, whose size the number of dimensions bounds, meet on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charpoly import combined, largest_roots, null_space, primes, primes_needed, residues
from .common import fresh_folder

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Primes that a task reduces the matrix by.
TASK_PRIMES = 16
_LIMB = 40
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LONG = 1 << 63


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, floor(64 c) of their entries) for the usable vectors of each length."""
    column = batch.column(1)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    values = column.values.cast(pa.float64())
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = np.floor(flat[starts[rows][:, None] + np.arange(size)] * SCALE)
        good = (np.abs(x) < float(1 << 62)).all(1)  # neither a missing nor an infinite entry, nor one that no long holds
        yield rows[good], x[good].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """The bytes of each row in the smallest width that holds it: equal rows have equal bytes."""
    top = np.maximum(x.max(1), -1 - x.min(1))
    out: list[bytes] = [b""] * len(x)
    for kind, low, high in ((np.int16, 0, 1 << 15), (np.int32, 1 << 15, 1 << 31), (np.int64, 1 << 31, 1 << 62)):
        rows = np.flatnonzero((top >= low) & (top < high))
        raw, width = x[rows].astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
        for n, row in enumerate(rows.tolist()):
            out[row] = raw[n * width : (n + 1) * width]
    return out


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    kinds = {2 * d: np.int16, 4 * d: np.int32, 8 * d: np.int64}
    return np.array([np.frombuffer(raw, kinds[len(raw)]) for raw in column.to_pylist()], np.int64).reshape(-1, d)


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _usable(batch):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(_packed(x), pa.binary())], ["d", "x"])


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, digit) of an integer in base 2 ** 40, with its sign."""
    sign, left, number = (-1, -value, 0) if value < 0 else (1, value, 0)
    while left:
        yield number, sign * (left & ((1 << _LIMB) - 1))
        left, number = left >> _LIMB, number + 1


def _products(x: np.ndarray) -> np.ndarray:
    """The transpose of x times x, exactly."""
    top = int(max(x.max(initial=0), -x.min(initial=0)))
    if len(x) * top * top < 1 << 53:
        f = x.astype(np.float64)  # every partial sum is an integer that a double holds
        return (f.T @ f).astype(np.int64).astype(object)
    if len(x) * top * top < 1 << 63:
        return (x.T @ x).astype(object)
    wide = x.astype(object)
    return wide.T @ wide


def _moments(d: int):
    """Packed vectors -> limbs of their products (i, j), sums (i, d) and number (d, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            x = _unpacked(batch.column(0), d)
            total[:d, :d] += _products(x)
            total[:d, d] += x.astype(object).sum(0) if abs(x).max(initial=0) >= 1 << 40 else x.sum(0).astype(object)
            total[d, d] += len(x)
        rows = [(i, j, number, digit) for i in range(d + 1) for j in range(i, d + 1) for number, digit in _limbs(int(total[i, j]))]
        if rows:
            i, j, number, digit = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(number, pa.int32()), pa.array(digit, pa.int64())], ["i", "j", "number", "digit"])

    return run


def _residue_rows(matrix: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moduli = batch.column(0).to_pylist()
            for at in range(0, len(moduli), TASK_PRIMES):
                part = moduli[at : at + TASK_PRIMES]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(residues(matrix, part).tolist(), pa.list_(pa.int64()))], ["prime", "coefficients"])

    return run


def _vector_rows(matrix: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, top, bottom, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vectors = null_space(matrix, Fraction(int(top), int(bottom)), count)
                yield pa.RecordBatch.from_arrays([pa.array([number] * count, pa.int32()), pa.array(range(count), pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], ["root", "place", "vector"])

    return run


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a positive semidefinite integer matrix, constant term first; primes are dealt over tasks."""
    moduli = primes(primes_needed(matrix))
    frame = spark.createDataFrame([(p,) for p in moduli], "prime long").repartition(-(-len(moduli) // TASK_PRIMES))
    rows = frame.mapInArrow(_residue_rows(matrix), "prime long, coefficients array<long>").collect()
    return combined([r["prime"] for r in rows], [r["coefficients"] for r in rows])


def principal(spark: SparkSession, matrix: list[list[int]], count: int) -> tuple[list[Fraction], np.ndarray]:
    """(roots, unit vectors), falling, of at most count positive roots of the matrix."""
    roots = largest_roots(polynomial(spark, matrix), count)
    if not roots:
        return [], np.empty((0, len(matrix)))
    rows = [(n, str(r.numerator), str(r.denominator), m) for n, (r, m) in enumerate(roots)]
    frame = spark.createDataFrame(rows, "root int, top string, bottom string, count int").repartition(len(rows))
    found = sorted(frame.mapInArrow(_vector_rows(matrix), "root int, place int, vector array<double>").collect())
    values = [r for r, m in roots for _ in range(m)][:count]
    return values, np.array([r["vector"] for r in found])[:count]


def _projected(x: np.ndarray, n: int, sums: list[int], vectors: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """(whitened entries, deviations) of integer vectors; a deviation that no long holds is null."""
    top = n * int(abs(x).max(initial=0)) + max(map(abs, sums))
    if top * top * x.shape[1] < _LONG:
        away = n * x - np.array(sums, np.int64)
        deviation = (away * away).sum(1).tolist()
    else:
        away = n * x.astype(object) - np.array(sums, object)
        deviation = [v if v < _LONG else None for v in (away * away).sum(1).tolist()]
    return away.astype(np.float64) @ vectors.T / roots, deviation


def _second_moments(d: int, n: int, sums: list[int], vectors: np.ndarray, roots: np.ndarray):
    """Packed vectors -> sums of products (i, j) and of entries (i, -1) of their whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(roots)
        products, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w, _ = _projected(_unpacked(batch.column(0), d), n, sums, vectors, roots)
            products, total = products + w.T @ w, total + w.sum(0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.arange(k)]), pa.int32()), pa.array(np.concatenate([j, np.full(k, -1)]), pa.int32()), pa.array(np.concatenate([products[i, j], total]))], ["i", "j", "value"]
        )

    return run


def _white_rows(d: int, n: int, sums: list[int], vectors: np.ndarray, roots: np.ndarray, explained: np.ndarray, error: float):
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(roots)
        for batch in batches:
            for rows, x in _usable(batch):
                if x.shape[1] != d or not len(rows):
                    continue
                white, deviation = _projected(x, n, sums, vectors, roots)
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                count = len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(count, n)),
                        pa.array(deviation, pa.int64()).take(each), pa.array(white.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(count, error)),
                    ],
                    schema=schema,
                )

    return run


def whiten(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    A row is left out if its vector is null, empty, holds a null, infinite or undefined entry or one whose
    64-fold is beyond 2 ** 62, or has another length than most usable rows (of equally common lengths the
    longest counts).  Equal vectors are one vector of the fit; rows with equal or without ids are rows of
    their own; other columns are not read.  Directions without variance have no component, so there are
    fewer than asked for where the vectors span less, and none, thus no row, for a single vector or an
    empty table.  A deviation that a long cannot hold is null.
    """
    spark = rows.sparkSession
    folder = fresh_folder(spark, "whitening")
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    packed = given.mapInArrow(_pack_rows, "d int, x binary").groupBy("d", "x").agg(F.count("*").alias("rows"))
    packed.write.option("compression", "zstd").parquet(f"{folder}/fit")
    packed = spark.read.schema("d int, x binary, rows long").parquet(f"{folder}/fit")
    lengths = packed.groupBy("d").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    nothing = spark.createDataFrame([], _RESULT)
    if lengths is None:
        return nothing
    d = lengths["d"]
    fit = packed.where(F.col("d") == d).select("x")

    limbs = fit.mapInArrow(_moments(d), "i int, j int, number int, digit long").groupBy("i", "j", "number").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))
    total = [[0] * (d + 1) for _ in range(d + 1)]
    for r in limbs.collect():
        total[r["i"]][r["j"]] += int(r["digit"]) << (_LIMB * r["number"])
    n, sums = total[d][d], [total[i][d] for i in range(d)]
    scatter = [[n * total[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace, shared = sum(scatter[i][i] for i in range(d)), reduce(math.gcd, (v for row in scatter for v in row))
    if shared == 0:
        return nothing
    values, vectors = principal(spark, [[v // shared for v in row] for row in scatter], components)
    roots = np.array([math.sqrt(v * shared) for v in values])
    explained = np.array([float(v * shared / trace) for v in values])

    k = len(values)
    moments = fit.mapInArrow(_second_moments(d, n, sums, vectors, roots), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = {(r["i"], r["j"]): r["value"] / n for r in moments.collect()}
    error = max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(k) for j in range(i, k))
    return given.mapInArrow(_white_rows(d, n, sums, vectors, roots, explained, error), _RESULT)
