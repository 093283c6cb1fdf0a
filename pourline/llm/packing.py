"""Best-fit packing of documents into training sequences of bounded length.

The lengths' histogram, which has at most ``capacity`` entries whatever the input
is, gives a configuration linear program: use patterns (multisets of lengths that
fit one sequence) so that every length is covered as often as it occurs, with as
few patterns as possible.  It is solved by multiplicative weights: each round a
knapsack dynamic program over all lengths finds the pattern of most weight, which is
used until the first of its lengths has grown by a set share of its need, and the
weights of its lengths sink by how much of their need that covers.  Any weights also
bound the program from below (what all lengths weigh over what the pattern of most
weight does), so the gap of a solution is known.  What the rounds leave uncovered is
covered by best fit, decreasing, in fractions; the cover is feasible.

Rounding takes each pattern as often as its use, rounded up, allows; what is left of
the histogram is filled best fit, decreasing.

Pieces of one length are interchangeable, so a piece's place follows from its rank
among the pieces of its length; ranks come from counts per partition and prefix
sums, and no length, however common, has to meet in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable
from .tokens import encoder
from .words import steps

#: Rounds of multiplicative weights at most, and how far a length's weight sinks (as a power of e) until it is covered.
ROUNDS, SINK = 600, 6.0
#: How much more a token of the longest length weighs at first than one of the shortest.
LARGE = 0.05
#: Shares of the solution, from its first rounds on, that roundings take from it.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)
#: The share of a length's need that one round covers at most: as small as the rounds allow, within these bounds.
LEAST_STEP, MOST_STEP = 1 / 32, 1.0


def _pieces(path: str, cut: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, cut)
        for batch in batches:
            for part, texts in steps(batch, 1):
                ids, bounds = encode([t or "" for t in texts], end_id)
                n = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(len(texts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[row] - start)
                raw, at = memoryview(ids).cast("B"), 4 * (bounds[:-1][row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def heaviest(weights: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by length of a pattern of most weight that fits, each length within its limit.

    Knapsack by dynamic programming, exact over all lengths.  A length whose limit
    the capacity never reaches is unbounded; the others enter as bundles of 1, 2, 4, ... and a rest.
    """
    lengths = np.arange(capacity + 1)
    present = (limits > 0) & (weights > 0)
    free = present & (limits >= capacity // np.maximum(lengths, 1))
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    if free.any():
        gain = np.where(free, weights, -np.inf)
        for room in range(int(np.argmax(free)), capacity + 1):
            found = gain[1 : room + 1] + best[room - 1 :: -1] if room > 1 else gain[1:2] + best[0]
            k = int(found.argmax())
            if found[k] > best[room - 1]:
                best[room], choice[room] = found[k], k + 1
            else:  # one token stays free
                best[room] = best[room - 1]
    took: list[tuple[int, int, np.ndarray]] = []
    for length in np.flatnonzero(present & ~free)[::-1].tolist():
        most, bundle = min(int(limits[length]), capacity // length), 1
        while most > 0:
            k = min(bundle, most)
            size = k * length
            with_it = best[: capacity + 1 - size] + k * weights[length]
            mask = with_it > best[size:] + 1e-12
            np.maximum(best[size:], with_it, out=best[size:])
            took.append((length, k, mask))
            most -= k
            bundle *= 2
    pattern, room = np.zeros(len(limits), np.int64), capacity
    for length, k, mask in reversed(took):
        size = k * length
        if room >= size and mask[room - size]:
            pattern[length] += k
            room -= size
    while room > 0:
        length = int(choice[room])
        pattern[length] += length > 0
        room -= max(length, 1)
    return pattern


def _greedy(limits: np.ndarray, capacity: int) -> np.ndarray:
    """The largest length left, then again and again the largest that fits: best fit, decreasing."""
    pattern, room = np.zeros(len(limits), np.int64), capacity
    left = np.flatnonzero(limits)
    while (at := int(np.searchsorted(left, room, "right")) - 1) >= 0:
        length = int(left[at])
        pattern[length] = min(math.ceil(limits[length]), room // length)
        room -= int(pattern[length]) * length
        left = left[:at]
    return pattern


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(patterns and how often each is used, in the order of the rounds; a bound that no packing goes below).

    The uses are a feasible solution of the configuration program: every length is
    covered counts[length] times at least.  The bound is the best dual value met.
    """
    need = counts.astype(float)
    held = counts > 0
    lengths = np.arange(len(counts))
    step = min(MOST_STEP, max(LEAST_STEP, 1.5 * int(held.sum()) / rounds))
    # Of patterns that are equally full, those of few and large lengths come first: what is small fits anywhere later.
    weights, covered = np.where(held, lengths / capacity * (1 + LARGE * lengths / capacity), 0.0), np.zeros(len(counts))
    bound = max(float(need @ lengths) / capacity, float(need[lengths > capacity / 2].sum()))
    patterns: dict[bytes, list] = {}

    def use(pattern: np.ndarray, times: float) -> None:
        patterns.setdefault(pattern.tobytes(), [pattern, 0.0])[1] += times

    for _ in range(rounds):
        if (covered[held] >= need[held] * (1 - 1e-9)).all():
            break
        pattern = heaviest(weights, counts, capacity)
        bound = max(bound, float(weights @ need) / float(weights @ pattern))
        own = np.flatnonzero(pattern)
        # No longer than until all its lengths are covered.
        times = min(step * (need[own] / pattern[own]).min(), max(((need[own] - covered[own]) / pattern[own]).max(), 1e-9))
        use(pattern, times)
        covered[own] += times * pattern[own]
        weights[own] *= np.exp(-SINK * times * pattern[own] / need[own])
        if weights[held].max() < 1e-6:
            weights *= 1e6
    left = np.where(held, np.maximum(need - covered, 0.0), 0.0)
    left[left < 1e-9 * need] = 0.0
    while left.any():
        pattern = _greedy(left, capacity)
        own = pattern > 0
        times = (left[own] / pattern[own]).min()
        use(pattern, times)
        left[own] = np.maximum(left[own] - times * pattern[own], 0.0)
        left[left < 1e-9 * need] = 0.0
    return [(pattern, times) for pattern, times in patterns.values()], bound


def _rounded(counts: np.ndarray, capacity: int, uses: list[tuple[np.ndarray, float]], whole=math.floor) -> list[tuple[np.ndarray, int]]:
    """Whole uses of patterns, by ``whole`` of each use and within what is left; then best fit, decreasing."""
    left, plan = counts.copy(), []

    def use(pattern: np.ndarray, most: float = math.inf) -> None:
        held = np.flatnonzero(pattern)
        times = int(min(most, (left[held] // pattern[held]).min()))
        if times > 0:
            left[held] -= times * pattern[held]
            plan.append((pattern, times))

    for pattern, times in uses:
        use(pattern, whole(times))
    while left.any():
        use(_greedy(left, capacity))
    return plan


def pack_histogram(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; every length is used exactly counts[length] times.

    The program's solution is rounded in several ways: all of it or what its first
    rounds gave, in their order or the fullest patterns first, uses rounded up or down.
    The rounding with the fewest sequences is kept.
    """
    counts = counts.astype(np.int64).copy()
    whole = int(counts[capacity])
    counts[capacity] = 0
    full = np.zeros_like(counts)
    full[capacity] = 1
    uses, _ = solve(counts, capacity, rounds) if counts.any() else ([], 0.0)
    size, before, best, least = np.arange(len(counts)), np.cumsum([0.0, *(times for _, times in uses)]), [], math.inf
    for share in SHARES if uses else ():
        part = uses[: max(1, int(np.searchsorted(before, share * before[-1])))]
        for way in (part, sorted(part, key=lambda x: -int(x[0] @ size))):
            for to in (math.ceil, math.floor):
                plan = _rounded(counts, capacity, way, to)
                if (n := sum(times for _, times in plan)) < least:  # one plan is held at a time
                    best, least = plan, n
    return [(full, whole)] * (whole > 0) + best


def _slots(plan: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """For each length in turn: runs of ranks, the first sequence of each run, and the place in the sequence."""
    lengths, times, first, offset, base = [], [], [], [], 0
    for pattern, n in plan:
        at = 0
        for length in np.flatnonzero(pattern)[::-1]:
            for _ in range(pattern[length]):
                lengths.append(int(length))
                times.append(n)
                first.append(base)
                offset.append(at)
                at += int(length)
        base += n
    lengths, times = np.array(lengths, np.int64), np.array(times, np.int64)
    order = np.argsort(lengths, kind="stable")
    out = {"length": lengths[order], "times": times[order], "first": np.array(first, np.int64)[order], "offset": np.array(offset, np.int64)[order]}
    ends = np.cumsum(out["times"])
    begin_of_length = np.searchsorted(out["length"], out["length"], "left")
    before = ends - out["times"]
    out["rank"] = before - before[begin_of_length] if len(ends) else before
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    cut: str = "space",
    end_id: int = 0,
    capacity: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id.  Only a longer one than ``capacity`` is cut.
    A null text is empty and has one piece of length 1.  Rows with equal or null
    ids are packed one by one.  An empty table gives an empty result.
    """
    pieces = durable(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(
            _pieces(tokenizer_path, cut, end_id, capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long",
        )
        .withColumn("part", F.spark_partition_id())
    )
    counts = durable(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["n"]
    slots = _slots(pack_histogram(histogram, capacity))
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(before, ["part", "length"])
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).cast("long").alias("rank")
    ).mapInArrow(
        _place(slots),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def _place(slots: dict[str, np.ndarray]):
    lengths, ranks, first, offset = (slots[k] for k in ("length", "rank", "first", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # Runs are ordered by (length, first rank): one search finds each piece's run.
            low = np.searchsorted(lengths, own, "left")
            high = np.searchsorted(lengths, own, "right")
            while (low + 1 < high).any():
                mid = (low + high) // 2
                go = (low + 1 < high) & (ranks[np.minimum(mid, len(ranks) - 1)] <= rank)
                stay = (low + 1 < high) & ~go
                low, high = np.where(go, mid, low), np.where(stay, mid, high)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(first[low] + rank - ranks[low]), pa.array(offset[low])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run
