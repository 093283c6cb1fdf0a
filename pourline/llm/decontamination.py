"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of lower-cased words.  A benchmark item (or, of a long one,
each piece of up to ``LONGEST`` words) is looked for in every window of its own
size in every document:

1. a window that no edits within the bound could make of any item is passed over:
   too few of its words occur in the benchmark, or too few are different;
2. the CGK random walk embeds the window's words into a string three times as long,
   such that a few edits change a few places; ``WALKS`` walks are taken;
3. of each walk, ``SAMPLES`` keys are drawn, each the hash of ``BITS`` sampled places;
   windows and pieces that share a key are candidates;
4. candidates are verified by exact edit distance between the piece and the best
   stretch of words around the window.

Items of fewer words than allow a single edit have no edits to bound: their windows are
looked up whole, by one key of all words.

All this happens where the document is read: the index of a block of the benchmark
is made in a task and written to the shared folder, where the tasks that read documents
open it; larger benchmarks take several blocks, over each of which a step of documents goes
with words cut once.  No document is shuffled, so neither hot passages nor long texts
gather anywhere, and the driver sees the files' names only.
"""

from __future__ import annotations

import codecs
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh_folder
from .store import mapped, writing
from .words import Words, steps

#: Words of a piece at most, and pieces of a block at most.
LONGEST, BLOCK = 64, 20_000
#: Blocks' indexes that a worker keeps open.
OPEN_BLOCKS = 4
#: Walks, keys of each walk, places of each key.  Keys of one walk fail together where the walk goes astray, so more walks help most.
WALKS, SAMPLES, BITS = 8, 8, 5
#: Windows that are embedded at a time.
WINDOWS = 10_000
#: Words this near to their last occurrence count as repeats.
NEAR = 8
SEED = 977
_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What a character outside Windows-1252 is written as begins with a byte that no character of it has.
_ESCAPE = 0x81
_NO_WORD = np.array([not (b == _ESCAPE or (c := bytes([b]).decode("cp1252", "replace")).isalnum() and c != "\ufffd") for b in range(256)])


def _escaped(error: UnicodeEncodeError) -> tuple[bytes, int]:
    found = error.object[error.start : error.end]
    return b"".join(b"%c%06x" % (_ESCAPE, ord(c)) if c.isalnum() else b" " for c in found), error.end


codecs.register_error("pourline-words", _escaped)


def normal_words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORDS.findall(text.lower())


def cut_words(texts: list[str | None]) -> Words:
    """The same words of many texts."""
    return Words([(t or "").lower().encode("cp1252", "pourline-words") for t in texts], _NO_WORD)


def edit_stretch(piece: list[int], around: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``around`` with the least edit distance to piece, the first of equals."""
    row = [(0, j) for j in range(len(around) + 1)]
    for i, a in enumerate(piece, 1):
        new = [(i, 0)]
        for j, b in enumerate(around, 1):
            change, skip, add = row[j - 1], row[j], new[j - 1]
            best = (change[0] + (a != b), change[1])
            if skip[0] + 1 < best[0]:
                best = (skip[0] + 1, skip[1])
            if add[0] + 1 < best[0]:
                best = (add[0] + 1, add[1])
            new.append(best)
        row = new
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], row[end][1], end


def embed(words: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """CGK: rows of word ids (0 stands for unknown words, and follows a row's size) to rows three times as long.

    At step j the word under the pointer is written and the pointer moves on if the
    random bit of (step, word) is set; past a row's end, 0 is written.
    """
    n, width = words.shape
    flat = np.concatenate([words, np.zeros((n, 1), words.dtype)], axis=1).reshape(-1)
    base = np.arange(n, dtype=np.int64) * (width + 1)
    last, pointer, out = base + sizes, base.copy(), np.empty((3 * width, n), np.uint64)
    for j in range(3 * width):
        now = flat[pointer].astype(np.uint64)
        out[j] = now
        salt = np.uint64(((SEED + 1_000_003 * walk + 7919 * j) * 2 + 1) * int(_MIX) % 2**64)
        pointer += (((now + np.uint64(1)) * salt) >> np.uint64(63)).astype(np.int64)
        np.minimum(pointer, last, out=pointer)
    return out


def keys(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """WALKS * SAMPLES keys, one row each, for each row of word ids; places are drawn within three times a row's size."""
    rng, out, rows = np.random.default_rng(SEED), [], np.arange(len(words))
    for walk in range(WALKS):
        embedded = embed(words, sizes, walk)
        for _ in range(SAMPLES):
            key = sizes.astype(np.uint64) * np.uint64(WALKS) + np.uint64(walk)
            for draw in rng.random(BITS):
                key = (key ^ (key >> np.uint64(29))) * _MIX + embedded[(draw * 3 * sizes).astype(np.int64), rows]
            out.append(key ^ (key >> np.uint64(32)))
    return np.stack(out)


def pieces_of(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text number, first word, keys of the words) of every piece, in the order of the texts; texts without words have none."""
    words = cut_words(texts)
    keys = words.keys()
    for number, (low, high) in enumerate(zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False)):
        parts = -(-(high - low) // LONGEST)
        cuts = [(high - low) * k // parts for k in range(parts + 1)] if parts else []
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield number, start, keys[low + start : low + stop]


class Index:
    """One block of benchmark pieces (item, first word, keys of the words), ready to search."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]], rate: float):
        self.rate = rate
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *(k for _, _, k in pieces)]))
        self.pieces = [(item, start, (np.searchsorted(self.vocabulary, keys) + 1).tolist()) for item, start, keys in pieces]
        by_size: dict[int, list[int]] = {}
        for number, (_, _, ids) in enumerate(self.pieces):
            by_size.setdefault(len(ids), []).append(number)
        self.sizes, self.exact = [], {}
        for size, numbers in sorted(by_size.items()):
            if int(rate * size):
                different = min(len(set(self.pieces[p][2])) for p in numbers)
                self.sizes.append((size, int(rate * size), different))
            else:
                whole = self.exact.setdefault(size, {})
                for p in numbers:
                    whole.setdefault(tuple(self.pieces[p][2]), []).append(p)
        edited = np.array([p for p, (_, _, ids) in enumerate(self.pieces) if int(rate * len(ids))], np.int64)
        rows = np.zeros((len(edited), LONGEST), np.int32)
        for row, p in enumerate(edited.tolist()):
            rows[row, : len(self.pieces[p][2])] = self.pieces[p][2]
        found = keys(rows, np.array([len(self.pieces[p][2]) for p in edited.tolist()], np.int64))
        order = np.argsort(found, axis=1, kind="stable")
        self.sorted_keys, self.numbers = np.take_along_axis(found, order, 1), edited[order]

    def _windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, size) of the windows that could be made of a piece by edits within the bound."""
        known = words > 0
        known_before = np.concatenate([[0], np.cumsum(known)])
        near = np.zeros(len(words), bool)
        for back in range(1, NEAR + 1):
            near[back:] |= words[back:] == words[:-back]
        near_before = np.concatenate([[0], np.cumsum(near & known)])
        spots, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if self.sizes:
            # No window has more unknown words at its start than the largest number of edits.
            least, most = self.sizes[0][0], max(edits for _, edits, _ in self.sizes)
            hopeful = np.flatnonzero(known_before[least:] - known_before[:-least] >= least - most) if len(words) >= least else np.empty(0, np.int64)
            for size, edits, different in self.sizes:
                at = hopeful[: np.searchsorted(hopeful, len(words) - size, "right")]
                at = at[known_before[at + size] - known_before[at] >= size - edits]
                repeats = near_before[at + size] - near_before[np.minimum(at + NEAR, at + size)]
                at = at[size - repeats >= different - edits]
                spots.append(at)
                lengths.append(np.full(len(at), size, np.int64))
        return np.concatenate(spots), np.concatenate(lengths)

    def found(self, cut: Words) -> dict[tuple[int, int], tuple]:
        """(text number, item) -> (distance for the piece's size, first word, distance, words): the nearest stretch, of equal ones the first."""
        texts, own = range(len(cut.counts)), cut.keys()
        at = np.minimum(np.searchsorted(self.vocabulary, own), max(len(self.vocabulary) - 1, 0))
        ids = np.where(self.vocabulary[at] == own, at + 1, 0).astype(np.int32) if len(self.vocabulary) else np.zeros(len(own), np.int32)
        # Between texts stand as many unknown words as the longest piece has.
        begins = cut.bounds[:-1] + LONGEST * np.arange(1, len(texts) + 1)
        ends = begins + cut.counts
        words = np.zeros(int(cut.bounds[-1]) + LONGEST * (len(texts) + 1), np.int32)
        words[np.arange(len(ids)) + LONGEST * (1 + np.repeat(np.arange(len(texts)), cut.counts))] = ids
        best: dict[tuple[int, int], tuple] = {}
        spots, lengths = self._windows(words)
        met = [np.empty((2, 0), np.int64)]
        for part in range(0, len(spots), WINDOWS):
            at, sizes = spots[part : part + WINDOWS], lengths[part : part + WINDOWS]
            column = np.arange(LONGEST)
            rows = np.where(column < sizes[:, None], words[np.minimum(at[:, None] + column, len(words) - 1)], 0)
            for own, sorted_own, numbers in zip(keys(rows, sizes), self.sorted_keys, self.numbers, strict=True):
                low = np.searchsorted(sorted_own, own, "left")
                hits = np.flatnonzero(sorted_own[np.minimum(low, len(sorted_own) - 1)] == own)
                if len(hits):
                    many = np.searchsorted(sorted_own, own[hits], "right") - low[hits]
                    place = np.repeat(low[hits] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                    met.append(np.stack([numbers[place], np.repeat(at[hits], many)]))
        self._verify(np.unique(np.concatenate(met, axis=1), axis=1), words, begins, ends, best)
        for size, whole in self.exact.items():
            known = np.concatenate([[0], np.cumsum(words > 0)])
            for spot in np.flatnonzero(known[size:] - known[:-size] == size).tolist():
                for piece in whole.get(tuple(words[spot : spot + size].tolist()), ()):
                    doc = int(np.searchsorted(begins, spot, "right")) - 1
                    self._keep(best, doc, piece, 0, spot - int(begins[doc]), size)
        return best

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item, first word, words, distance) of every item found: of its pieces, the nearest stretch of each text."""
        return _rows(self.found(cut_words(texts)))

    def _keep(self, best: dict, doc: int, piece: int, distance: int, first: int, length: int) -> None:
        item, _, ids = self.pieces[piece]
        found = (distance / len(ids), first, distance, length)
        if (doc, item) not in best or found < best[doc, item]:
            best[doc, item] = found

    def _verify(self, met: np.ndarray, words, begins, ends, best) -> None:
        """Edit distances of candidates (piece, first word of the window), in order; near windows of a piece share one stretch of words."""
        pieces, spots = met[0].tolist(), met[1]
        half = np.array([len(self.pieces[p][2]) // 2 for p in pieces], np.int64)
        docs = np.searchsorted(begins, spots + half, "right") - 1
        at = 0
        while at < len(pieces):
            piece, doc, last = pieces[at], int(docs[at]), at
            _, _, ids = self.pieces[piece]
            edits = int(self.rate * len(ids))
            while last + 1 < len(pieces) and pieces[last + 1] == piece and docs[last + 1] == doc and spots[last + 1] - spots[last] <= len(ids):
                last += 1
            if doc >= 0 and begins[doc] < ends[doc]:
                low, high = max(int(begins[doc]), int(spots[at]) - edits), min(int(ends[doc]), int(spots[last]) + len(ids) + edits)
                around = words[low:high].tolist()
                if len(set(ids).difference(around)) <= edits:
                    distance, first, stop = edit_stretch(ids, around)
                    if distance <= edits:
                        self._keep(best, doc, piece, distance, low - int(begins[doc]) + first, stop - first)
            at = last + 1


def _rows(best: dict[tuple[int, int], tuple]) -> list[tuple[int, int, int, int, int]]:
    return [(doc, item, first, length, distance) for (doc, item), (_, first, distance, length) in best.items()]


@lru_cache(OPEN_BLOCKS)
def _index(uri: str) -> Index:
    """A block's index as its task wrote it; a worker keeps a few."""
    with mapped(uri) as source:
        return pickle.loads(source.read())


def search_blocks(uris: list[str], texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """What the blocks' indexes find in texts, whose words are cut once; of an item with pieces in several blocks, the nearest stretch."""
    cut, best = cut_words(texts), {}
    for uri in uris:
        for key, found in _index(uri).found(cut).items():
            if key not in best or found < best[key]:
                best[key] = found
    return _rows(best)


def indexes(spark: SparkSession, benchmark: DataFrame, rate: float, item_id: str, text: str, block: int = BLOCK) -> list[str]:
    """Files of the indexes of the benchmark's blocks, each made and written by a task; items without words are not looked for.

    Pieces are dealt by a hash over so many blocks that one has half of ``block`` pieces on average.
    """
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, 1):
                found = list(pieces_of(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([n for n, _, _ in found], pa.int64())),
                        pa.array([start for _, start, _ in found], pa.int64()),
                        pa.array([k.tobytes() for _, _, k in found], pa.binary()),
                    ],
                    names=["item_id", "start", "words"],
                )

    pieces = durable(rows.mapInArrow(cut, "item_id long, start long, words binary").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in pieces.groupBy("part").count().collect())  # one short row a task
    blocks = max(1, -(-sum(n for _, n in sizes) // block)) if sizes else 0
    folder = fresh_folder(spark, "benchmark")

    def build(key: tuple, group: pa.Table) -> pa.Table:
        found = sorted(
            (item if item is not None else -1, item is None, start, raw) for item, start, raw in zip(*(group.column(c).to_pylist() for c in ("item_id", "start", "words")), strict=True)
        )
        index = Index([(None if none else item, start, np.frombuffer(raw, np.uint64)) for item, none, start, raw in found], rate)
        with writing(folder, f"block-{key[0].as_py()}", ".index") as (stream, uri):
            stream.write(pickle.dumps(index))
        return pa.table({"uri": [uri]})

    if not blocks:
        return []
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("words", "item_id", "start"), F.lit(2 * blocks if blocks > 1 else 1)))
    return sorted(r["uri"] for r in dealt.groupBy("block").applyInArrow(build, "uri string").collect())


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.1,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance): documents that hold an item within rate * words edits.

    One row for each document and item, for the nearest stretch found of any piece of it.
    Items without words are not looked for; a null or empty text holds nothing; of
    repeated rows each has its own result.  Without items the result is empty.
    """
    schema = "doc_id long, item_id long, start_word long, n_words long, distance long"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    uris = indexes(docs.sparkSession, benchmark, rate, item_id, item_text, block)
    if not uris:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, 1):
                found = sorted(search_blocks(uris, texts), key=lambda x: (x[0], x[1] is None, x[1] or 0))
                columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(columns[0]), *columns[1:]], names=["doc_id", "item_id", "start_word", "n_words", "distance"]
                )

    return source.mapInArrow(run, schema)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; they are judged where they are read."""
    at = docs.columns.index(text)
    uris = indexes(docs.sparkSession, benchmark, rate, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, at):
                leaks = {x[0] for x in search_blocks(uris, texts)}
                yield part.filter(pa.array([i not in leaks for i in range(len(texts))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if uris else docs
