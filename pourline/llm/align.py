"""Alignment of the tokens of two tokenizers, and corpus counts of the linked id pairs.

*Units.*  A blank after something that is not white space starts a token of either tokenizer
here and is inside none (checked when the tables are read), so a text is cut there and the
alignment of a text is that of its units, one after another.  A worker remembers the units it
met; a batch's new units are encoded together and aligned with a few sorted searches: the
ends of the tokens of both sides cut the bytes into stretches, each of which is one link.

*Counts.*  A first pass folds every task's texts into (pair, texts that hold it).  The different
pairs are dealt by a hash over buckets; each bucket gets a minimal perfect hash and is
written with its keys in hash order.  The folded rows become dense vectors of counts indexed by
that hash, which are summed bucket by bucket in a tree of fixed width.  A second pass aligns the
texts again and reads the counts of their pairs at the hashed places, where the stored key
must be the pair asked for.  All of it lies in the folder that driver and executors share; the driver
sees the names of the buckets' files only.
"""

from __future__ import annotations

import hashlib
import re
from collections import ChainMap
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder
from .perfect_hash import PerfectHash, mixed
from .store import mapped, writing
from .tokens import _spread

#: Pairs of one bucket on average; buckets are a power of two.
BUCKET_PAIRS = 1 << 16
#: Units that a worker remembers, and the longest of them; longer ones are aligned where they are met.
MEMORY_UNITS, LONGEST_UNIT = 300_000, 64
#: Characters of units that are encoded in one text.
JOINED_CHARS = 2000
#: Different pairs that a worker numbers before it starts anew.
FOLDED_PAIRS = 1 << 20
#: Vectors that are summed into one.
FAN_IN = 16
#: Buckets' files that a worker keeps open at most.
OPEN_BUCKETS = 256
_HASH_BITS = 20
_BUCKET_SEED = 1 << 20
_CUT = re.compile(r"(?<=\S)(?= )")
_CROSSED = re.compile(r"\s ")

_PARTIAL = "bucket long, pair long, n long"
_FILE = "bucket long, n_pairs long, uri string"
_VECTOR = "bucket long, slot long, counts binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---- the two tokenizers ----


def _byte_values() -> dict[str, int]:
    """The byte behind every character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers: ids of many texts, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        value = _byte_values()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(value[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {piece!r} goes on after a blank: texts cannot be cut before blanks")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.sizes_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.sizes_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        self.blank_b = self.b.piece_to_id("▁")

        texts = [[np.array([f"{i}{mark}" for i in range(len(known))], object) for mark in marks] for known, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        self.texts_a, self.texts_b = texts

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that start with a blank; the second tokenizer puts its own before what it is given."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [[self.blank_b] if t == " " else x for t, x in zip(texts, b, strict=True)]

    def spelled(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, ids of B, whether each unit is exact); a unit that is not has no ids.

        Units go to the tokenizers some at a time, joined, which gives their ids one after another.  White space at
        a unit's end would run on into the next one's blank, so such a unit is the last of its text.
        """
        starts, size = [0], 0
        for n, u in enumerate(units[:-1], 1):
            size += len(u)
            if size >= JOINED_CHARS or u[-1].isspace():
                starts.append(n)
                size = 0
        parts = [units[i:j] for i, j in zip(starts, [*starts[1:], len(units)], strict=True)] if units else []
        a, b, exact = [], [], []
        for part, ids_a, ids_b, fits in self._checked(["".join(p) for p in parts], parts):
            if fits or len(part) == 1:
                alone = [(ids_a, ids_b, fits)]
                exact += [fits] * len(part)
            else:
                alone = [(x, y, ok) for _, x, y, ok in self._checked(part, [[u] for u in part])]
                exact += [ok for _, _, ok in alone]
            for x, y, ok in alone:
                if ok:
                    a.append(np.array(x, np.int64))
                    b.append(np.array(y, np.int64))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b]), np.array(exact, bool)

    def _checked(self, texts: list[str], units: list[list[str]]) -> Iterator[tuple[list[str], list[int], list[int], bool]]:
        known_a, known_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for part, text, x, y in zip(units, texts, *self.ids(texts), strict=True):
            raw = text.encode()
            yield part, x, y, b"".join(map(known_a, x)) == raw and b"".join(map(known_b, y)) == raw


@dataclass
class Aligned:
    """Units one after another: the linked pairs as numbers of the worker's, how many each has, counts, and groups as text."""

    codes: np.ndarray
    n_links: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    exact: np.ndarray


def _different(values: np.ndarray) -> np.ndarray:
    """Sorted values without repeats, by a sort (much faster here than numpy's unique, which hashes)."""
    out = np.sort(values)
    return out[np.concatenate([np.ones(min(len(out), 1), bool), out[1:] != out[:-1]])]


def align(tokenizers: Pair, units: list[str], number: Callable[[np.ndarray], np.ndarray]) -> Aligned:
    """Every unit on its own; ``number`` gives pairs their numbers.  A unit whose tokens do not spell it is not exact and has nothing."""
    a, b, exact = tokenizers.spelled(units)
    end_a, end_b = np.cumsum(tokenizers.sizes_a[a]), np.cumsum(tokenizers.sizes_b[b])
    sizes = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
    bounds = np.concatenate([[0], np.cumsum(np.where(exact, sizes, 0))])  # where units end, in bytes of the exact ones
    cuts = _different(np.concatenate([end_a, end_b]))  # every stretch between two cuts lies in one token of each side
    pairs = (a[np.searchsorted(end_a, cuts)] << 32) | b[np.searchsorted(end_b, cuts)]
    both = end_b[end_a[np.minimum(np.searchsorted(end_a, end_b), len(end_a) - 1)] == end_b] if len(end_a) else end_b
    n_a, n_b, n_links, n_groups = (np.diff(np.searchsorted(ends, bounds, "right")) for ends in (end_a, end_b, cuts, both))
    # Groups as text: the tokens by group and side, each with the mark that follows it.
    side = np.concatenate([2 * np.searchsorted(both, end_a), 2 * np.searchsorted(both, end_b) + 1])
    last = np.empty(len(side), np.int64)
    last[:-1] = side[1:] != side[:-1]
    last[-1:] = 1
    last[len(a) - 1 : len(a)] = 1
    text = np.empty(len(side), object)
    for own, held, marked in ((slice(0, len(a)), a, tokenizers.texts_a), (slice(len(a), None), b, tokenizers.texts_b)):
        text[own] = np.where(last[own] == 1, marked[1][held], marked[0][held])
    said = text[np.argsort(side, kind="stable")].tolist()
    ends = np.cumsum(n_a + n_b).tolist()
    groups = ["".join(said[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=False)]
    return Aligned(number(pairs), n_links, n_a, n_b, n_groups, groups, exact)


def cut_units(text: str) -> list[str]:
    """A blank and the text, cut before every blank that follows something other than white space."""
    whole = " " + text
    if _CROSSED.search(whole, 0):
        return _CUT.split(whole)
    return [" " + part for part in text.split(" ")]


# ---- what a worker remembers ----


class Memory:
    """Alignments of units met before, in flat arrays; ``numbers`` gives a unit's place in them.

    When they are too many, those met once since the last time are forgotten.  Units too long to be met often
    are aligned for the step alone and follow the ``size`` remembered ones.  Pairs are numbered as they come;
    ``pairs`` has the pair of each number.
    """

    def __init__(self, tokenizers: Pair, most: int = MEMORY_UNITS):
        self.tokenizers, self.most = tokenizers, most
        self.start_anew()

    def start_anew(self) -> None:
        self.numbers: dict[str, int] = {}
        self.codes: dict[int, int] = {}
        self.pairs = np.empty(0, np.int64)
        self.flat = self._align([])
        self.size, self.uses = 0, np.empty(0, np.int64)

    def _align(self, units: list[str]) -> Aligned:
        return align(self.tokenizers, units, self._number)

    def _number(self, pairs: np.ndarray) -> np.ndarray:
        different = _different(pairs)
        known = self.codes
        own = np.fromiter((known.setdefault(p, len(known)) for p in different.tolist()), np.int64, len(different))
        fresh = different[own >= len(self.pairs)]
        self.pairs = np.concatenate([self.pairs, fresh])  # numbers were given in this order
        return own[np.searchsorted(different, pairs)]

    def _forget(self) -> None:
        """Keep the units that were met again."""
        stay = np.flatnonzero(self.uses > 1)
        if 2 * len(stay) > self.most:
            stay = stay[-self.most // 2 :]
        old, kept = self.flat, stay.tolist()
        names = list(self.numbers)
        start = np.cumsum(old.n_links) - old.n_links
        rest = [x[stay] for x in (old.n_links, old.n_a, old.n_b, old.n_groups)]
        self.flat = Aligned(old.codes[_spread(start[stay], old.n_links[stay])], *rest, [old.groups[k] for k in kept], old.exact[stay])
        self.numbers = {names[k]: n for n, k in enumerate(kept)}
        self.size, self.uses = len(kept), np.zeros(len(kept), np.int64)

    def __call__(self, units: list[list[str]]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """(alignments, the place in them of every unit of the texts, units of each text)."""
        if len(self.pairs) > FOLDED_PAIRS:
            self.start_anew()
        elif self.size > self.most:
            self._forget()
        every = list(chain.from_iterable(units))
        places = np.fromiter(map(self.numbers.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(places < 0).tolist()
        new = list(dict.fromkeys([every[k] for k in missing]))
        short = [u for u in new if len(u) <= LONGEST_UNIT]
        if short:
            self.numbers.update(zip(short, range(self.size, self.size + len(short)), strict=True))
            self.flat = _joined(self.flat, self._align(short))
            self.size += len(short)
            self.uses = np.concatenate([self.uses, np.zeros(len(short), np.int64)])
        flat, find = self.flat, self.numbers
        if len(short) < len(new):
            long = [u for u in new if len(u) > LONGEST_UNIT]
            flat = _joined(flat, self._align(long))
            find = ChainMap(dict(zip(long, range(self.size, self.size + len(long)), strict=True)), find)
        places[missing] = [find[every[k]] for k in missing]
        self.uses += np.bincount(places[places < self.size], minlength=self.size)
        return flat, places, np.fromiter(map(len, units), np.int64, len(units))


def _joined(first: Aligned, second: Aligned) -> Aligned:
    numbers = [np.concatenate([getattr(first, f), getattr(second, f)]) for f in ("codes", "n_links", "n_a", "n_b", "n_groups")]
    return Aligned(*numbers, first.groups + second.groups, np.concatenate([first.exact, second.exact]))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of stretches of so many values, one after another."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


@lru_cache(2)
def _memory(path_a: str, path_b: str) -> Memory:
    """The worker's memory for two tokenizer files; workers outlive tasks."""
    return Memory(Pair(path_a, path_b))


def _texts_of(batches: Iterator[pa.RecordBatch], most_rows: int = 512, most_chars: int = 2 << 20) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) in steps of bounded size; a longer text is a step of its own."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            chars += len(t or "")
            if len(ids) >= most_rows or chars >= most_chars:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def _step(memory: Memory, texts: list[str | None]) -> tuple[Aligned, np.ndarray, np.ndarray]:
    """Alignments of the texts' units.  A text with a unit that is not exact is aligned whole, as a unit of its own."""
    units = [cut_units(t) if t else [] for t in texts]
    flat, places, counts = memory(units)
    bad = ~flat.exact[places]
    if bad.any():
        whole = set(np.repeat(np.arange(len(texts)), counts)[bad].tolist())
        units = [[" " + texts[n]] if n in whole else u for n, u in enumerate(units)]
        flat, places, counts = memory(units)
    return flat, places, counts


# ---- first pass: the texts of every pair ----


def _bucket_hash(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs, _BUCKET_SEED) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


def _count_pairs(path_a: str, path_b: str):
    schema = pa.schema([("bucket", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(path_a, path_b)
        known, counts = memory.pairs, np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            held = np.flatnonzero(counts)
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(_bucket_hash(known[held])), pa.array(known[held]), pa.array(counts[held])], schema=schema)

        for _, texts in _texts_of(batches):
            flat, places, per_text = _step(memory, texts)
            if len(memory.pairs) < len(known) or (memory.pairs[: len(known)] != known).any():  # numbers were given anew
                yield from rows()
                counts = np.zeros(0, np.int64)
            known = memory.pairs
            start = np.cumsum(flat.n_links) - flat.n_links
            once = _different((np.repeat(np.arange(len(texts)), per_text) << 32) | places)  # a unit counts once a text
            text, places = once >> 32, once & 0xFFFFFFFF
            links = flat.n_links[places]
            once = _different((np.repeat(text, links) << 32) | flat.codes[_spread(start[places], links)])
            found = np.bincount(once & 0xFFFFFFFF, minlength=len(known))
            found[: len(counts)] += counts
            counts = found
        yield from rows()

    return run


# ---- buckets ----


def _write_bucket(folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One bucket's different pairs -> its file: the hash, and the pairs in hash order."""
        pairs = table.column("pair").to_numpy()
        hashed = PerfectHash.build(pairs)
        ordered = np.empty(len(pairs), np.int64)
        ordered[hashed(pairs)] = pairs
        bucket = key[0].as_py()
        with writing(folder, f"pairs-{bucket}", ".bin") as (stream, uri):
            head = np.array([len(hashed.levels), len(hashed.bits), len(pairs)], np.int64)
            for part in (head, hashed.levels, ordered, np.packbits(hashed.bits)):
                stream.write(part.tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "n_pairs": pa.array([len(pairs)], pa.int64()), "uri": [uri]})

    return run


class Buckets:
    """Index of pairs within their buckets; files are opened as they are asked for, a bounded number at a time."""

    def __init__(self, uris: dict[int, str], bits: int):
        self.uris, self.bits = uris, bits
        self.opened: dict[int, tuple[PerfectHash, np.ndarray]] = {}

    def bucket(self, pairs: np.ndarray) -> np.ndarray:
        return _bucket_hash(pairs) >> (_HASH_BITS - self.bits)

    def file(self, bucket: int) -> tuple[PerfectHash, np.ndarray]:
        if bucket not in self.opened:
            if len(self.opened) >= OPEN_BUCKETS:
                self.opened.pop(next(iter(self.opened)))
            with mapped(self.uris[bucket]) as source:
                raw = source.read()
            n_levels, n_bits, n_pairs = np.frombuffer(raw, np.int64, 3).tolist()
            levels = np.frombuffer(raw, np.int64, n_levels, 24)
            pairs = np.frombuffer(raw, np.int64, n_pairs, 24 + 8 * n_levels)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 24 + 8 * (n_levels + n_pairs)), count=n_bits).astype(bool)
            self.opened[bucket] = PerfectHash.of(levels, bits), pairs
        return self.opened[bucket]

    def index(self, bucket: int, pairs: np.ndarray) -> np.ndarray:
        """Places of pairs of one bucket; -1 for a pair that the bucket does not hold, as its stored key tells."""
        if bucket not in self.uris:
            return np.full(len(pairs), -1, np.int64)
        hashed, stored = self.file(bucket)
        at = hashed(pairs)
        return np.where((at >= 0) & (stored[at] == pairs), at, -1)


def _all_known(known: np.ndarray) -> None:
    if not known.all():
        raise RuntimeError("a pair was not counted: the texts changed between the passes")


def _vectors(uris: dict[int, str], bits: int):
    """Folded rows of a task -> a dense vector of counts for each bucket it has rows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, slot = Buckets(uris, bits), TaskContext.get().partitionId()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            pairs, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            own = buckets.bucket(pairs)
            order = np.argsort(own, kind="stable")
            bounds = np.flatnonzero(np.diff(own[order], prepend=-1, append=-1))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = order[lo:hi]
                bucket = int(own[rows[0]])
                at = buckets.index(bucket, pairs[rows])
                _all_known(at >= 0)
                if bucket not in sums:
                    sums[bucket] = np.zeros(len(buckets.file(bucket)[1]), np.int64)
                np.add.at(sums[bucket], at, n[rows])
            if len(sums) >= OPEN_BUCKETS:
                yield from _vector_rows(sums, slot)
                sums = {}
        yield from _vector_rows(sums, slot)

    return run


def _vector_rows(sums: dict[int, np.ndarray], slot: int) -> Iterator[pa.RecordBatch]:
    for bucket, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([slot], pa.int64()), pa.array([counts.tobytes()], pa.binary())], ["bucket", "slot", "counts"])


def _sum_vectors(key: tuple, table: pa.Table) -> pa.Table:
    """The sum of at most FAN_IN vectors of one bucket."""
    total = sum(np.frombuffer(raw.as_buffer(), np.int64) for raw in table.column("counts"))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "slot": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _write_counts(folder: str, uris: dict[int, str], bits: int):
    """Summed vectors -> count files, and each bucket's highest count for every id of the first tokenizer."""
    schema = pa.schema([("bucket", pa.int64()), ("uri", pa.string()), ("a", pa.int64()), ("top", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(uris, bits)
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(raw.as_buffer(), np.int64)
                with writing(folder, f"counts-{bucket}", ".bin") as (stream, uri):
                    stream.write(counts.tobytes())
                first = buckets.file(bucket)[1] >> 32
                order = np.lexsort((counts, first))
                last = order[np.diff(first[order], append=-1) != 0]
                n = len(last)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket)), pa.array([uri] * n, pa.string()), pa.array(first[last]), pa.array(counts[last])], schema=schema)

    return run


# ---- second pass ----


class Counts:
    """Corpus counts of pairs, and whether each is the highest of its first id."""

    def __init__(self, buckets: Buckets, uris: dict[int, str], tops: np.ndarray):
        self.buckets, self.uris, self.tops = buckets, uris, tops
        self.opened: dict[int, np.ndarray] = {}

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, whether highest); -1 for pairs that no text holds."""
        different, code = np.unique(pairs, return_inverse=True)
        own, counts = self.buckets.bucket(different), np.zeros(len(different), np.int64)
        order = np.argsort(own, kind="stable")
        bounds = np.flatnonzero(np.diff(own[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = order[lo:hi]
            bucket = int(own[rows[0]])
            at = self.buckets.index(bucket, different[rows])
            if (at < 0).all():
                counts[rows] = -1
                continue
            if bucket not in self.opened:
                if len(self.opened) >= OPEN_BUCKETS:
                    self.opened.pop(next(iter(self.opened)))
                with mapped(self.uris[bucket]) as source:
                    self.opened[bucket] = np.frombuffer(source.read(), np.int64)
            counts[rows] = np.where(at >= 0, self.opened[bucket][at], -1)
        first = np.minimum(different >> 32, len(self.tops) - 1)
        best = counts == self.tops[first]
        return counts[code], best[code]


def _look_up(path_a: str, path_b: str, uris: dict[int, str], bits: int, count_uris: dict[int, str], tops: np.ndarray):
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in (x.split()[0] for x in _RESULT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, counts = _memory(path_a, path_b), Counts(Buckets(uris, bits), count_uris, tops)
        known, count, top = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for ids, texts in _texts_of(batches):
            flat, places, per_text = _step(memory, texts)
            if len(memory.pairs) < len(known) or (memory.pairs[: len(known)] != known).any():  # numbers were given anew
                count, top = count[:0], top[:0]
            if len(memory.pairs) > len(count):
                more, highest = counts.of(memory.pairs[len(count) :])
                count, top = np.concatenate([count, more]), np.concatenate([top, highest])
            known = memory.pairs
            linked = count[flat.codes]
            # Units met only in texts without tokens were not counted, and no other text holds them.
            _all_known(_sums(linked < 0, flat.n_links)[places] == 0)
            units = (flat.n_a, flat.n_b, flat.n_groups, flat.n_links, _sums(top[flat.codes], flat.n_links), _sums(linked, flat.n_links))
            columns = [_sums(values[places], per_text) for values in units]
            hashes, at, where = [], 0, places.tolist()
            for n, held in zip(per_text.tolist(), columns[0].tolist(), strict=True):
                hashes.append(hashlib.sha256(";".join([flat.groups[k] for k in where[at : at + n]]).encode()).hexdigest() if held else "")
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in columns), pa.array(hashes, pa.string())], schema=schema)

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    A is a byte-level tokenizer of the tokenizers library, given a blank and the text; B is a
    sentencepiece model, which puts the blank there itself.  Special tokens' strings in texts are plain text.
    A link is a token of either side whose bytes overlap; a pair of ids counts in every row that holds
    it linked.  Texts that are null or empty, and those that the tokens of either side do not spell
    byte for byte (as U+2581 for B), have no tokens: zeros and ''.  Rows with equal or without ids are
    rows of their own; other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "aligned")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(_count_pairs(path_a, path_b), _PARTIAL).write.option("compression", "zstd").parquet(f"{folder}/folded")
    folded = spark.read.schema(_PARTIAL).parquet(f"{folder}/folded")

    pairs = folded.select("bucket", "pair").distinct()
    pairs.write.option("compression", "zstd").parquet(f"{folder}/pairs")
    pairs = spark.read.schema("bucket long, pair long").parquet(f"{folder}/pairs")
    bits = min(_HASH_BITS, max(0, (pairs.count() - 1) // bucket_pairs).bit_length())
    shift = _HASH_BITS - bits
    bucketed = pairs.select(F.shiftright("bucket", shift).alias("bucket"), "pair")
    files = bucketed.groupBy("bucket").applyInArrow(_write_bucket(f"{folder}/hashes"), _FILE)
    uris = {r["bucket"]: r["uri"] for r in files.collect()}

    vectors = folded.mapInArrow(_vectors(uris, bits), _VECTOR)
    slots = max(1, folded.rdd.getNumPartitions())
    while True:
        slots = -(-slots // FAN_IN)
        vectors = vectors.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("bucket", "slot").applyInArrow(_sum_vectors, _VECTOR)
        if slots <= 1:
            break
    vectors.mapInArrow(_write_counts(f"{folder}/counts", uris, bits), "bucket long, uri string, a long, top long").write.parquet(f"{folder}/tops")
    tops = spark.read.schema("bucket long, uri string, a long, top long").parquet(f"{folder}/tops")
    count_uris = {r["bucket"]: r["uri"] for r in tops.select("bucket", "uri").distinct().collect()}
    # One number for each id of the first tokenizer: bounded by its vocabulary.
    best = tops.groupBy("a").agg(F.max("top").alias("top")).toPandas()
    highest = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    highest[best["a"].to_numpy(np.int64)] = best["top"].to_numpy(np.int64)
    return rows.mapInArrow(_look_up(path_a, path_b, uris, bits, count_uris, highest), _RESULT)
