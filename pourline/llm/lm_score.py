"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of words and one end.  Every token has a binary (Huffman) code:
the commonest words one of their own, any other word that of its bucket (a hash of the
word), after which its share of the bucket follows from corpus counts.  Each bit of a code
is predicted without context, by the corpus counts of the two subtrees of the code,
and by several contexts: the word before, the two before, the one before that, and the
nearest frequent word before.  Each context hashes the bit's place in the code into a
table of bit counts, whose size grows with the number of training tokens.  A
context's prediction starts from the one without context and moves by its counts;
the log-odds by which the contexts move are mixed by weights, and the set of weights
is gated by how much two contexts have seen.  A last table refines the mixed probability
from what came true before at such a probability.

Training covers all training rows in one pass over shards: rows are dealt by a hash
of id and text into shards of bounded size and learned in the order of that hash, so
the model does not depend on how Spark partitions the table.  A shard predicts a
block of tokens from what it has counted so far, learns weights and refinement from
the outcome (so they are never fitted to tokens already counted), and then counts the
block.  Count tables and weights (in fixed point) are summed exactly, as a tree.
Word counts, which grow with the corpus, stay distributed: only words above a
count that leaves ``COMMON`` of them at most are broadcast, others are joined.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .words import lower_words, steps

#: Words broadcast at most, how many of them have a code of their own, and buckets of all other words.
COMMON, OWN, BUCKETS = 100_000, 1 << 14, 1024
#: Bytes of a shard's texts, about; shards whose tables are summed at a time; tokens predicted at a time; slots in a row of counts.
SHARD_BYTES, FAN, TOKENS, CHUNK = 32_000_000, 32, 1 << 15, 1 << 16
#: Tokens that a task counts before it sends their counts on.
FLUSH = 4_000_000
#: Bits of the table of the two words before, at least and at most (a worker holds 8 bytes a slot in training), and how many fewer the other contexts' tables have.
LEAST_BITS, MOST_BITS, FEWER = 16, 22, (1, 0, 1, 3)
#: How many bits of a code each context predicts, from the first on: a frequent word before says little of the finer ones.
DEEP = (32, 32, 32, 10)
#: A word whose code is as short is a frequent one.
FREQUENT = 8
GATES, CELLS, PRIOR, RATE = 16, 33, 2.0, 0.02
#: Mixed log-odds are looked up in steps of 1 / FINE within +-REACH; costs are in units of 2 ** -20 of log10.
FINE, REACH, UNIT = 32, 12, 1 << 20
INPUTS = len(FEWER) + 2
#: The end's key and the key before a text; no word hashes to a reserved value but by the chance of 64 bits.
END, START = np.int64(-7046029254386353131), np.uint64(1609587929392839161)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_K1, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def held_out_column(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a row without id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys of the texts' words, and the end's after each text; where each text begins, and the whole number)."""
    words = lower_words(texts)
    bounds = words.bounds + np.arange(len(texts) + 1)
    out = np.full(int(bounds[-1]), END, np.int64)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] - 1] = False
    out[inside] = words.keys().view(np.int64)
    return out, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def sent() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "c"])

    for batch in batches:
        for _, texts in steps(batch, 0):
            held.append(token_keys(texts)[0])
            size += len(held[-1])
            if size > FLUSH:
                yield sent()
                size = 0
    if held:
        yield sent()


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Huffman code lengths; weights are floored so that no code is longer than 30 bits or so."""
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    sorted_weights = np.maximum(weights[order], weights.sum() / 2**24).tolist()
    # Two queues: leaves and inner nodes, both from light to heavy.
    leaves, inner, up, node = deque(enumerate(sorted_weights)), deque(), np.zeros(2 * n - 1, np.int64), n

    def lightest() -> tuple[int, float]:
        return leaves.popleft() if leaves and (not inner or leaves[0][1] <= inner[0][1]) else inner.popleft()

    while len(leaves) + len(inner) > 1:
        (a, x), (b, y) = lightest(), lightest()
        up[a] = up[b] = node
        inner.append((node, x + y))
        node += 1
    depth = [0] * (2 * n - 1)
    for k, parent in zip(range(2 * n - 3, -1, -1), up[: 2 * n - 2][::-1].tolist(), strict=True):
        depth[k] = depth[parent] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


class Code:
    """Binary codes of all symbols: the buckets of words first, then the words with codes of their own, in the order of their keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, rare_counts: np.ndarray, rare_kinds: np.ndarray):
        self.places = Places(keys)
        weights = np.concatenate([rare_counts + 0.5 * (rare_kinds + 1), counts + 0.5])
        self.size = code_lengths(weights).astype(np.uint8)
        # Canonical: codes of one length follow each other; heavier symbols first.
        code, at = np.zeros(len(weights), np.uint32), 0
        order = np.lexsort((-weights, self.size))
        lengths = self.size[order].tolist()
        values, last = [], 0
        for length in lengths:
            at <<= length - last
            values.append(at)
            at += 1
            last = length
        code[order] = values
        self.code = code
        #: Of each symbol's bits, in turn: the log-odds that the counts of the two subtrees give.
        self.start = np.cumsum(self.size.astype(np.int64)) - self.size
        self.odds = np.zeros(int(self.size.sum()), np.float32)
        by_code, code, size, weights = order, code[order], self.size[order].astype(np.uint32), weights[order]
        for depth in range(int(size.max(initial=0))):
            deep = size > depth
            here, own, w = by_code[deep], code[deep] >> (size[deep] - np.uint32(depth + 1)), weights[deep]
            # Codes of one length are in order, but not those of several: the subtrees' weights are summed by prefix.
            prefix, number = np.unique(own, return_inverse=True)
            sums = np.bincount(number, w)
            # Every subtree's sibling differs from it in the last bit alone.
            sibling = np.searchsorted(prefix, prefix ^ np.uint32(1))
            with_sibling = (sibling < len(prefix)) & (prefix[np.minimum(sibling, len(prefix) - 1)] == prefix ^ np.uint32(1))
            other = np.where(with_sibling, sums[np.minimum(sibling, len(prefix) - 1)], 1e-9)
            odds = np.where(prefix & np.uint32(1) == 1, np.log(sums / other), np.log(other / sums))
            self.odds[self.start[here] + depth] = np.clip(odds, -REACH, REACH)[number]
        self.p = 1 / (1 + np.exp(-self.odds))
        #: log10 of every bucket's total, of which a word has its count and 0.5.
        self.total = np.log10(rare_counts + 0.5 * (rare_kinds + 1))

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        at = self.places.of(keys)
        return np.where(at >= 0, at + BUCKETS, bucket_of(keys))


def bucket_of(keys: np.ndarray) -> np.ndarray:
    """The bucket of each word: the first bits of its key."""
    return (keys.view(np.uint64) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


class Places:
    """Where keys are among sorted ones: the first bits of a key tell where to begin, some steps lead to the key."""

    #: Steps from where the first bits lead, at most; where equal first bits are commoner, keys are searched for.
    STEPS = 16

    def __init__(self, sorted_keys: np.ndarray):
        self.keys = sorted_keys
        bits = max(1, (2 * len(sorted_keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        per_slot = np.bincount(self._slots(sorted_keys), minlength=1 << bits)
        self.few = bool(per_slot.max() <= self.STEPS)
        self.first = np.minimum(np.cumsum(per_slot) - per_slot, max(0, len(sorted_keys) - 1)).astype(np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        # With the sign turned, unsigned keys are in the order of the signed ones.
        slots = keys.view(np.uint64) ^ np.uint64(1 << 63)
        slots >>= self.shift
        return slots.view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        if not self.few:
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            return np.where(self.keys[at] == keys, at, -1)
        at = self.first.take(self._slots(keys)).astype(np.int64)
        found = self.keys.take(at)
        behind = np.flatnonzero(found < keys)
        while len(behind := behind[at[behind] < len(self.keys) - 1]):
            at[behind] += 1
            found[behind] = step = self.keys.take(at[behind])
            behind = behind[step < keys[behind]]
        at[found != keys] = -1
        return at


def contexts(keys: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """32-bit hashes of every token's contexts, one row a context; all are within the token's text."""
    n, key = len(keys), keys.view(np.uint64)
    before, second, far = np.full(n, START), np.full(n, START), np.full(n, START)
    before[1:] = key[:-1]
    before[bounds[:-1]] = START
    second[1:] = before[:-1]
    second[bounds[:-1]] = START
    last = np.maximum.accumulate(np.where(frequent, np.arange(n), -1))[:-1]
    within = np.flatnonzero(last >= np.repeat(bounds[:-1], np.diff(bounds))[1:])
    far[within + 1] = key[last[within]]
    out = np.zeros((len(FEWER), n), np.uint32)
    first = before * _M1
    for row, mixed in enumerate((first, (first ^ second) * _M2, (second + np.uint64(977)) * _M2, (far + np.uint64(31)) * _M1 ^ np.uint64(1 << 60))):
        out[row] = (mixed ^ (mixed >> np.uint64(29))) * _M2 >> np.uint64(32)
    return out


def table_bits(tokens: int) -> list[int]:
    """Table sizes for so many training tokens: one bit more for four times as many, until a worker's memory bounds them."""
    most = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(tokens + 1) / 2) + 9))
    return [most - f for f in FEWER]


def bit_levels(code: Code, symbols: np.ndarray, hashes: np.ndarray, bits: list[int]) -> Iterator[tuple]:
    """Level by level of the codes: (tokens whose codes reach it, their bits there, log-odds and probability without context, slots by context).

    The tokens of a level are the first ones of the level before. All places are within their tables, so taking with
    wrapping, which is the fastest way, never wraps.
    """
    size = code.size[symbols]
    order = np.argsort(size, kind="stable")[::-1]
    own = symbols.take(order)
    size, codes, starts, hashes = size.take(order).astype(np.uint32), code.code.take(own), code.start.take(own), hashes.take(order, axis=1)
    longer = np.cumsum(np.bincount(size, minlength=33)[::-1])[::-1]
    for depth in range(int(size[0]) if len(size) else 0):
        n = int(longer[depth + 1])
        rest = codes[:n] >> (size[:n] - np.uint32(depth + 1))
        salt = ((rest >> np.uint32(1)) + np.uint32(1 << depth)) * _K1
        slots = []
        for h, b, deep in zip(hashes, bits, DEEP, strict=True):
            if depth < deep:
                slot = h[:n] ^ salt
                slot *= _K2
                slot >>= np.uint32(32 - b)
                slots.append(slot.astype(np.intp))
        at = starts[:n] + depth
        yield order[:n], (rest & np.uint32(1)).astype(np.int64), code.odds.take(at, mode="wrap"), code.p.take(at, mode="wrap"), slots


#: The class of what a slot has seen, for small counts.
_CLASSES = np.digitize(np.arange(64), (1, 4, 32)).astype(np.int64)
#: The probability of every mixed value, and the cell it is refined in.
_MIXED = np.arange(2 * FINE * REACH + 1) / FINE - REACH
_SQUASH = 1 / (1 + np.exp(-_MIXED))
_CELL = np.clip(np.rint(_MIXED * 1.5) + CELLS // 2, 0, CELLS - 1).astype(np.int64)
#: State bytes: counts up to SMALL in all are kept as they are; above, their number by class and log-odds by level.
SMALL, LEVELS = 6, 32
_STEPS = np.array([7, 11, 17, 33, 65, 257, 2049, 32768])
_FIRST = (SMALL + 1) * (SMALL + 2) // 2
_ODDS_STEP = 2 * 9.0 / (LEVELS - 1)


def _state_counts() -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) that each state byte stands for."""
    zeros, ones = np.zeros(256), np.zeros(256)
    for n in range(SMALL + 1):
        for one in range(n + 1):
            ones[n * (n + 1) // 2 + one], zeros[n * (n + 1) // 2 + one] = one, n - one
    for k in range(len(_STEPS) - 1):
        size = math.sqrt(_STEPS[k] * _STEPS[k + 1])
        for level in range(LEVELS):
            p = 1 / (1 + math.exp(9.0 - level * _ODDS_STEP))
            # The ends of the scale stand for counts of one kind alone.
            p = 0.0 if level == 0 else 1.0 if level == LEVELS - 1 else p
            ones[_FIRST + k * LEVELS + level], zeros[_FIRST + k * LEVELS + level] = size * p, size * (1 - p)
    return zeros, ones


_ZEROS, _ONES = (x.astype(np.float32) for x in _state_counts())
_STATE_CLASS = _CLASSES[np.minimum(np.rint(_ZEROS + _ONES), 63).astype(np.int64)]


def moved(zeros: np.ndarray, ones: np.ndarray, prior: np.ndarray, other: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """By how much counts, to which prior counts of ones and zeros are added, move log-odds away from plain ones; none if nothing was seen. Counts are overwritten."""
    ones += prior
    zeros += other
    ones /= zeros
    np.log(ones, out=ones)
    ones -= plain
    return ones


def priors(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prior counts of ones and of zeros at a probability without context."""
    prior = np.float32(PRIOR) * p
    return prior, np.float32(PRIOR) - prior


def _place(mixed: np.ndarray) -> np.ndarray:
    """Mixed log-odds to places in the tables above."""
    mixed = np.clip(mixed, -REACH, REACH)
    mixed *= FINE
    place = np.rint(mixed, out=mixed).astype(np.int64)
    place += FINE * REACH
    return place


class Learner:
    """One shard's tables, weights and refinement counts; a slot holds the count of ones above that of zeros."""

    def __init__(self, code: Code, bits: list[int]):
        self.code, self.bits = code, bits
        self.counts = [np.zeros(1 << b, np.int64) for b in bits]
        self.weights = first_weights()
        self.squares = np.full((GATES, INPUTS), 1e-2)
        self.refine = np.zeros(2 * GATES * CELLS, np.int64)
        self.seen = 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def feed(self, texts: list[str | None]) -> None:
        """Learn from whole texts, in blocks that do not depend on how texts are handed over."""
        keys, bounds = token_keys(texts)
        symbols = self.code.symbols(keys)
        self.held.append((symbols, contexts(keys, bounds, (self.code.size[symbols] <= FREQUENT) & (keys != END))))
        if sum(len(s) for s, _ in self.held) >= TOKENS:
            symbols, hashes = np.concatenate([s for s, _ in self.held]), np.concatenate([h for _, h in self.held], axis=1)
            whole = len(symbols) - len(symbols) % TOKENS
            for at in range(0, whole, TOKENS):
                self.learn(symbols[at : at + TOKENS], hashes[:, at : at + TOKENS])
            self.held = [(symbols[whole:], hashes[:, whole:].copy())]

    def finish(self) -> None:
        for symbols, hashes in self.held:
            if len(symbols):
                self.learn(symbols, hashes)
        self.held = []

    def learn(self, symbols: np.ndarray, hashes: np.ndarray) -> None:
        low, one = np.int64(0xFFFFFFFF), np.int64(1)
        for _, bit, plain, p, slots in bit_levels(self.code, symbols, hashes, self.bits):
            odds, classes, (prior, other), add = [plain], [], priors(p), one << (bit << 5)
            for t, (counts, slot) in enumerate(zip(self.counts, slots, strict=False)):
                both = counts.take(slot, mode="wrap")
                # Counted as soon as read, while the slots are at hand; what was read stays without this block's.
                np.add.at(counts, slot, add)
                ones = both >> 32
                both &= low
                odds.append(moved(both.astype(np.float32), ones.astype(np.float32), prior, other, plain))
                if t < 2:
                    ones += both
                    classes.append(_CLASSES.take(np.minimum(ones, 63, out=ones)))
            gate = classes[1] * 4 + classes[0]
            weights = np.ascontiguousarray(self.weights.T, np.float32)
            mixed = weights[0].take(gate, mode="wrap")
            for i, x in enumerate(odds, 1):
                mixed += weights[i].take(gate, mode="wrap") * x
            place = _place(mixed)
            miss = bit - _SQUASH.take(place, mode="wrap")
            refine = np.bincount((bit * GATES + gate) * CELLS + _CELL.take(place, mode="wrap"), minlength=len(self.refine))
            self.refine += refine
            share = np.maximum(refine.reshape(2, GATES, CELLS).sum((0, 2)), 1)
            for i in range(len(odds) + 1):
                slope = np.bincount(gate, miss * odds[i - 1] if i else miss, GATES) / share
                self.squares[:, i] += slope**2
                self.weights[:, i] += RATE * slope / np.sqrt(self.squares[:, i])
            self.seen += len(bit)

    def rows(self, shard: int) -> pa.RecordBatch:
        press = zstd.ZstdCompressor(level=1)
        weights = np.append(np.rint(self.weights.reshape(-1) * 4096).astype(np.int64) * self.seen, self.seen)
        rows = [("w", 0, press.compress(weights.tobytes())), ("r", 0, press.compress(self.refine.tobytes()))]
        for t, counts in enumerate(self.counts):
            for at in range(0, len(counts), CHUNK):
                if (part := counts[at : at + CHUNK]).any():
                    rows.append((f"t{t}", at // CHUNK, press.compress(part.tobytes())))
        names, chunks, values = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(chunks, pa.int32()), pa.array([shard] * len(rows), pa.int64()), pa.array(values, pa.binary())],
            names=["name", "chunk", "shard", "value"],
        )


def first_weights() -> np.ndarray:
    """A bias of nothing, the counts without context whole, and something of every context."""
    return np.tile(np.array([0.0, 1.0] + [0.4] * len(FEWER)), (GATES, 1))


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, shard = None, None
        for batch in batches:
            for part, texts in steps(batch, 1):
                own = part.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if own[a] != shard:
                        if learner:
                            learner.finish()
                            yield learner.rows(shard)
                        shard, learner = int(own[a]), Learner(shared.value["code"], shared.value["bits"])
                    learner.feed(texts[a:b])
        if learner:
            learner.finish()
            yield learner.rows(shard)

    return run


def _total(group: pa.Table) -> pa.Table:
    total = None
    for value in group.column("value"):
        own = np.frombuffer(zstd.ZstdDecompressor().decompress(value.as_buffer()), np.int64)
        total = own if total is None else total + own
    return pa.table({
        "name": group.column("name")[:1], "chunk": group.column("chunk")[:1], "shard": group.column("shard")[:1],
        "value": pa.array([zstd.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary()),
    })


def states(counts: np.ndarray) -> np.ndarray:
    """Counts of slots as state bytes."""
    ones, zeros = counts >> 32, counts & np.int64(0xFFFFFFFF)
    n = ones + zeros
    with np.errstate(divide="ignore"):
        odds = np.log(ones) - np.log(np.maximum(zeros, 1e-30))
    level = np.clip(np.rint((odds + 9.0) / _ODDS_STEP), 0, LEVELS - 1)
    level = np.where(zeros == 0, LEVELS - 1, np.where(ones == 0, 0, np.clip(level, 1, LEVELS - 2))).astype(np.int64)
    large = _FIRST + (np.minimum(np.searchsorted(_STEPS, n, "right"), len(_STEPS) - 1) - 1) * LEVELS + level
    return np.where(n <= SMALL, n * (n + 1) // 2 + ones, large).astype(np.uint8)


def _as_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = []
        for name, value in zip(batch.column("name").to_pylist(), batch.column("value"), strict=True):
            raw = zstd.ZstdDecompressor().decompress(value.as_buffer())
            values.append(states(np.frombuffer(raw, np.int64)).tobytes() if name.startswith("t") else raw)
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("chunk"), pa.array(values, pa.binary())], names=["name", "chunk", "value"])


class Model:
    """What scoring needs: codes, a byte for every slot, weights by gate, and costs by gate and mixed value."""

    def __init__(self, code: Code, bits: list[int], tables: list[np.ndarray], weights: np.ndarray, refine: np.ndarray):
        self.code, self.bits, self.tables = code, bits, tables
        self.weights = [np.ascontiguousarray(w, np.float32) for w in weights.T]
        zeros, ones = refine.reshape(2, GATES, CELLS)
        even = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) / 1.5))
        came_true = (ones + 4 * even) / (ones + zeros + 4)
        # Half the mixed probability, half what came true at such probabilities under this gate, between the cells' middles.
        refined = np.stack([np.interp(_MIXED, (np.arange(CELLS) - CELLS // 2) / 1.5, row) for row in came_true])
        p = (refined + _SQUASH[None, :]) / 2
        self.costs = np.rint(np.log10(np.stack([1 - p, p])) * UNIT).astype(np.int64).reshape(-1)

    def score(self, symbols: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """log10 of every token's code's probability, in UNITs."""
        out, many = np.zeros(len(symbols), np.int64), len(_MIXED)
        for at in range(0, len(symbols), TOKENS):
            held, all_tokens = np.zeros(len(symbols[at : at + TOKENS]), np.int64), None
            for order, bit, plain, p, slots in bit_levels(self.code, symbols[at : at + TOKENS], hashes[:, at : at + TOKENS], self.bits):
                all_tokens = order if all_tokens is None else all_tokens
                said, (prior, other) = [t.take(s, mode="wrap") for t, s in zip(self.tables, slots, strict=False)], priors(p)
                gate = _STATE_CLASS.take(said[1]) * 4
                gate += _STATE_CLASS.take(said[0])
                mixed = self.weights[0].take(gate, mode="wrap")
                mixed += self.weights[1].take(gate, mode="wrap") * plain
                for weight, state in zip(self.weights[2:], said, strict=False):
                    away = moved(_ZEROS.take(state, mode="wrap"), _ONES.take(state, mode="wrap"), prior, other, plain)
                    away *= weight.take(gate, mode="wrap")
                    mixed += away
                gate += GATES * bit
                gate *= many
                gate += _place(mixed)
                held[: len(order)] += self.costs.take(gate, mode="wrap")
            if all_tokens is not None:
                out[at + all_tokens] = held
        return out


def read_model(summed: DataFrame, code: Code, bits: list[int]) -> Model:
    """The model from the summed tables; its size is bounded by MOST_BITS."""
    tables = [np.full(1 << b, states(np.zeros(1, np.int64))[0], np.uint8) for b in bits]
    weights, refine = first_weights(), np.zeros(2 * GATES * CELLS)
    for row in summed.mapInArrow(_as_states, "name string, chunk int, value binary").toLocalIterator():
        if row["name"] == "w":
            value = np.frombuffer(row["value"], np.int64).astype(float)
            weights = (value[:-1] / value[-1] / 4096).reshape(GATES, INPUTS)
        elif row["name"] == "r":
            refine = np.frombuffer(row["value"], np.int64).astype(float)
        else:
            at, part = row["chunk"] * CHUNK, np.frombuffer(row["value"], np.uint8)
            tables[int(row["name"][1:])][at : at + len(part)] = part
    return Model(code, bits, tables, weights, refine)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        model, common_logs = v["model"], v["logs"]
        code, row_id = model.code, TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, texts in steps(batch, 1):
                n = len(texts)
                keys, bounds = token_keys(texts)
                owner = np.repeat(np.arange(n), np.diff(bounds))
                place = v["common"].of(keys)
                known, symbols = place >= 0, v["symbols"].take(place)
                shared_code = symbols < 0
                symbols[shared_code] = bucket_of(keys[shared_code])
                own = np.where(known, common_logs[place], np.log10(0.5))
                base = np.bincount(owner, own, n) - np.diff(bounds) * v["log_all"]
                units = model.score(symbols, contexts(keys, bounds, (code.size[symbols] <= FREQUENT) & (keys != END)))
                # A word without a code of its own: its share of its bucket; counts that are not broadcast follow below.
                shares = np.where(shared_code, own - code.total[np.minimum(symbols, BUCKETS - 1)], 0.0)
                score = np.bincount(owner, units, n) / UNIT + np.bincount(owner, shares, n)
                other = np.flatnonzero(~known)
                rare = np.split(keys[other], np.searchsorted(owner[other], np.arange(1, n)))
                rare_keys, rare_times = zip(*(np.unique(x, return_counts=True) for x in rare), strict=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rare_keys])]).astype(np.int32))
                size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row_id + np.arange(n)), part.column(0), part.column(2), pa.array(np.diff(bounds)),
                        pa.array(np.bincount(owner, known, n).astype(np.int64)), pa.array(base), pa.array(score), pa.array(size),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rare_keys), pa.int64())),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rare_times), pa.int32())),
                    ],
                    names=["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare", "times"],
                )
                row_id += n

    return run


def learn_tables(training: DataFrame, code: Code, bits: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The summed count tables, weights and refinement: rows (name, chunk, shard, value)."""
    spark = training.sparkSession
    size = training.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, -(-int(size) // SHARD_BYTES))
    dealt = (
        training.select(F.xxhash64(doc_id, text).alias("deal"), F.col(text).alias("text"))
        .select(F.pmod("deal", F.lit(shards)).alias("shard"), "text", "deal")
        .repartition(shards, "shard").sortWithinPartitions("shard", "deal", "text")
    )
    schema = "name string, chunk int, shard long, value binary"
    summed = dealt.mapInArrow(_train(spark.sparkContext.broadcast({"code": code, "bits": bits})), schema)
    while shards > 1:
        summed = summed.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("name", "chunk", "shard").applyInArrow(_total, schema)
        shards = -(-shards // FAN)
    return summed


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from the rows that are not held out and scores all.  base_score
    is the smoothed word-count score, score the mixing model's; both are log10 of a
    probability.  A null or empty text is one end; repeated rows count as often as
    they come; without training rows counts are 0.  bits_per_byte is null for 0 bytes.
    A row's results do not depend on the partitioning of docs.
    """
    spark = docs.sparkSession
    held_out = held_out_column(doc_id) if held_out is None else held_out
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), held_out.alias("held_out"))
    training = source.where(~F.col("held_out")).select("doc_id", "text")
    counts = durable(training.select("text").mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Counts in steps of 2 ** (1/8): the step above which at most COMMON words lie.
    step = F.floor(8 * F.log2("c")).cast("int")
    by_step = counts.groupBy(step.alias("step")).count().collect()
    room, least = COMMON, 1 << 30
    for r in sorted(by_step, key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    common_words = counts.where(step >= least).toPandas().sort_values("key")
    keys, common_counts = common_words["key"].to_numpy(np.int64), common_words["c"].to_numpy(np.int64)
    rare = counts.where(step < least)
    own = np.zeros(len(keys), bool)
    own[np.argsort(-common_counts, kind="stable")[:OWN]] = True
    other_buckets = bucket_of(keys[~own])
    bucket_counts, bucket_kinds = np.bincount(other_buckets, common_counts[~own], BUCKETS), np.bincount(other_buckets, minlength=BUCKETS).astype(float)
    bucket = F.shiftrightunsigned("key", 65 - BUCKETS.bit_length())
    for r in rare.groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        bucket_counts[r["bucket"]] += r["c"]
        bucket_kinds[r["bucket"]] += r["v"]
    code, bits = Code(keys[own], common_counts[own], bucket_counts, bucket_kinds), table_bits(int(totals["n"]))
    all_tokens, all_words = int(totals["n"]), int(totals["v"])
    fixed = {
        "model": read_model(learn_tables(training, code, bits), code, bits),
        "common": Places(keys), "logs": np.log10(np.append(common_counts, 0) + 0.5),
        # The symbols of common words with codes of their own, in the order of the keys; -1 for the rest and, as the last one, for words not broadcast.
        "symbols": np.append(np.where(own, np.cumsum(own) - 1 + BUCKETS, -1), -1),
        "log_all": float(np.log10(all_tokens + 0.5 * (all_words + 1))),
    }
    shared = spark.sparkContext.broadcast(fixed)
    scored = durable(
        source.mapInArrow(
            _score(shared),
            "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, "
            "rare array<long>, times array<int>",
        )
    )
    # A word that is not broadcast had no count so far (0.5); a counted one adds the difference, in fixed point so that no order matters.
    rest = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_id", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    gain = F.round(F.log10((F.col("c") + 0.5) / 0.5) * float(1 << 32)).cast("long")
    added = rest.join(rare, "key").groupBy("row_id").agg((F.sum(F.col("times") * gain) / float(1 << 32)).alias("more"), F.sum(F.col("times").cast("long")).alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    final = F.col("score") + more
    return scored.join(added, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), final.alias("score"),
        F.when(F.col("n_bytes") > 0, -final * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
