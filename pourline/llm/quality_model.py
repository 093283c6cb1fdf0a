"""Quality classifier from weak labels.

Heuristic labellers vote on each document: 1 good, -1 poor, 0 no vote.  Their
accuracies are unknown and their votes overlap; expectation-maximisation over the
counts of vote patterns (at most 3 ** labellers, whatever the input is) estimates
how often each labeller votes and how, given the class of a document.  One class is
that of good documents; poor ones have several, since kinds of junk exclude each
other: one begins at each labeller's votes against.  A class is poor only if labellers
agree on it: others than the one it began at must vote against it too, by ``AGREE``
votes a document more than against good ones.  A labeller that cries alone is thus
found to be inaccurate, and its class counts as good.  The posterior of a document's
votes is its weak label, and weak labels train a linear scorer over hashed features of
words, which judges every document.

The counts cover all documents.  The scorer is fitted on a bounded sample of different
texts (``SAMPLE``), those with the smallest hashes; ids play no part in it, and neither
does the partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .words import Words, steps

#: Texts that the scorer is fitted on at most, its hashed features, and words that a worker remembers.
SAMPLE, FEATURES, MEMORY = 4_000, 1 << 14, 300_000
EM_ROUNDS, FIT_ROUNDS, AGREE = 200, 120, 0.5
_SHAPES = (
    (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"),
    (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"),
    (re.compile(r"\d+"), "9"),
)
_PLAIN_WORD = re.compile(r"[\"'(“¿¡]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\"'”…]?")
_AFTER = frozenset(".,;:!?)\"'”…")
LABELLERS = (
    "symbols", "letters", "capital_words", "capital_letters", "marks", "worded", "plain_words", "repeats", "variety", "top_word", "shouts", "ends", "word_length",
)
#: Kinds of bytes that are counted: letters (small, capital, the first byte of others), symbols, ends of sentences, exclamation marks.
_BYTE_KINDS = np.zeros(256, np.int64)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(0xC0, 0x100)), b"#*$%&|<>~^{}\\=+@", b".?", b"!", b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0))), 1):
    _BYTE_KINDS[list(_chars)] = _kind
SMALL, CAPITAL, WIDE, SYMBOL, END, SHOUT, BLANKS, INNER = range(1, 9)


class Texts:
    """Words and counts of some texts, by numpy; a worker remembers what it knows of a word."""

    def __init__(self, texts: list[str | None], known: KnownWords):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.words = words = Words(raw)
        n = self.n = len(raw)
        self.number = words.counts
        codes, different = words.dictionary()
        self.rows = known.rows(different)
        self.owner = owner = np.repeat(np.arange(n), words.counts)
        self.codes = codes
        within = np.ones(len(codes), bool)
        within[words.bounds[:-1][words.counts > 0]] = False
        same = np.zeros(len(codes), bool)
        same[1:] = codes[1:] == codes[:-1]
        self.repeats = np.bincount(owner[same & within], minlength=n)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of their words over each text."""
        return np.bincount(self.owner, values[self.rows][self.codes], self.n)

    def byte_counts(self) -> np.ndarray:
        lengths = np.diff(self.words.begins)
        inside = self.words.data[1 : 1 + int(lengths.sum())]
        place = np.repeat(np.arange(self.n) * 9, lengths)
        place += _BYTE_KINDS[inside]
        return np.bincount(place, minlength=9 * self.n).reshape(self.n, 9)

    def variety(self) -> tuple[np.ndarray, np.ndarray]:
        """How many different words each text has, and how often its commonest one comes."""
        many = max(1, len(self.rows))
        pairs, times = np.unique(self.owner * many + self.codes, return_counts=True)
        owner = pairs // many
        different = np.bincount(owner, minlength=self.n)
        most = np.zeros(self.n, np.int64)
        full = np.flatnonzero(different)
        if len(full):
            most[full] = np.maximum.reduceat(times, np.concatenate([[0], np.cumsum(different[full])[:-1]]))
        return different, most


class KnownWords:
    """One kind of facts about every word met, as rows of an array; within bounds."""

    def __init__(self, facts, width: int, kind) -> None:
        self.facts, self.memory, self.values = facts, {}, np.empty((0, width), kind)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each word; rows hold until the next call."""
        if len(self.memory) > MEMORY:
            self.memory, self.values = {}, self.values[:0]
        rows = np.fromiter(map(self.memory.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0).tolist()
        if new:
            rows[new] = len(self.values) + np.arange(len(new))
            self.values = np.concatenate([self.values, np.array([self.facts(words[k].decode("utf-8", "surrogatepass")) for k in new], self.values.dtype)])
            self.memory.update(zip((words[k] for k in new), rows[new].tolist(), strict=True))
        return rows


def word_kinds(word: str) -> tuple[bool, bool, bool, bool]:
    """All capitals; a mark without letters and digits; some letter; a plain word."""
    stem = word[:-1] if len(word) > 1 and word[-1] in _AFTER else word
    if stem.isalpha():
        return len(word) > 1 and stem.isupper(), False, True, True
    letter = any(map(str.isalpha, word))
    return word.isupper() and len(word) > 1, not letter and not any(map(str.isdigit, word)), letter, bool(_PLAIN_WORD.fullmatch(word))


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as one mark each; other characters as they are."""
    stem, rest = (word[:-1], word[-1]) if len(word) > 1 and word[-1] in _AFTER else (word, "")
    if stem.isascii() and stem.isalpha() and (mark := "a" if stem.islower() else "A" if stem.isupper() else "Aa" if stem.istitle() else ""):
        return mark + rest
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:12]


@lru_cache(100_000)
def _feature(kind: str, part: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind} {part}".encode("utf-8", "surrogatepass")) % (FEATURES - 8) + 8


def word_places(word: str) -> tuple[int, int, int]:
    """Places of the features of a word: itself, its shape and its last characters."""
    own = xxhash.xxh32_intdigest(word.lower().encode("utf-8", "surrogatepass")) % (FEATURES - 8) + 8
    return own, _feature("s", shape(word)), _feature("e", word[-2:])


KINDS, PLACES = KnownWords(word_kinds, 4, np.float32), KnownWords(word_places, 3, np.int32)


def votes(texts: list[str | None]) -> np.ndarray:
    """The labellers' votes (-1, 0, 1), one row a text; a text without words has -1 from all."""
    held = Texts(texts, KINDS)
    n = held.number
    some, words = n > 0, np.maximum(n, 1)
    counts = held.byte_counts()
    letters = counts[:, SMALL] + counts[:, CAPITAL] + counts[:, WIDE]
    solid = np.maximum(counts.sum(axis=1) - counts[:, BLANKS] - counts[:, INNER], 1)
    capitals, marks, worded, plain = (held.total(kind) for kind in KINDS.values.T)
    different, top = held.variety()
    expected = np.minimum(1.0, 8.0 / np.sqrt(words))  # long texts repeat words more
    ends = counts[:, END] + counts[:, SHOUT]

    def share(value: np.ndarray, poor: float, good: float) -> np.ndarray:
        """-1 from poor on, 1 up to good; the other way round where good is the larger."""
        return np.where(value >= poor, -1, np.where(value <= good, 1, 0)) if poor > good else np.where(value <= poor, -1, np.where(value >= good, 1, 0))

    mean = letters / words
    columns = [
        share(counts[:, SYMBOL] / words, 0.2, 0.05),
        share(letters / solid, 0.65, 0.8),
        share(capitals / words, 0.4, 0.1),
        share(counts[:, CAPITAL] / np.maximum(counts[:, SMALL] + counts[:, CAPITAL], 1), 0.4, 0.2),
        share(marks / words, 0.15, 0.03),
        share(worded / words, 0.75, 0.9),
        share(plain / words, 0.55, 0.8),
        share(held.repeats / words, 0.25, 0.05),
        share(different / words / expected, 0.25, 0.4),
        np.where(n < 20, 0, share(top / words, 0.25, 0.12)),
        share(counts[:, SHOUT] / words, 0.25, 0.05),
        np.where(ends == 0, np.where(n >= 60, -1, 0), np.where(words <= 60 * ends, 1, 0)),
        np.where((mean >= 2.5) & (mean <= 9), 1, np.where((mean > 14) | (mean < 1.5), -1, 0)),
    ]
    return np.where(some[:, None], np.stack(columns, axis=1), -1)


def _said(found: np.ndarray) -> list[str]:
    return ["".join("-0+"[v] for v in row) for row in (found + 1).tolist()]


def _seen(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) for c in p] for p in patterns])


class Estimate:
    """What EM found: the classes' shares, P(vote | class) as (class, labeller, vote + 1), and which classes are good."""

    def __init__(self, share: np.ndarray, given: np.ndarray, good: np.ndarray):
        self.share, self.given, self.good = share, given, good

    def classes(self, seen: np.ndarray) -> np.ndarray:
        """P(class | votes), with the labellers independent given the class; not to vote is an outcome like others."""
        log = np.log(self.share)[None, :] + sum(np.log(self.given[:, k, seen[:, k]]).T for k in range(seen.shape[1]))
        log -= log.max(axis=1, keepdims=True)
        out = np.exp(log)
        return out / out.sum(axis=1, keepdims=True)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """P(good | votes) of each vote pattern."""
        return self.classes(_seen(patterns))[:, self.good].sum(axis=1) if patterns else np.empty(0)

    def accuracies(self) -> np.ndarray:
        """Of each labeller: the shares of its votes against that are right, and of its votes for."""
        weight = self.share[:, None, None] * self.given
        against, in_favour = weight[:, :, 0], weight[:, :, 2]
        return np.stack([against[~self.good].sum(axis=0) / against.sum(axis=0), in_favour[self.good].sum(axis=0) / in_favour.sum(axis=0)], axis=1)


def estimate(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> Estimate:
    """EM over the counts of vote patterns; classes are the good one and one for each labeller."""
    keys = sorted(patterns)
    n, seen = np.array([patterns[k] for k in keys], float), _seen(keys)
    labellers = seen.shape[1]
    alarms = seen == 0
    loud = alarms.any(axis=1, keepdims=True)
    member = np.concatenate([np.where(loud, 0.1, 1.0), 0.9 * alarms / np.maximum(alarms.sum(axis=1, keepdims=True), 1)], axis=1)
    usual = np.stack([((seen == v) * n[:, None]).sum(axis=0) for v in range(3)], axis=1) / n.sum()
    found = None
    for _ in range(rounds):
        held = member * n[:, None]
        given = np.stack([held.T @ (seen == v) for v in range(3)], axis=2) + 0.5 * usual[None] + 1e-3
        share = held.sum(axis=0) + 0.1
        found = Estimate(share / share.sum(), given / given.sum(axis=2, keepdims=True), np.zeros(labellers + 1, bool))
        member = found.classes(seen)
    against = found.given[:, :, 0] - found.given[:1, :, 0]
    agreed = against.sum(axis=1)
    agreed[1:] -= against[np.arange(1, labellers + 1), np.arange(labellers)]
    found.good = agreed < AGREE
    return found


def fit(places: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by gradient steps scaled for each feature; classes weigh alike."""
    weights = np.zeros(FEATURES)
    if not len(label):
        return weights
    row = np.repeat(np.arange(len(label)), [len(p) for p in places])
    place, value = np.concatenate(places), np.concatenate(values)
    balance = np.where(label > 0.5, 0.5 / max((label > 0.5).mean(), 1e-3), 0.5 / max((label <= 0.5).mean(), 1e-3))
    size, squares = len(label), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        miss = balance * (label - 1 / (1 + np.exp(-np.bincount(row, weights[place] * value, size))))
        slope = np.bincount(place, miss[row] * value, FEATURES) / size - 1e-5 * weights
        squares += slope**2
        weights += 0.5 * slope / np.sqrt(squares)
    return weights


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in steps(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_said(votes(texts)), pa.string())], names=["pick", "votes"])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pick, places, values): shares of the text's words by feature, a constant, and the share of words equal to the one before."""
    for batch in batches:
        for part, texts in steps(batch, 1):
            places, values = [], []
            for text in texts:
                held = Texts([text], PLACES)
                n = max(1, len(held.codes))
                place, count = np.unique(PLACES.values[held.rows][held.codes], return_counts=True)
                places.append(np.append(place, [0, 2]))
                values.append(np.append(count / n, [1.0, held.repeats[0] / n]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["pick", "places", "values"]
            )


class Model:
    """What judging needs: the estimates of the labellers and the scorer's weights; about a hundred KB."""

    def __init__(self, estimates: Estimate | None, weights: np.ndarray):
        self.estimates, self.weights = estimates, weights

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(words, the scorer's log-odds that the text is good) of each text."""
        held = Texts(texts, PLACES)
        n = np.maximum(held.number, 1)
        own = self.weights[PLACES.values[held.rows]].sum(axis=1)
        total = np.bincount(held.owner, own[held.codes], held.n)
        return held.number, self.weights[0] + (total + self.weights[2] * held.repeats) / n


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def train(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Estimate the labellers on all documents and fit the scorer on a bounded sample of different texts.

    Texts without words take no part: they are rejected in any case.
    """
    source = docs.select(F.xxhash64(F.col(text).cast("string")).alias("pick"), F.col(text).cast("string").alias("text"))
    voted = durable(source.mapInArrow(_voting, "pick long, votes string").where(F.col("votes") != "-" * len(LABELLERS)))
    patterns = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}  # at most 3 ** labellers rows
    if not patterns:
        return Model(None, np.zeros(FEATURES))
    found = estimate(patterns)
    # The smallest hashes of different texts: a bound that leaves about twice the sample, then their order.
    different = voted.groupBy("pick").agg(F.min("votes").alias("votes"))
    share = min(1.0, 2.0 * sample / max(1, different.count()))
    bound = int(-(2**63) + share * (2**64 - 1))
    drawn = {r["pick"]: r["votes"] for r in different.where(F.col("pick") <= min(bound, 2**63 - 1)).orderBy("pick").limit(sample).collect()}
    texts = source.where(F.col("pick") <= max(drawn)).groupBy("pick").agg(F.first("text").alias("text")) if drawn else source.where("false")
    rows = sorted((r["pick"], r["places"], r["values"]) for r in texts.mapInArrow(_features_of, "pick long, places array<int>, values array<double>").toLocalIterator() if r["pick"] in drawn)
    labels = dict(zip(patterns, found.posterior(list(patterns)).tolist(), strict=True))
    label = np.array([labels[drawn[pick]] for pick, _, _ in rows])
    return Model(found, fit([np.array(p, np.int64) for _, p, _ in rows], [np.array(v) for _, _, v in rows], label))


def weak_labels(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, votes (one of - 0 + for each labeller), posterior that the document is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, 1):
                said = _said(votes(texts))
                found = shared.value.estimates.posterior(said) if shared.value.estimates else np.zeros(len(said))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string()), pa.array(found, pa.float64())], names=["doc_id", "votes", "posterior"])

    return _source(docs, doc_id, text).mapInArrow(run, "doc_id long, votes string, posterior double")


def classify(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, score, kept (score > 0).

    A null or wordless text is rejected.  Equal texts get equal results, whatever their
    ids (null and repeated ones included); an empty table gives an empty result.
    """
    model = model or train(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, 1):
                n, score = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(score), pa.array((n > 0) & (score > 0))], names=["doc_id", "n_words", "score", "kept"]
                )

    return _source(docs, doc_id, text).mapInArrow(run, "doc_id long, n_words long, score double, kept boolean")


def drop_poor(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps; rows are judged where they are read."""
    model = model or train(docs, doc_id=doc_id, text=text)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, at):
                n, score = shared.value.scores(texts)
                yield part.filter(pa.array((n > 0) & (score > 0)))

    return docs.mapInArrow(run, docs.schema)
