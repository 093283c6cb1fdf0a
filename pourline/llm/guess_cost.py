"""How many guesses a password stands: minimum-cost segmentation by dynamic programming.

The value is cut into words, dates, repeats, sequences, keyboard walks and
brute-force characters; each segment has a cost (log10 of guesses) and the cut of
least total cost counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from math import log10

#: Words that people put in passwords, the commonest first.
WORDS = (
    "password pass admin welcome letmein login qwerty master dragon monkey secret changeme example test user root "
    "default token key hello summer winter spring autumn love baby angel princess sunshine shadow football baseball "
    "soccer hockey batman superman michael jordan jessica charlie thomas daniel andrew george robert jennifer "
    "ashley hunter killer pepper ginger cookie flower purple orange silver golden freedom whatever trustno access "
    "server database mysql oracle postgres system manager office company internet computer network security private "
    "public service account guest demo sample placeholder dummy value string none null your here insert my the and "
    "correct horse battery staple monday friday january june july august march april"
).split()
#: The rows of a common keyboard, and what stands for which letter.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("4@8310!$57", "aabeioisst")
SEGMENT = 0.3
_DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d))")
_YEAR = re.compile(r"(?:19|20)\d\d")
_NEXT = {}
for _row in (*ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789"):
    for _a, _b in zip(_row, _row[1:], strict=False):
        _NEXT.setdefault((_a, _b), set()).add(1)
        _NEXT.setdefault((_b, _a), set()).add(-1)


def _one(c: str) -> float:
    """Cost of one character by brute force, within its class."""
    if c.isdigit():
        return 1.0
    return log10(26) if c.isascii() and c.isalpha() else log10(33 if c.isascii() else 100)


#: Values whose guesses reach this power of ten resist guessing; what costs as much needs no exact figure.
LEAST_COST = 8.0
#: A repeat's block has at most so many characters: by its characters alone, each at least one power of ten, a longer one
#: reaches LEAST_COST, so no segmentation below it holds one.
LONGEST_BLOCK = int(LEAST_COST)


class Dictionary:
    """Words in order of commonness, with their costs and all their beginnings (so that a search ends with the last one)."""

    def __init__(self, words: Iterable[str]):
        self.costs: dict[str, float] = {}
        for word in words:
            self.costs.setdefault(word, log10(len(self.costs) + 10))
        self.beginnings = {w[:k] for w in self.costs for k in range(1, len(w) + 1)}


#: Words of passwords alone; a scan may go on with the words of a vocabulary.
COMMON = Dictionary(WORDS)
#: How a vocabulary of word pieces marks the end of a word.
END_OF_WORD = "</w>"


def vocabulary_words(path: str) -> tuple[str, ...]:
    """Whole words of three letters or more of a tokenizer's vocabulary, in the order of its ids: the commonest first.

    They number at most the vocabulary's size, whatever is scanned.
    """
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    ends = (w.removesuffix(END_OF_WORD) for w in sorted(ids, key=ids.get) if w.endswith(END_OF_WORD))
    return tuple(w for w in ends if len(w) >= 3 and w.isalpha())


class Run:
    """The open repeats of one block size, or walks of one direction, that may end at the place now reached.

    A segment from start to end costs ``least[start] + base + log10(units)``, where units grow with its length.  The
    logarithm grows ever slower, so a start that an earlier one undercuts at its own shortest segment is undercut at
    all later ends and is never kept: few starts are left, however long the run.
    """

    def __init__(self, unit: int, shortest: int):
        self.unit, self.shortest = unit, shortest  # characters of a unit, units of the shortest segment
        self.starts: list[list[int]] = [[] for _ in range(unit)]  # by their place within a unit

    def clear(self) -> None:
        if any(self.starts):
            self.starts = [[] for _ in range(self.unit)]

    def add(self, start: int, least: list[float]) -> None:
        held, bound = self.starts[start % self.unit], least[start] + log10(self.shortest)
        if all(least[i] + log10((start - i) // self.unit + self.shortest) > bound for i in held):
            held.append(start)

    def cheapest(self, end: int, least: list[float]) -> float:
        """The least of ``least[start] + log10(units)`` over the starts of segments that end here."""
        out = float("inf")
        for i in self.starts[end % self.unit]:
            units = (end - i) // self.unit
            if units >= self.shortest:
                out = min(out, least[i] + log10(units))
        return out


def words_at(value: str, low: str, plain: str, i: int, words: Dictionary) -> list[tuple[int, float]]:
    """(length, cost) of every word that starts at i, as it is written or with marks for letters."""
    out = []
    for text, extra in ((low, 0.0), (plain, log10(4))):
        k = 1
        while i + k <= len(value) and (word := text[i : i + k]) in words.beginnings:
            if word in words.costs:
                out.append((k, words.costs[word] + extra + (0.0 if value[i : i + k].islower() else log10(3))))
            k += 1
    return out


def dates_at(value: str, i: int) -> list[tuple[int, float]]:
    """(length, cost) of every date that starts at i; a year alone has fewer guesses."""
    if not value[i].isdigit():
        return []
    out = [(k, log10(365 * 120)) for k in range(3, 11) if i + k <= len(value) and _DATE.fullmatch(value, i, i + k)]
    return [*out, (4, log10(120))] if _YEAR.match(value, i) else out


def guess_cost(value: str, words: Dictionary = COMMON) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs; 0 for an empty one.

    Every word, date, walk and repeat counts at each of its lengths, from three characters on.  Exact below LEAST_COST;
    at or above it a repeat of a longer block could be cheaper, but not below LEAST_COST.
    """
    n = len(value)
    # Letters one by one: the lower case of a whole text may be longer than the text.
    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    plain = low.translate(LEET)
    least, sums = [0.0] + [float("inf")] * n, [0.0]
    repeats = [Run(block, 3 if block == 1 else 2) for block in range(1, LONGEST_BLOCK + 1)]
    walks = {1: Run(1, 3), -1: Run(1, 3)}
    for end in range(n + 1):
        if end:
            sums.append(sums[-1] + _one(value[end - 1]))
            least[end] = min(least[end], least[end - 1] + _one(value[end - 1]))  # single characters in a row share one segment
            step = _NEXT.get((low[end - 2], low[end - 1]), ()) if end > 1 else ()
            for way, run in walks.items():
                if way not in step:
                    run.clear()
                run.add(end - 1, least)
                least[end] = min(least[end], run.cheapest(end, least) + log10(47 * 2) + SEGMENT)
            for block, run in enumerate(repeats[:end], 1):
                if end <= block or value[end - 1] != value[end - 1 - block]:
                    run.clear()
                run.add(end - block, least)
                least[end] = min(least[end], run.cheapest(end, least) + sums[end] - sums[end - block] + SEGMENT)
        if end < n:
            for length, cost in words_at(value, low, plain, end, words) + dates_at(value, end):
                least[end + length] = min(least[end + length], least[end] + cost + SEGMENT)
    return least[-1]
