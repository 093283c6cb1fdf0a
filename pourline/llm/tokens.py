"""Exact token ids with a public tokenizer, many texts at a time.

A tokenizer of the two kinds used here first cuts a text into runs of letters, of
numbers and of other characters, and never joins characters across a cut, so the
ids of a text are those of its runs, and a run met before need not be encoded again:

* ``space``: white space and case are dropped, and every digit stands alone;
* ``lead``: a run keeps the one blank before it; other white space makes runs of its own.

Texts of Windows-1252 characters (Western letters and punctuation) are cut here, all
texts of a step in a few numpy passes; the different runs are found by Arrow's
dictionary encoding, and only those not remembered reach the tokenizer, joined so
that its ids show where each run ends.  Any other text, and one that may hold a
special token's string, goes through the tokenizer whole.
"""

from __future__ import annotations

import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Runs that a worker remembers at most; beyond it the half that was met in the most steps stays.
MEMORY_RUNS = 500_000
#: Runs that are encoded in one call, joined.
JOINED = 100
WHITE, LETTER, NUMBER, OTHER = 1, 2, 3, 4
#: Kind of every Windows-1252 byte; 0 where a text must go whole: bytes without a character, and separator controls.
KINDS = np.zeros(256, np.uint8)
for _byte in range(256):
    try:
        _char = bytes([_byte]).decode("cp1252")
    except UnicodeDecodeError:
        continue
    if 0x1C <= _byte <= 0x1F:
        continue
    KINDS[_byte] = WHITE if _char in " \t\n\x0b\x0c\r\xa0" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(_char)[0], OTHER)
_WHOLE = bytes(np.flatnonzero(KINDS == 0).tolist())
#: Endings that an apostrophe starts.
_SHORT_ENDINGS, _LONG_ENDINGS = b"stmd", (b"re", b"ve", b"ll")


def cut_runs(data: np.ndarray, begins: np.ndarray, cut: str) -> np.ndarray:
    """Whether a run starts at each byte; begins are the texts' first bytes (empty texts: that of the next)."""
    n = len(data)
    kinds = KINDS[data]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    starts = first[:n].copy()
    starts[1:] |= kinds[1:] != kinds[:-1]
    if cut == "space":
        starts |= kinds == NUMBER
    else:
        white = kinds == WHITE
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])  # white space before something else of its text
        starts[last] = True
        starts[last[data[last] == 0x20] + 1] = False
    marks = np.flatnonzero(data == 0x27)
    if len(marks):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        inside = ~np.concatenate([first[:n], np.ones(4, bool)])
        marks = marks[starts[marks] & inside[marks + 1]]
        one = np.isin(padded[marks + 1], np.frombuffer(_SHORT_ENDINGS, np.uint8))
        two = np.zeros(len(marks), bool)
        for a, b in _LONG_ENDINGS:
            two |= (padded[marks + 1] == a) & (padded[marks + 2] == b) & inside[marks + 2]
        starts[marks[one | two] + 1] = False
        for chosen, size in ((one, 2), (two, 3)):
            after = marks[chosen] + size
            # After an ending a new run starts, but for a blank that begins a run anyway.
            starts[after[after < n]] = True
    return starts


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one stretch after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Token ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, cut: str, most: int = MEMORY_RUNS):
        if cut not in ("space", "lead"):
            raise ValueError(f"unknown way to cut texts: {cut}")
        self.cut, self.most = cut, most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        if cut == "space":
            # A run's last token, and no other, has the mark of a word's end.
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        else:
            self.between = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.memory: dict[bytes, int] = {}
        self.ids, self.sizes, self.uses = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _forget(self) -> None:
        """Keep the half of the runs that was met in the most steps."""
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        number = np.full(len(self.uses), -1, np.int64)
        number[stay] = np.arange(len(stay))
        number = number.tolist()
        self.memory = {run: number[k] for run, k in self.memory.items() if number[k] >= 0}
        before = np.cumsum(self.sizes) - self.sizes
        self.ids, self.sizes, self.uses = self.ids[_spread(before[stay], self.sizes[stay])], self.sizes[stay], self.uses[stay] // 2

    def _plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs_ids(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs one after another, how many each has)."""
        ids, sizes = [], []
        for at in range(0, len(runs), JOINED):
            part = runs[at : at + JOINED]
            joined = (b" " if self.cut == "space" else b"\n").join(part).decode("cp1252")
            own = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            if self.cut == "space":
                bounds = np.flatnonzero(self.ends[own]) + 1
                keep = slice(None)
                size = np.diff(bounds, prepend=0)
            else:
                marks = np.flatnonzero(own == self.between)
                keep = own != self.between
                size = np.diff(np.concatenate([[-1], marks, [len(own)]])) - 1
            if len(size) == len(part) and size.all() and int(size.sum()) == len(own[keep]):
                ids.append(own[keep])
                sizes.append(size)
            else:
                alone = self._plainly([r.decode("cp1252") for r in part])
                ids += alone
                sizes.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])

    def _cut_texts(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.flatnonzero(cut_runs(data, begins, self.cut)) if len(data) else np.empty(0, np.int64)
        run_lengths = np.diff(at, append=len(data))
        if self.cut == "space":
            solid = KINDS[data] != WHITE
            named = solid[at]
            at, run_lengths, data = at[named], run_lengths[named], data[solid]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(run_lengths, out=offsets[1:])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes, runs = found.indices.to_numpy(), found.dictionary.to_pylist()

        known = np.fromiter(map(self.memory.get, runs, repeat(-1)), np.int64, len(runs))
        self.uses[known[known >= 0]] += 1
        new = np.flatnonzero(known < 0)
        alone = [k for k in new.tolist() if self.cut == "lead" and runs[k].isspace()]
        if alone:
            new = np.concatenate([np.setdiff1d(new, alone), alone])
        new_runs = [runs[k] for k in new.tolist()]
        joined = len(new_runs) - len(alone)
        ids, sizes = self._runs_ids(new_runs[:joined])
        if alone:
            white = self._plainly([r.decode("cp1252") for r in new_runs[joined:]])
            ids, sizes = np.concatenate([ids, *white]), np.concatenate([sizes, [len(x) for x in white]])
        known[new] = len(self.sizes) + np.arange(len(new))
        self.memory.update(zip(new_runs, known[new].tolist(), strict=True))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.ones(len(new), np.int32)])
        all_ids, all_starts = self.ids, np.cumsum(self.sizes) - self.sizes
        size, start = self.sizes[known][codes], all_starts[known][codes]

        # The place of each run's ids in the result: one end id follows every text.
        runs_before = np.searchsorted(at, begins)
        filled = np.concatenate([[0], np.cumsum(size)])
        bounds = filled[runs_before] + np.arange(len(begins))
        owner = np.repeat(np.arange(len(texts)), np.diff(runs_before))
        out = np.empty(int(bounds[-1]), np.uint32)
        out[bounds[1:] - 1] = end_id
        place = filled[:-1] + owner
        source = np.repeat(start - filled[:-1], size)
        tokens = np.arange(int(filled[-1]))
        source += tokens
        tokens += np.repeat(place - filled[:-1], size)
        out[tokens] = all_ids[source]

        if len(self.sizes) > self.most:
            self._forget()
        return out, bounds

    def __call__(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; where each text begins, and the whole length)."""
        ready: list[bytes | None] = []
        for text in texts:
            low = text.lower() if self.cut == "space" else text
            try:
                raw = low.encode("cp1252")
            except UnicodeEncodeError:
                ready.append(None)
                continue
            whole = len(raw.translate(None, _WHOLE)) < len(raw) or ("<|" in low and any(s in low.lower() for s in self.special))
            ready.append(None if whole else raw)
        out, bounds = self._cut_texts([r for r in ready if r is not None], end_id)
        if all(r is not None for r in ready):
            return out, bounds
        others = iter(self._plainly([t for t, r in zip(texts, ready, strict=True) if r is None]))
        parts, k, end = [], 0, np.array([end_id], np.uint32)
        for r in ready:
            if r is None:
                parts.append(np.concatenate([next(others), end]))
            else:
                parts.append(out[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str, most: int = MEMORY_RUNS) -> Encoder:
    """The worker's encoder for a tokenizer file; workers outlive tasks, and so does what they remember."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = Encoder(path, cut, most)
    return _ENCODERS[path, cut]
