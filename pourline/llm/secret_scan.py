"""Secrets in texts: three base patterns, and credential-context values that resist guessing.

Base kinds: ``assign`` (a credential name, ``:`` or ``=``, a value of 6 or more
characters), ``access`` (AKIA keys of 20 or more) and ``hex`` (24 or more digits).
The method adds ``guess``: a value after a wider set of credential names and
separators whose guess cost, by the segmentation of ``guess_cost``, reaches
``LEAST_COST``; a value that a base span touches is not added again.  Its words are
the fixed ones and those that the caller adds, the commonest first.  A span is the
whole match for base kinds and the value for ``guess``; places are code points, the
end exclusive.  A null or empty text has no spans.  Whole texts are searched,
whatever their length; each row is judged alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guess_cost import COMMON, LEAST_COST, WORDS, Dictionary, guess_cost
from .words import steps

KINDS = ("assign", "access", "hex", "guess")
SHORTEST_VALUE = 6
MARK = "[SECRET]"
#: The base patterns.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "bearer", "credential", "authorization")
_CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|(?:client[_-]?)?secret(?:[_-]?key)?|(?:access[_-]?|auth[_-]?)?token"
    r"|(?:api|access|private|encryption|signing)[_-]?key|bearer|credentials?|authorization)"
    r"[\"'`]?\s{0,3}(?::=|=>|[:=]|\s(?:is|was|bearer)\s)\s{0,3}[\"'`]?([^\s\"'`<>]{6,})",
    re.IGNORECASE | re.ASCII,
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping within each kind."""
    low = text.lower()
    out = []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def guessed_spans(text: str, base: list[tuple[int, str, int]], words: Dictionary = COMMON) -> list[tuple[int, str, int]]:
    """Credential-context values outside the base spans that cost LEAST_COST or more to guess."""
    low, out = text.lower(), []
    if not any(h in low for h in _CONTEXT_HINTS):
        return out
    for m in _CONTEXT.finditer(text):
        start, end = m.span(1)
        end = start + len(text[start:end].rstrip(".,;:!?)]}"))
        if end - start < SHORTEST_VALUE or any(a < end and start < b for a, _, b in base):
            continue
        if guess_cost(text[start:end], words) >= LEAST_COST:
            out.append((start, "guess", end))
    return out


def all_spans(text: str, words: Dictionary = COMMON) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + guessed_spans(text, base, words), key=lambda x: (x[0], KINDS.index(x[1])))


def _said(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch], words: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    known = Dictionary((*WORDS, *words))
    for batch in batches:
        for part, texts in steps(batch, 1):
            found = [all_spans(t or "", known) for t in texts]
            counts = [pa.array([sum(x[1] == kind for x in spans) for _, spans in found], pa.int64()) for kind in KINDS]
            prints = [hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts[:3], pa.array(prints), pa.array([_said(spans) for _, spans in found]), counts[3]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, counts by kind, the base spans' SHA-256, all spans as text, and the method's count.

    ``words`` (a vocabulary's, see ``vocabulary_words``) go to every task.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda batches: _scan(batches, words), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    )


def redacted(text: str, words: Dictionary = COMMON) -> str:
    """The text with every span (overlapping ones as one) replaced by MARK."""
    out, at, end = [], 0, -1
    for start, _, stop in all_spans(text, words)[1]:
        if start >= end:
            if end >= 0:
                at = end
            out += [text[at:start], MARK]
            end = stop
        end = max(end, stop)
    return text if end < 0 else "".join([*out, text[end:]])


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", words: tuple[str, ...] = ()) -> DataFrame:
    """All rows and columns of docs; secrets in the text are replaced, and n_chars, if there, follows. Null stays null."""
    at = docs.columns.index(text)
    size = docs.columns.index(n_chars) if n_chars in docs.columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary((*WORDS, *words))
        for batch in batches:
            for part, texts in steps(batch, at):
                new = [t if t is None else redacted(t, known) for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(new, columns[at].type)
                if size is not None:
                    old = columns[size].to_pylist()
                    columns[size] = pa.array([o if a is b or a == b or a is None else len(b) for o, a, b in zip(old, texts, new, strict=True)], columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, schema)
