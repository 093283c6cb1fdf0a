"""Exact duplicates by Grace hash partitioning.

Two texts are equal when they are identical once every character of ``[\\x20\\x09-\\x0D]``
is deleted.  The work runs in three steps, none of which needs a text in two places at once:

1. *Fold.*  Every task normalises its texts and folds equal ones through an open-addressing
   table that compares whole contents.  It writes one record per different text (content,
   digest, best row) and one narrow member per row.  The table is emptied whenever its
   contents reach ``table_bytes``, so a group of copies, however large, costs a task one record
   a filling, and its members never travel with the text.
2. *Partition.*  Records are dealt over partitions by a hash of the digest, in so many that a
   partition's contents should fit a table.  Each partition fills one table; records whose
   content the full table does not hold go to spill files, which the next round deals by
   another hash.  Rounds end when nothing spills: a round settles at least one table of
   contents a partition.
3. *Join.*  Members find the verdict of their record by its number; a record has at most
   ``FOLD_ROWS`` members, so no group of copies meets in one task.

Records, spill files and verdicts are Parquet in the folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder

#: Bytes of different contents that a table holds before it is full; a longer text has a table to itself.
TABLE_BYTES = 48 << 20
#: Rows that are folded together at most, and so members of one record.
FOLD_ROWS = 1 << 18
#: Bytes of contents in one Arrow batch of records.
BATCH_BYTES = 4 << 20
#: Partitions of a round at most; what they do not hold goes on to further rounds, each of which has a hash of its own.
FAN_OUT, MAX_ROUNDS = 1 << 14, 64
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Sorts rows without an id after all others.
_NO_ID = (1 << 63) - 1

_MEMBER, _RECORD = 0, 1
_FOLDED = "kind int, record long, doc_id long, has_id boolean, best boolean, chars long, rows long, digest binary, content binary"
_SETTLED = "spilled boolean, record long, keep_id long, has_id boolean, chars long, rows long, winner boolean, digest binary, content binary"


class ContentTable:
    """An open-addressing table from whole contents to numbers 0, 1, 2, ...

    Slots are probed one after another from the digest's leading bits; an entry is a match
    only if its content is equal byte for byte.  The table doubles at two thirds full.
    """

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.contents: list[bytes] = []
        self.starts: list[int] = []
        self.bytes = 0

    def find(self, start: int, content: bytes, add: bool) -> int:
        """The number of a content, which is added if asked for; -1 if it is not held."""
        mask = len(self.slots) - 1
        at = start & mask
        while (number := self.slots[at]) >= 0:
            if self.starts[number] == start and self.contents[number] == content:
                return number
            at = (at + 1) & mask
        if not add:
            return -1
        number = self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.starts.append(start)
        self.bytes += len(content)
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return number

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for number, start in enumerate(self.starts):
            at = start & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _start(digest: bytes) -> int:
    return int.from_bytes(digest[:7], "big")


def normalised(text: str | None) -> bytes:
    """The UTF-8 of a text without the six ASCII white-space characters; nothing for a missing text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(None, _SPACE)


def _fold(table_bytes: int):
    """Batches of (doc_id, text) -> members and records."""
    schema = pa.schema([("kind", pa.int32()), ("record", pa.int64()), ("doc_id", pa.int64()), ("has_id", pa.bool_()), ("best", pa.bool_()), ("chars", pa.int64()), ("rows", pa.int64()), ("digest", pa.binary()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A repeated attempt of a task numbers alike or its files are not read: numbers need only differ within what is read.
        base = (TaskContext.get().partitionId() << 34) if TaskContext.get() else 0
        made = 0
        table, ids, named, chars, numbers, digests = ContentTable(), [], [], [], [], []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if not numbers:
                return
            record, long, own = np.array(numbers, np.int64), np.array(chars, np.int64), np.array(ids, np.int64)
            has = np.array(named, bool)
            order = np.lexsort((own, ~has, -long, record))
            first = order[np.diff(record[order], prepend=-1) != 0]  # the best row of every record
            best = np.zeros(len(record), bool)
            best[first] = True
            n = len(record)
            empty = lambda kind, size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, _MEMBER, np.int32)), pa.array(record + (base + made)), pa.array(own, mask=~has), pa.array(has), pa.array(best), empty(pa.int64(), n), empty(pa.int64(), n), empty(pa.binary(), n), empty(pa.binary(), n)],
                schema=schema,
            )
            rows = np.bincount(record)
            at = 0
            while at < len(first):
                end, size = at, 0
                while end < len(first) and (end == at or size + len(table.contents[end]) <= BATCH_BYTES):
                    size += len(table.contents[end])
                    end += 1
                part = first[at:end]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(end - at, _RECORD, np.int32)), pa.array(np.arange(at, end, dtype=np.int64) + (base + made)), pa.array(own[part], mask=~has[part]), pa.array(has[part]),
                        empty(pa.bool_(), end - at), pa.array(long[part]), pa.array(rows[at:end].astype(np.int64)), pa.array(digests[at:end], pa.binary()), pa.array(table.contents[at:end], pa.binary()),
                    ],
                    schema=schema,
                )
                at = end
            made += len(first)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = normalised(text)
                digest = hashlib.sha256(content).digest()
                number = table.find(_start(digest), content, True)
                if number == len(digests):
                    digests.append(digest)
                numbers.append(number)
                ids.append(_NO_ID if doc_id is None else doc_id)
                named.append(doc_id is not None)
                chars.append(0 if text is None else len(text))
                if table.bytes >= table_bytes or len(numbers) >= FOLD_ROWS:
                    yield from emit()
                    table, ids, named, chars, numbers, digests = ContentTable(), [], [], [], [], []
        yield from emit()

    return run


def _settle(table_bytes: int):
    """Records of one partition -> a verdict for each whose content the table holds; the others spill."""
    schema = pa.schema([("spilled", pa.bool_()), ("record", pa.int64()), ("keep_id", pa.int64()), ("has_id", pa.bool_()), ("chars", pa.int64()), ("rows", pa.int64()), ("winner", pa.bool_()), ("digest", pa.binary()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        digests: list[bytes] = []
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            found = np.empty(batch.num_rows, np.int64)
            for row, (digest, content) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                found[row] = table.find(_start(digest), content, table.bytes < table_bytes)
                if found[row] == len(digests):
                    digests.append(digest)
            held = found >= 0
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            columns = [found, batch.column("record").to_numpy(), ids, batch.column("has_id").to_numpy(zero_copy_only=False), batch.column("chars").to_numpy(), batch.column("rows").to_numpy()]
            kept.append(tuple(c[held] for c in columns))
            if not held.all():
                over = batch.filter(pa.array(~held))
                n = over.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(n, bool)), over.column("record"), over.column("doc_id"), over.column("has_id"), over.column("chars"), over.column("rows"), pa.nulls(n, pa.bool_()), over.column("digest"), over.column("content")],
                    schema=schema,
                )
        if not kept:
            return
        number, record, ids, has, chars, rows = (np.concatenate(c) for c in zip(*kept, strict=True))
        if not len(number):
            return
        order = np.lexsort((record, ids, ~has, -chars, number))
        first = order[np.diff(number[order], prepend=-1) != 0]
        size = np.zeros(len(first), np.int64)
        np.add.at(size, number, rows)
        winner = np.zeros(len(number), bool)
        winner[first] = True
        digest = pa.array(digests, pa.binary())
        for at in range(0, len(number), 1 << 16):
            n = number[at : at + (1 << 16)]
            top = first[n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), bool)), pa.array(record[at : at + len(n)]), pa.array(ids[top], mask=~has[top]), pa.array(has[top]), pa.nulls(len(n), pa.int64()), pa.array(size[n]), pa.array(winner[at : at + len(n)]), digest.take(pa.array(n)), pa.nulls(len(n), pa.binary())],
                schema=schema,
            )

    return run


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Of rows with equal texts that with the most code points in its original text stays, then
    the smallest doc_id; keep_id is its id.  A null text counts as empty, so all texts without a
    word are one group.  Rows without an id come after those with one (keep_id is null only where no
    row of the group has an id); of rows alike in text and id one stays.  Every row of docs gives one
    row, other columns of docs are not read, and an empty table gives none.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "exact-duplicates")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = {"compression": "zstd"}
    rows.mapInArrow(_fold(table_bytes), _FOLDED).write.options(**packed).partitionBy("kind").parquet(f"{folder}/folded")
    folded = spark.read.schema(_FOLDED).parquet(f"{folder}/folded")
    members = folded.where(F.col("kind") == _MEMBER).select("record", "doc_id", "best")
    records = folded.where(F.col("kind") == _RECORD).select("record", "doc_id", "has_id", "chars", "rows", "digest", "content")

    settled, number = [], 0
    size = records.agg(F.sum(F.octet_length("content") + 64)).first()[0]
    while size is not None:
        if number == MAX_ROUNDS:
            raise RuntimeError(f"texts were still spilled after {MAX_ROUNDS} rounds")
        # Half full on average: a partition that is dealt more than a table holds spills the rest.
        parts = min(fan_out, -(-2 * size // table_bytes))
        path = f"{folder}/round-{number}"
        dealt = records.repartition(max(parts, spark.sparkContext.defaultParallelism), F.xxhash64("digest", F.lit(number)))
        dealt.mapInArrow(_settle(table_bytes), _SETTLED).write.options(**packed).partitionBy("spilled").parquet(path)
        out = spark.read.schema(_SETTLED).parquet(path)
        settled.append(out.where(~F.col("spilled")).select("record", "keep_id", "rows", "winner", "digest"))
        records = out.where("spilled").select("record", F.col("keep_id").alias("doc_id"), "has_id", "chars", "rows", "digest", "content")
        size = records.agg(F.sum(F.octet_length("content") + 64)).first()[0]
        number += 1
    verdicts = spark.createDataFrame([], "record long, keep_id long, rows long, winner boolean, digest binary")
    for part in settled:
        verdicts = verdicts.unionByName(part)
    return members.join(verdicts, "record").select(
        "doc_id", "keep_id", F.col("rows").alias("group_size"), (F.col("best") & F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
