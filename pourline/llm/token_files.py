"""Token ids as flat unsigned integers with 64-bit document offsets.

A folder holds one shard per range of doc_id: ``.ids`` has the ids of all its
documents one after another (16 bits each where the vocabulary allows, else 32),
``.idx`` has 64-bit words: for each document its doc_id and where it ends in the
shard.  Shards follow doc_id; each one's base (ids in all shards before it) comes
from a prefix sum over the shards' totals, so writers need not know each other.
Readers map both files and touch only what they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh_folder
from .store import mapped, writing
from .tokens import encoder
from .words import steps

NO_ID = np.iinfo(np.int64).min
#: Ids that a reader holds at a time, unless one document has more.
READ_IDS = 4_000_000


def _write(folder: str, path: str, cut: str, end_id: int, width: int):
    kind = {16: "<u2", 32: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, total, n = encoder(path, cut), TaskContext.get().partitionId(), 0, 0
        with writing(folder, f"{shard:06d}", ".ids") as (ids_file, ids_uri), writing(folder, f"{shard:06d}", ".idx") as (idx_file, idx_uri):
            for batch in batches:
                for part, texts in steps(batch, 1):
                    ids, bounds = encode([t or "" for t in texts], end_id)
                    if width == 16 and ids.max(initial=0) > 0xFFFF:
                        raise ValueError("a token id needs more than 16 bits")
                    ids_file.write(ids.astype(kind).tobytes())
                    rows = np.empty((len(texts), 2), "<i8")
                    rows[:, 0] = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    rows[:, 1] = total + bounds[1:]
                    idx_file.write(rows.tobytes())
                    total += len(ids)
                    n += len(texts)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "ids": [ids_uri], "idx": [idx_uri], "n_docs": [n], "n_tokens": [total]})

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, cut: str, end_id: int, width: int = 16, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the shards; one row per shard: shard, ids, idx (files), n_docs, n_tokens, base (ids in earlier shards).

    A null text is empty (its end id only); null ids come first; rows with equal ids
    follow each other.  An empty table has no shards.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = durable(
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .mapInArrow(_write(folder, tokenizer_path, cut, end_id, width), "shard long, ids string, idx string, n_docs long, n_tokens long")
    )
    # One short row per shard, not per document, comes to the driver.
    kept = sorted((r for r in shards.collect() if r["n_docs"]), key=lambda r: r["shard"])
    bases = accumulate((r["n_tokens"] for r in kept), initial=0)
    return docs.sparkSession.createDataFrame(
        [(r["shard"], r["ids"], r["idx"], r["n_docs"], r["n_tokens"], base) for r, base in zip(kept, bases, strict=False)],
        "shard long, ids string, idx string, n_docs long, n_tokens long, base long",
    )


def _read(width: int):
    kind, size = {16: "<u2", 32: "<u4"}[width], width // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with mapped(row["idx"]) as idx_file, mapped(row["ids"]) as ids_file:
                    index = np.frombuffer(idx_file.read_buffer(), "<i8").reshape(-1, 2)
                    ends, at = index[:, 1], 0
                    while at < len(ends):
                        begin = int(ends[at - 1]) if at else 0
                        to = max(at + 1, int(np.searchsorted(ends, begin + READ_IDS, "right")))
                        ids_file.seek(begin * size)
                        ids = np.frombuffer(ids_file.read_buffer((int(ends[to - 1]) - begin) * size), kind).astype("<u4")
                        starts = np.concatenate([[begin], ends[at : to - 1]])
                        own = memoryview(ids).cast("B")
                        crc = [zlib.crc32(own[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(starts.tolist(), ends[at:to].tolist(), strict=True)]
                        keys = index[at:to, 0]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, mask=keys == NO_ID), pa.array(row["base"] + starts), pa.array(ends[at:to] - starts), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to

    return run


def read_token_files(shards: DataFrame, width: int = 16) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit)."""
    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(_read(width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, cut: str, end_id: int, width: int = 16) -> DataFrame:
    """Write the documents' ids to a new shared folder and read them back."""
    return read_token_files(write_token_files(docs, fresh_folder(spark, "token-files"), tokenizer_path, cut, end_id, width), width)
