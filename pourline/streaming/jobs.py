"""Streaming forms of the incremental jobs: discover, validate, pause."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import upsert_latest
from ..operators.validation import eval_rows, evaluate
from ..shared import durable

WINDOW, THRESHOLD = 20, 0.4
#: The setting that keeps the state of streams in RocksDB, on disk and not in the executors' heaps.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_discover(urls: DataFrame) -> DataFrame:
    """Each url once, the first time it comes.  State holds every url seen; ``discover_batches`` keeps none."""
    return urls.dropDuplicates(["url"])


def discover_batches(urls: DataFrame, frontier_path: str, checkpoint: str):
    """Append urls that the stored frontier does not have: an anti-join in every batch, and no state that grows.

    A batch that is run again after a failure finds its own rows and adds nothing.
    """

    def step(batch: DataFrame, _: int) -> None:
        known = batch.sparkSession.read.schema("url string, site string").parquet(frontier_path).select("url")
        fresh = batch.groupBy("url").agg(F.min("site").alias("site")).join(known, "url", "left_anti")
        fresh.write.mode("append").parquet(frontier_path)

    return urls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_validate(pages: DataFrame, runs_path: str, checkpoint: str, run_id: int, now):
    """Evaluate each landed page (id, site, url, status, content_type, html) once and store its rows by batch.

    Batches overwrite their own folder, so a batch that is run again leaves one copy;
    ``latest_runs`` gives the last row of each page.  A restart goes on where it stopped.
    """

    def step(batch: DataFrame, number: int) -> None:
        validated, scored = eval_rows(durable(evaluate(batch)), run_id, now)  # both read it; pages are parsed once
        rows = validated.join(scored.select("page_id", "label", "score"), "page_id").withColumn("batch", F.lit(number))
        rows.drop("batch").write.mode("overwrite").parquet(f"{runs_path}/batch={number}")

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_runs(runs: DataFrame) -> DataFrame:
    return upsert_latest(runs.limit(0), runs, "page_id", [F.desc("batch"), F.desc("evaluated_at")]).drop("batch")


def _ring(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the last WINDOW statuses of a site and whether its pause was told."""
    kept, told = state.get if state.exists else ("[]", False)
    ring = [tuple(x) for x in json.loads(kept)]
    for batch in batches:
        ring += list(zip(batch["id"].tolist(), batch["status"].tolist(), strict=True))
        ring = sorted(ring)[-WINDOW:]
    paused = len(ring) >= WINDOW and sum(s == "blocked" for _, s in ring) / len(ring) > THRESHOLD
    if paused and not told:
        yield pd.DataFrame({"site": [key[0]], "blocked": [sum(s == "blocked" for _, s in ring)]})
    state.update((json.dumps(ring), told or paused))


def stream_circuit_breaker(statuses: DataFrame) -> DataFrame:
    """statuses(id, site, status) -> (site, blocked), once per site when it trips; a site's state is WINDOW statuses."""
    return statuses.where("status <> 'pending'").groupBy("site").applyInPandasWithState(
        _ring, "site string, blocked long", "ring string, told boolean", "append", GroupStateTimeout.NoTimeout
    )


class _Breaker(StatefulProcessor):
    """The last WINDOW statuses of a site as a typed list, and whether its pause was told."""

    def __init__(self, quiet_ms: int | None = None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "id long, status string", self.quiet_ms)
        self.told = handle.getValueState("told", "told boolean", self.quiet_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        ring = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        for batch in rows:  # late statuses take the place that their id gives them
            ring = sorted(ring + list(zip(batch["id"].tolist(), batch["status"].tolist(), strict=True)))[-WINDOW:]
        self.ring.put(ring)
        blocked = sum(s == "blocked" for _, s in ring)
        told = self.told.exists()
        if not told and len(ring) >= WINDOW and blocked / len(ring) > THRESHOLD:
            self.told.update((True,))
            yield pd.DataFrame({"site": [key[0]], "blocked": [blocked]})

    def close(self) -> None:
        pass


def stream_breaker_state(statuses: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """``stream_circuit_breaker`` with typed state; the session's state store must be RocksDB (``ROCKSDB``).

    With ``quiet_ms`` a site without statuses for so long is forgotten, and may be told again.
    """
    rows = statuses.where("status <> 'pending' AND site IS NOT NULL").groupBy("site")
    mode = "None" if quiet_ms is None else "ProcessingTime"
    return rows.transformWithStateInPandas(_Breaker(quiet_ms), "site string, blocked long", "append", mode)
