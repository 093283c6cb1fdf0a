"""A frontier at rest that a stream of urls grows: buckets by url hash, each with a membership filter."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import BUCKET, KeyedTable
from ..shared import durable

#: Places that a url sets in its bucket's filter.
PROBES = 6


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """PROBES places of each url from its two hashes."""
    with np.errstate(over="ignore"):
        steps = first[:, None] + second[:, None] * np.arange(PROBES)
    return (steps.astype(np.uint64) % np.uint64(size)).astype(np.int64)


def _bits(filters: pa.Table, size: int) -> np.ndarray:
    raw = filters.column("bits")[0].as_py() if filters.num_rows else bytes(size // 8)
    return np.unpackbits(np.frombuffer(raw, np.uint8))


@dataclass(frozen=True)
class UrlFrontier:
    """(url, site) under ``path`` in ``buckets`` folders by a hash of the url, and a filter of ``bits`` places for each.

    ``bits`` is some ten times the urls that a bucket should hold; a bucket that holds more is only read more often.
    """

    path: str
    buckets: int
    bits: int = 1 << 20

    @property
    def filters(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/filters", "part", "part long, bits binary", min(self.buckets, 64))

    def read(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(f"url string, site string, {BUCKET} int").parquet(f"{self.path}/urls")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], f"url string, site string, {BUCKET} int")

    def add(self, urls: DataFrame) -> list[int]:
        """Add urls(url, site) that the frontier does not have, once each, and return the buckets that had to be read.

        A url whose places are not all set is new.  The others are held against the stored urls of their buckets, which alone
        are read.  Filters are written before urls: a call that broke off and is made again finds its urls
        possible, not stored, and adds them.
        """
        spark, size = urls.sparkSession, self.bits
        first, second = F.xxhash64("url"), F.xxhash64("url", F.lit(1)).bitwiseOR(F.lit(1))
        part = F.pmod(F.xxhash64("url", F.lit(2)), F.lit(self.buckets))
        batch = urls.where("url IS NOT NULL").groupBy("url").agg(F.min("site").alias("site")).select("url", "site", part.alias("part"), first.alias("h1"), second.alias("h2"))
        stored = self.filters.rows(spark)

        def look(rows: pa.Table, filters: pa.Table) -> pa.Table:
            places = _places(rows.column("h1").to_numpy(), rows.column("h2").to_numpy(), size)
            held = _bits(filters, size)[places].all(1) if rows.num_rows else np.zeros(0, bool)
            return rows.append_column("maybe", pa.array(held))

        def grow(rows: pa.Table, filters: pa.Table) -> pa.Table:
            bits = _bits(filters, size)
            bits[_places(rows.column("h1").to_numpy(), rows.column("h2").to_numpy(), size).ravel()] = 1
            key = rows.column("part") if rows.num_rows else filters.column("part")
            return pa.table({"part": key[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        given = "url string, site string, part long, h1 long, h2 long"
        looked = durable(batch.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(look, f"{given}, maybe boolean"))
        read = sorted(r[0] for r in looked.where("maybe").select("part").distinct().collect())
        known = self.read(spark).where(F.col(BUCKET).isin(read)).select(F.col("url").alias("_known"))
        unsure = looked.where("maybe").join(known, F.col("url") == F.col("_known"), "left_anti")
        fresh = durable(looked.where("NOT maybe").unionByName(unsure).drop("maybe"))
        touched = fresh.select("part").distinct()
        grown = fresh.groupBy("part").cogroup(stored.join(touched, "part", "left_semi").groupBy("part")).applyInArrow(grow, "part long, bits binary")
        self.filters.merge(grown, [F.col("part")])
        rows = fresh.select("url", "site", F.col("part").cast("int").alias(BUCKET))
        rows.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{self.path}/urls")
        return read


def discover_to(urls: DataFrame, frontier: UrlFrontier, checkpoint: str):
    """Feed a stream of urls(url, site) to a frontier, batch by batch; a batch that is run again adds nothing."""

    def step(batch: DataFrame, _: int) -> None:
        frontier.add(batch.select("url", "site"))

    return urls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
