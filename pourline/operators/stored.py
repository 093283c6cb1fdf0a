"""Latest-only tables at rest: rows in buckets by a hash of the key, of which a merge rewrites those it changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..shared import durable

#: The column that names a row's bucket; tables are partitioned by it.
BUCKET = "bucket"


@dataclass(frozen=True)
class KeyedTable:
    """One row per key, as Parquet under ``path`` in ``buckets`` folders.

    ``buckets`` is the table's size over what one task should rewrite (some 256 MB); it stays as it is.
    One merge runs at a time.  It is as safe as Spark's dynamic partition overwrite: rows are
    written beside the table first and their folders change places at the end.
    """

    path: str
    key: str
    schema: str
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; a filter on ``bucket`` reads its folder only."""
        rows = spark.read.schema(f"{self.schema}, {BUCKET} int")
        try:
            return rows.parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return spark.createDataFrame([], f"{self.schema}, {BUCKET} int")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).drop(BUCKET)

    def of(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """Rows of the given keys (a frame with the key column), from their buckets only."""
        keys = durable(keys.select(self.key).distinct().withColumn(BUCKET, self.bucket()))
        held = self.touched(keys)
        return self.read(spark).where(F.col(BUCKET).isin(*held)).join(keys.drop(BUCKET), self.key, "left_semi").drop(BUCKET)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def touched(rows: DataFrame) -> list[int]:
        """Buckets that rows lie in: at most as many as the table has."""
        return [r[0] for r in rows.select(BUCKET).distinct().collect()]

    def merge(self, updates: DataFrame, order: list[Column], keep: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> list[int]:
        """Insert or replace by key and return the buckets that were rewritten.

        Of several updates of a key the first by ``order`` counts.  A known key keeps its values of the columns in
        ``keep``.  Updates that equal the stored row, columns in ``ignore`` aside, change nothing, and
        a bucket without a change is not written: a merge that is run again rewrites none.  Rows without a key are not stored.
        """
        spark, fields = updates.sparkSession, StructType.fromDDL(self.schema).fields
        names = [f.name for f in fields]
        typed = updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        ranked = typed.where(F.col(self.key).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(self.key).orderBy(*order)))
        last = durable(ranked.where("_rank = 1").drop("_rank").withColumn(BUCKET, self.bucket()))  # read for its buckets and for the merge
        stored = self.read(spark).where(F.col(BUCKET).isin(*self.touched(last)))
        # Both sides meet once, on the key and its bucket; every row says whether it is new, changed or as it was.
        old = stored.select(F.struct(*names).alias("_old"), F.col(self.key).alias("_key"), F.col(BUCKET).alias("_bucket"))
        both = last.select(F.struct(*names).alias("_new"), F.col(self.key).alias("_k"), BUCKET).join(old, (F.col("_k") == F.col("_key")) & (F.col(BUCKET) == F.col("_bucket")), "full")
        known = F.col("_key").isNotNull()
        pick = [F.when(known, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")) if c in keep else F.col(f"_new.{c}") for c in names]
        new = F.struct(*[p.alias(c) for p, c in zip(pick, names, strict=True)])
        compared = [c for c in names if c not in ignore]
        same = known & F.col("_k").isNotNull()
        for c in compared:
            same = same & new[c].eqNullSafe(F.col("_old")[c])
        changed = F.col("_k").isNotNull() & ~same
        merged = durable(both.select(F.when(changed, new).otherwise(F.col("_old")).alias("row"), changed.alias("changed"), F.coalesce(BUCKET, "_bucket").alias(BUCKET)))
        dirty = self.touched(merged.where("changed"))
        if dirty:
            rows = merged.where(F.col(BUCKET).isin(*dirty)).select("row.*", BUCKET)
            rows.repartition(min(len(dirty), 4096), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return sorted(dirty)


def merge_recipes(table: KeyedTable, new: DataFrame, now) -> list[int]:
    """Extracted recipes into a stored table by source_url: known ones keep their id, new ones get a hash of their url.

    ``extracted_at`` becomes now with any other change of the row, so that a repeated extraction changes nothing.
    """
    rows = new.withColumns({"id": F.xxhash64("source_url"), "extracted_at": F.lit(now).cast("timestamp")})
    return table.merge(rows, [F.desc("fetched_at"), F.col("jsonld")], keep=("id",), ignore=("extracted_at", "fetched_at"))
