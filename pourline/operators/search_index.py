"""A stored trigram index of the catalog, kept up by upserts, and searches that read it.

``docs`` is a keyed table id -> (version, name, ingredients_json).  ``postings`` holds lists
(gram, chunk, entries): entries are (id, version) of recipes whose text has the gram, and a chunk is a
hash of the id.  A gram has as many lists of a chunk as keep each of them short.  Lists lie in folders by a hash
of the gram.  An upsert adds lists of the new texts under a new version; entries of older
versions are told by ``docs`` and go at ``compact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import durable, new_folder
from .search import asked_terms, matches, meet, of_queries, rarest_grams, sent, trigrams
from .stored import KeyedTable

_POSTINGS = "gram string, chunk int, n int, entries array<struct<id:long,version:long>>, gram_block int"
#: Entries of one list at most, or so: a task that makes lists holds some hundred of them.
LIST = 1000


@dataclass(frozen=True)
class SearchIndex:
    """``path`` is the index's folder; ``chunks`` is recipes over what one bucket of them should hold (some 100,000), ``blocks`` the folders of lists."""

    path: str
    chunks: int
    blocks: int

    @property
    def docs(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/docs", "id", "id long, version long, name string, ingredients_json string", self.chunks)

    def _block(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.blocks)).cast("int")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")

    def _append(self, texts: DataFrame, mode: str, path: str) -> None:
        """Lists of texts(id, version, name, ingredients_json), each of one gram and of one piece of a chunk."""
        body = F.concat_ws("\n", "name", "ingredients_json")
        pieces = 1 + texts.count() // (self.chunks * LIST)
        place = F.pmod(F.xxhash64("id"), F.lit(self.chunks * pieces))
        grams = texts.select("id", "version", F.explode(trigrams(body)).alias("gram"), place.alias("place"))
        lists = grams.groupBy("gram", "place").agg(F.array_sort(F.collect_list(F.struct("id", "version"))).alias("entries"))
        lists = lists.select("gram", (F.col("place") % self.chunks).cast("int").alias("chunk"), F.size("entries").alias("n"), "entries")
        lists.withColumn("gram_block", self._block(F.col("gram"))).repartition("gram_block", "chunk").write.mode(mode).partitionBy("gram_block").parquet(path)

    def upsert(self, recipes: DataFrame, version: int) -> None:
        """recipes(id, name, ingredients_json), inserted or replaced; versions rise from call to call.

        Rows whose texts are as stored are passed over.  A call that failed is made again with the same version: its
        lists may then lie twice, which changes no result.
        """
        spark = recipes.sparkSession
        given = recipes.groupBy("id").agg(F.max(F.struct("name", "ingredients_json")).alias("x")).select("id", "x.*")
        stored = self.docs.of(spark, given).select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("ingredients_json").alias("_lines"), F.col("version").alias("_version"))
        joined = given.join(stored, F.col("id") == F.col("_id"), "left")
        same = F.col("_id").isNotNull() & F.col("name").eqNullSafe(F.col("_name")) & F.col("ingredients_json").eqNullSafe(F.col("_lines")) & (F.col("_version") != version)
        new = durable(joined.where(~same).select("id", F.lit(version).cast("long").alias("version"), "name", "ingredients_json"))
        self._append(new, "append", f"{self.path}/postings")
        self.docs.merge(new, [F.col("version")])

    def compact(self, spark: SparkSession) -> None:
        """Lists without entries of old versions."""
        fresh = new_folder(spark, "postings")
        self._append(self.docs.rows(spark), "overwrite", fresh)
        spark.read.schema(_POSTINGS).parquet(fresh).repartition("gram_block", "chunk").write.mode("overwrite").partitionBy("gram_block").parquet(f"{self.path}/postings")

    def search(self, queries: DataFrame) -> DataFrame:
        """queries(query_id, q) -> (query_id, id) of the recipes that hold every term; all without terms.

        Queries with the same terms are answered once.  A set of terms asks under its rarest gram: the ids in that gram's lists, each
        once whatever versions list it, meet the stored texts and are verified there.  No row holds a list longer than
        those stored.  Only the folders of the grams asked for are read.
        """
        spark = queries.sparkSession
        cut, grams, bare = asked_terms(queries)
        held = [r[0] for r in grams.select(self._block(F.col("gram"))).distinct().collect()]  # at most as many as there are folders
        lists = self.postings(spark).where(F.col("gram_block").isin(*held))
        counts = meet(lists.select("gram", "n"), sent(durable(grams.select("gram").distinct())), "gram").groupBy("gram").agg(F.sum("n").alias("n"))
        asks = rarest_grams(grams, counts)
        listed = meet(lists.select("gram", "entries"), sent(durable(asks.select("gram").distinct())), "gram").select("gram", F.explode("entries.id").alias("id"))
        # An id of an old version is told by the text that is stored now.
        found = listed.groupBy("id").agg(F.collect_set("gram").alias("grams")).join(self.docs.rows(spark), "id")
        texts = found.select("id", "name", "ingredients_json", F.explode("grams").alias("gram"))
        sure = meet(texts, sent(asks), "gram").where(F.forall("terms", matches)).select("id", "terms")
        bare = bare.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("bucket"))
        every = self.docs.read(spark).select("id", "bucket").join(bare, "bucket").select("query_id", "id")
        return of_queries(sure, cut).unionByName(every)
