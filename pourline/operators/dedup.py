"""The same drink at several sites, and drinks that share ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import durable
from .scoring import DRY, LIQUID

#: Entries of a list that one block holds on average.
LIST_ROWS = 2000
#: Sets of at most so many parts meet under two shared parts: their pairs of parts are few.
SHORT = 16
_UNITS = r"\b(?:" + "|".join([*LIQUID, *DRY]) + r")\b"


def normal_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " "))


def normal_ingredient(line: Column) -> Column:
    """A line without digits, fractions, unit words and punctuation."""
    bare = F.regexp_replace(F.lower(line), r"[^a-z]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, _UNITS, " "), " +", " "))


def ingredient_set(ingredients: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(ingredients, normal_ingredient), lambda s: s != "")))


def dedup_key(name: Column, ingredients: Column) -> Column:
    return F.sha2(F.concat(normal_name(name), F.lit("\n"), F.array_join(ingredient_set(ingredients), "\n")), 256)


def dedup_recipes(recipes: DataFrame) -> DataFrame:
    """recipes(id, name, ingredients) -> one row per key: dedup_key, id kept (the least), n_members.

    Members are counted by partial aggregation; ``dedup_members`` lists them.
    """
    keyed = recipes.select("id", dedup_key(F.col("name"), F.col("ingredients")).alias("dedup_key"))
    return keyed.groupBy("dedup_key").agg(F.min("id").alias("id"), F.count("*").alias("n_members"))


def dedup_members(recipes: DataFrame) -> DataFrame:
    """recipes(id, name, ingredients) -> one row per recipe: id, dedup_key, class_id (the least id of its key)."""
    keyed = recipes.select("id", dedup_key(F.col("name"), F.col("ingredients")).alias("dedup_key"))
    least = keyed.groupBy("dedup_key").agg(F.min("id").alias("class_id"))
    return keyed.join(least, "dedup_key").select("id", "dedup_key", "class_id")


def overlap_members(recipes: DataFrame) -> DataFrame:
    """recipes(id, ingredients) -> one row per recipe with ingredients: id, class_id.

    class_id is the id under which ``ingredient_overlap`` states the recipe's set: the least
    of its equal sets, met by an equi-join on the set's hash.
    """
    key = F.sha2(F.to_json("parts"), 256)
    keyed = recipes.select("id", ingredient_set(F.col("ingredients")).alias("parts")).where(F.size("parts") > 0).select("id", key.alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("class_id"))
    return keyed.join(least, "key").select("id", "class_id")


def _met(a: DataFrame, b: DataFrame, key: str, min_jaccard: float, list_rows: int, where: Column) -> DataFrame:
    """(id, other_id, jaccard), id < other_id, of entries (id, n, parts, key) of both sides under one key; a pair may come under several.

    A key with more than ``list_rows`` entries of ``b`` is dealt over blocks by a hash of the id, so that no task has more than a block
    of a list at once; the entries of ``a`` go to each of its blocks.
    """
    blocks = durable(b.groupBy(key).agg(F.ceil(F.count("*") / list_rows).cast("int").alias("blocks")).where("blocks > 1"))
    same = F.col(f"a.{key}") == F.col(f"b.{key}")
    if blocks.isEmpty():
        a, b = a.alias("a"), b.alias("b")
    else:
        own = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
        blocks = F.broadcast(blocks)  # at most the entries over list_rows
        a, b = (x.join(blocks, key, "left").select(*x.columns, block).alias(name) for x, block, name in ((a, every, "a"), (b, own.alias("block"), "b")))
        same = same & (F.col("a.block") == F.col("b.block"))
    fits = (F.col("a.n") >= F.col("b.n") * min_jaccard - 1e-9) & (F.col("b.n") >= F.col("a.n") * min_jaccard - 1e-9)
    common = F.size(F.array_intersect("a.parts", "b.parts"))
    jaccard = common / (F.col("a.n") + F.col("b.n") - common)
    met = a.join(b, same & where & fits & (jaccard >= min_jaccard))
    return met.select(F.least("a.id", "b.id").alias("id"), F.greatest("a.id", "b.id").alias("other_id"), jaccard.alias("jaccard"))


def similar_sets(sets: DataFrame, min_jaccard: float = 0.5, list_rows: int = LIST_ROWS) -> DataFrame:
    """sets(id, parts), parts a set of values -> (id, other_id, jaccard) of all pairs id < other_id of at least min_jaccard.

    Parts are ordered by how many sets hold them, the rarest first.  Two sets that must share c parts share one of the
    first n - c + 1 of that order, and two of the first n - c + 2.  So sets of at most SHORT parts that must share two or
    more meet under two parts of their beginnings, which few unlike sets have in common; longer sets, and those for which one
    shared part is enough, meet under one.  A pair is verified wherever it meets and counts once.  Sets are read twice.
    """
    posted = sets.select("id", F.explode("parts").alias("part"))
    seen = posted.groupBy("part").agg(F.count("*").alias("df"))
    ranked = posted.join(seen, "part").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "part"))), lambda x: x["part"]).alias("parts"))
    ranked = durable(ranked.select("id", F.size("parts").alias("n"), "parts"))
    least = F.ceil(F.col("n") * min_jaccard - 1e-9).cast("int")  # parts that a similar set shares at least
    one = (1 + min_jaccard) / min_jaccard + 1e-9  # sets of so many parts together need only one in common
    first, two = F.slice("parts", F.lit(1), F.col("n") - least + 1), F.slice("parts", F.lit(1), F.col("n") - least + 2)
    both = F.flatten(F.transform(two, lambda x, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda y: F.xxhash64(x, y))))
    pairs = ranked.where((F.col("n") >= 2) & (F.col("n") <= SHORT)).select("id", "n", "parts", F.explode(both).alias("key"))
    single = ranked.where((F.col("n") > SHORT * min_jaccard) | (F.col("n") < one)).select("id", "n", "parts", F.explode(first).alias("key"))
    ordered, together = F.col("a.id") < F.col("b.id"), F.col("a.n") + F.col("b.n")
    met = _met(pairs, pairs, "key", min_jaccard, list_rows, ordered & (together > one))
    # The longer of a pair is a long set; of two long ones each pair counts from its smaller id.
    met = met.unionByName(_met(single.where(F.col("n") > SHORT), single, "key", min_jaccard, list_rows, ordered | (F.col("b.n") <= SHORT)))
    small = single.where(F.col("n") < one)
    met = met.unionByName(_met(small, small, "key", min_jaccard, list_rows, ordered & (together <= one)))
    return met.groupBy("id", "other_id").agg(F.first("jaccard").alias("jaccard"))


def most_similar(sets: DataFrame, k: int = 5, min_jaccard: float = 0.5) -> DataFrame:
    """sets(id, parts) -> (id, other_id, jaccard): of each set the k most similar others, ties by id.

    Equal sets are compared once, under their least id.  A class of equal sets is represented by its k + 1 least ids, which are all
    that any set can have among its k best.
    """
    sets = durable(sets.where(F.size("parts") > 0).select("id", F.array_sort("parts").alias("parts")))
    rank = F.row_number().over(Window.partitionBy("parts").orderBy("id"))
    heads = sets.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).groupBy("parts").agg(F.sort_array(F.collect_list("id")).alias("heads"))
    classes = durable(heads.select(F.get("heads", F.lit(0)).alias("id"), "parts", "heads"))
    pairs = similar_sets(classes.select("id", "parts"), min_jaccard)
    linked = pairs.select(F.explode(F.array(F.struct("id", "other_id", "jaccard"), F.struct(F.col("other_id").alias("id"), F.col("id").alias("other_id"), "jaccard"))).alias("x")).select("x.*")
    others = linked.join(classes.select(F.col("id").alias("other_id"), "heads"), "other_id").select("id", "jaccard", F.explode("heads").alias("other_id"))
    own = classes.where(F.size("heads") > 1).select("id", F.lit(1.0).alias("jaccard"), F.explode("heads").alias("other_id"))
    top = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("jaccard"), "other_id"))
    best = others.unionByName(own).withColumn("_rank", top).where(F.col("_rank") <= k + 1)
    best = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_rank", "other_id", "jaccard"))).alias("best"))
    listed = sets.join(classes.select(F.col("id").alias("class_id"), "parts").join(best.withColumnRenamed("id", "class_id"), "class_id").select("parts", "best"), "parts")
    kept = F.slice(F.filter("best", lambda x: x["other_id"] != F.col("id")), F.lit(1), F.lit(k))
    return listed.select("id", F.explode(kept).alias("x")).select("id", "x.other_id", "x.jaccard")


def ingredient_overlap(recipes: DataFrame, k: int = 5, min_jaccard: float = 0.5) -> DataFrame:
    """Per ingredient set the k most similar other sets by Jaccard, ties by id: (id, other_id, jaccard).

    Recipes of equal sets count once, under their least id; ``overlap_members`` has it for every recipe.
    """
    sets = recipes.select("id", ingredient_set(F.col("ingredients")).alias("parts")).where(F.size("parts") > 0).groupBy("parts").agg(F.min("id").alias("id"))
    return most_similar(sets, k, min_jaccard)
