"""The ingredient taxonomy: a DAG of nodes with aliases."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable

ROLES = ("brand", "expression")


def build_taxonomy(nodes: DataFrame, edge_pairs: DataFrame, alias_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, slug, …), edge_pairs(parent, child), alias_pairs(alias, slug) -> (edges, aliases) by id; unknown slugs drop out."""
    ids = lambda name: nodes.select(F.col("slug").alias(name), F.col("id").alias(f"{name}_id"))
    edges = edge_pairs.join(ids("parent"), "parent").join(ids("child"), "child").select("parent_id", "child_id")
    aliases = alias_pairs.join(ids("slug"), "slug").select("alias", F.col("slug_id").alias("node_id"))
    return edges, aliases


def violations(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(rule, value) of every broken constraint."""
    said = lambda rule, value: [F.lit(rule).alias("rule"), value.cast("string").alias("value")]
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    out = twice(nodes, "slug").select(*said("slug is not unique", F.col("slug")))
    out = out.unionByName(nodes.where(F.col("role").isNotNull() & ~F.col("role").isin(*ROLES)).select(*said("unknown role", F.col("slug"))))
    out = out.unionByName(edges.where("parent_id = child_id").select(*said("edge to itself", F.col("parent_id"))))
    out = out.unionByName(twice(edges, "parent_id", "child_id").select(*said("edge is not unique", F.concat_ws(">", "parent_id", "child_id"))))
    return out.unionByName(twice(aliases, "alias", "node_id").select(*said("alias is not unique", F.concat_ws(">", "alias", "node_id"))))


def resolve_aliases(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """texts(…, text) with node_id of the exact alias, trimmed and lower-cased; several nodes give several rows, none a null."""
    known = aliases.select(F.lower(F.trim("alias")).alias("_alias"), "node_id")
    return texts.join(known, F.lower(F.trim("text")) == F.col("_alias"), "left").drop("_alias")


def taxonomy_closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) with the least depth of each pair, however deep; it ends when a step gives no new pair."""
    step = edges.select(F.col("parent_id").alias("_from"), F.col("child_id").alias("_to")).distinct()
    known = step.select(F.col("_from").alias("ancestor"), F.col("_to").alias("descendant"), F.lit(1).alias("depth"))
    frontier = known
    for depth in count(2):
        grown = frontier.join(step, frontier["descendant"] == step["_from"]).select("ancestor", F.col("_to").alias("descendant")).distinct()
        frontier = durable(grown.join(known, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def descendants(closure: DataFrame, nodes: DataFrame, slug: str) -> DataFrame:
    own = nodes.where(F.col("slug") == slug).select(F.col("id").alias("ancestor"))
    return closure.join(own, "ancestor", "left_semi").select("descendant", "depth")


def _reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that start(node, color) reaches along edges(src, dst, color) of its color, itself included; a round walks one edge."""
    known = frontier = durable(start)
    while True:
        step = edges.join(frontier.select(F.col("node").alias("src"), "color"), ["src", "color"]).select(F.col("dst").alias("node"), "color").distinct()
        frontier = durable(step.join(known, ["node", "color"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends both have an edge in and an edge out, after all others fell away round by round."""
    left, n = edges, edges.count()
    while n:
        both = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
        kept = left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        left = durable(kept)
        before, n = n, left.count()
        if n == before:
            break
    return left


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node_id, component, n_nodes) of every node on a cycle: its strongly connected component by least node, and that one's size.

    Nodes without an edge in or out are trimmed.  Of the rest every node takes as its color the largest node that
    reaches it, and a node of its own color with those that reach it back within the color is one
    component.  These go, and the next round colors what is left.  A round joins the edges a few times with
    one row per node; no pair of nodes far apart is ever formed, as in a closure.  An edge to itself is a cycle.
    """
    given = edges.where("parent_id IS NOT NULL AND child_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst")).distinct()
    given = durable(given)
    loops = given.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root"))
    left, found = _trimmed(given.where("src <> dst")), None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).distinct()
        color = durable(nodes.select("node", F.col("node").alias("color"), F.lit(True).alias("moved")))
        while not color.where("moved").isEmpty():
            told = left.join(color.where("moved").select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("told"))
            risen = F.coalesce(F.col("told") > F.col("color"), F.lit(False))
            color = durable(color.join(told, "node", "left").select("node", F.when(risen, F.col("told")).otherwise(F.col("color")).alias("color"), risen.alias("moved")))
        color = color.drop("moved")
        ends = left.join(color.withColumnsRenamed({"node": "src", "color": "a"}), "src").join(color.withColumnsRenamed({"node": "dst", "color": "b"}), "dst")
        inner = durable(ends.where("a = b").select("src", "dst", F.col("a").alias("color")))
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "color")
        done = _reached(back, color.where("node = color")).select("node", F.col("color").alias("root"))
        found = done if found is None else found.unionByName(done)
        gone = done.select("node")
        inner = inner.select("src", "dst")
        left = _trimmed(durable(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")))
    every = loops if found is None else found.unionByName(loops.join(found, "node", "left_anti"))
    sized = every.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n_nodes"))
    alone = loops.select(F.col("node").alias("own")).distinct()
    out = every.join(sized, "root").join(alone, F.col("node") == F.col("own"), "left").where("n_nodes > 1 OR own IS NOT NULL")
    return out.select(F.col("node").alias("node_id"), "component", "n_nodes")


def find_cycles(closure: DataFrame) -> DataFrame:
    """Nodes that are their own ancestors, with the length of the shortest way round."""
    return closure.where("ancestor = descendant").select(F.col("ancestor").alias("node_id"), "depth")
