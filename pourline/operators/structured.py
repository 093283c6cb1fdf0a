"""JSON-LD blocks and nodes by Spark's own functions where a page is plain enough, and by the HTML helper elsewhere.

A page is plain if a regular expression sees its scripts as an HTML parser does, it has no microdata, and its blocks are
JSON that both sides write alike: without escapes, fractions, repeated keys and nesting beyond what is opened here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.page_facts import page_facts

#: Levels of lists and @graph wrappers that are opened; a page with more goes to the helper.
LEVELS = 3
#: Brackets of a block at most: below the helper's bound on nesting, whatever their order.
MOST_BRACKETS = 200
_SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
#: Elements and marks in which a parser does not see tags, or sees an end of its own; and microdata.
_OTHER_RULES = r"(?i)<!--|<!\[|<\?|<(?:textarea|xmp|iframe|noembed|noframes|plaintext|noscript)\b|itemscope|<script\b[^>]*/>"
_SCRIPT_INSIDE = r"(?is)<(style|title)\b[^>]*>(?:(?!</\1).)*<script"
_PLAIN_ATTRIBUTES = r"^(?:\s+[A-Za-z-]+(?:=\"[^\"&]*\"|='[^'&]*')?)*\s*$"
_IS_JSONLD = r"(?i)\stype=(\"|')(?-i:application/ld\+json)\1"
_STRING = r"\"[^\"\\\x00-\x1f]*\""


def _scripts(html: Column) -> tuple[Column, Column]:
    """(attributes, bodies) of a page's scripts, in order."""
    return F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)), F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(2))


def _plain_json(body: Column) -> Column:
    """Whether a block is JSON that Spark and the helper read and write alike."""
    frame = F.regexp_replace(body, _STRING, "s")
    whole = F.regexp_replace(F.get_json_object(body, "$"), _STRING, "s") == F.regexp_replace(frame, r"[ \t\r\n]+", "")  # nothing follows the value
    brackets = F.length(frame) - F.length(F.translate(frame, "[{", ""))
    return (
        frame.rlike(r"^[ \t\r\n{}\[\],:\-0-9a-z]*$") & ~body.rlike(r"\"\s*[\[{]") & (brackets <= MOST_BRACKETS) & F.try_parse_json(body).isNotNull() & F.coalesce(whole, F.lit(False))
    )


def _held(text: Column) -> Column:
    """The JSON text of a list of a node's own: its members if it is a list, its @graph if that is one; else null."""
    graph = F.get_json_object(text, "$['@graph']")
    return F.when(text.startswith("["), text).when(text.startswith("{") & graph.startswith("["), graph)


def _opened(texts: Column) -> Column:
    members = lambda t: F.from_json(_held(t), "array<string>")
    return F.filter(F.flatten(F.transform(texts, lambda t: F.coalesce(members(t), F.array(t)))), lambda t: t.isNotNull())


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """pages(…, html) -> pages with nodes, the JSON text of every JSON-LD object in page order, and by_helper; html is dropped.

    ``by_helper`` marks the pages that went through Python.  Malformed blocks are skipped there.  A null page has null nodes.
    """
    html = F.col("html")
    attributes, bodies = _scripts(html)
    seen = pages.withColumns({"_attributes": attributes, "_bodies": bodies})
    pairs = F.arrays_zip(F.col("_attributes").alias("a"), F.col("_bodies").alias("b"))
    blocks = F.transform(F.filter(pairs, lambda p: p["a"].rlike(_IS_JSONLD)), lambda p: p["b"])
    seen = seen.withColumn("_blocks", blocks)
    plain = (
        ~html.rlike(_OTHER_RULES) & ~html.rlike(_SCRIPT_INSIDE) & F.forall("_attributes", lambda a: a.rlike(_PLAIN_ATTRIBUTES) & (F.regexp_count(a, F.lit(r"(?i)\stype\b")) <= 1))
        & (F.size("_attributes") == F.regexp_count(html, F.lit(r"(?i)<script\b"))) & F.forall("_blocks", _plain_json)
    )
    texts = F.transform("_blocks", lambda b: F.get_json_object(b, "$"))
    for _ in range(LEVELS):
        texts = _opened(texts)
    seen = seen.withColumn("_texts", F.when(plain, texts))
    shut = F.forall("_texts", lambda t: _held(t).isNull())
    seen = seen.withColumn("by_helper", html.isNotNull() & ~F.coalesce(shut, F.lit(False)))
    own = F.filter("_texts", lambda t: t.startswith("{"))
    helped = page_facts(F.when(F.col("by_helper"), html))["nodes"]  # a null page is passed through unread
    out = seen.withColumn("_helped", helped).withColumn("nodes", F.when(F.col("by_helper"), F.col("_helped")).otherwise(own))
    return out.drop("html", "_attributes", "_bodies", "_blocks", "_texts", "_helped")
