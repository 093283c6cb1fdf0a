"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct w-word shingles.  Its signature has
``coordinates`` minima; every (coordinate, value) is an element.  Documents are
posted under their elements and collisions are counted:

* an element that only one document has can match nothing, so it is skipped, and a
  document with fewer than ``matches`` shared elements is skipped whole;
* elements are ordered from rare to frequent, and a document with s shared
  elements is posted under its first s - matches + 1 only (its prefix): two
  documents with ``matches`` common elements meet under one of them.  Frequent
  elements, such as those of a passage that many texts quote, fall out of prefixes;
* in a small posting list, pairs are joined, counted over all their elements and
  kept from ``matches`` on, each under its first common element alone;
* in a long posting list, every document is first held against a few hubs of the
  list; that joins most large groups of near copies at a cost linear in the list.
  Documents that are then outside the list's main group are counted against those
  of every other group, in blocks of bounded rows and bytes, by the same rule; pairs
  within a group that hangs together add nothing to it and are not looked at.

Every link is confirmed on the full sets.  Documents of equal sets count as one
until the end, so exact copies cost one row each.

At the default 32 coordinates and 16 matches a pair at a similarity of exactly 0.8
is met with probability 0.9999 (binomial tail), and a closer pair more surely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable_alone, keep_ids
from .graph import connected_components
from .words import lower_words, steps

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Longest posting list whose pairs are joined directly, and hubs of a longer one.
SMALL_LIST, HUBS = 64, 3
#: Documents and shingles that one block of a long list has on average at most.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000
#: Parts over which the documents of one element or hub are dealt in joins.
SALTS = 16
#: Bits of the map that tells scanning tasks which texts may be candidates; one that is full passes more texts and loses none.
CANDIDATE_BITS = 1 << 26


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle; no words, none."""
    words = lower_words(texts)
    keys, bounds = words.keys(), words.bounds.tolist()

    def rolled(h: np.ndarray, width: int) -> np.ndarray:
        out = h[: len(h) - width + 1] * _M1 + np.uint64(width)
        for k in range(1, width):
            out = ((out ^ (out >> np.uint64(29))) * _M2) + h[k : len(h) - width + 1 + k]
        out = (out ^ (out >> np.uint64(32))) * _M1
        return out ^ (out >> np.uint64(29))

    # All windows of the step at once; those that cross into the next text are never looked at.
    windows = rolled(keys, width) if len(keys) >= width else keys[:0]
    out = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        n = high - low
        out.append(np.unique(windows[low : high - width + 1]) if n >= width else rolled(keys[low:high], n) if n else keys[:0])
    return out


def _signatures(width: int, coordinates: int):
    rng = np.random.default_rng(20240531)
    odd = rng.integers(1, 2**63, coordinates, dtype=np.uint64) | np.uint64(1)
    flip = rng.integers(0, 2**63, coordinates, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, 1):
                sets = shingle_sets(texts, width)
                n = np.array([len(s) for s in sets], np.int64)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                full = np.flatnonzero(n)
                elements = np.zeros((len(full), coordinates), np.uint64)
                if len(full):
                    joined = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for k in range(coordinates):
                        h = (joined ^ flip[k]) * odd[k]
                        h ^= h >> np.uint64(32)
                        h *= _M2
                        low = np.minimum.reduceat(h, starts)
                        low = (low ^ np.uint64(k + 1)) * _M1
                        elements[:, k] = low ^ (low >> np.uint64(31))
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, coordinates, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n),
                        pa.array(prints, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "print", "elements"],
                )

    return run


def _full_sets(width: int, shared):
    """Full sets of the texts whose slot is marked in the shared map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(zstd.ZstdDecompressor().decompress(shared.value), np.uint8)
        for batch in batches:
            slot = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((marks[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            for part, texts in steps(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([x.tobytes() for x in shingle_sets(texts, width)], pa.binary())],
                    names=["doc_id", "text_hash", "shingles"],
                )

    return run


def _slot(doc_id: str, text_hash: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_hash), F.lit(CANDIDATE_BITS))


def _marks(named: DataFrame) -> bytes:
    """The map of the slots of named rows (own, own_hash), a bit each, compressed; its size is bounded by CANDIDATE_BITS."""
    marks, place = np.zeros(CANDIDATE_BITS // 8, np.uint8), _slot("own", "own_hash") + 1
    parts = named.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    for row in parts.collect():
        at = (row["bucket"] - 1) * len(row["bits"])
        marks[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return zstd.ZstdCompressor(level=1).compress(marks.tobytes())


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([a, b])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                held.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    return run


def _between_groups(percent: int, matches: int):
    """Confirmed links between documents outside the main group (``rest``) and those of other groups, for one pair of blocks.

    A pair is counted under the first element that both prefixes have, and confirmed
    only while no link found here has joined the two groups.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = {name: table.column(name).to_numpy() for name in ("node", "n", "component", "posts", "rest", "asks")}
        found = table.column("found").chunk(0)
        sizes = np.diff(found.offsets.to_numpy())
        values, codes = np.unique(found.flatten().to_numpy(), return_inverse=True)
        here = int(np.searchsorted(values, table.column("element")[0].as_py()))
        spots = np.arange(sizes.max())[None, :] < sizes[:, None]
        grid = np.full(spots.shape, len(values))
        grid[spots] = codes
        posted = np.arange(grid.shape[1])[None, :] < column["posts"][:, None]
        shingles = table.column("shingles").chunk(0)
        asked = np.flatnonzero(~column["asks"])
        node, n, component, rest = (column[name][asked] for name in ("node", "n", "component", "rest"))
        grid_asked, posted_asked = grid[asked], posted[asked]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        links = []
        mine, prefix = np.zeros(len(values) + 1, bool), np.zeros(len(values) + 1, bool)
        for i in np.flatnonzero(column["asks"]):
            mine[grid[i][spots[i]]] = prefix[grid[i][posted[i]]] = True
            size, home, me = column["n"][i], int(column["component"][i]), int(column["node"][i])
            near = (
                (component != home)
                & (~rest | (node > me))
                & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
                & (np.count_nonzero(mine[grid_asked], axis=1) >= matches)
            )
            near = np.flatnonzero(near)
            both = prefix[grid_asked[near]] & posted_asked[near]
            near = near[grid_asked[near, both.argmax(axis=1)] == here] if len(near) else near
            mine[grid[i]] = prefix[grid[i]] = False
            own = np.frombuffer(shingles[i].as_buffer(), np.uint64)
            for j in near:
                x, y = root(home), root(int(component[j]))
                if x == y:
                    continue
                common = len(np.intersect1d(own, np.frombuffer(shingles[asked[j]].as_buffer(), np.uint64), assume_unique=True))
                if 100 * common >= percent * (size + n[j] - common):
                    parent[max(x, y)] = min(x, y)
                    links.append((me, int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    coordinates: int = 32,
    matches: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Linked are documents with 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable, kept marks it.  A null or
    wordless text has an empty set, is linked with nothing and is its own component.
    Repeated rows are repeated in the result; rows of one id with different texts are linked
    each by its own text.  A row without an id is judged with no other and has no component.
    Column names of docs do not matter.
    """
    if matches is None:
        matches = max(1, math.floor(coordinates * percent / 100 - 4.25 * math.sqrt(coordinates * percent / 100 * (1 - percent / 100))))
    body = F.col(text).cast("string")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))
    signed = durable_alone(
        source.mapInArrow(_signatures(width, coordinates), "doc_id long, text_hash long, n_shingles long, print binary, elements array<long>")
    )
    # A class is a set; it is numbered, and its row of the smallest id stands for it.
    classes = durable_alone(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("print")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n_shingles").alias("n"), F.first("elements").alias("elements"))
        .select("print", F.monotonically_increasing_id().alias("node"), "row.doc_id", "row.text_hash", "n", "elements")
    )
    edges = _links(source, classes, width, percent, matches)
    rooted = (
        classes.select("print", "node", F.col("doc_id").alias("own")).join(connected_components(edges, "a", "b"), "node", "left")
        .select("print", "own", F.coalesce("component", "node").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("own").alias("component"))
    named = rooted.join(least, "root").select(F.col("print").alias("class_print"), "component")
    return (
        signed.drop("elements").join(named, (F.col("print") == F.col("class_print")) & F.col("doc_id").isNotNull(), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def _new_name(docs: DataFrame, stem: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while stem in taken:
        stem += "_"
    return stem


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, less all but one of each group of near duplicates: that with the smallest id.

    Rows whose id is null or not theirs alone are told apart by a hash of id and text in
    place of the id; of rows that are equal in both, one stays.
    """
    key = _new_name(docs, "row_key")
    counted = docs.groupBy(F.col(doc_id).alias("shared_id")).agg(F.count("*").alias("rows"))
    shared = durable_alone(counted.where((F.col("rows") > 1) | F.col("shared_id").isNull()).select("shared_id"))
    if shared.isEmpty():
        found = near_duplicates(docs, width, percent, doc_id=doc_id, text=text)
        return keep_ids(docs, found.where("kept = false").select("doc_id"), doc_id=doc_id, how="left_anti")
    same = docs[doc_id].eqNullSafe(shared["shared_id"])
    own, mixed = docs.join(shared, same, "left_anti"), docs.join(shared, same, "left_semi")
    # Hashes are above all ids of bounded size, so a row of its own id is kept before such a row.
    hashed = F.shiftrightunsigned(F.xxhash64(doc_id, text), 2) + F.lit(1 << 61)
    keyed = own.withColumn(key, F.col(doc_id).cast("long")).unionByName(mixed.withColumn(key, hashed).dropDuplicates([key]))
    found = near_duplicates(keyed, width, percent, doc_id=key, text=text)
    return keep_ids(keyed, found.where("kept = false").select("doc_id"), doc_id=key, how="left_anti").select(*docs.columns)


def _links(source: DataFrame, classes: DataFrame, width: int, percent: int, matches: int) -> DataFrame:
    """Confirmed links (a, b) between classes that connect all that are similar."""
    posted = classes.select("node", F.explode("elements").alias("element"))
    shared = posted.groupBy("element").agg(F.count("*").alias("c")).where("c > 1")
    prefixed = (
        posted.join(shared, "element")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("c", "element"))).alias("found"))
        .where(F.size("found") >= matches)
        .select("node", F.transform("found", lambda x: x["element"]).alias("found"), (F.size("found") - (matches - 1)).alias("posts"))
    )
    # The first ``posts`` of the elements found are the prefix; a posting does not hold them twice.
    postings = durable_alone(
        prefixed.join(classes.select("node", "n"), "node")
        .select("node", "n", "found", "posts", F.explode(F.slice("found", F.lit(1), F.col("posts"))).alias("element"))
    )
    lists = durable_alone(postings.groupBy("element").agg(F.count("*").alias("m")).where("m > 1"))

    left = postings.join(lists.where(F.col("m") <= SMALL_LIST).select("element"), "element")
    x, y = left.alias("x"), left.alias("y")
    prefix_x, prefix_y = (F.slice(f"{side}.found", F.lit(1), F.col(f"{side}.posts")) for side in ("x", "y"))
    met = x.join(
        y,
        (F.col("x.element") == F.col("y.element"))
        & (F.col("x.node") < F.col("y.node"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.get(F.array_intersect(prefix_x, prefix_y), F.lit(0)) == F.col("x.element"))
        & (F.size(F.array_intersect("x.found", "y.found")) >= matches),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = durable_alone(met.distinct())

    long_lists = durable_alone(
        postings.join(lists.where(F.col("m") > SMALL_LIST).select("element"), "element")
        .select("element", "node", "n", "found", "posts")
    )
    wanted = (
        pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        .unionByName(long_lists.select("node")).distinct()
    )
    named = durable_alone(classes.join(wanted, "node").select("node", F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash")))
    # Texts are not shuffled: their tasks make the sets of those that may be candidates, and the join drops the rest.
    full = (
        source.where("doc_id IS NOT NULL").select("doc_id", "text", "text_hash", _slot("doc_id", "text_hash"))
        .mapInArrow(_full_sets(width, source.sparkSession.sparkContext.broadcast(_marks(named))), "doc_id long, text_hash long, shingles binary")
    )
    sets = durable_alone(
        full.join(named, (F.col("doc_id") == F.col("own")) & (F.col("text_hash") == F.col("own_hash")))
        .dropDuplicates(["own", "own_hash"]).select("node", "shingles")
    )
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b"))
    confirmed = (
        pairs.join(first, "a").join(second, "b").select("a", "b", "shingles_a", "shingles_b")
        .mapInArrow(_confirm(percent), "a long, b long")
    )
    if long_lists.isEmpty():
        return confirmed
    labels = connected_components(confirmed.unionByName(_to_hubs(long_lists, sets, percent, matches)), "a", "b")
    joined = durable_alone(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return joined.unionByName(_between(long_lists, joined, sets, percent, matches))


def _salted(df: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _to_hubs(long_lists: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Confirmed links of documents to the hubs of their long lists; lists of the same documents have the same hubs."""
    one = F.struct("node", "n", "found")
    hubs = long_lists.groupBy("element").agg(F.array_distinct(F.array(*(F.min_by(one, F.xxhash64("node", F.lit(k))) for k in range(HUBS)))).alias("hubs"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")
    spokes = durable_alone(
        long_lists.select("*", salt).join(_salted(hubs), ["element", "salt"])
        .select("node", "n", "found", F.explode("hubs").alias("hub"))
        .where(F.col("node") != F.col("hub.node"))
        .where(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
        .where(F.size(F.array_intersect("found", "hub.found")) >= matches)
        .select("node", F.col("hub.node").alias("hub")).distinct()
    )
    centre = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("shingles_hub"))
    centre = _salted(centre.join(spokes.select("hub").distinct(), "hub"))
    return (
        spokes.join(sets, "node").select("*", salt).join(centre, ["hub", "salt"])
        .select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("shingles").alias("shingles_a"), F.col("shingles_hub").alias("shingles_b"))
        .mapInArrow(_confirm(percent), "a long, b long")
    )


def _between(long_lists: DataFrame, joined: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Confirmed links that join the groups (``joined``: a node, b its group) which still lie apart in a long list."""
    grouped = long_lists.join(joined.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )

    def blocks(rows: str, shingles: str):
        return F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(shingles) / BLOCK_SHINGLES)).cast("int")

    apart = (
        grouped.groupBy("element", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
        .groupBy("element").agg(
            F.max(F.struct("rows", "component", "shingles")).alias("main"),
            F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.count("*").alias("groups"),
        )
        .where("groups > 1")
        .select(
            "element", F.col("main.component").alias("main"), blocks("rows", "shingles").alias("blocks"),
            (F.col("rows") - F.col("main.rows")).alias("rows"), (F.col("shingles") - F.col("main.shingles")).alias("shingles"),
        )
        .select("element", "main", "blocks", blocks("rows", "shingles").alias("rest_blocks"))
    )
    rows = grouped.join(apart, "element").withColumn("rest", F.col("component") != F.col("main")).join(sets, "node")
    kept = ["element", "node", "n", "component", "found", "posts", "rest", "shingles"]

    def block(count: str):
        return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    asking = rows.where("rest").select(*kept, F.lit(True).alias("asks"), block("rest_blocks").alias("x"), every("blocks").alias("y"))
    asked = rows.select(*kept, F.lit(False).alias("asks"), every("rest_blocks").alias("x"), block("blocks").alias("y"))
    return asking.unionByName(asked).groupBy("element", "x", "y").applyInArrow(_between_groups(percent, matches), "a long, b long")
