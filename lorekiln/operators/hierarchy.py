"""Problem 3: parent-child rows to full hierarchies with nested-set ranges.

Let f(v) be the parent of v. Everything that runs along chains is done by
pointer doubling, so the number of rounds is the logarithm of the depth:

1. Upward: subtree sizes. In round k a node knows the number of nodes within
   2^k - 1 steps below it and its ancestor 2^k steps up; adding the sizes of
   the nodes that point at it doubles the reach.
2. Nodes whose pointer never comes to an end are left unprocessed: they lie on
   a cycle or run into one. Among them f applied 2^k times maps onto the cycles
   alone as soon as its image stops shrinking.
3. Downward: each sibling gets a range of preorder numbers behind its earlier
   siblings (prefix sums of sizes); numbers are offsets summed along the chain,
   again by doubling. Siblings are ordered by a hash bucket and then by id, so
   that the prefix sum of a node with a third of all rows as its children is
   split over as many tasks as it asks for.
4. Ancestors and descendants are comparisons of ranges. They are joined block by
   block of BLOCK preorder numbers: a block holds its own nodes and those
   ancestors that begin before it and reach into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import cut
from lorekiln.sources.tables import current_rows

#: Children that one hash bucket of a family holds about; the number of buckets follows from that of the nodes.
BUCKET_ROWS = 200_000
BLOCK = 4096
BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_id(column: Column) -> Column:
    """An id without blanks at its ends; null if nothing is left."""
    text = F.regexp_replace(column, BLANKS, "")
    return F.when(text != "", text)


def parent_links(entries: DataFrame) -> DataFrame:
    """(id, parent, known) from the current row of each id.

    The current row has the highest revision, then the latest ``ingested_at``;
    repeated rows count once, rows with a null or blank id are left out. A null
    or blank parent means none; ``known`` tells whether the parent exists.
    """
    rows = entries.select(clean_id(F.col("id")).alias("id"), clean_id(F.col("parent")).alias("parent"), "revision", "ingested_at")
    links = current_rows(rows, "id", ["revision", "ingested_at"], ["parent"])
    ids = links.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return links.join(ids, "parent", "left").select("id", "parent", F.coalesce("known", F.lit(False)).alias("known"))


def subtree_sizes(links: DataFrame) -> DataFrame:
    """(id, parent, up, depth, root, size): ``up`` is null for processed nodes, else a node on the way to a cycle.

    Depth counts the steps to the root so far; it is final where up is null.
    """
    state = cut(
        links.select(
            "id",
            F.when(F.col("known"), F.col("parent")).alias("parent"),
            F.when(F.col("known"), F.col("parent")).alias("up"),
            F.lit(0).cast("bigint").alias("depth"),
            F.col("id").alias("root"),
            F.lit(1).cast("bigint").alias("size"),
        )
    )
    step, left = 1, -1
    while True:
        now = state.where(F.col("up").isNotNull()).count()
        if now == 0 or now == left:  # a round that finishes nobody leaves only chains without an end
            return state
        left = now
        below = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("up_depth"), F.col("root").alias("up_root"))
        state = cut(
            state.join(above, "up", "left")
            .join(below, "id", "left")
            .select(
                "id",
                "parent",
                F.col("next").alias("up"),
                (F.col("depth") + F.when(F.col("up").isNull(), 0).when(F.col("next").isNull(), F.col("up_depth") + step).otherwise(0)).alias("depth"),
                F.when(F.col("up").isNull(), F.col("root")).otherwise(F.coalesce("up_root", "root")).alias("root"),
                (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            )
        )
        step *= 2


def cycles(unprocessed: DataFrame) -> DataFrame:
    """(id, on_cycle, cycle_id) of nodes whose chain has no end, from (id, parent); cycle_id is the least id on the cycle."""
    state = cut(unprocessed.select("id", F.col("parent").alias("up"), F.col("id").alias("least")))
    image = -1
    while True:
        on = state.select("up").distinct()
        now = on.count()
        doubled = state.join(state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("up_least")), "up")
        changed = doubled.where(F.col("up_least") < F.col("least")).limit(1).count()
        if now == image and not changed:
            break
        image = now
        state = cut(doubled.select("id", F.col("next").alias("up"), F.least("least", "up_least").alias("least")))
    on = state.select(F.col("up").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    names = state.select(F.col("id").alias("up"), F.col("least").alias("cycle_id"))
    return state.select("id", "up").join(names, "up").join(on, "id", "left").select("id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "cycle_id")


def preorder(sized: DataFrame) -> DataFrame:
    """(id, depth, root, size, low): ``[low, low + size)`` is the range of the subtree, unique over all trees."""
    salted = sized.select("*", F.pmod(F.xxhash64("id"), F.lit(64 + sized.count() // BUCKET_ROWS)).alias("salt"))
    family = ["parent", "salt"]
    by_salt = salted.groupBy(*family).agg(F.sum("size").alias("block"))
    before = by_salt.withColumn("skip", F.sum("block").over(Window.partitionBy("parent").orderBy("salt")) - F.col("block")).drop("block")
    within = F.sum("size").over(Window.partitionBy(*family).orderBy("id")) - F.col("size")
    same = F.col("l.parent").eqNullSafe(F.col("r.parent")) & (F.col("l.salt") == F.col("r.salt"))
    offsets = (
        salted.withColumn("within", within)
        .alias("l")
        .join(before.alias("r"), same)
        .select("id", "depth", "root", "size", F.col("l.parent").alias("up"), (F.col("within") + F.col("skip") + F.when(F.col("l.parent").isNull(), 0).otherwise(1)).alias("low"))
    )
    state = cut(offsets)
    while state.where(F.col("up").isNotNull()).limit(1).count():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("more"))
        state = cut(state.join(above, "up", "left").select("id", "depth", "root", "size", F.col("next").alias("up"), (F.col("low") + F.coalesce("more", F.lit(0))).alias("low")))
    return state.drop("up")


def _blocks(ranges: DataFrame) -> DataFrame:
    """One row per node and block of preorder numbers it reaches into; ``own`` marks the block it begins in."""
    first = F.floor(F.col("low") / BLOCK)
    last = F.floor((F.col("low") + F.col("size") - 1) / BLOCK)
    return ranges.withColumn("block", F.explode(F.sequence(first, last))).withColumn("own", F.col("block") == first)


def paths(ranges: DataFrame) -> DataFrame:
    """(id, root, depth, path): ids from the root to the node, joined by ``>``, from nested ranges alone.

    Each block is swept once in preorder; the open ranges are the ancestors.
    A block has at most BLOCK nodes of its own and the ancestors of its first.
    """
    rows = _blocks(ranges).select("block", "id", "low", "size", "depth", "root", "own")

    def sweep(table: pa.Table) -> pa.Table:
        t = table.sort_by("low")
        stack: list[tuple[int, str]] = []
        out = []
        for name, low, size, own in zip(*(t.column(c).to_pylist() for c in ("id", "low", "size", "own"))):
            while stack and stack[-1][0] <= low:
                stack.pop()
            path = f"{stack[-1][1]}>{name}" if stack else name
            if size > 1:
                stack.append((low + size, path))
            out.append(path)
        t = t.append_column("path", pa.array(out, pa.string()))
        return t.filter(t.column("own")).select(["id", "root", "depth", "path"])

    return rows.groupBy("block").applyInArrow(sweep, "id string, root string, depth bigint, path string")


def descendants(ranges: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every pair, by comparing ranges within blocks.

    The number of pairs is the sum of all depths, which is the size of the
    result asked for; nodes without descendants give none.
    """
    above = _blocks(ranges).where(F.col("size") > 1).select("block", F.col("id").alias("ancestor"), F.col("low").alias("a_low"), (F.col("low") + F.col("size")).alias("a_end"), F.col("depth").alias("a_depth"))
    below = ranges.select(F.floor(F.col("low") / BLOCK).alias("block"), F.col("id").alias("descendant"), "low", "depth")
    inside = (F.col("low") > F.col("a_low")) & (F.col("low") < F.col("a_end"))
    return below.join(above, "block").where(inside).select("ancestor", "descendant", (F.col("depth") - F.col("a_depth")).alias("distance"))


def forest(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, nested-set ranges of the processed nodes, and the cycle members of the rest."""
    links = cut(parent_links(entries))
    sized = subtree_sizes(links)
    whole = sized.where(F.col("up").isNull())
    rest = sized.where(F.col("up").isNotNull()).select("id", "parent")
    return links, preorder(whole.select("id", "parent", "depth", "root", "size")), cycles(rest)


def hierarchy(entries: DataFrame) -> DataFrame:
    """(id, link_status, root_id, tree_depth, tree_path, descendants): one row per id.

    ``tree``: the chain ends in an entry without parent; ``orphan``: it ends in
    an entry whose parent doesn't exist; ``cycle``: the entry lies on a cycle (a
    node that is its own parent too); ``into_cycle``: its chain runs into one.
    For cycles the root is the least id of the cycle, the depth -1, the path
    empty and the number of descendants null. An empty table gives no rows.
    """
    links, ranges, looped = forest(entries)
    lost = links.where(F.col("parent").isNotNull() & ~F.col("known")).select(F.col("id").alias("root"), F.lit(True).alias("lost"))
    trees = (
        paths(ranges)
        .join(ranges.select("id", "size"), "id")
        .join(lost, "root", "left")
        .select(
            "id",
            F.when(F.col("lost"), "orphan").otherwise("tree").alias("link_status"),
            F.col("root").alias("root_id"),
            F.col("depth").cast("int").alias("tree_depth"),
            F.col("path").alias("tree_path"),
            (F.col("size") - 1).alias("descendants"),
        )
    )
    loops = looped.select(
        "id",
        F.when(F.col("on_cycle"), "cycle").otherwise("into_cycle").alias("link_status"),
        F.col("cycle_id").alias("root_id"),
        F.lit(-1).alias("tree_depth"),
        F.lit("").alias("tree_path"),
        F.lit(None).cast("bigint").alias("descendants"),
    )
    return trees.unionByName(loops)
