"""Linguistic and document graphs as node and edge tables; closures and components by iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import cut

from .ordered import carried, neighbours_in_order, newest


def chain(tokens: DataFrame, by: list[str], order: str, steps: int = 1) -> DataFrame:
    """Each row with the previous and next row's order within its group, ``steps`` rows away.

    One step works on groups of any size; more steps sort each group in one task.
    """
    if steps == 1:
        return neighbours_in_order(tokens, by, order)
    w = Window.partitionBy(*by).orderBy(order)
    return tokens.withColumn("previous", F.lag(order, steps).over(w)).withColumn("next", F.lead(order, steps).over(w))


def chain_errors(chained: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows whose next row doesn't point back, and groups with several heads."""
    back = chained.select(*by, F.col(order).alias("next"), F.col("previous").alias("points_to"))
    broken = chained.where(F.col("next").isNotNull()).join(back, [*by, "next"], "left").where(~F.col("points_to").eqNullSafe(F.col(order)))
    return broken.select(*by, order)


def verb_paths(tagged: DataFrame) -> DataFrame:
    """(doc_id, position, verb, preposition, phrase): a verb, a preposition and the noun phrase behind it.

    ``tagged``: doc_id, position, token, pos. The phrase is the run of nouns
    and determiners that begins behind the preposition; two shifted reads of
    one window stand for the joins.
    """
    w = Window.partitionBy("doc_id").orderBy("position")
    nominal = F.col("pos").isin("Noun", "Determiner")
    runs = tagged.withColumn("island", F.sum((~nominal).cast("int")).over(w))
    phrases = runs.where(nominal).groupBy("doc_id", "island").agg(F.min("position").alias("begin"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda x: x.token), " ").alias("phrase"))
    pairs = tagged.withColumn("pre", F.lead("token").over(w)).withColumn("pre_pos", F.lead("pos").over(w)).where((F.col("pos") == "Verb") & (F.col("pre_pos") == "Preposition"))
    return pairs.withColumn("begin", F.col("position") + 2).join(phrases, ["doc_id", "begin"]).select("doc_id", "position", F.col("token").alias("verb"), F.col("pre").alias("preposition"), "phrase")


def islands(tagged: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Phrases: maximal runs of tokens of one kind, (doc_id, kind, begin, size, phrase)."""
    kind = F.lit(None).cast("string")
    for name, tags in kinds.items():
        kind = F.when(F.col("pos").isin(tags), name).otherwise(kind)
    w = Window.partitionBy("doc_id").orderBy("position")
    marked = tagged.withColumn("kind", kind)
    change = (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")
    runs = marked.withColumn("change", change).withColumn("island", F.sum("change").over(w)).where(F.col("kind").isNotNull())
    return runs.groupBy("doc_id", "island", "kind").agg(F.min("position").alias("begin"), F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda x: x.token), " ").alias("phrase")).drop("island")


def summary(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, element, kind, n): counts of nodes and edges by kind."""
    n = nodes.groupBy(*by, F.lit("node").alias("element"), "kind").agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(*by, F.lit("edge").alias("element"), "kind").agg(F.count("*").alias("n")))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node: (src, dst, missing)."""
    ids = nodes.select("node_id").distinct()
    no_src = edges.join(ids, edges.src == ids.node_id, "left_anti").select("src", "dst", F.lit("src").alias("missing"))
    no_dst = edges.join(ids, edges.dst == ids.node_id, "left_anti").select("src", "dst", F.lit("dst").alias("missing"))
    return no_src.unionByName(no_dst)


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, outgoing, incoming): degrees of every node that has an edge."""
    both = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node each node is connected with, by alternating large and small stars.

    Each round links every node and its larger neighbours to the least one
    around it; hot nodes are only ever aggregated by minimum, which combines
    map-side. Rounds grow with the logarithm of the longest path.
    """
    pairs = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).where("node_id IS NOT NULL").distinct()
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        new = cut(small)
        if new.exceptAll(pairs).limit(1).count() == 0 and pairs.exceptAll(new).limit(1).count() == 0:
            break
        pairs = new
    root = pairs.groupBy(F.col("u").alias("node_id")).agg(F.min("v").alias("component"))
    return nodes.join(root, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def closure(pairs: DataFrame) -> DataFrame:
    """(src, dst): all pairs joined by a path, semi-naive: each round extends only the pairs found last."""
    known = cut(pairs.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    step, fresh = known, known
    while True:
        longer = fresh.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct()
        fresh = cut(longer.join(known, ["src", "dst"], "left_anti"))
        if fresh.limit(1).count() == 0:
            return known
        known = cut(known.unionByName(fresh))


def carry_forward(turns: DataFrame, by: str, order: str, value: str, to: str) -> DataFrame:
    """Adds the last value before each row of its group, nulls passed over."""
    return carried(turns, [by], order, value, to)


def earlier_links(mentions: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Each mention with the nearest earlier one of the same key in its group (not all earlier ones: the chain implies them)."""
    w = Window.partitionBy(by, key).orderBy(order)
    return mentions.withColumn("antecedent", F.lag(order).over(w)).where(F.col("antecedent").isNotNull())


def recent(mentions: DataFrame, by: str, order: str, window: int, kind: Column | None = None) -> DataFrame:
    """The last ``window`` mentions of each group, the newest first; of them those of a kind, if one is asked for."""
    rows = newest(mentions, [by], order, window)
    return rows if kind is None else rows.where(kind)


def coordination_groups(tokens: DataFrame, conjunctions: list[str]) -> DataFrame:
    """(doc_id, begin, members, agreement): words joined by conjunctions (``a and b and c``), at least two; the agreement is plural.

    ``tokens``: doc_id, position, token. A chain is an island of the positions of its conjunctions, two apart.
    """
    w = Window.partitionBy("doc_id").orderBy("position")
    near = tokens.withColumn("left", F.lag("token").over(w)).withColumn("right", F.lead("token").over(w))
    joins = near.where(F.col("token").isin(conjunctions) & F.col("left").isNotNull() & F.col("right").isNotNull() & ~F.col("left").isin(conjunctions) & ~F.col("right").isin(conjunctions))
    runs = joins.withColumn("new", F.coalesce((F.col("position") - F.lag("position").over(w) != 2).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    made = runs.groupBy("doc_id", "island").agg((F.min("position") - 1).alias("begin"), F.array_sort(F.collect_list(F.struct("position", "left", "right"))).alias("c"))
    members = F.concat(F.array(F.element_at("c", 1).left), F.transform("c", lambda x: x.right))
    return made.select("doc_id", "begin", F.array_join(members, "|").alias("members"), F.size(members).alias("size"), F.lit("Plural").alias("agreement"))


def evoked(tokens: DataFrame, lexicon: DataFrame, parents: DataFrame) -> DataFrame:
    """(src, dst, kind): word to the concept of its form (evokes), and each of those concepts to its parent (is_a)."""
    words = tokens.select("token").distinct().join(lexicon.select(F.col("form").alias("token"), "concept").distinct(), "token")
    evokes = words.select(F.col("token").alias("src"), F.col("concept").alias("dst"), F.lit("evokes").alias("kind"))
    is_a = words.select("concept").distinct().join(parents.select(F.col("id").alias("concept"), "parent"), "concept").where("parent IS NOT NULL").select(F.col("concept").alias("src"), F.col("parent").alias("dst"), F.lit("is_a").alias("kind"))
    return evokes.unionByName(is_a)


def find(tokens: DataFrame, lexicon: DataFrame, what: str) -> DataFrame:
    """Tokens whose concept, lemma or form is ``what``, case aside."""
    wanted = what.lower()
    hit = lexicon.where((F.lower("concept") == wanted) | (F.lower("lemma") == wanted) | (F.lower("form") == wanted)).select(F.col("form").alias("token")).distinct()
    return tokens.join(hit.unionByName(tokens.sparkSession.createDataFrame([(wanted,)], "token string")).distinct(), "token", "left_semi")
