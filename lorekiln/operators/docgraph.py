"""The graph of a document as node and edge tables: blocks, paragraphs, sentences, meanings, frames, mentions, candidates, events.

Everything is numbered within its document, in document order, so ids don't
depend on partitions. Texts stay in the row of their document until they are
cut; after that only pieces travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import store

from . import frames as P
from . import segment

#: Sentences: up to repeated terminals with closers and the blanks behind them.
SENTENCE = r"[^.?!…]*[.?!…]+[\"'”’»)\]}]*[ \t\n\r\f]*|[^.?!…]+\z"
NODES = ["doc_id", "node_id", "kind", "ordinal", "sentence_no", "start_byte", "end_byte", "label"]


def node_id(kind: str, number: str | Column) -> Column:
    return F.concat(F.lit(f"n:{kind}:"), F.lpad((F.col(number) if isinstance(number, str) else number).cast("string"), 6, "0"))


def document_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, paragraph_ordinal, sentence_no, raw_start, raw_end, start_byte, end_byte, sentence), in bytes of the text.

    ``paragraph_ordinal`` is the place in the paragraph, ``sentence_no`` the one in the document. Blank pieces aren't sentences.
    """
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    spans = segment.paragraphs(segment.lines(docs)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_no", "start_byte", "end_byte"))).alias("p"))
    cut = lambda x: F.struct(x.paragraph_no.alias("paragraph_no"), x.start_byte.alias("at"), F.substring(F.encode("text", "utf-8"), x.start_byte.cast("int") + 1, (x.end_byte - x.start_byte).cast("int")).cast("string").alias("body"))
    paragraphs = spans.join(docs, "doc_id").select("doc_id", F.inline(F.transform("p", cut)))
    pieces = paragraphs.select("doc_id", "paragraph_no", "at", F.posexplode(F.regexp_extract_all("body", F.lit(SENTENCE), F.lit(0))).alias("k", "raw"))
    inside = Window.partitionBy("doc_id", "paragraph_no").orderBy("k")
    before = F.coalesce(F.sum(F.octet_length("raw")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blanks = r"^[ \t\n\r\f]+|[ \t\n\r\f]+\z"
    sized = pieces.withColumn("raw_start", F.col("at") + before).withColumn("sentence", F.regexp_replace("raw", blanks, "")).where("sentence <> ''")
    lead = F.octet_length(F.regexp_extract("raw", r"^[ \t\n\r\f]*", 0))
    start = F.col("raw_start") + lead
    rows = sized.select("doc_id", "paragraph_no", "k", "raw_start", (F.col("raw_start") + F.octet_length("raw")).alias("raw_end"), start.alias("start_byte"), (start + F.octet_length("sentence")).alias("end_byte"), "sentence")
    whole = Window.partitionBy("doc_id").orderBy("paragraph_no", "k")
    return rows.withColumn("paragraph_ordinal", F.row_number().over(inside) - 1).withColumn("sentence_no", F.row_number().over(whole) - 1).drop("k")


def sentence_frames(sentences: DataFrame) -> DataFrame:
    """The sentences with ``frame_type`` and ``roles`` (role, filler; in the order of the frame), null where none was found, and the frame's number in the document."""
    s = F.col("sentence")
    kind, roles = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,filler:string>>")
    for pattern, frame, names in reversed(P.TEMPLATES):
        fits = s.rlike(pattern)
        kind = F.when(fits, frame).otherwise(kind)
        roles = F.when(fits, F.array(*[F.struct(F.lit(n).alias("role"), F.regexp_extract(s, pattern, k).alias("filler")) for k, n in enumerate(names, 1)])).otherwise(roles)
    w = Window.partitionBy("doc_id").orderBy("sentence_no")
    out = sentences.withColumn("frame_type", kind).withColumn("roles", roles)
    has = F.col("frame_type").isNotNull()
    number = F.when(has, F.sum(has.cast("int")).over(w) - 1)
    return out.withColumn("frame_no", number).withColumn("unresolved_no", F.when(~has, F.sum((~has).cast("int")).over(w) - 1))


SPANS = """aggregate(regexp_extract_all(filler, '[^ \\\\t\\\\n\\\\r\\\\f]+|[ \\\\t\\\\n\\\\r\\\\f]+', 0), named_struct('at', begin, 'spans', cast(array() AS array<struct<start_byte:bigint,end_byte:bigint>>)),
  (acc, p) -> named_struct('at', acc.at + octet_length(p), 'spans', CASE WHEN trim(p) = '' OR p RLIKE '^[ \\\\t\\\\n\\\\r\\\\f]' THEN acc.spans ELSE array_append(acc.spans, named_struct('start_byte', acc.at, 'end_byte', acc.at + octet_length(p))) END), acc -> acc.spans)"""


def factuality() -> Column:
    """Of a sentence: a question before a negation before a plain statement."""
    negated = F.lower("sentence").rlike("(^| )(not|never|nie|nigdy|nicht|kein|keine)( |$)")
    return F.when(F.endswith("sentence", F.lit("?")), "Questioned").when(negated, "Negated").otherwise("Asserted")


def mentions(framed: DataFrame) -> DataFrame:
    """One row per role of each frame: its path, name and anchor in the text.

    The anchor is ``Exact`` for one word, ``Discontinuous`` (a span for each
    word, and their envelope) for several, else ``SentenceScoped``.
    """
    rows = framed.where("frame_no IS NOT NULL").select("doc_id", "sentence_no", "frame_no", "frame_type", "sentence", factuality().alias("factuality"), F.col("start_byte").alias("s_start"), F.col("end_byte").alias("s_end"), F.posexplode("roles").alias("role_ordinal", "r"))
    rows = rows.select("*", "r.role", "r.filler").withColumn("mention_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_no", "role_ordinal")) - 1)
    place = F.instr("sentence", F.col("filler"))
    begin = F.col("s_start") + F.octet_length(F.substring("sentence", F.lit(1), place - 1))
    rows = rows.withColumn("begin", begin.cast("bigint")).withColumn("spans", F.when((place > 0) & (F.col("filler") != ""), F.expr(SPANS)))
    n = F.coalesce(F.size("spans"), F.lit(0))
    name = F.lower(F.regexp_replace(F.trim("filler"), r"\s+", " "))
    return rows.select(
        "doc_id", "sentence_no", "frame_no", "frame_type", "factuality", "mention_no", "role", "role_ordinal", F.col("filler").alias("name"), name.alias("normalized_name"),
        F.format_string("frame[0.0]/%s[%d]", "role", "role_ordinal").alias("path"),
        F.when(n > 1, "Discontinuous").when(n == 1, "Exact").otherwise("SentenceScoped").alias("anchor"),
        F.when(n > 0, F.element_at("spans", 1).start_byte).otherwise(F.col("s_start")).alias("start_byte"),
        F.when(n > 0, F.element_at("spans", -1).end_byte).otherwise(F.col("s_end")).alias("end_byte"),
        F.when(n > 1, n).otherwise(1).alias("spans"),
    )


def build(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, mentions) of all documents.

    Nodes have the columns NODES; edges doc_id, edge_no, src, dst, kind, in the
    order of building: blocks, paragraphs, sentences (each contained, then
    linked to the next), then what each sentence means. A sentence without a
    frame has an unresolved fragment. Null texts give no graph, empty ones a
    root alone.
    """
    docs = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    blocks = store(segment.blocks(docs, segment.paragraphs(segment.lines(docs))), "graph-blocks")  # each table feeds several kinds of nodes and edges
    paragraphs = blocks.where("kind = 'Paragraph'").withColumn("paragraph_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_byte")) - 1)
    framed = store(sentence_frames(document_sentences(docs)), "graph-sentences")
    roles = store(mentions(framed), "graph-mentions")
    none = F.lit(None)

    def nodes(df: DataFrame, kind: str, number: str | Column, sentence: Column, start: str | Column, end: str | Column, label: Column) -> DataFrame:
        number = F.col(number) if isinstance(number, str) else number
        return df.select("doc_id", node_id(kind, number).alias("node_id"), F.lit(kind).alias("kind"), number.cast("int").alias("ordinal"), sentence.cast("int").alias("sentence_no"), (F.col(start) if isinstance(start, str) else start).cast("bigint").alias("start_byte"), (F.col(end) if isinstance(end, str) else end).cast("bigint").alias("end_byte"), label.cast("string").alias("label"))

    at = F.col("sentence_no")
    meant = framed.where("frame_no IS NOT NULL")
    status = F.when(F.col("frame_no").isNotNull(), "Resolved").otherwise("Unresolved")
    node_rows = [
        nodes(docs, "document", F.lit(0), none, F.lit(0), F.octet_length("text"), none),
        nodes(blocks, "block", "block_no", none, "start_byte", "end_byte", F.col("kind")),
        nodes(paragraphs, "paragraph", "paragraph_no", none, "start_byte", "end_byte", none),
        nodes(framed, "sentence", "sentence_no", at, "start_byte", "end_byte", status),
        nodes(meant, "semantic", "frame_no", at, "start_byte", "end_byte", none),
        nodes(meant, "frame", "frame_no", at, "start_byte", "end_byte", F.col("frame_type")),
        nodes(roles, "mention", "mention_no", at, "start_byte", "end_byte", F.col("role")),
        nodes(roles, "candidate", "mention_no", at, none, none, F.col("normalized_name")),
        nodes(meant, "event", "frame_no", at, none, none, F.col("frame_type")),
        nodes(framed.where("unresolved_no IS NOT NULL"), "unresolved", "unresolved_no", at, "start_byte", "end_byte", F.lit("Unresolved")),
    ]

    def edges(df: DataFrame, kind: str, src: Column, dst: Column, phase: int, first: Column, second: Column | int = 0) -> DataFrame:
        return df.select("doc_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(phase).alias("phase"), first.cast("int").alias("k1"), (F.lit(second) if isinstance(second, int) else second).cast("int").alias("k2"))

    def chained(df: DataFrame, kind: str, node: str, number: str, phase: int) -> DataFrame:
        nxt = df.withColumn("next__", F.lead(number).over(Window.partitionBy("doc_id").orderBy(number))).where("next__ IS NOT NULL")
        return edges(nxt, kind, node_id(node, number), node_id(node, "next__"), phase, F.col(number))

    root = F.lit("n:document:000000")
    edge_rows = [
        edges(blocks, "ContainsBlock", root, node_id("block", "block_no"), 1, F.col("block_no")),
        chained(blocks, "NextBlock", "block", "block_no", 2),
        edges(paragraphs, "ContainsParagraph", node_id("block", "block_no"), node_id("paragraph", "paragraph_no"), 3, F.col("paragraph_no")),
        chained(paragraphs, "NextParagraph", "paragraph", "paragraph_no", 4),
        edges(framed, "ContainsSentence", node_id("paragraph", "paragraph_no"), node_id("sentence", "sentence_no"), 5, at),
        chained(framed, "NextSentence", "sentence", "sentence_no", 6),
        edges(meant, "HasSemanticSentence", node_id("sentence", "sentence_no"), node_id("semantic", "frame_no"), 7, at, 0),
        edges(meant, "HasFrame", node_id("semantic", "frame_no"), node_id("frame", "frame_no"), 7, at, 1),
        edges(roles, "HasMention", node_id("frame", "frame_no"), node_id("mention", "mention_no"), 7, at, F.col("role_ordinal") * 2 + 2),
        edges(roles, "RefersToCandidate", node_id("mention", "mention_no"), node_id("candidate", "mention_no"), 7, at, F.col("role_ordinal") * 2 + 3),
        edges(meant, "RepresentsEvent", node_id("frame", "frame_no"), node_id("event", "frame_no"), 7, at, F.lit(1_000_000)),
        edges(framed.where("unresolved_no IS NOT NULL"), "HasUnresolvedFragment", node_id("sentence", "sentence_no"), node_id("unresolved", "unresolved_no"), 7, at, 0),
    ]
    all_nodes, all_edges = node_rows[0], edge_rows[0]
    for more in node_rows[1:]:
        all_nodes = all_nodes.unionByName(more)
    for more in edge_rows[1:]:
        all_edges = all_edges.unionByName(more)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("phase", "k1", "k2")) - 1
    return all_nodes, all_edges.withColumn("edge_no", number).select("doc_id", "edge_no", "src", "dst", "kind"), roles


def outgoing(edges: DataFrame, side: str = "src") -> DataFrame:
    """(doc_id, node_id, place, edge_no, other, kind): the edges of each node in their order; ``side`` ``dst`` gives the incoming ones."""
    other = "dst" if side == "src" else "src"
    w = Window.partitionBy("doc_id", side).orderBy("edge_no")
    return edges.select("doc_id", F.col(side).alias("node_id"), (F.row_number().over(w) - 1).alias("place"), "edge_no", F.col(other).alias("other"), "kind")


def sentence_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, candidate, name): the candidates to which a sentence's mentions refer."""
    mention = nodes.where("kind = 'mention'").select("doc_id", F.col("node_id").alias("src"), "sentence_no")
    name = nodes.where("kind = 'candidate'").select("doc_id", F.col("node_id").alias("dst"), F.col("label").alias("name"))
    refers = edges.where("kind = 'RefersToCandidate'").select("doc_id", "src", "dst")
    return refers.join(mention, ["doc_id", "src"]).join(name, ["doc_id", "dst"]).select("doc_id", "sentence_no", F.col("dst").alias("candidate"), "name").distinct()


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, element, kind, n): counts of nodes and edges by kind."""
    n = nodes.groupBy("doc_id", F.lit("node").alias("element"), "kind").agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy("doc_id", F.lit("edge").alias("element"), "kind").agg(F.count("*").alias("n")))


def errors(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, error, subject) of a graph against its documents.

    DuplicateNode, DuplicateEdge, DanglingEdge (an end that is no node),
    MissingRoot, UnknownDocument, UncoveredBytes (blocks that don't add up to
    the text), MissingSentence (gaps in the numbers), NoMeaning (a sentence with
    neither meaning nor unresolved fragment).
    """
    size = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    say = lambda df, error, subject: df.select("doc_id", F.lit(error).alias("error"), F.col(subject).cast("string").alias("subject"))
    ids = nodes.select("doc_id", "node_id").distinct()
    ends = edges.select("doc_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    covered = nodes.where("kind = 'block'").groupBy("doc_id").agg(F.sum(F.col("end_byte") - F.col("start_byte")).alias("covered"))
    numbers = nodes.where("kind = 'sentence'").groupBy("doc_id").agg((F.max("ordinal") + 1).alias("last"), F.count("*").alias("n"))
    meaning = edges.where("kind IN ('HasSemanticSentence', 'HasUnresolvedFragment')").select("doc_id", F.col("src").alias("node_id"))
    found = [
        say(nodes.groupBy("doc_id", "node_id").count().where("count > 1"), "DuplicateNode", "node_id"),
        say(edges.groupBy("doc_id", "edge_no").count().where("count > 1"), "DuplicateEdge", "edge_no"),
        say(ends.join(ids, ["doc_id", "node_id"], "left_anti"), "DanglingEdge", "node_id"),
        say(size.join(nodes.where("kind = 'document'").select("doc_id"), "doc_id", "left_anti"), "MissingRoot", "doc_id"),
        say(nodes.select("doc_id").distinct().join(size, "doc_id", "left_anti"), "UnknownDocument", "doc_id"),
        say(size.join(covered, "doc_id", "left").where("coalesce(covered, 0) <> size"), "UncoveredBytes", "size"),
        say(numbers.where("last <> n"), "MissingSentence", "last"),
        say(nodes.where("kind = 'sentence'").join(meaning, ["doc_id", "node_id"], "left_anti"), "NoMeaning", "node_id"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
