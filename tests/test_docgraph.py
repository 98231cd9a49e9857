from pyspark.sql import functions as F

from lorekiln.operators import docgraph as D

TEXT = "Paris is the capital of France. Żółw spał…\n\nAla sends a red  map to Jan Kot! End"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_sentences_in_bytes(spark):
    got = D.document_sentences(docs(spark, TEXT, None, "", " \n ")).orderBy("sentence_no").collect()
    raw = TEXT.encode()
    assert [(raw[r.start_byte : r.end_byte].decode(), r.paragraph_no, r.paragraph_ordinal, r.sentence_no) for r in got] == [("Paris is the capital of France.", 0, 0, 0), ("Żółw spał…", 0, 1, 1), ("Ala sends a red  map to Jan Kot!", 1, 0, 2), ("End", 1, 1, 3)]
    assert raw[got[0].raw_start : got[0].raw_end].decode() == "Paris is the capital of France. "


def test_mentions_and_anchors(spark):
    *_, roles = D.build(docs(spark, TEXT))
    raw = TEXT.encode()
    got = [(r.role, raw[r.start_byte : r.end_byte].decode(), r.anchor, r.spans, r.normalized_name) for r in roles.orderBy("mention_no").collect()]
    assert got == [("Subject", "Paris", "Exact", 1, "paris"), ("Object", "France", "Exact", 1, "france"), ("Agent", "Ala", "Exact", 1, "ala"), ("Theme", "a red  map", "Discontinuous", 3, "a red map"), ("Recipient", "Jan Kot", "Discontinuous", 2, "jan kot")]


def test_graph(spark):
    d = docs(spark, TEXT, "", None)
    nodes, edges, _ = D.build(d)
    counts = {(r.doc_id, r.element, r.kind): r.n for r in D.summary(nodes, edges).collect()}
    assert {k[2]: n for k, n in counts.items() if k[:2] == (0, "node")} == {"document": 1, "block": 3, "paragraph": 2, "sentence": 4, "semantic": 2, "frame": 2, "mention": 5, "candidate": 5, "event": 2, "unresolved": 2}
    assert [k for k in counts if k[0] == 1] == [(1, "node", "document")]
    order = [r.kind for r in edges.where("doc_id = 0").orderBy("edge_no").collect()]
    assert order[:5] == ["ContainsBlock"] * 3 + ["NextBlock"] * 2 and order[-1] == "HasUnresolvedFragment"
    first = [(r.kind, r.other) for r in D.outgoing(edges).where("node_id = 'n:frame:000001'").orderBy("place").collect()]
    assert first == [("HasMention", "n:mention:000002"), ("HasMention", "n:mention:000003"), ("HasMention", "n:mention:000004"), ("RepresentsEvent", "n:event:000001")]
    assert {r.name for r in D.sentence_candidates(nodes, edges).where("sentence_no = 0").collect()} == {"paris", "france"}


def test_errors(spark):
    d = docs(spark, TEXT, "x")
    nodes, edges, _ = D.build(d)
    assert D.errors(d, nodes, edges).count() == 0
    bad_nodes = nodes.where("node_id NOT IN ('n:sentence:000001', 'n:document:000000', 'n:block:000002')").unionByName(nodes.where("doc_id = 0 AND node_id = 'n:event:000000'"))
    bad_edges = edges.where("kind <> 'HasUnresolvedFragment' OR src <> 'n:sentence:000003'")
    found = {(r.doc_id, r.error) for r in D.errors(d, bad_nodes.where("doc_id = 0"), bad_edges.where("doc_id = 0")).collect()}
    assert found == {(0, "DuplicateNode"), (0, "DanglingEdge"), (0, "MissingRoot"), (1, "MissingRoot"), (0, "UncoveredBytes"), (1, "UncoveredBytes"), (0, "MissingSentence"), (0, "NoMeaning")}
    assert D.errors(d.limit(0), nodes.limit(0), edges.limit(0)).count() == 0
