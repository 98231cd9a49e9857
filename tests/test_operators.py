import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lorekiln.operators import claims as C
from lorekiln.operators import evaluate as E
from lorekiln.operators import frames as P
from lorekiln.operators import graph as G
from lorekiln.operators import segment
from lorekiln.sources import store


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


@pytest.mark.parametrize("text, paragraphs", [("", 0), (" \t\r\n", 0), ("X.\r\n", 1), ("line1\nline2", 1), ("A\r\n\r\nB", 2), ("A\r\rB", 2), ("A\n \t \nB", 2), ("\n\nA", 1), ("A\r\nB\n\nC\rD", 2), ("żó\n\n☃", 2)])
def test_paragraphs_and_partition(spark, text, paragraphs):
    docs = texts(spark, text, None)
    found = segment.paragraphs(segment.lines(docs))
    blocks = segment.blocks(docs, found)
    assert found.count() == paragraphs
    assert segment.partition_errors(docs, blocks).count() == 0
    assert all(r.same for r in segment.reconstructed(docs, blocks).collect())


def test_partition_errors(spark):
    docs = texts(spark, "abcdef")
    bad = spark.createDataFrame([(0, 0, 2), (0, 3, 4), (0, 3, 5)], "doc_id bigint, start_byte bigint, end_byte bigint")
    assert {r.error for r in segment.partition_errors(docs, bad).collect()} == {"Gap", "Overlap", "Coverage"}


@pytest.mark.parametrize("text, n", [("A. B! C? D… E?! F...", 6), ('He said "Stop." Then (it ended.) Fine.', 3), ("no stop", 1), ("Pi is 3.14 at example.com today.", 1), ("Mr. Lee met J. R. R. Name, e.g. here.", 1)])
def test_rule_sentences(spark, text, n):
    assert len(texts(spark, text).select(segment.rule_sentences(F.col("text"))).first()[0]) == n


def test_constraints(spark):
    df = spark.createDataFrame([("cluster", "a", "Supported"), ("cluster", "b", "Contested"), (None, None, None)], "subj_kind string, subj_val string, status string")
    assert df.where(C.condition(C.And())).count() == 3 and df.where(C.condition(C.Or())).count() == 0
    assert df.where(C.condition(C.Not(C.Subject("cluster", "a")))).count() == 2
    with pytest.raises(ValueError):
        C.compile_query(C.Query(where=C.And((C.TextContains("x"),))))
    with pytest.raises(ValueError):
        C.compile_query(C.Query(project=("nope",)))


def test_question_query():
    q = C.question_query("What", "CAPITAL_OF", subject="c1")
    assert q.project == ("object",) and q.limit == 20
    assert C.question_query("HowMany", "LOCATED_IN").intent == "Count"
    assert C.question_query("Is", "IS_A", "a", "b").intent == "Boolean"
    assert "ScanBySubject" in C.compile_query(q).steps and C.query_hash(q) == C.query_hash(q)


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(0, None)]
    parent = {x: x for e in edges for x in e if x is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    got = {r.node_id: r.component for r in G.components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: top(x) for x in parent}


def test_closure_with_cycle(spark):
    got = {tuple(r) for r in G.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, None)], "src int, dst int")).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)}


def test_compare_runs(spark):
    s = "case_id string, metric string, value double"
    a = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0), ("b", "k", 1.0), ("c", "m", 1.0)], s)
    b = spark.createDataFrame([("a", "m", 2.0), ("b", "m", 2.0), ("b", "k", 0.0), ("d", "m", 1.0)], s)
    assert {r.case_id: (r.outcome, r.mixed, r.critical) for r in E.compare_runs(a, b).collect()} == {"a": ("Improved", False, False), "b": ("Unchanged", True, False), "c": ("Missing", False, True), "d": ("Added", False, False)}


def test_question_semantics(spark):
    q = P.question_semantics(F.col("text"))
    got = [r[0] and (r[0].kind, r[0].predicate) for r in texts(spark, "What is the capital of X?", "Gdzie jest młyn?", "No question.", None).select(q).collect()]
    assert got == [("What", "CAPITAL_OF"), ("Where", "LOCATED_IN"), None, None]


def test_session_store(spark, tmp_path):
    root = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    store.save_session(df, root, "one")
    assert store.load_session(spark, root).count() == 2
    spark.createDataFrame([(3, "x")], "id int, v string").write.mode("append").parquet(f"{root}/snapshot_id=one")
    with pytest.raises(ValueError):
        store.load_session(spark, root)
    with pytest.raises(ValueError):
        store.save_session(df, root, "../up")


def test_batch_lines(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# c\nPL->EN: Ala.\nDIALOGUE:EN->PL: a ||| b\n\n")
    got = [(r.source_lang, r.dialogue, r.turn, r.text) for r in store.batch_lines(spark, str(tmp_path / "in.txt")).collect()]
    assert got == [("pl", False, 0, "Ala."), ("en", True, 0, "a"), ("en", True, 1, "b")]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from lorekiln.streaming.ingest import document_stream, ingest

    schema = "doc_id bigint, lang string, text string"
    for k in (1, 2):
        spark.createDataFrame([(1, "en", "same"), (k, "en", f"own {k}")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(document_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["own 1", "own 2", "same"]


def test_temporal_closure_of_both_relations(spark, tmp_path):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "b")]
    spark.createDataFrame([(i, p, 1, None) for i, p in rows], "id string, parent string, revision int, ingested_at timestamp").write.parquet(str(tmp_path / "ontology_entry.parquet"))
    got = {tuple(r) for r in queries()["q_temporal_closure"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"), ("b", "d"), ("a", "d"), ("c", "b"), ("c", "d")}  # b and d are After links


def test_run_compare_keeps_every_customer(spark, tmp_path):
    rows = [(5, "1-URGENT", "1997-12-31"), (5, "1-URGENT", "1998-01-01"), (5, "1-URGENT", "1999-01-01"), (10, "2-HIGH", "1993-01-01"), (1002, "2-HIGH", "2001-01-01"), (15, "2-HIGH", None)]
    spark.createDataFrame(rows, "o_custkey bigint, o_orderpriority string, d string").selectExpr("*", "cast(d AS timestamp) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.case_id: r.outcome for r in queries()["q_run_compare"](spark, str(tmp_path)).collect()}
    assert got == {5: "Improved", 10: "Missing", 1002: "Added", 15: "Missing"}


def test_lines_keep_any_character(spark):
    docs = texts(spark, "a\x00b\r\n\x01c\rd\n", "", "x\n\ny")
    got = [(r.doc_id, r.line, r.start_byte, r.end_byte, r.full_end) for r in segment.lines(docs).orderBy("doc_id", "line_no").collect()]
    assert got == [(0, "a\x00b", 0, 3, 5), (0, "\x01c", 5, 7, 8), (0, "d", 8, 9, 10), (0, "", 10, 10, 10), (1, "", 0, 0, 0), (2, "x", 0, 1, 2), (2, "", 2, 2, 3), (2, "y", 3, 4, 4)]


def test_line_and_column_in_characters(spark):
    docs = texts(spark, "żó\nłab c")
    asked = spark.createDataFrame([(0, o) for o in (0, 2, 4, 5, 7, 8, 1, 40)], "doc_id bigint, offset bigint")
    got = {r.offset: (r.line, r.char_column) for r in segment.line_of_offset(asked, segment.lines(docs)).collect()}
    assert got == {0: (1, 1), 1: (1, 2), 2: (1, 2), 4: (1, 3), 5: (2, 1), 7: (2, 2), 8: (2, 3), 40: (2, 35)}


def test_assemble_keeps_blanks(spark):
    rows = [(0, 1, " One. ", None), (0, 2, "Two?\n\n", "DWA?"), (0, 3, "\tThree", "TRZY"), (1, 1, "  ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, k int, raw string, made string")
    assert {r.doc_id: r.text for r in segment.assemble(df, "k", "made", "raw").collect()} == {0: " One. DWA?\n\n\tTRZY", 1: "  "}


def test_ordered_state_equals_windows(spark):
    """Hot group, null group, null values: ranges of the order give what one window per group gives."""
    from pyspark.sql import Window

    from lorekiln.operators import ordered

    random.seed(5)
    rows = [(random.choice(["hot", "hot", "hot", "a", "b", None]), k, random.choice([None, None, "x", "y"])) for k in random.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "g string, k bigint, v string")
    w = Window.partitionBy("g").orderBy("k")
    want = df.select("g", "k", F.lag("k").over(w).alias("p"), F.lead("k").over(w).alias("n"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("c"), F.row_number().over(w).alias("r"))
    by = {r.k: r for r in want.collect()}
    assert {(r.k, r.previous, r.next) for r in ordered.neighbours_in_order(df, ["g"], "k").collect()} == {(k, r.p, r.n) for k, r in by.items()}
    assert {(r.k, r.c) for r in ordered.carried(df, ["g"], "k", "v", "c").collect()} == {(k, r.c) for k, r in by.items()}
    assert {(r.k, r.r) for r in ordered.numbered(df, ["g"], "k", "v", "r").collect()} == {(k, r.r) for k, r in by.items()}
    assert ordered.newest(df, ["g"], "k", 3).count() == 12
    assert ordered.neighbours_in_order(df.limit(0), ["g"], "k").count() == 0
