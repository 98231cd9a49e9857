import pytest
from pyspark.sql import functions as F

from lorekiln.operators import claims as C
from lorekiln.operators import docgraph, evaluate, frames, generate, graph, knowledge, lexicon

TEXT = "Paris is the capital of France. Nothing here.\n\nRome is the capital of France? Ala works for Ola in Łódź."


@pytest.fixture(scope="module")
def framed(spark):
    docs = spark.createDataFrame([(1, TEXT, "T", "s", None), (2, None, None, None, None), (3, "", "x", "y", "r")], "doc_id bigint, text string, title string, source string, revision string")
    return docs, docgraph.sentence_frames(docgraph.document_sentences(docs)).cache()


def test_occurrences_claims_evidence(framed):
    docs, rows = framed
    roles = docgraph.mentions(rows)
    found = knowledge.occurrences(roles)
    got = {(r.subject, r.predicate, r.object, r.factuality, r.world): (r.evidence, len(r.spans)) for r in found.collect()}
    assert got == {("Paris", "CAPITAL_OF", "France", "Asserted", "Actual"): ([0, 1], 2), ("Rome", "CAPITAL_OF", "France", "Questioned", "Question"): ([2, 3], 2), ("Ala", "WORKS_FOR", "Ola", "Asserted", "Actual"): ([4, 5], 2)}
    claims = knowledge.document_claims(found)
    assert {(r.subject, r.status) for r in claims.collect()} == {("Paris", "Supported"), ("Rome", "NonFactual"), ("Ala", "Supported")}
    assert knowledge.knowledge_errors(found, claims).count() == 0
    assert {r.error for r in knowledge.knowledge_errors(found.where("occ_no > 0"), claims.where("subject <> 'Ala'")).collect()} == {"MissingClaim", "ClaimWithoutOccurrence"}
    detail = knowledge.evidence_detail(claims, found, docs)
    assert detail.count() == 6 and {(r.title, r.uri, r.revision) for r in detail.collect()} == {("T", "s", None)}
    s = knowledge.knowledge_summary(found, claims).first()
    assert (s.occurrences, s.with_evidence, s.questioned, s.claims, s.contested) == (3, 3, 1, 3, 0)
    assert knowledge.occurrences(roles.limit(0)).count() == 0


def test_translation(framed):
    docs, rows = framed
    sentences = generate.translated_sentences(rows, "pl")
    text = {r.doc_id: (r.text, r.generated, r.copied) for r in generate.translated_documents(docs, sentences).collect()}
    assert text == {1: ("France ma stolicę: Paris. Nothing here.\n\nFrance ma stolicę: Rome? Ala pracuje dla: Ola, miejsce: Łódź.", 3, 1), 3: ("", 0, 0)}
    assert generate.translation_errors(rows, sentences).count() == 0
    with pytest.raises(ValueError):
        generate.translated_sentences(rows, "pl", "Guess")


def test_isolation_and_diagnostics(framed):
    _, rows = framed

    def compiler(text):
        if "Nothing" in text:
            raise KeyError("no")
        return text[:3] if "Ala" in text else None

    got = {r.sentence_no: (r.status, r.payload, r.error) for r in frames.compile_sentences(rows, compiler).collect()}
    assert got == {0: ("Unresolved", None, None), 1: ("Failed", None, "KeyError: 'no'"), 2: ("Unresolved", None, None), 3: ("Resolved", "Ala", None)}
    assert [(r.sentence_no, r.code) for r in frames.diagnostics(rows).orderBy("sentence_no", "place").collect()] == [(1, "UnresolvedSentence"), (2, "QuestionFrame")]
    i = frames.inspection(rows).first()
    assert (i.sentences, i.frames, i.questions, i.roles, i.fillers) == (4, 3, 1, 7, 6)


def test_detect_capabilities_liquids(spark):
    df = spark.createDataFrame([(1, "pl", 0, 3, 2), (1, "en", 1, 0, 2), (2, "pl", 0, 1, 1), (2, "en", 0, 1, 1)], "text_id int, lang string, questions int, frames int, sentences int")
    assert {(r.text_id, r.lang) for r in frames.detect_by_parse(df).collect()} == {(1, "en"), (2, "en")}
    one = spark.range(1).select(frames.missing_capabilities(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), frames.liquid_rule(F.lit("EAT"), F.lit(True)), frames.liquid_rule(F.lit("EAT"), F.lit(False))).first()
    assert tuple(one) == (["a"], "DRINK", "EAT")


def test_graph_helpers(spark):
    words = "ala and ola and ela met jan and ewa".split()
    tokens = spark.createDataFrame([(1, k, w) for k, w in enumerate(words)], "doc_id int, position int, token string")
    assert {(r.begin, r.members) for r in graph.coordination_groups(tokens, ["and"]).collect()} == {(0, "ala|ola|ela"), (6, "jan|ewa")}
    chained = spark.createDataFrame([("a", 1, None, 2), ("a", 2, 1, 3), ("a", 3, 9, None)], "g string, k int, previous int, next int")
    assert [(r.g, r.k) for r in graph.chain_errors(chained, ["g"], "k").collect()] == [("a", 2)]


def test_metrics_and_words(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 0, 0), (3, None, 4)], "id int, n int, d int")
    rows = evaluate.metric_rows(df, "id", {("g", "m"): (F.col("n"), F.col("d"))})
    assert {r.case_id: (r.value, r.status) for r in rows.collect()} == {1: (0.5, "Exact"), 2: (1.0, "Empty"), 3: (None, "Unavailable")}
    assert [r.severity for r in evaluate.top_failures(rows).collect()] == ["major"]
    rules = spark.createDataFrame([("owości", None, "loc"), ("s", None, "pl")], "suffix string, restore string, feature string")
    got = lexicon.analyse(spark.createDataFrame([("nowości",), ("s",), ("mills",), (None,)], "surface string"), rules)
    assert {(r.surface, r.stem) for r in got.collect()} == {("nowości", "n"), ("mills", "mill")}


def test_labels_and_groups(spark):
    rows = spark.createDataFrame([("c1", "cluster:7", "text:x", "Asserted", "Supported", 2, 500), ("c2", "cluster:9", "cluster:7", "Negated", "Contradicted", 1, 400)], "claim string, subject string, object string, factuality string, status string, evidence_count int, confidence int")
    labels = spark.createDataFrame([("7", "Seven"), ("7", "Z"), ("8", None)], "cluster_id string, canonical_name string")
    got = {r.claim: (r.subject_label, r.object_label, r.shown) for r in C.with_labels(rows, labels).withColumn("shown", C.preferred_value("subject_label", "object_label")).collect()}
    assert got == {"c1": ("Seven", "x", "Seven"), "c2": ("9", "Seven", "9")}
    assert {(r.quality, r.group_rank) for r in C.quality_groups(rows, []).collect()} == {("Supported", 1), ("Negated", 3)}
