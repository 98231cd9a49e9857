"""Queries of segmentation, tokens, graphs, resolution, time, evaluation and storage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators import claims as C
from lorekiln.operators import evaluate as E
from lorekiln.operators import frames as P
from lorekiln.operators import graph as G
from lorekiln.operators import docgraph, generate, hierarchy, lexicon, resolve, segment
from lorekiln.operators import knowledge as K
from lorekiln.operators import temporal as T
from lorekiln.session import store as store_table
from lorekiln.sources import store
from lorekiln.sources.tables import current_rows, table

# A small tagged lexicon: word, part of speech, lemma, concept.
LEXICON = [
    *((w, "Verb", w.rstrip("s"), "ACT") for w in "asks sends keeps finds waits works lies counts opens moved repairs borrows".split()),
    *((w, "Preposition", w, "REL") for w in "for to in at behind from of with".split()),
    *((w, "Determiner", w, "DET") for w in "the a an this".split()),
    *((w, "Noun", w, "THING") for w in "crew station company choir council key clock map page office chapel mill library warehouse ledger anchor".split()),
]
FORMS = [(w, lemma, pos, concept) for w, pos, lemma, concept in LEXICON] + [("railway station", "station", "Noun", "PLACE"), ("town council", "council", "Noun", "GROUP"), ("ferry company", "company", "Noun", "GROUP"), ("third time this", "time", "Noun", "TIME")]


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMS, "form string, lemma string, pos string, concept string")


LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in FORMS) + ") AS t(form, lemma, pos, concept))"
WORDS = r"list_filter(list_transform(regexp_split_to_array({0}, '[ \t\n\v\f\r]+'), lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda x: x <> '')"
TOKENS = f"tokens AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS position FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL))"
SIMPLE = r"list_filter(list_transform(regexp_extract_all({0}, '[^.?!]*[.?!]|[^.?!]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(table(spark, sf, "debug_turn_context"), "turn_id", ["ingested_at"], ["session_id", "turn_no", "input_text", "question_kind", "predicate", "parse_status", "answer_status", "sentence_count", "run_id"])


TURNS = "turns AS (SELECT * FROM debug_turn_context WHERE turn_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at DESC NULLS LAST) = 1)"


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of the current mentions. Four sentences stand for a paragraph, names and pronouns are persons; the id is that of the entity whose name the surface is."""
    kept = ["doc_id", "source_sentence_ordinal", "mention_kind", "source_form", "exact_surface", "normalized_surface", "concept", "role_context", "is_proper_name", "is_pronoun"]
    rows = current_rows(table(spark, sf, "mention_resolution_profile"), "mention_id", ["ingested_at"], kept).where("doc_id IS NOT NULL AND source_sentence_ordinal IS NOT NULL")
    ids = table(spark, sf, "entity_ref").groupBy(F.col("canonical_name").alias("exact_surface")).agg(F.min("entity_id").alias("entity_id"))
    at, surface = F.col("source_sentence_ordinal"), F.col("normalized_surface")
    return rows.join(ids, "exact_surface", "left").select(
        "doc_id", "mention_id", at.alias("sentence"), F.floor(at / 4).cast("int").alias("paragraph"), (at % 4).alias("place"), F.when(F.coalesce("is_proper_name", F.lit(False)) | F.coalesce("is_pronoun", F.lit(False)), "PERSON").otherwise(F.col("concept")).alias("concept"), surface.alias("surface"),
        resolve.source_form(F.col("mention_kind"), surface, F.col("source_form")).alias("form"), F.coalesce(F.col("role_context").isin(resolve.SUBJECT_ROLES), F.lit(False)).alias("subject_like"), "entity_id",
        resolve.pronoun_gender(surface).alias("gender"), resolve.pronoun_number(surface).alias("number"),
    )


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve(_mentions(spark, sf), ["gender", "number"])


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).where("text IS NOT NULL").select("doc_id", F.posexplode(segment.simple_sentences(F.col("text"))).alias("ordinal", "sentence"))


SENTENCES = f"sentences AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS ordinal FROM (SELECT doc_id, {SIMPLE.format('text')} AS s FROM documents WHERE text IS NOT NULL))"


def q_line_index(spark, sf):
    return segment.lines(_documents(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.col("blank").cast("int")).alias("blank_lines"), F.max("end_byte").alias("last_byte"))


def q_paragraph_regions(spark, sf):
    return segment.paragraphs(segment.lines(_documents(spark, sf))).select("doc_id", "paragraph_no", "first_line", "lines", "start_byte", "end_byte")


def q_block_partition(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text")
    blocks = segment.blocks(docs, segment.paragraphs(segment.lines(docs)))
    errors = segment.partition_errors(docs, blocks).groupBy("doc_id").agg(F.sum("places").alias("places"))
    return blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes")).join(errors, "doc_id", "left").select("doc_id", "kind", "blocks", "bytes", F.coalesce("places", F.lit(0)).alias("errors"))


def q_reconstruction_check(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "text")
    return segment.reconstructed(docs, segment.blocks(docs, segment.paragraphs(segment.lines(docs))))


def q_sentence_rules(spark, sf):
    return _documents(spark, sf).where("text IS NOT NULL").select("doc_id", F.size(segment.rule_sentences(F.col("text"))).cast("bigint").alias("sentences"), F.array_join(segment.rule_sentences(F.col("text")), "|").alias("joined"))


def q_sentence_simple_split(spark, sf):
    return _sentences(spark, sf)


def q_text_counts(spark, sf):
    t = F.col("text")
    return _documents(spark, sf).where("text IS NOT NULL").select("doc_id", segment.paragraph_count(t).cast("bigint").alias("paragraphs"), segment.sentence_count(t).cast("bigint").alias("sentences"))


def q_offset_lines(spark, sf):
    asked = table(spark, sf, "sentence_range").select("doc_id", F.col("content_span.start_byte").alias("offset")).where("doc_id IS NOT NULL AND offset IS NOT NULL").distinct()
    return segment.line_of_offset(asked, segment.lines(_documents(spark, sf)))


def q_span_relations(spark, sf):
    r = table(spark, sf, "sentence_range")
    c = [F.col(x) for x in ("raw_span.start_byte", "raw_span.end_byte", "content_span.start_byte", "content_span.end_byte")]
    return r.where(c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull() & c[3].isNotNull()).groupBy("bundle_id", segment.span_relation(*c).alias("relation")).agg(F.count("*").alias("ranges"))


def q_assembled_documents(spark, sf):
    """Every document put together again with its questions in capitals: blanks between sentences stay."""
    raw = _documents(spark, sf).where("text IS NOT NULL").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.?!]*[.?!]|[^.?!]+\z"), F.lit(0))).alias("ordinal", "raw"))
    return segment.assemble(raw.withColumn("made", F.when(F.endswith("raw", F.lit("?")), F.upper(F.regexp_replace("raw", r"^\s+|\s+\z", "")))), "ordinal", "made", "raw")


def q_token_stats(spark, sf):
    return lexicon.token_rows(_documents(spark, sf)).groupBy("token").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("documents"))


def q_token_overlap(spark, sf):
    return _documents(spark, sf).where("title IS NOT NULL AND text IS NOT NULL").select("doc_id", F.round(E.overlap(lexicon.words(F.col("title")), lexicon.words(F.col("text"))), 6).alias("overlap"))


def q_multiset_recall(spark, sf):
    docs = _documents(spark, sf).where("title IS NOT NULL AND text IS NOT NULL")
    side = lambda c: docs.select("doc_id", F.explode(lexicon.words(F.col(c))).alias("token"))
    return E.multiset_recall(side("title"), side("text"), ["doc_id"], "token")


def q_alignment_ratio(spark, sf):
    """Sentences of the rule splitter against those of the simple one, place by place."""
    docs = _documents(spark, sf).where("text IS NOT NULL")
    side = lambda c: docs.select("doc_id", F.posexplode(c).alias("ordinal", "v"))
    return E.alignment(side(segment.rule_sentences(F.col("text"))), side(segment.simple_sentences(F.col("text"))), ["doc_id"], "ordinal", "v")


def q_context_window(spark, sf):
    return lexicon.context_windows(_documents(spark, sf), "ferry", 3)


def q_multiword_lookup(spark, sf):
    """Uses of the forms; the lexicon is the fixed one above, so it is broadcast."""
    return lexicon.multiword_hits(_documents(spark, sf), F.broadcast(_lexicon(spark).select("form", "lemma"))).groupBy("form", "lemma").agg(F.count("*").alias("uses"))


def q_lexicon_lookup(spark, sf):
    tokens = lexicon.token_rows(_documents(spark, sf)).select("token").distinct()
    return lexicon.look_up(tokens, _lexicon(spark)).groupBy("pos", "concept").agg(F.count("*").alias("tokens"))


def q_scalar_words(spark, sf):
    t = lexicon.token_rows(_documents(spark, sf)).select("token").distinct()
    return t.select("token", lexicon.cardinal(F.col("token")).alias("cardinal"), lexicon.relative_days(F.col("token")).alias("days"), lexicon.unknown_bucket(F.col("token"), ["A", "B", "C"]).alias("bucket")).where("cardinal IS NOT NULL OR days IS NOT NULL OR bucket = 'A'")


def q_clause_groups(spark, sf):
    return lexicon.clause_groups(lexicon.token_rows(_documents(spark, sf)), ["and", "i", "und", "a"]).groupBy("doc_id").agg((F.max("clause") + 1).alias("clauses"))


def q_discourse_cues(spark, sf):
    return T.cues(_sentences(spark, sf), strip_marks=True)


def q_sentence_pair_temporal(spark, sf):
    return T.sentence_order(_sentences(spark, sf))


def q_next_prev_chain(spark, sf):
    return G.chain(_turns(spark, sf).where("session_id IS NOT NULL").select("session_id", "turn_id"), ["session_id"], "turn_id")


def _tagged(spark, sf):
    tags = _lexicon(spark).select(F.col("form").alias("token"), "pos")
    return lexicon.token_rows(_documents(spark, sf)).join(F.broadcast(tags), "token", "left")  # the inline lexicon above


def q_verb_prep_paths(spark, sf):
    return G.verb_paths(_tagged(spark, sf).withColumn("pos", F.coalesce("pos", F.lit("Other"))))


def q_phrase_islands(spark, sf):
    return G.islands(_tagged(spark, sf), {"NP": ["Noun", "Determiner"], "PP": ["Preposition"], "VP": ["Verb"]}).groupBy("kind", "size").agg(F.count("*").alias("phrases"))


def _graph(spark, sf):
    n = table(spark, sf, "nation").selectExpr("concat('nation:', n_nationkey) AS node_id", "'Nation' AS kind").unionByName(table(spark, sf, "region").selectExpr("concat('region:', r_regionkey) AS node_id", "'Region' AS kind")).unionByName(table(spark, sf, "customer").selectExpr("concat('customer:', c_custkey) AS node_id", "'Customer' AS kind"))
    e = table(spark, sf, "nation").selectExpr("concat('nation:', n_nationkey) AS src", "concat('region:', n_regionkey) AS dst", "'PartOf' AS kind").unionByName(table(spark, sf, "customer").selectExpr("concat('customer:', c_custkey) AS src", "concat('nation:', c_nationkey) AS dst", "'LocatedIn' AS kind"))
    return n, e


GRAPH = """nodes AS (SELECT concat('nation:', n_nationkey) AS node_id, 'Nation' AS kind FROM nation UNION ALL SELECT concat('region:', r_regionkey), 'Region' FROM region UNION ALL SELECT concat('customer:', c_custkey), 'Customer' FROM customer),
  edges AS (SELECT concat('nation:', n_nationkey) AS src, concat('region:', n_regionkey) AS dst, 'PartOf' AS kind FROM nation UNION ALL SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), 'LocatedIn' FROM customer)"""


def q_graph_summary(spark, sf):
    n, e = _graph(spark, sf)
    return G.summary(n, e, [])


def q_graph_neighbors(spark, sf):
    return G.neighbours(_graph(spark, sf)[1])


def q_dangling_edges(spark, sf):
    """Ontology links to parents that don't exist."""
    links = hierarchy.parent_links(table(spark, sf, "ontology_entry"))
    return G.dangling(links.where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst")), links.select(F.col("id").alias("node_id")))


def q_doc_graph_nodes(spark, sf):
    return docgraph.build(_documents(spark, sf))[0]


def q_doc_graph_edges(spark, sf):
    return docgraph.build(_documents(spark, sf))[1]


def q_doc_graph_mentions(spark, sf):
    return docgraph.build(_documents(spark, sf))[2]


def q_doc_graph_summary(spark, sf):
    nodes, edges, _ = docgraph.build(_documents(spark, sf))
    return docgraph.summary(nodes, edges)


def q_doc_graph_outgoing(spark, sf):
    """The edges out of and into every node, in their order."""
    edges = docgraph.build(_documents(spark, sf))[1]
    side = lambda s: docgraph.outgoing(edges, s).withColumn("side", F.lit(s))
    return side("src").unionByName(side("dst"))


def q_doc_graph_candidates(spark, sf):
    nodes, edges, _ = docgraph.build(_documents(spark, sf))
    return docgraph.sentence_candidates(nodes, edges)


def q_doc_graph_errors(spark, sf):
    """A graph of the texts without their last paragraph's sentences, held against the whole texts: what is gone must be found."""
    nodes, edges, _ = docgraph.build(_documents(spark, sf))
    lost = nodes.where("kind = 'sentence'").groupBy("doc_id").agg(F.max("ordinal").alias("sentence_no"))
    cut = nodes.where("kind IN ('sentence', 'unresolved')").join(lost, ["doc_id", "sentence_no"], "left_semi").unionByName(nodes.where("kind = 'block' AND ordinal = 0").select("doc_id", "sentence_no", *[c for c in nodes.columns if c not in ("doc_id", "sentence_no")]))
    kept = nodes.join(cut.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
    return docgraph.errors(_documents(spark, sf), kept, edges)


def _knowledge(spark, sf):
    found = store_table(K.occurrences(docgraph.build(_documents(spark, sf))[2]), "occurrences")
    return found, K.document_claims(found)


def q_doc_occurrences(spark, sf):
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x.start_byte.cast("string"), F.lit("-"), x.end_byte.cast("string"))), ",")
    return _knowledge(spark, sf)[0].withColumn("evidence", F.array_join("evidence", ",")).withColumn("spans", spans)


def q_doc_claims(spark, sf):
    return _knowledge(spark, sf)[1].select("doc_id", "sentence_no", "subject", "pred_kind", "predicate", "object", "factuality", "world", "status", "occurrences", "confidence_milli")


def q_doc_knowledge_summary(spark, sf):
    return K.knowledge_summary(*_knowledge(spark, sf))


def q_doc_knowledge_errors(spark, sf):
    """Claims of all but the last sentence with one against all occurrences: those of the last are missing."""
    found, claims = _knowledge(spark, sf)
    last = found.groupBy("doc_id").agg(F.max("sentence_no").alias("last"))
    return K.knowledge_errors(found, claims.join(last, "doc_id").where("sentence_no < last").drop("last"))


def q_claim_evidence_detail(spark, sf):
    found, claims = _knowledge(spark, sf)
    return K.evidence_detail(claims, found, _documents(spark, sf)).select("status", "doc_id", "occ_no", "start_byte", "end_byte", "title", "uri", "revision")


def q_source_sentence_fallback(spark, sf):
    """The first sentence of each text that holds both words."""
    return C.fallback_sentences(_sentences(spark, sf), ["ferry", "town"])


def _framed(spark, sf):
    return store_table(docgraph.sentence_frames(docgraph.document_sentences(_documents(spark, sf))), "framed-sentences")


def q_translated_sentences(spark, sf):
    return generate.translated_sentences(_framed(spark, sf), "pl").select("doc_id", "sentence_no", "target", "status")


def q_translated_documents(spark, sf):
    return generate.translated_documents(_documents(spark, sf), generate.translated_sentences(_framed(spark, sf), "en", "Placeholder"))


def q_translation_errors(spark, sf):
    """Checks of a translation whose generated sentences have lost their last letter, its first sentences left out."""
    framed = _framed(spark, sf)
    broken = generate.translated_sentences(framed, "pl").withColumn("target", F.expr("left(target, length(target) - 1)")).where("sentence_no > 0")
    return generate.translation_errors(framed, broken)


def q_doc_diagnostics(spark, sf):
    return P.diagnostics(_framed(spark, sf))


def q_doc_inspection(spark, sf):
    return P.inspection(_framed(spark, sf))


def _number_compiler(text: str) -> str | None:
    """A compiler that knows only whole numbers and fails on decimals."""
    found = [w.strip(".,;:!?()") for w in text.split()]
    found = [w for w in found if w[:1].isascii() and w[:1].isdigit()]
    return "+".join(str(int(w)) for w in found) if found else None


def q_compile_isolation(spark, sf):
    """Sentences through a compiler that fails on many: each failure is a row of its own."""
    done = P.compile_sentences(_framed(spark, sf), _number_compiler)
    return done.groupBy("status").agg(F.count("*").alias("sentences"), F.count("payload").alias("payloads"), F.count("error").alias("errors"))


def q_event_profiles(spark, sf):
    return P.event_profiles(docgraph.build(_documents(spark, sf))[2])


def _metrics(spark, sf):
    t, title = F.col("text"), F.col("title")
    docs = _documents(spark, sf).where("text IS NOT NULL")
    a, b = F.size(segment.rule_sentences(t)), F.size(segment.simple_sentences(t))
    words = lexicon.words(t)
    return E.metric_rows(docs, "doc_id", {
        ("segmentation", "sentence_ratio"): (F.least(a, b), F.greatest(a, b)), ("lexical", "title_overlap"): (F.size(F.array_intersect(F.array_distinct(lexicon.words(title)), words)), F.size(F.array_distinct(lexicon.words(title)))),
        ("lexical", "distinct_words"): (F.size(F.array_distinct(words)), F.size(words)), ("source", "length_kept"): (F.least(F.col("n_chars"), F.length(t)), F.greatest(F.col("n_chars"), F.length(t))),
    })


def q_metric_rows(spark, sf):
    return _metrics(spark, sf)


def q_metric_summary(spark, sf):
    return E.metric_summary(_metrics(spark, sf))


def q_top_failures(spark, sf):
    return E.top_failures(_metrics(spark, sf)).select("case_id", "metric_group", "metric", "value", "severity")


def q_eval_answers(spark, sf):
    """Test items by whether the expected answer is one of the entities' names, its symmetric length ratio to the text, and a role signature."""
    names = table(spark, sf, "entity_ref").select(F.lower("canonical_name").alias("k")).distinct()
    items = table(spark, sf, "eval_item").withColumn("k", F.lower("expected_answer")).join(names.withColumn("known", F.lit(True)), "k", "left")
    return items.select(
        "item_id", E.exact_match(F.col("expected_answer"), F.array(F.coalesce(F.when(F.col("known"), F.concat(F.lit(" "), F.upper("k"), F.lit("."))), F.lit("?")))).alias("matches"),
        F.round(E.symmetric_ratio(F.length("text"), F.coalesce(F.length("expected_answer"), F.lit(0))), 6).alias("ratio"),
        E.role_signature(F.coalesce("expected_predicate", F.lit("none")), F.array(F.struct(F.lit("Object").alias("role"), F.coalesce("expected_answer", F.lit("?")).alias("filler")), F.struct(F.lit("Lang").alias("role"), F.col("lang").alias("filler")))).alias("signature"),
    )


def q_coordination_groups(spark, sf):
    return G.coordination_groups(lexicon.token_rows(_documents(spark, sf)), ["and", "oraz", "und"])


def q_concept_by_label(spark, sf):
    """The texts' words and the labels of the ontology as they stand, each in lower case, against the labels."""
    entries = current_rows(table(spark, sf, "ontology_entry"), "id", ["revision", "ingested_at"], ["label"])
    words = lexicon.token_rows(_documents(spark, sf)).select(F.col("token").alias("word")).unionByName(table(spark, sf, "ontology_entry").where("label IS NOT NULL").select(F.lower("label").alias("word"))).distinct()
    return E.concept_by_label(words, entries)


def q_year_numbers(spark, sf):
    return E.year_numbers(lexicon.token_rows(_documents(spark, sf)))


CONCEPTS = [("ACT", "EVENT"), ("REL", "TOP"), ("DET", "TOP"), ("THING", "ENTITY"), ("PLACE", "ENTITY"), ("GROUP", "ENTITY"), ("TIME", "ENTITY"), ("ENTITY", "TOP"), ("EVENT", "TOP")]


def q_concept_edges(spark, sf):
    """Words of the lexicon to their concepts, and those to their parents."""
    return G.evoked(lexicon.token_rows(_documents(spark, sf)), _lexicon(spark), spark.createDataFrame(CONCEPTS, "id string, parent string"))


def q_find_tokens(spark, sf):
    return G.find(lexicon.token_rows(_documents(spark, sf)), _lexicon(spark), "Act").groupBy("token").agg(F.count("*").alias("uses"))


def q_ontology_closure(spark, sf):
    return G.closure(_graph(spark, sf)[1])


def _links(spark, sf):
    return hierarchy.parent_links(table(spark, sf, "ontology_entry")).where("known").select(F.col("id").alias("src"), F.col("parent").alias("dst"))


ONTOLOGY = r"""links AS (SELECT id, parent FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC NULLS LAST, ingested_at DESC NULLS LAST, parent DESC NULLS LAST) AS k
    FROM (SELECT nullif(regexp_replace(id, '^\s+|\s+$', '', 'g'), '') AS id, nullif(regexp_replace(parent, '^\s+|\s+$', '', 'g'), '') AS parent, revision, ingested_at FROM ontology_entry) WHERE id IS NOT NULL) WHERE k = 1),
  steps AS (SELECT a.id AS src, a.parent AS dst FROM links a JOIN links b ON a.parent = b.id),
  closed AS (SELECT src, dst FROM steps UNION SELECT c.src, s.dst FROM closed c JOIN steps s ON c.dst = s.src)"""


def _relations(spark, sf):
    return _links(spark, sf).withColumn("relation", F.when(F.ascii("src") % 2 == 0, "After").otherwise("Before"))


def q_temporal_closure(spark, sf):
    """All links with both relations: what is marked After is turned round."""
    return T.before_closure(_relations(spark, sf))


def q_temporal_conflicts(spark, sf):
    return T.order_conflicts(G.closure(_links(spark, sf)))


def q_feature_inheritance(spark, sf):
    entries = table(spark, sf, "ontology_entry")
    own = current_rows(entries.select(hierarchy.clean_id(F.col("id")).alias("id"), "revision", "ingested_at", F.col("features.animacy").alias("animacy")), "id", ["revision", "ingested_at"], ["animacy"])
    pairs = hierarchy.descendants(hierarchy.forest(entries)[1])
    return lexicon.inherited(pairs, own, "animacy")


def q_role_violations(spark, sf):
    e = current_rows(table(spark, sf, "ontology_entry").withColumn("animacy", F.col("features.animacy")).withColumn("roles", F.array_join(F.array_sort("allowed_roles"), ",")), "id", ["revision", "ingested_at"], ["animacy", "roles"])
    bad = F.array_intersect(F.split("roles", ","), F.array(*map(F.lit, ["Agent", "Experiencer", "Recipient"])))
    return e.where("animacy = 'Inanimate'").select("id", F.array_join(F.array_sort(bad), ",").alias("violations")).where("violations <> ''")


def q_temporal_normalize(spark, sf):
    """Order dates written as times with and without a zone, dates, durations, frequencies, deictic and other words."""
    day, clock = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    n = F.dayofmonth("o_orderdate").cast("string")
    forms = [F.concat(clock, F.lit("+02:30")), day, F.concat(clock, F.lit("Z")), F.concat(F.lit("for "), n, F.lit(" days")), F.concat(F.lit("Every "), n, F.lit(" days")), F.lit("Yesterday"), F.concat(F.lit("the flood of "), n), F.concat(clock, F.lit("-11:00")), F.date_format("o_orderdate", "yyyy-MM")]
    orders = table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*forms), (F.dayofyear("o_orderdate") % len(forms) + 1).cast("int")).alias("text"))
    p, kind = T.iso_parts(F.col("text")), T.expression_kind(F.col("text"))
    days = F.coalesce(lexicon.relative_days(F.lower("text")), F.lit(0))
    return orders.select("o_orderkey", p.year.alias("year"), p.month.alias("month"), p.day.alias("day"), p.hour.alias("hour"), p.offset_minutes.alias("offset_minutes"), kind.alias("kind"), T.time_relation(kind, days).alias("relation"))


def q_event_groups(spark, sf):
    return T.event_groups(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"])


def q_pair_score(spark, sf):
    return resolve.alternatives(_resolved(spark, sf))


def q_resolution_decision(spark, sf):
    return _resolved(spark, sf).select("doc_id", "mention_id", "form", "decision", "target_id", "score", "cluster_no", F.size("alternatives").alias("alternatives"), resolve.confidence().alias("confidence_milli"))


def q_resolution_clusters(spark, sf):
    return resolve.clusters(_resolved(spark, sf))


def q_resolution_summary(spark, sf):
    return resolve.resolution_summary(_resolved(spark, sf))


def q_resolution_errors(spark, sf):
    """Errors of the resolution against all delivered mentions, current or not: those without a place have no decision."""
    delivered = table(spark, sf, "mention_resolution_profile").where("mention_id IS NOT NULL").select("doc_id", "mention_id")
    return resolve.resolution_errors(delivered, _resolved(spark, sf))


def q_named_clusters(spark, sf):
    """Every entity of the reference list with the clusters that bear its name."""
    names = table(spark, sf, "entity_ref").select("entity_id", F.lower("canonical_name").alias("name"))
    found = resolve.clusters(_resolved(spark, sf)).join(names, F.col("canonical_name") == F.col("name"))
    return found.groupBy("entity_id").agg(F.count("*").alias("clusters"), F.sum("mentions").alias("mentions"))


def q_coref_components(spark, sf):
    """Mentions joined by accepted links: what the clusters must be."""
    d = _resolved(spark, sf).where("target_id IS NOT NULL").selectExpr("mention_id AS src", "target_id AS dst")
    return G.components(d)


def q_topic_carry_forward(spark, sf):
    return _turns(spark, sf).where("session_id IS NOT NULL").transform(lambda t: G.carry_forward(t, "session_id", "turn_id", "predicate", "topic")).select("turn_id", "topic")


def q_cross_turn_coref(spark, sf):
    return G.earlier_links(_turns(spark, sf).where("session_id IS NOT NULL AND predicate IS NOT NULL").select("session_id", "turn_id", "predicate"), "session_id", "turn_id", "predicate")


def q_recent_entities(spark, sf):
    return G.recent(_turns(spark, sf).where("session_id IS NOT NULL AND predicate IS NOT NULL").select("session_id", "turn_id", "predicate"), "session_id", "turn_id", 3)


def q_run_compare(spark, sf):
    """Every customer a case, every order in one of two runs: before 1998 (or undated) and since."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("metric"), F.coalesce(F.year("o_orderdate") >= 1998, F.lit(False)).alias("late"))
    run = lambda late: rows.where(F.col("late") == late).groupBy("case_id", "metric").agg(F.count("*").cast("double").alias("value"))
    return E.compare_runs(run(False), run(True))


TERMS = [(1, "ferry", False, 5), (2, "lighthouse", False, 100000000), (3, "clock", True, 0), (4, "zzzz", True, 0), (5, "śnieg", False, 1)]


def q_glossary_compliance(spark, sf):
    return E.glossary(_documents(spark, sf), spark.createDataFrame(TERMS, "term_id int, form string, forbidden boolean, minimum int"))


def q_invariants(spark, sf):
    return E.invariants(_documents(spark, sf)).groupBy("invariant", "holds").agg(F.count("*").alias("documents"))


def q_corpus_validation(spark, sf):
    return E.corpus_errors(table(spark, sf, "eval_item"), 40)


def q_status_summary(spark, sf):
    rows = _turns(spark, sf).select(F.coalesce("question_kind", F.lit("none")).alias("kind"), P.compile_status(F.col("input_text").isNull(), F.when(F.col("predicate").isNull(), 0).otherwise(1), F.when(F.col("parse_status") == "parsed", 0).otherwise(1)).alias("status"))
    return P.coverage(rows, ["kind"])


def q_budget_guard(spark, sf):
    return store.over_budget(_documents(spark, sf), segment.sentence_count(F.col("text")), {"source_bytes": 5000, "sentences": 60})


def q_lineage_hash(spark, sf):
    return _documents(spark, sf).where("text IS NOT NULL").select("doc_id", store.document_id(F.col("lang"), F.col("text")).alias("document_id"), F.sha2("text", 256).eqNullSafe(F.col("content_sha256")).alias("verified"))


def q_trace_sequence(spark, sf):
    rows = current_rows(table(spark, sf, "trace_event"), "event_id", ["ingested_at"], ["run_id", "recorded_at", "stage"])
    return store.numbered_trace(rows).select("event_id", "run_id", "sequence", "stage")


def q_learner_merge(spark, sf):
    e = table(spark, sf, "lineitem").selectExpr("concat('w', cast(l_partkey % 500 AS string)) AS word", "l_linenumber AS source_order", "concat('s', cast(l_linenumber AS string)) AS source", "CASE WHEN l_partkey % 3 > 0 THEN concat('C', cast(l_suppkey % 7 AS string)) END AS concept", "CASE WHEN l_orderkey % 4 = 0 THEN l_returnflag END AS gloss", "l_discount AS score")
    return E.merge_proposals(e)


def q_new_words(spark, sf):
    return E.new_words(_documents(spark, sf), _lexicon(spark))


def q_frame_templates(spark, sf):
    return P.template_frames(_sentences(spark, sf)).groupBy("frame_type").agg(F.count("*").alias("frames"), F.count_distinct("doc_id").alias("documents"))


def q_question_semantics(spark, sf):
    q = P.question_semantics(F.col("input_text"))
    return _turns(spark, sf).select("turn_id", q.kind.alias("kind"), q.predicate.alias("predicate")).where("kind IS NOT NULL")


MORPH_RULES = [("add", "AddSuffix", "s", None), ("cut", "Truncate", "2", None), ("head", "Prefix", "the-", None), ("swap", "ReplaceSuffix", "y", "ies"), ("soft", "ConsonantAlternate", "k", "c"), ("twice", "DoubleFinalConsonant", "ed", None)]


def q_morph_rules(spark, sf):
    """Every distinct word of the part names under each operation, and under none; rule 7 would add a second suffix but comes too late."""
    stems = table(spark, sf, "part").select(F.explode(lexicon.words(F.col("p_name"))).alias("stem")).distinct()
    every = stems.select("stem", F.explode(F.array(*[F.lit(k) for k, *_ in MORPH_RULES], F.lit("none"))).alias("form"))
    rules = [(n, {"form": k}, op, a, b) for n, (k, op, a, b) in enumerate(MORPH_RULES, 1)] + [(7, {"form": "add"}, "AddSuffix", "x", None)]
    rules = spark.createDataFrame(rules, "rule_ord int, conditions map<string,string>, operation string, a string, b string")
    return lexicon.apply_rules(every.select("stem", F.create_map(F.lit("form"), "form").alias("features")), rules).select("stem", F.element_at("features", "form").alias("form"), "surface")


def q_suffix_analysis(spark, sf):
    """Stems and features of all distinct tokens by suffix rules of one to six letters."""
    rules = spark.createDataFrame(SUFFIXES, "suffix string, restore string, feature string")
    return lexicon.analyse(lexicon.token_rows(_documents(spark, sf)).select(F.col("token").alias("surface")).distinct(), rules)


SUFFIXES = [("s", None, "plural"), ("ed", None, "past"), ("ies", "y", "plural"), ("ing", None, "progressive"), ("ation", "e", "noun"), ("owości", None, "locative"), ("ów", None, "genitive")]


QUERIES = [v for k, v in list(globals().items()) if k.startswith("q_")]

def _in(column: str, words: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


def _points(name: str, test: str) -> str:
    return f"CASE WHEN {test} THEN {resolve.POINTS[name]} ELSE 0 END"


IS_PRONOUN = "{0}.form IN ('Pronoun', 'ReflexivePronoun', 'PossessivePronoun')"
#: The sequential decisions as a recursion over the mentions of all documents at once, the accepted ones in a list.
RESOLVED = f"""RECURSIVE m AS (
    SELECT doc_id, mention_id, source_sentence_ordinal AS sentence, source_sentence_ordinal // 4 AS paragraph, source_sentence_ordinal % 4 AS place, CASE WHEN coalesce(is_proper_name, false) OR coalesce(is_pronoun, false) THEN 'PERSON' ELSE coalesce(concept, chr(0)) END AS concept, normalized_surface AS surface, entity_id,
      coalesce({_in('role_context', resolve.SUBJECT_ROLES)}, false) AS subj, CASE {' '.join(f"WHEN {_in('w', v)} THEN '{k}'" for k, v in resolve.GENDERS.items())} END AS gender,
      CASE WHEN {_in('w', resolve.PLURALS)} THEN 'Plural' WHEN {_in('w', sum(resolve.GENDERS.values(), []))} THEN 'Singular' END AS number,
      CASE WHEN mention_kind = 'Modifier' THEN 'Modifier' WHEN mention_kind = 'CoordinationGroup' THEN 'Group' WHEN source_form = 'Generic' THEN 'Generic' WHEN {_in('w', resolve.REFLEXIVES)} THEN 'ReflexivePronoun' WHEN {_in('w', resolve.PRONOUNS)} THEN 'Pronoun'
        WHEN {_in('w', resolve.POSSESSIVES)} THEN 'PossessivePronoun' WHEN {_in('w', resolve.DEMONSTRATIVES)} THEN 'DemonstrativeDescription' WHEN source_form <> '' THEN source_form WHEN w <> '' AND NOT contains(w, ' ') THEN 'ProperName' ELSE 'Unknown' END AS form
    FROM (SELECT *, lower(trim(normalized_surface)) AS w FROM mention_resolution_profile WHERE mention_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at DESC NULLS LAST) = 1) p
    LEFT JOIN (SELECT canonical_name, min(entity_id) AS entity_id FROM entity_ref GROUP BY 1) e ON e.canonical_name = p.exact_surface WHERE doc_id IS NOT NULL AND source_sentence_ordinal IS NOT NULL
  ), docs AS (SELECT doc_id, list(m ORDER BY sentence, mention_id) AS ms FROM m GROUP BY doc_id),
  walk AS (
    SELECT doc_id, 0 AS k, ms, ms[1:0] AS accepted, NULL::BIGINT AS mention_id, NULL::VARCHAR AS decision, NULL::BIGINT AS target_id, 0 AS score, ms[1:0] AS scored_ms, [0][1:0] AS scores FROM docs
    UNION ALL
    SELECT doc_id, k + 1, ms, CASE WHEN decision IN ('Seeded', 'Accepted', 'HardAccepted') THEN list_append(accepted, c) ELSE accepted END, c.mention_id, decision, CASE WHEN decision LIKE '%Accepted' THEN best.mention_id END, CASE WHEN decision = 'Excluded' THEN 0 ELSE coalesce(scores[1], 0) END, ranked, scores FROM (
      SELECT *, CASE WHEN {_in('c.form', resolve.EXCLUDED)} THEN 'Excluded' WHEN len(scores) = 0 THEN 'Seeded' WHEN scores[1] >= 700 AND (len(scores) = 1 OR scores[1] - scores[2] >= 140) THEN CASE WHEN c.entity_id = best.entity_id THEN 'HardAccepted' ELSE 'Accepted' END
        WHEN scores[1] >= 700 THEN 'Ambiguous' WHEN scores[1] >= 560 THEN 'Deferred' ELSE 'Unresolved' END AS decision FROM (
        SELECT *, list_transform(pairs, lambda p: p.t) AS ranked, list_transform(pairs, lambda p: -p.s) AS scores, pairs[1].t AS best FROM (
          SELECT doc_id, k, ms, accepted, c, list_sort(list_transform(list_filter(accepted, lambda t: abs(c.sentence - t.sentence) <= 6 AND abs(c.place - t.place) <= 1 AND c.concept = t.concept AND (c.paragraph = t.paragraph OR NOT ({IS_PRONOUN.format('c')} OR {IS_PRONOUN.format('t')}))
              AND coalesce(c.gender = t.gender, true) AND coalesce(c.number = t.number, true)),
            lambda t: {{'s': -({_points('entity', 'c.entity_id = t.entity_id')} + {_points('surface', 'c.surface = t.surface')} + 380 - 35 * abs(c.sentence - t.sentence) + {_points('paragraph', 'c.paragraph = t.paragraph')} + {_points('subjects', 'c.subj AND t.subj')}
              + {_points('pronoun', IS_PRONOUN.format('c') + ' OR ' + IS_PRONOUN.format('t'))} + {_points('reflexive', "'ReflexivePronoun' IN (c.form, t.form)")} + {_points('proper', "'ProperName' IN (c.form, t.form)")}), 'id': t.mention_id::VARCHAR, 't': t}})) AS pairs
          FROM (SELECT *, ms[k + 1] AS c FROM walk WHERE k < len(ms)))))
  ), decided AS (SELECT w.doc_id, w.mention_id, m.form, w.decision, w.target_id, w.score, w.scored_ms, w.scores, m.sentence, m.concept, m.surface FROM walk w JOIN m USING (mention_id) WHERE k > 0),
  heads AS (SELECT doc_id, mention_id, mention_id AS head FROM decided WHERE decision = 'Seeded' UNION ALL SELECT d.doc_id, d.mention_id, h.head FROM heads h JOIN decided d ON d.target_id = h.mention_id),
  numbered AS (SELECT doc_id, mention_id AS head, (row_number() OVER (PARTITION BY doc_id ORDER BY sentence, mention_id) - 1)::INT AS cluster_no FROM decided WHERE decision = 'Seeded'),
  full_ AS (SELECT d.*, h.head, n.cluster_no FROM decided d LEFT JOIN heads h ON h.mention_id = d.mention_id LEFT JOIN numbered n ON n.head = h.head),
  groups AS (SELECT doc_id, cluster_no, head AS representative, count(*) AS mentions, arg_min(surface, (sentence, mention_id)) FILTER (surface IS NOT NULL) AS canonical_name, nullif(any_value(concept), chr(0)) AS concept FROM full_ WHERE cluster_no IS NOT NULL GROUP BY doc_id, cluster_no, head)"""
LINES = r"""lines AS (SELECT doc_id, k - 1 AS line_no, line, coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte, strlen(line) AS n, regexp_matches(line, '^[\s\pZ\v]*$') AS blank
    FROM (SELECT doc_id, k, replace(raw, chr(1), '') AS line, strlen(raw) AS size FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS k
      FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(1) || chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL))))"""
PARAGRAPHS = """runs AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines),
  paras AS (SELECT doc_id, min(line_no)::INT AS first_line, count(*) AS lines, min(start_byte) AS start_byte, max(start_byte + n) AS end_byte FROM runs WHERE NOT blank GROUP BY doc_id, island)"""
BLANK = r"[ \t\n\r\f]"
FRAME_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for p, k, _ in P.TEMPLATES) + " END"
ROLES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN [{', '.join(f"{{'role': '{n}', 'filler': regexp_extract(s, '{p}', {k})}}" for k, n in enumerate(names, 1))}]" for p, _, names in P.TEMPLATES) + " END"
FACTUALITY_SQL = "CASE WHEN suffix(s, '?') THEN 'Questioned' WHEN regexp_matches(lower(s), '(^| )(not|never|nie|nigdy|nicht|kein|keine)( |$)') THEN 'Negated' ELSE 'Asserted' END"
DOCGRAPH = f"""WITH {LINES}, {PARAGRAPHS}, gaps AS (SELECT doc_id, coalesce(lag(end_byte) OVER (PARTITION BY doc_id ORDER BY start_byte), 0) AS a, start_byte AS b FROM paras
      UNION ALL SELECT d.doc_id, coalesce(p.e, 0), strlen(text) FROM documents d LEFT JOIN (SELECT doc_id, max(end_byte) AS e FROM paras GROUP BY doc_id) p USING (doc_id) WHERE text <> ''),
  blocks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS block_no FROM (SELECT doc_id, start_byte AS a, end_byte AS b, 'Paragraph' AS kind FROM paras UNION ALL SELECT doc_id, a, b, 'PreservedWhitespace' FROM gaps WHERE a < b)),
  pars AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS paragraph_no FROM blocks WHERE kind = 'Paragraph'),
  pieces AS (SELECT doc_id, paragraph_no, a, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM (SELECT p.*, regexp_extract_all(decode(array_slice(encode(text), a + 1, b)), '{docgraph.SENTENCE.replace(chr(92) + 'z', '$').replace("'", "''")}') AS l FROM pars p JOIN documents USING (doc_id))),
  sized AS (SELECT *, a + coalesce(sum(strlen(raw)) OVER (PARTITION BY doc_id, paragraph_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw_start, regexp_replace(raw, '^{BLANK}+|{BLANK}+$', '', 'g') AS s FROM pieces),
  sents AS (SELECT doc_id, paragraph_no, s, (raw_start + strlen(regexp_extract(raw, '^{BLANK}*')))::BIGINT AS a, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_no, k) - 1 AS no, {FRAME_SQL} AS frame_type, {ROLES_SQL} AS roles FROM sized WHERE s <> ''),
  framed AS MATERIALIZED (SELECT *, a + strlen(s) AS b, CASE WHEN frame_type IS NOT NULL THEN sum((frame_type IS NOT NULL)::INT) OVER w - 1 END AS frame_no, CASE WHEN frame_type IS NULL THEN sum((frame_type IS NULL)::INT) OVER w - 1 END AS unresolved_no FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
  roles AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, role_ordinal) - 1 AS mention_no, len(words) AS n FROM (
    SELECT doc_id, no, frame_no, frame_type, {FACTUALITY_SQL} AS factuality, s, a, b, r.role, r.filler, role_ordinal, regexp_extract_all(r.filler, '[^ \t\n\r\f]+') AS words, a + strlen(left(s, instr(s, r.filler) - 1)) AS begin_ FROM (SELECT *, unnest(roles) AS r, generate_subscripts(roles, 1) - 1 AS role_ordinal FROM framed WHERE frame_no IS NOT NULL))),
  nodes AS (SELECT doc_id, 'n:' || kind || ':' || lpad(ordinal::VARCHAR, 6, '0') AS node_id, kind, ordinal::INT AS ordinal, sentence_no::INT AS sentence_no, a::BIGINT AS start_byte, b::BIGINT AS end_byte, label FROM (
    SELECT doc_id, 'document' AS kind, 0 AS ordinal, NULL AS sentence_no, 0 AS a, strlen(text) AS b, NULL AS label FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 'block', block_no, NULL, a, b, kind FROM blocks UNION ALL SELECT doc_id, 'paragraph', paragraph_no, NULL, a, b, NULL FROM pars
    UNION ALL SELECT doc_id, 'sentence', no, no, a, b, CASE WHEN frame_no IS NULL THEN 'Unresolved' ELSE 'Resolved' END FROM framed
    UNION ALL SELECT doc_id, kind, frame_no, no, CASE WHEN kind <> 'event' THEN a END, CASE WHEN kind <> 'event' THEN b END, CASE WHEN kind <> 'semantic' THEN frame_type END FROM framed, (SELECT unnest(['semantic', 'frame', 'event']) AS kind) WHERE frame_no IS NOT NULL
    UNION ALL SELECT doc_id, 'mention', mention_no, no, begin_, begin_ + strlen(regexp_replace(filler, '{BLANK}+$', '')), role FROM roles
    UNION ALL SELECT doc_id, 'candidate', mention_no, no, NULL, NULL, lower(regexp_replace(trim(filler), '[ \t\n\r\f\v]+', ' ', 'g')) FROM roles
    UNION ALL SELECT doc_id, 'unresolved', unresolved_no, no, a, b, 'Unresolved' FROM framed WHERE unresolved_no IS NOT NULL)),
  links AS (
    SELECT doc_id, 'ContainsBlock' AS kind, 'document' AS f, 0 AS x, 'block' AS t, block_no AS y, 1 AS p, block_no AS k1, 0 AS k2 FROM blocks
    UNION ALL SELECT doc_id, 'NextBlock', 'block', block_no - 1, 'block', block_no, 2, block_no, 0 FROM blocks WHERE block_no > 0
    UNION ALL SELECT doc_id, 'ContainsParagraph', 'block', block_no, 'paragraph', paragraph_no, 3, paragraph_no, 0 FROM pars
    UNION ALL SELECT doc_id, 'NextParagraph', 'paragraph', paragraph_no - 1, 'paragraph', paragraph_no, 4, paragraph_no, 0 FROM pars WHERE paragraph_no > 0
    UNION ALL SELECT doc_id, 'ContainsSentence', 'paragraph', paragraph_no, 'sentence', no, 5, no, 0 FROM framed
    UNION ALL SELECT doc_id, 'NextSentence', 'sentence', no - 1, 'sentence', no, 6, no, 0 FROM framed WHERE no > 0
    UNION ALL SELECT doc_id, 'HasSemanticSentence', 'sentence', no, 'semantic', frame_no, 7, no, 0 FROM framed WHERE frame_no IS NOT NULL
    UNION ALL SELECT doc_id, 'HasFrame', 'semantic', frame_no, 'frame', frame_no, 7, no, 1 FROM framed WHERE frame_no IS NOT NULL
    UNION ALL SELECT doc_id, 'HasMention', 'frame', frame_no, 'mention', mention_no, 7, no, role_ordinal * 2 + 2 FROM roles
    UNION ALL SELECT doc_id, 'RefersToCandidate', 'mention', mention_no, 'candidate', mention_no, 7, no, role_ordinal * 2 + 3 FROM roles
    UNION ALL SELECT doc_id, 'RepresentsEvent', 'frame', frame_no, 'event', frame_no, 7, no, 1000000 FROM framed WHERE frame_no IS NOT NULL
    UNION ALL SELECT doc_id, 'HasUnresolvedFragment', 'sentence', no, 'unresolved', unresolved_no, 7, no, 0 FROM framed WHERE unresolved_no IS NOT NULL),
  edges AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p, k1, k2) - 1)::INT AS edge_no, 'n:' || f || ':' || lpad(x::VARCHAR, 6, '0') AS src, 'n:' || t || ':' || lpad(y::VARCHAR, 6, '0') AS dst, kind FROM links)"""
OCCURRENCES = f"""{DOCGRAPH}, rules AS (SELECT * FROM (VALUES {', '.join(str(r) for r in K.FRAME_RULES)}) AS r(frame_type, s_role, pred_kind, predicate, o_role)),
  spanned AS (SELECT *, lower(regexp_replace(trim(filler), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS name, begin_ + strlen(regexp_replace(filler, '{BLANK}+$', '')) AS end_ FROM roles),
  triples AS (SELECT doc_id, frame_no, any_value(no) AS no, any_value(factuality) AS factuality, pred_kind, predicate, max(CASE WHEN role = s_role THEN filler END) AS subject, max(CASE WHEN role = o_role THEN filler END) AS object, max(CASE WHEN role = s_role THEN name END) AS s_name, max(CASE WHEN role = o_role THEN name END) AS o_name
    FROM spanned JOIN rules USING (frame_type) GROUP BY doc_id, frame_no, pred_kind, predicate),
  cited AS (SELECT t.doc_id, t.frame_no, string_agg(DISTINCT mention_no, ',' ORDER BY mention_no) AS evidence, list_sort(list(DISTINCT {{'a': begin_, 'b': end_}})) AS spans FROM triples t JOIN spanned m ON m.doc_id = t.doc_id AND m.no = t.no AND m.name IN (t.s_name, t.o_name) GROUP BY ALL),
  occ AS (SELECT t.*, (row_number() OVER (PARTITION BY doc_id ORDER BY frame_no) - 1)::INT AS occ_no, CASE WHEN factuality = 'Questioned' THEN 'Question' ELSE 'Actual' END AS world, evidence, spans FROM triples t LEFT JOIN cited USING (doc_id, frame_no) WHERE subject IS NOT NULL),
  told AS (SELECT doc_id, no, subject, pred_kind, predicate, object, arg_min(factuality, occ_no) AS factuality, arg_min(world, occ_no) AS world, min(occ_no) AS occ_no, count(*) AS occurrences FROM occ GROUP BY doc_id, no, subject, pred_kind, predicate, object),
  bad AS (SELECT subject, pred_kind, predicate, world FROM told GROUP BY ALL HAVING count(*) >= 2 AND (bool_or(factuality = 'Negated') OR predicate IN ('CAPITAL_OF', 'POPULATION', 'DATE_OF') AND count(DISTINCT object) > 1)),
  claims_ AS (SELECT t.*, CASE WHEN b.subject IS NOT NULL THEN 'Contested' WHEN factuality = 'Asserted' THEN 'Supported' WHEN factuality = 'Negated' THEN 'Contradicted' ELSE 'NonFactual' END AS status FROM told t LEFT JOIN bad b ON b.subject = t.subject AND b.pred_kind = t.pred_kind AND b.predicate = t.predicate AND b.world = t.world)"""
def _realised_sql(language: str) -> str:
    out = []
    for frame, pattern in generate.PATTERNS[language].items():
        parts = [x for t, k in generate._parts(pattern) for x in ([f"'{t}'"] if t else []) + ([f"nullif(roles[{k}].filler, '')"] if k else [])]
        out.append(f"WHEN '{frame}' THEN {' || '.join(parts)}")
    return f"CASE frame_type {' '.join(out)} END"


OPENED = "(^|[\\s(\\[{\"“„])"


def _rules_sql() -> str:
    out = "text"
    for w in ("e.g", "i.e"):
        out = f"regexp_replace({out}, '(?i){OPENED}{w.replace('.', chr(92) + '.')}\\.', '\\1{w.replace('.', chr(1))}{chr(1)}', 'g')"
    out = f"regexp_replace({out}, '(?i){OPENED}(mr|mrs|ms|dr|prof|etc)\\.(\\s|$)', '\\1\\2{chr(1)}\\3', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}])\\.([\\p{{L}}\\p{{N}}])', '\\1{chr(1)}\\2', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{OPENED}(\\p{{L}})\\.(\\s*\\p{{L}}[\\p{{L}}.{chr(1)}])', '\\1\\2{chr(1)}\\3', 'g')"
    closers = "\"''”’»)\\]}"
    out = f"regexp_replace({out}, '([.!?…]+[{closers}]*)[\\s]*', '\\1{chr(2)}', 'g')"
    return f"list_filter(list_transform(string_split({out}, '{chr(2)}'), lambda x: regexp_replace(replace(x, '{chr(1)}', '.'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


METRICS = f"""WITH w AS (SELECT doc_id, n_chars, length(text) AS n, {WORDS.format('text')} AS t, list_distinct({WORDS.format('title')}) AS h, len({_rules_sql()}) AS a, len({SIMPLE.format('text')}) AS b FROM documents WHERE text IS NOT NULL),
  parts AS (SELECT doc_id AS case_id, unnest([{{'g': 'segmentation', 'm': 'sentence_ratio', 'x': least(a, b)::DOUBLE, 'y': greatest(a, b)::DOUBLE}}, {{'g': 'lexical', 'm': 'title_overlap', 'x': len(list_intersect(h, t))::DOUBLE, 'y': len(h)::DOUBLE}},
    {{'g': 'lexical', 'm': 'distinct_words', 'x': len(list_distinct(t))::DOUBLE, 'y': len(t)::DOUBLE}}, {{'g': 'source', 'm': 'length_kept', 'x': CASE WHEN n_chars IS NOT NULL THEN least(n_chars, n) ELSE n END::DOUBLE, 'y': coalesce(greatest(n_chars, n), n)::DOUBLE}}]) AS p FROM w),
  rows_ AS (SELECT case_id, p.g AS metric_group, p.m AS metric, p.x AS numerator, p.y AS denominator, CASE WHEN p.x IS NULL OR p.y IS NULL THEN NULL WHEN p.y = 0 THEN 1.0 ELSE round(p.x / p.y, 6) END AS value, CASE WHEN p.x IS NULL OR p.y IS NULL THEN 'Unavailable' WHEN p.y = 0 THEN 'Empty' ELSE 'Exact' END AS status FROM parts)"""
CARDINAL_SQL = "CASE token " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicon.CARDINALS.items()) + " ELSE CASE WHEN regexp_matches(token, '^[0-9]+$') THEN try_cast(token AS INT) END END"
DAYS_SQL = "CASE token " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicon.DEICTIC.items()) + " END"
CUE_SQL = "CASE cue " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CUES.items()) + " END"
SQL = {
    "q_line_index": f"WITH {LINES} SELECT doc_id, count(*) AS lines, sum(blank::INT)::BIGINT AS blank_lines, max(start_byte + n) AS last_byte FROM lines GROUP BY doc_id",
    "q_paragraph_regions": f"WITH {LINES}, {PARAGRAPHS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1)::INT AS paragraph_no, first_line, lines, start_byte, end_byte FROM paras",
    "q_block_partition": f"""WITH {LINES}, {PARAGRAPHS}, gaps AS (SELECT doc_id, coalesce(lag(end_byte) OVER (PARTITION BY doc_id ORDER BY start_byte), 0) AS a, start_byte AS b FROM paras
        UNION ALL SELECT d.doc_id, coalesce(p.e, 0), strlen(text) FROM documents d LEFT JOIN (SELECT doc_id, max(end_byte) AS e FROM paras GROUP BY doc_id) p USING (doc_id) WHERE text <> '')
      SELECT doc_id, 'Paragraph' AS kind, count(*) AS blocks, sum(end_byte - start_byte)::BIGINT AS bytes, 0 AS errors FROM paras GROUP BY doc_id
      UNION ALL SELECT doc_id, 'PreservedWhitespace', count(*), sum(b - a)::BIGINT, 0 FROM gaps WHERE a < b GROUP BY doc_id""",
    "q_reconstruction_check": f"""WITH {LINES}, {PARAGRAPHS}, gaps AS (SELECT doc_id, coalesce(lag(end_byte) OVER (PARTITION BY doc_id ORDER BY start_byte), 0) AS a, start_byte AS b FROM paras
        UNION ALL SELECT d.doc_id, coalesce(p.e, 0), strlen(text) FROM documents d LEFT JOIN (SELECT doc_id, max(end_byte) AS e FROM paras GROUP BY doc_id) p USING (doc_id) WHERE text <> '')
      SELECT doc_id, count(*) AS blocks, true AS same FROM (SELECT doc_id FROM paras UNION ALL SELECT doc_id FROM gaps WHERE a < b) GROUP BY doc_id""",
    "q_sentence_rules": f"SELECT doc_id, len({_rules_sql()}) AS sentences, array_to_string({_rules_sql()}, '|') AS joined FROM documents WHERE text IS NOT NULL",
    "q_sentence_simple_split": f"WITH {SENTENCES} SELECT doc_id, ordinal::INT AS ordinal, sentence FROM sentences",
    "q_text_counts": r"SELECT doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ') <> '')) AS paragraphs, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x, ' ') <> '')) AS sentences FROM documents WHERE text IS NOT NULL",
    "q_offset_lines": f"""WITH {LINES}, asked AS (SELECT DISTINCT doc_id, content_span.start_byte AS offset_ FROM sentence_range WHERE doc_id IS NOT NULL AND content_span.start_byte IS NOT NULL)
      SELECT doc_id, "offset", line_no AS line, len(list_filter(range(1, length(text) + 1), lambda i: strlen(left(text, i - 1)) < size)) + greatest(size - strlen(text), 0) + 1 AS char_column
      FROM (SELECT a.doc_id, a.offset_ AS "offset", (l.line_no + 1)::INT AS line_no, l.line AS text, a.offset_ - l.start_byte AS size FROM asked a ASOF LEFT JOIN lines l ON a.doc_id = l.doc_id AND a.offset_ >= l.start_byte)""",
    "q_span_relations": """SELECT bundle_id, CASE WHEN a = c AND b = d THEN 'equal' WHEN a <= c AND d <= b THEN 'contains' WHEN c <= a AND b <= d THEN 'inside' WHEN a < d AND c < b THEN 'overlaps' ELSE 'apart' END AS relation, count(*) AS ranges
      FROM (SELECT bundle_id, raw_span.start_byte AS a, raw_span.end_byte AS b, content_span.start_byte AS c, content_span.end_byte AS d FROM sentence_range) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL GROUP BY ALL""",
    "q_assembled_documents": r"""WITH r AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^.?!]*[.?!]|[^.?!]+$') AS p FROM documents WHERE text IS NOT NULL))
      SELECT doc_id, string_agg(CASE WHEN suffix(raw, '?') THEN regexp_extract(raw, '^[ \t\n\r\f\v]*') || upper(regexp_replace(raw, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) ELSE raw END, '' ORDER BY k) AS text FROM r GROUP BY doc_id""",
    "q_token_stats": f"WITH {TOKENS} SELECT token, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM tokens GROUP BY token",
    "q_token_overlap": f"SELECT doc_id, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS overlap FROM (SELECT doc_id, list_distinct({WORDS.format('title')}) AS a, {WORDS.format('text')} AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL)",
    "q_multiset_recall": f"""WITH d AS (SELECT doc_id, {WORDS.format('title')} AS a, {WORDS.format('text')} AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL),
      want AS (SELECT doc_id, t, count(*) AS w FROM (SELECT doc_id, unnest(a) AS t FROM d) GROUP BY ALL), have AS (SELECT doc_id, t, count(*) AS h FROM (SELECT doc_id, unnest(b) AS t FROM d) GROUP BY ALL)
      SELECT doc_id, sum(least(w, coalesce(h, 0)))::BIGINT AS matched, sum(w)::BIGINT AS expected, round(sum(least(w, coalesce(h, 0))) / sum(w), 6) AS recall FROM want LEFT JOIN have USING (doc_id, t) GROUP BY doc_id""",
    "q_alignment_ratio": f"""WITH s AS (SELECT doc_id, {_rules_sql()} AS a, {SIMPLE.format('text')} AS b FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, len(a) AS left_n, len(b) AS right_n, n AS same, round(n / greatest(len(a), len(b)), 6) AS ratio, CASE WHEN len(a) = len(b) THEN 'Exact' ELSE 'Approximate' END AS status
      FROM (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS n FROM s) WHERE len(a) > 0 OR len(b) > 0""",
    "q_context_window": f"WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, (k - 1)::INT AS position, array_to_string(w[greatest(k - 3, 1):k + 3], ' ') AS context FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d) WHERE w[k] = 'ferry'",
    "q_multiword_lookup": f"""WITH {LEX}, d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS form FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), (VALUES (1), (2), (3)) AS s(n) WHERE k + n - 1 <= len(w)),
      hit AS (SELECT doc_id, k, n, form, lemma FROM g JOIN lex USING (form) QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY n DESC) = 1) SELECT form, lemma, count(*) AS uses FROM hit GROUP BY ALL""",
    "q_lexicon_lookup": f"""WITH {LEX}, {TOKENS}, t AS (SELECT DISTINCT token FROM tokens) SELECT coalesce(a.pos, b.pos, c.pos, 'Unknown') AS pos, coalesce(a.concept, b.concept, c.concept, 'PERSON') AS concept, count(*) AS tokens
      FROM t LEFT JOIN lex a ON a.form = token LEFT JOIN lex b ON b.form = regexp_extract(token, '^(.+)s$', 1) LEFT JOIN lex c ON c.form = regexp_extract(token, '^(.+)ed$', 1) GROUP BY ALL""",
    "q_scalar_words": f"""WITH {TOKENS}, t AS (SELECT DISTINCT token FROM tokens), v AS (SELECT token, {CARDINAL_SQL} AS cardinal, {DAYS_SQL} AS days, substr('ABC', ((2 * length(token) - length(regexp_replace(token, '[aeiouyąęó]', '', 'g'))) % 3 + 1)::INT, 1) AS bucket FROM t)
      SELECT * FROM v WHERE cardinal IS NOT NULL OR days IS NOT NULL OR bucket = 'A'""",
    "q_clause_groups": f"WITH {TOKENS} SELECT doc_id, sum((token IN ('and', 'i', 'und', 'a'))::INT)::BIGINT + 1 AS clauses FROM tokens GROUP BY doc_id",
    "q_discourse_cues": f"""WITH {SENTENCES}, f AS (SELECT doc_id, ordinal, regexp_replace(lower(regexp_extract(trim(sentence), '^[^\\s]+')), '[!-/:-@\\[-`{{-~]+$', '') AS cue, lag(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) AS previous FROM sentences)
      SELECT doc_id, ordinal::INT AS ordinal, cue, {CUE_SQL} AS relation, previous::INT AS previous FROM f WHERE {CUE_SQL} IS NOT NULL""",
    "q_sentence_pair_temporal": f"""WITH {SENTENCES}, f AS (SELECT doc_id, ordinal, lag(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) AS previous, regexp_split_to_array(lower(trim(sentence)), '[ \\t\\n\\v\\f\\r]+') AS w FROM sentences)
      SELECT doc_id, ordinal::INT AS ordinal, previous::INT AS previous, CASE WHEN list_has_any(w, ['before', 'przed', 'zanim']) THEN 'Before' ELSE 'After' END AS relation FROM f WHERE previous IS NOT NULL AND list_has_any(w, ['before', 'przed', 'zanim', 'after', 'po'])""",
    "q_next_prev_chain": f"WITH {TURNS} SELECT session_id, turn_id, lag(turn_id) OVER w AS previous, lead(turn_id) OVER w AS next FROM turns WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY turn_id)",
    "q_verb_prep_paths": f"""WITH {LEX}, {TOKENS}, tagged AS (SELECT t.*, coalesce(pos, 'Other') AS pos FROM tokens t LEFT JOIN lex ON form = token), r AS (SELECT *, sum((pos NOT IN ('Noun', 'Determiner'))::INT) OVER w AS island, lead(token) OVER w AS pre, lead(pos) OVER w AS pre_pos FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
      p AS (SELECT doc_id, min(position) AS b, string_agg(token, ' ' ORDER BY position) AS phrase FROM r WHERE pos IN ('Noun', 'Determiner') GROUP BY doc_id, island)
      SELECT r.doc_id, position::INT AS position, token AS verb, pre AS preposition, phrase FROM r JOIN p ON p.doc_id = r.doc_id AND p.b = r.position + 2 WHERE pos = 'Verb' AND pre_pos = 'Preposition'""",
    "q_phrase_islands": f"""WITH {LEX}, {TOKENS}, tagged AS (SELECT t.*, CASE WHEN pos IN ('Noun', 'Determiner') THEN 'NP' WHEN pos = 'Preposition' THEN 'PP' WHEN pos = 'Verb' THEN 'VP' END AS kind FROM tokens t LEFT JOIN lex ON form = token),
      c AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER w)::INT AS change FROM tagged WINDOW w AS (PARTITION BY doc_id ORDER BY position)), i AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY position) AS island FROM c)
      SELECT kind, size, count(*) AS phrases FROM (SELECT doc_id, island, kind, count(*) AS size FROM i WHERE kind IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "q_graph_summary": f"WITH {GRAPH} SELECT 'node' AS element, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind",
    "q_graph_neighbors": f"WITH {GRAPH} SELECT node_id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT src AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node_id",
    "q_dangling_edges": f"WITH RECURSIVE {ONTOLOGY} SELECT id AS src, parent AS dst, 'dst' AS missing FROM links WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM links)",
    "q_doc_graph_nodes": f"{DOCGRAPH} SELECT * FROM nodes",
    "q_doc_graph_edges": f"{DOCGRAPH} SELECT * FROM edges",
    "q_doc_graph_mentions": f"""{DOCGRAPH} SELECT doc_id, no::INT AS sentence_no, frame_no, frame_type, factuality, mention_no::INT AS mention_no, role, role_ordinal::INT AS role_ordinal, filler AS name, lower(regexp_replace(trim(filler), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS normalized_name, 'frame[0.0]/' || role || '[' || role_ordinal || ']' AS path,
      CASE WHEN n > 1 THEN 'Discontinuous' ELSE 'Exact' END AS anchor, begin_ AS start_byte, begin_ + strlen(regexp_replace(filler, '{BLANK}+$', '')) AS end_byte, greatest(n, 1)::INT AS spans FROM roles""",
    "q_doc_graph_summary": f"{DOCGRAPH} SELECT doc_id, 'node' AS element, kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT doc_id, 'edge', kind, count(*) FROM edges GROUP BY ALL",
    "q_doc_graph_outgoing": f"""{DOCGRAPH} SELECT doc_id, src AS node_id, (row_number() OVER (PARTITION BY doc_id, src ORDER BY edge_no) - 1)::INT AS place, edge_no, dst AS other, kind, 'src' AS side FROM edges
      UNION ALL SELECT doc_id, dst, (row_number() OVER (PARTITION BY doc_id, dst ORDER BY edge_no) - 1)::INT, edge_no, src, kind, 'dst' FROM edges""",
    "q_doc_graph_candidates": f"{DOCGRAPH} SELECT doc_id, sentence_no, node_id AS candidate, label AS name FROM nodes WHERE kind = 'candidate'",
    "q_doc_graph_errors": f"""{DOCGRAPH}, lost AS (SELECT doc_id, max(ordinal) AS no FROM nodes WHERE kind = 'sentence' GROUP BY doc_id), cut AS (
        SELECT doc_id, node_id FROM nodes JOIN lost USING (doc_id) WHERE kind IN ('sentence', 'unresolved') AND sentence_no = no UNION ALL SELECT doc_id, node_id FROM nodes WHERE kind = 'block' AND ordinal = 0)
      SELECT DISTINCT c.doc_id, 'DanglingEdge' AS error, c.node_id AS subject FROM cut c JOIN edges e ON e.doc_id = c.doc_id AND c.node_id IN (e.src, e.dst) UNION ALL SELECT doc_id, 'UncoveredBytes', strlen(text)::VARCHAR FROM documents WHERE text <> ''""",
    "q_doc_occurrences": f"""{OCCURRENCES} SELECT doc_id, occ_no, no::INT AS sentence_no, frame_no, subject, pred_kind, predicate, object, factuality, world, 700 AS confidence_milli, evidence,
      array_to_string(list_transform(spans, lambda x: x.a || '-' || x.b), ',') AS spans FROM occ""",
    "q_doc_claims": f"{OCCURRENCES} SELECT doc_id, no::INT AS sentence_no, subject, pred_kind, predicate, object, factuality, world, status, occurrences, 700 AS confidence_milli FROM claims_",
    "q_doc_knowledge_summary": f"""{OCCURRENCES} SELECT * FROM (SELECT doc_id, count(*) AS occurrences, sum((len(spans) > 0)::INT)::BIGINT AS with_evidence, sum((factuality = 'Questioned')::INT)::BIGINT AS questioned, sum((factuality = 'Negated')::INT)::BIGINT AS negated FROM occ GROUP BY doc_id)
      JOIN (SELECT doc_id, count(*) AS claims, sum((status = 'Contested')::INT)::BIGINT AS contested FROM claims_ GROUP BY doc_id) USING (doc_id)""",
    "q_doc_knowledge_errors": f"{OCCURRENCES} SELECT doc_id, 'MissingClaim' AS error, occ_no::VARCHAR AS subject FROM occ JOIN (SELECT doc_id, max(no) AS no FROM occ GROUP BY doc_id) USING (doc_id, no)",
    "q_claim_evidence_detail": f"{OCCURRENCES} SELECT status, doc_id, o.occ_no, x.a AS start_byte, x.b AS end_byte, title, source AS uri, revision FROM (SELECT *, unnest(spans) AS x FROM occ) o JOIN claims_ c USING (doc_id, no, subject, pred_kind, predicate, object) JOIN documents USING (doc_id)",
    "q_source_sentence_fallback": f"WITH {SENTENCES} SELECT doc_id, min(ordinal)::INT AS ordinal, arg_min(sentence, ordinal) AS sentence FROM sentences WHERE contains(lower(sentence), 'ferry') AND contains(lower(sentence), 'town') GROUP BY doc_id",
    "q_translated_sentences": f"""{DOCGRAPH} SELECT doc_id, no::INT AS sentence_no, coalesce({_realised_sql('pl')} || regexp_extract(s, '[.!?…]*$'), s) AS target, CASE WHEN {_realised_sql('pl')} IS NULL THEN 'CopySource' ELSE 'Generated' END AS status FROM framed""",
    "q_translated_documents": f"""{DOCGRAPH}, t AS (SELECT doc_id, no, a, b, coalesce({_realised_sql('en')} || regexp_extract(s, '[.!?…]*$'), '[[' || no || ']]') AS target, {_realised_sql('en')} IS NOT NULL AS made, lag(b) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM framed)
      SELECT d.doc_id, coalesce(string_agg(decode(array_slice(encode(text), coalesce(before, 0) + 1, a)) || target, '' ORDER BY no), '') || decode(array_slice(encode(any_value(text)), coalesce(max(b), 0) + 1, strlen(any_value(text)))) AS text, coalesce(sum(made::INT), 0)::BIGINT AS generated, coalesce(sum((NOT made)::INT), 0)::BIGINT AS copied
      FROM documents d LEFT JOIN t USING (doc_id) WHERE text IS NOT NULL GROUP BY d.doc_id""",
    "q_translation_errors": f"""{DOCGRAPH}, t AS (SELECT doc_id, no, s, {_realised_sql('pl')} AS made, regexp_extract(s, '[.!?…]*$') AS mark FROM framed), u AS (SELECT *, left(coalesce(made || mark, s), length(coalesce(made || mark, s)) - 1) AS target FROM t)
      SELECT doc_id, no::INT AS sentence_no, 'MissingSentence' AS error FROM t WHERE no = 0 UNION ALL SELECT doc_id, no, 'EmptyTarget' FROM u WHERE no > 0 AND trim(target, ' ') = '' UNION ALL SELECT doc_id, no, 'ChangedCopy' FROM u WHERE no > 0 AND made IS NULL
      UNION ALL SELECT doc_id, no, 'LostMark' FROM u WHERE no > 0 AND made IS NOT NULL AND mark <> '' AND NOT suffix(target, mark)""",
    "q_doc_diagnostics": f"""{DOCGRAPH}, c AS (SELECT doc_id, no, unnest(list_filter([
        CASE WHEN NOT regexp_matches(s, '[.!?…]["''”’»)\\]}}]*$') THEN {{'a': 0, 'b': 2, 'stage': 'segmentation', 'severity': 'info', 'code': 'NoTerminal'}} END, CASE WHEN len(regexp_split_to_array(s, '[ \\t\\n\\r\\f]+')) > 40 THEN {{'a': 0, 'b': 1, 'stage': 'segmentation', 'severity': 'warning', 'code': 'LongSentence'}} END,
        CASE WHEN frame_type IS NULL THEN {{'a': 1, 'b': 1, 'stage': 'parse', 'severity': 'warning', 'code': 'UnresolvedSentence'}} END, CASE WHEN len(list_filter(roles, lambda r: r.filler = '')) > 0 THEN {{'a': 2, 'b': 0, 'stage': 'semantics', 'severity': 'error', 'code': 'EmptyRole'}} END,
        CASE WHEN len(list_distinct(list_transform(roles, lambda r: lower(r.filler)))) < len(roles) THEN {{'a': 2, 'b': 1, 'stage': 'semantics', 'severity': 'warning', 'code': 'RepeatedFiller'}} END, CASE WHEN frame_type IS NOT NULL AND suffix(s, '?') THEN {{'a': 2, 'b': 2, 'stage': 'semantics', 'severity': 'info', 'code': 'QuestionFrame'}} END],
        lambda x: x IS NOT NULL)) AS d FROM framed) SELECT doc_id, no::INT AS sentence_no, d.stage AS stage, d.severity AS severity, d.code AS code, (row_number() OVER (PARTITION BY doc_id, no ORDER BY d.a, d.b, d.code) - 1)::INT AS place FROM c""",
    "q_doc_inspection": f"""{DOCGRAPH} SELECT a.*, coalesce(fillers, 0) AS fillers FROM (SELECT doc_id, count(*) AS sentences, count(frame_type) AS frames, sum(suffix(s, '?')::INT)::BIGINT AS questions, count(DISTINCT frame_type) AS frame_types, sum(coalesce(len(roles), 0))::BIGINT AS roles FROM framed GROUP BY doc_id) a
      LEFT JOIN (SELECT doc_id, count(DISTINCT lower(filler)) AS fillers FROM roles GROUP BY doc_id) b USING (doc_id)""",
    "q_event_profiles": f"""{DOCGRAPH} SELECT doc_id, frame_no AS event_no, no::INT AS sentence_no, frame_type, CASE WHEN factuality = 'Negated' THEN 'Negative' ELSE 'Positive' END AS polarity, factuality = 'Questioned' AS asked, count(*) AS participants, string_agg(lower(regexp_replace(trim(filler), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '|' ORDER BY role_ordinal) AS names
      FROM roles GROUP BY doc_id, frame_no, no, frame_type, factuality""",
    "q_metric_rows": f"{METRICS} SELECT * FROM rows_",
    "q_metric_summary": f"""{METRICS} SELECT metric_group, metric, count(value) AS cases, round(avg(value), 6) AS mean, min(value) AS least, sum((value < 0.25)::INT)::BIGINT AS fatal, sum((value >= 0.25 AND value < 0.6)::INT)::BIGINT AS major, sum((value >= 0.6 AND value < 0.9)::INT)::BIGINT AS minor FROM rows_ GROUP BY ALL""",
    "q_top_failures": f"{METRICS} SELECT case_id, metric_group, metric, value, CASE WHEN value < 0.25 THEN 'fatal' WHEN value < 0.6 THEN 'major' ELSE 'minor' END AS severity FROM rows_ WHERE value < 0.9 ORDER BY CASE WHEN value < 0.25 THEN 0 WHEN value < 0.6 THEN 1 ELSE 2 END, value, metric_group, metric, case_id LIMIT 5",
    "q_eval_answers": r"""WITH n AS (SELECT DISTINCT lower(canonical_name) AS k FROM entity_ref), i AS (SELECT e.*, n.k AS known FROM eval_item e LEFT JOIN n ON n.k = lower(expected_answer))
      SELECT item_id, CASE WHEN expected_answer IS NULL THEN NULL ELSE known IS NOT NULL END AS matches, round(least(length(text), coalesce(length(expected_answer), 0)) / greatest(length(text), coalesce(length(expected_answer), 0)), 6) AS ratio,
        coalesce(expected_predicate, 'none') || '(' || array_to_string(list_sort(['Object=' || coalesce(expected_answer, '?') || CASE WHEN regexp_matches(coalesce(expected_answer, '?'), '^\p{Lu}') THEN '!' ELSE '' END, 'Lang=' || lang || CASE WHEN regexp_matches(lang, '^\p{Lu}') THEN '!' ELSE '' END]), ',') || ')' AS signature FROM i""",
    "q_coordination_groups": f"""WITH {TOKENS}, n AS (SELECT *, lag(token) OVER w AS l, lead(token) OVER w AS r FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY position)), j AS (SELECT * FROM n WHERE token IN ('and', 'oraz', 'und') AND l NOT IN ('and', 'oraz', 'und') AND r NOT IN ('and', 'oraz', 'und')),
      i AS (SELECT *, position - 2 * row_number() OVER (PARTITION BY doc_id, position % 2 ORDER BY position) AS island, position % 2 AS odd FROM j)
      SELECT doc_id, min(position)::INT - 1 AS begin, arg_min(l, position) || '|' || string_agg(r, '|' ORDER BY position) AS members, (count(*) + 1)::INT AS size, 'Plural' AS agreement FROM i GROUP BY doc_id, odd, island""",
    "q_concept_by_label": f"""WITH {TOKENS}, c AS (SELECT * FROM ontology_entry WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1)
      SELECT word, min(id) AS concept, 0.9::DOUBLE AS score FROM (SELECT token AS word FROM tokens UNION SELECT lower(label) FROM ontology_entry WHERE label IS NOT NULL) JOIN c ON upper(label) = upper(word) GROUP BY word""",
    "q_year_numbers": f"""WITH {TOKENS}, y AS (SELECT doc_id, position FROM tokens WHERE regexp_matches(token, '^(age|ages|year|years|rok|roku|lat|lata)$'))
      SELECT doc_id, position::INT AS position, token, 0.75::DOUBLE AS score FROM tokens t WHERE regexp_matches(token, '^[0-9]+$') AND EXISTS (FROM y WHERE y.doc_id = t.doc_id AND abs(y.position - t.position) BETWEEN 1 AND 2)""",
    "q_concept_edges": f"""WITH {LEX}, {TOKENS}, p AS (SELECT * FROM (VALUES {', '.join(str(c) for c in CONCEPTS)}) AS p(id, parent)), w AS (SELECT DISTINCT token, concept FROM tokens JOIN lex ON form = token)
      SELECT token AS src, concept AS dst, 'evokes' AS kind FROM w UNION ALL SELECT DISTINCT concept, parent, 'is_a' FROM w JOIN p ON id = concept""",
    "q_find_tokens": f"WITH {LEX}, {TOKENS} SELECT token, count(*) AS uses FROM tokens WHERE token = 'act' OR token IN (SELECT form FROM lex WHERE lower(concept) = 'act' OR lower(lemma) = 'act') GROUP BY token",
    "q_ontology_closure": f"WITH RECURSIVE {GRAPH}, closed AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closed c JOIN edges e ON c.dst = e.src) SELECT DISTINCT src, dst FROM closed",
    "q_temporal_closure": f"WITH RECURSIVE {ONTOLOGY.replace('closed AS', 'turned AS (SELECT CASE WHEN ascii(src) % 2 = 0 THEN dst ELSE src END AS src, CASE WHEN ascii(src) % 2 = 0 THEN src ELSE dst END AS dst FROM steps), closed AS').replace('FROM steps UNION', 'FROM turned UNION').replace('JOIN steps s', 'JOIN turned s')} SELECT DISTINCT src, dst FROM closed",
    "q_temporal_conflicts": f"WITH RECURSIVE {ONTOLOGY} SELECT DISTINCT a.src, a.dst FROM closed a JOIN closed b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst",
    "q_role_violations": """SELECT id, array_to_string(list_sort(list_intersect(list_distinct(allowed_roles), ['Agent', 'Experiencer', 'Recipient'])), ',') AS violations FROM (SELECT * FROM ontology_entry WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1)
      WHERE features.animacy = 'Inanimate' AND list_has_any(allowed_roles, ['Agent', 'Experiencer', 'Recipient'])""",
    "q_temporal_normalize": """WITH k AS (SELECT o_orderkey, o_orderdate AS d, dayofyear(o_orderdate) % 9 AS k FROM orders)
      SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 7, 8) THEN year(d) END::INT AS year, CASE WHEN k IN (0, 1, 2, 7, 8) THEN month(d) END::INT AS month, CASE WHEN k IN (0, 1, 2, 7) THEN day(d) END::INT AS day, CASE WHEN k IN (0, 2, 7) THEN hour(d) END::INT AS hour,
        CASE k WHEN 0 THEN 150 WHEN 2 THEN 0 WHEN 7 THEN -660 END::INT AS offset_minutes, CASE WHEN k IN (0, 1, 2, 7, 8) THEN 'Absolute' WHEN k = 3 THEN 'Duration' WHEN k = 4 THEN 'Frequency' WHEN k = 5 THEN 'Deictic' ELSE 'Symbolic' END AS kind,
        CASE k WHEN 3 THEN 'Overlaps' WHEN 5 THEN 'Before' ELSE 'Simultaneous' END AS relation FROM k""",
    "q_event_groups": "SELECT min(event_id) AS cluster, count(*) AS events FROM events GROUP BY coalesce(user_id::VARCHAR, '#' || event_id), coalesce(event_type, '#' || event_id)",
    "q_pair_score": f"WITH {RESOLVED} SELECT doc_id, mention_id, k::INT AS rank, scored_ms[k].mention_id AS target_id, scores[k]::INT AS score FROM (SELECT *, unnest(range(1, least(len(scores), 16) + 1)) AS k FROM decided)",
    "q_resolution_decision": f"WITH {RESOLVED} SELECT doc_id, mention_id, form, decision, target_id, score::INT AS score, cluster_no, least(len(scores), 16)::INT AS alternatives, greatest(least(score, 1000), 0)::INT AS confidence_milli FROM full_",
    "q_resolution_clusters": f"WITH {RESOLVED} SELECT * FROM groups",
    "q_resolution_summary": f"""WITH {RESOLVED} SELECT d.*, coalesce(c.several, 0) AS resolved_clusters, coalesce(c.one, 0) AS single_clusters FROM (SELECT doc_id, count(*) AS mentions, sum((decision IN ('Accepted', 'Seeded'))::INT)::BIGINT AS accepted, sum((decision = 'HardAccepted')::INT)::BIGINT AS hard_accepted,
        sum((decision = 'Ambiguous')::INT)::BIGINT AS ambiguous, sum((decision = 'Deferred')::INT)::BIGINT AS deferred, sum((decision = 'Unresolved')::INT)::BIGINT AS unresolved, sum((decision = 'Excluded')::INT)::BIGINT AS excluded FROM full_ GROUP BY doc_id) d
      LEFT JOIN (SELECT doc_id, sum((mentions > 1)::INT)::BIGINT AS several, sum((mentions = 1)::INT)::BIGINT AS one FROM groups GROUP BY doc_id) c USING (doc_id)""",
    "q_resolution_errors": f"""WITH {RESOLVED}, p AS (SELECT DISTINCT doc_id, mention_id FROM mention_resolution_profile WHERE mention_id IS NOT NULL)
      SELECT doc_id, mention_id, 'MissingDecision' AS error FROM p WHERE NOT EXISTS (FROM m WHERE m.doc_id = p.doc_id AND m.mention_id = p.mention_id)""",
    "q_named_clusters": f"WITH {RESOLVED} SELECT entity_id, count(*) AS clusters, sum(mentions)::BIGINT AS mentions FROM groups JOIN entity_ref ON lower(entity_ref.canonical_name) = groups.canonical_name GROUP BY entity_id",
    "q_coref_components": f"WITH {RESOLVED} SELECT mention_id AS node_id, min(mention_id) OVER (PARTITION BY head) AS component FROM (SELECT *, count(*) OVER (PARTITION BY head) AS n FROM full_ WHERE head IS NOT NULL) WHERE n > 1",
    "q_topic_carry_forward": f"WITH {TURNS} SELECT turn_id, last_value(predicate IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM turns WHERE session_id IS NOT NULL",
    "q_cross_turn_coref": f"WITH {TURNS} SELECT * FROM (SELECT session_id, turn_id, predicate, lag(turn_id) OVER (PARTITION BY session_id, predicate ORDER BY turn_id) AS antecedent FROM turns WHERE session_id IS NOT NULL AND predicate IS NOT NULL) WHERE antecedent IS NOT NULL",
    "q_recent_entities": f"WITH {TURNS} SELECT session_id, turn_id, predicate, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC)::INT AS recency FROM turns WHERE session_id IS NOT NULL AND predicate IS NOT NULL QUALIFY recency <= 3",
    "q_run_compare": """WITH a AS (SELECT o_custkey AS case_id, o_orderpriority AS metric, count(*)::DOUBLE AS v FROM orders WHERE NOT coalesce(year(o_orderdate) >= 1998, false) GROUP BY ALL), b AS (SELECT o_custkey AS case_id, o_orderpriority AS metric, count(*)::DOUBLE AS v FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY ALL),
      p AS (SELECT case_id, count(a.v) AS x, count(b.v) AS y, coalesce(bool_or(b.v - a.v > 1e-9), false) AS up, coalesce(bool_or(b.v - a.v < -1e-9), false) AS down FROM a FULL JOIN b USING (case_id, metric) GROUP BY case_id)
      SELECT *, outcome IN ('Regressed', 'Missing') AS critical FROM (SELECT case_id, CASE WHEN x = 0 THEN 'Added' WHEN y = 0 THEN 'Missing' WHEN up AND NOT down THEN 'Improved' WHEN down AND NOT up THEN 'Regressed' ELSE 'Unchanged' END AS outcome, up AND down AS mixed FROM p)""",
    "q_glossary_compliance": f"""WITH {TOKENS}, u AS (SELECT token, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM tokens GROUP BY token), t AS (SELECT * FROM (VALUES {', '.join(f"({a}, '{b}', {c}, {d})" for a, b, c, d in TERMS)}) AS t(term_id, form, forbidden, minimum))
      SELECT term_id, form, forbidden, minimum, coalesce(uses, 0) AS uses, coalesce(documents, 0) AS documents, CASE WHEN forbidden AND coalesce(uses, 0) > 0 THEN 'Forbidden' WHEN NOT forbidden AND coalesce(uses, 0) < minimum THEN 'TooFew' ELSE 'Kept' END AS verdict FROM t LEFT JOIN u ON token = form""",
    "q_invariants": r"""WITH c AS (SELECT unnest([{'k': 'HashMatches', 'v': content_sha256 IS NULL OR sha256(text) = content_sha256}, {'k': 'LengthMatches', 'v': n_chars = length(text)}, {'k': 'HasParagraph', 'v': len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ') <> '')) > 0},
        {'k': 'HasSentence', 'v': len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x, ' ') <> '')) > 0}, {'k': 'PreservesNumber', 'v': NOT regexp_matches(title, '\d') OR contains(text, regexp_extract(title, '(\d+)', 1))}, {'k': 'HasTitle', 'v': title IS NOT NULL}]) AS c FROM documents WHERE text IS NOT NULL)
      SELECT c.k AS invariant, coalesce(c.v, false) AS holds, count(*) AS documents FROM c GROUP BY ALL""",
    "q_corpus_validation": """SELECT 'DuplicateId' AS error, item_id::VARCHAR AS subject, count(*) AS n FROM eval_item GROUP BY item_id HAVING n > 1 UNION ALL SELECT 'DuplicateSource', sha256(text), count(*) AS n FROM eval_item GROUP BY text HAVING count(*) > 1
      UNION ALL SELECT 'SplitTooSmall', concat_ws('/', corpus_id, eval_split), count(*) FROM eval_item GROUP BY corpus_id, eval_split HAVING count(*) < 40""",
    "q_status_summary": f"""WITH {TURNS}, s AS (SELECT coalesce(question_kind, 'none') AS kind, CASE WHEN input_text IS NULL THEN 'f' WHEN predicate IS NULL THEN 'u' WHEN coalesce(parse_status, '') <> 'parsed' THEN 'p' ELSE 'r' END AS s FROM turns)
      SELECT kind, count(*) AS sentences, sum((s = 'f')::INT)::BIGINT AS failed, sum((s = 'u')::INT)::BIGINT AS unresolved, sum((s = 'p')::INT)::BIGINT AS partial, sum((s = 'r')::INT)::BIGINT AS resolved, round(sum((s <> 'f')::INT) / count(*), 6) AS compiled_ratio, round(sum((s IN ('p', 'r'))::INT) / count(*), 6) AS usable_ratio FROM s GROUP BY kind""",
    "q_budget_guard": """SELECT doc_id, 'source_bytes' AS limit_name, strlen(text) AS amount, 5000::BIGINT AS allowed FROM documents WHERE strlen(text) > 5000
      UNION ALL SELECT doc_id, 'sentences', n, 60 FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x, ' ') <> '')) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 60""",
    "q_lineage_hash": "SELECT doc_id, concat('doc-', coalesce(lang, ''), '-', left(sha256(encode(coalesce(lang, '')) || '\\x00'::BLOB || encode(text)), 32)) AS document_id, sha256(text) IS NOT DISTINCT FROM content_sha256 AS verified FROM documents WHERE text IS NOT NULL",
    "q_trace_sequence": "SELECT event_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY recorded_at NULLS FIRST, event_id)::INT AS sequence, stage FROM (SELECT * FROM trace_event WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC NULLS LAST) = 1)",
    "q_learner_merge": """WITH e AS (SELECT 'w' || (l_partkey % 500) AS word, l_linenumber AS o, 's' || l_linenumber AS source, CASE WHEN l_partkey % 3 > 0 THEN 'C' || (l_suppkey % 7) END AS concept, CASE WHEN l_orderkey % 4 = 0 THEN l_returnflag END AS gloss, l_discount AS score FROM lineitem)
      SELECT word, min((o, concept)) FILTER (concept IS NOT NULL)[2] AS first_concept, min((o, gloss)) FILTER (gloss IS NOT NULL)[2] AS gloss, max((score, concept)) FILTER (concept IS NOT NULL)[2] AS best_concept, max((score, concept)) FILTER (concept IS NOT NULL)[1] AS best_score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM e GROUP BY word""",
    "q_new_words": f"WITH {LEX}, {TOKENS} SELECT token AS word, min(doc_id) AS first_doc, count(*) AS uses FROM tokens WHERE strlen(token) > 2 AND regexp_matches(token, '^[\\p{{L}}\\p{{N}}]+$') AND token NOT IN (SELECT form FROM lex) GROUP BY token",
    "q_frame_templates": f"WITH {SENTENCES}, f AS (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{k}'" for p, k, _ in P.TEMPLATES) + " END AS frame_type FROM sentences) SELECT frame_type, count(*) AS frames, count(DISTINCT doc_id) AS documents FROM f WHERE frame_type IS NOT NULL GROUP BY frame_type",
    "q_question_semantics": f"WITH {TURNS}, q AS (SELECT turn_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for p, k, _ in P.QUESTIONS) + " END AS kind, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{x}'" for p, _, x in P.QUESTIONS) + " END AS predicate FROM (SELECT turn_id, lower(trim(input_text, ' ')) AS t FROM turns) WHERE contains(t, '?')) SELECT * FROM q WHERE kind IS NOT NULL",
    "q_morph_rules": f"""WITH s AS (SELECT DISTINCT unnest({WORDS.format('p_name')}) AS stem FROM part)
      SELECT stem, form, CASE form WHEN 'add' THEN stem || 's' WHEN 'cut' THEN left(stem, greatest(length(stem) - 2, 0)) WHEN 'head' THEN 'the-' || stem WHEN 'swap' THEN regexp_replace(stem, 'y$', 'ies') WHEN 'soft' THEN regexp_replace(stem, 'k$', 'c') WHEN 'twice' THEN stem || right(stem, 1) || 'ed' ELSE stem END AS surface
      FROM s, (SELECT unnest(['add', 'cut', 'head', 'swap', 'soft', 'twice', 'none']) AS form)""",
    "q_suffix_analysis": f"""WITH {TOKENS}, t AS (SELECT DISTINCT token AS surface FROM tokens), r AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b or ''}', '{c}')" for a, b, c in SUFFIXES)}) AS r(suffix, restore, feature))
      SELECT surface, left(surface, length(surface) - length(suffix)) || restore AS stem, feature FROM t JOIN r ON suffix(surface, r.suffix) WHERE length(surface) > length(r.suffix)""",
    "q_feature_inheritance": r"""WITH RECURSIVE """ + ONTOLOGY.split(",\n  steps")[0].replace("SELECT id, parent FROM (", "SELECT id, parent, animacy FROM (").replace("revision, ingested_at FROM ontology_entry", "revision, ingested_at, features.animacy AS animacy FROM ontology_entry") + """,
      walk AS (SELECT id, id AS here, 0::BIGINT AS distance FROM links UNION SELECT w.id, l.parent, w.distance + 1 FROM walk w JOIN links l ON l.id = w.here JOIN links p ON p.id = l.parent WHERE w.distance < 1000),
      looped AS (SELECT DISTINCT id FROM walk WHERE distance >= 1000)
      SELECT w.id, arg_min(l.animacy, w.distance) AS animacy, min(w.distance) AS distance FROM walk w JOIN links l ON l.id = w.here WHERE l.animacy IS NOT NULL AND (w.distance = 0 OR w.id NOT IN (SELECT id FROM looped)) GROUP BY w.id""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
