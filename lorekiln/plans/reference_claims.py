"""Queries of the claim algebra and knowledge extraction over claims made from the structured tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.operators import claims as C
from lorekiln.operators import knowledge as K
from lorekiln.sources.tables import current_rows, table

# bundle: table, key, subject, predicate kind, predicate, object kind, object, factuality (expressions of both SQL dialects)
BUNDLES = {
    "customer": ("customer", "c_custkey", "concat('customer:', cast(c_custkey AS string))", "LocatedAt", "", "cluster", "concat('nation:', cast(c_nationkey AS string))", "'Asserted'"),
    "supplier": ("supplier", "s_suppkey", "concat('supplier:', cast(s_suppkey AS string))", "LocatedAt", "", "cluster", "concat('nation:', cast(s_nationkey AS string))", "'Asserted'"),
    "nation": ("nation", "n_nationkey", "concat('nation:', cast(n_nationkey AS string))", "Custom", "PART_OF", "cluster", "concat('region:', cast(n_regionkey AS string))", "'Asserted'"),
    "orders": ("orders", "o_orderkey", "concat('order:', cast(o_orderkey AS string))", "Custom", "CREATED_BY", "cluster", "concat('customer:', cast(o_custkey AS string))", "CASE o_orderstatus WHEN 'F' THEN 'Negated' WHEN 'P' THEN 'Questioned' ELSE 'Asserted' END"),
    "part": ("part", "p_partkey", "concat('part:', cast(p_partkey AS string))", "HasProperty", "", "text", "p_brand", "'Asserted'"),
    "document": ("documents", "doc_id", "concat('document:', cast(doc_id AS string))", "HasProperty", "", "text", "lang", "'Asserted'"),
    "lineitem": ("lineitem", "l_orderkey * 8 + l_linenumber", "concat('part:', cast(l_partkey AS string))", "Custom", "SUPPLIED_BY", "cluster", "concat('supplier:', cast(l_suppkey AS string))", "CASE l_returnflag WHEN 'R' THEN 'Negated' ELSE 'Asserted' END"),
}


def _columns(bundle: str) -> list[str]:
    _, key, subject, pred_kind, pred, obj_kind, obj, fact = BUNDLES[bundle]
    return [
        f"'{bundle}' AS bundle_id", f"concat('{bundle}:', cast({key} AS string)) AS claim_id", f"cast({key} AS bigint) AS ordinal", "'cluster' AS subj_kind", f"{subject} AS subj_val",
        f"'{pred_kind}' AS pred_kind", f"'{pred}' AS pred_val", f"'{obj_kind}' AS obj_kind", f"{obj} AS obj_val", f"{fact} AS factuality",
        f"CASE {fact} WHEN 'Questioned' THEN 'Question' ELSE 'Actual' END AS world", f"CASE {fact} WHEN 'Asserted' THEN 'Supported' WHEN 'Negated' THEN 'Contradicted' ELSE 'NonFactual' END AS status",
        f"cast(500 + cast({key} AS bigint) % 500 AS int) AS confidence_milli",
    ]


def claims(spark: SparkSession, sf: str, *bundles: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, sf, BUNDLES[b][0]).selectExpr(*_columns(b)) for b in bundles])


def claims_sql(*bundles: str) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(_columns(b))} FROM {BUNDLES[b][0]}" for b in bundles)


def order_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Every order of a customer is an occurrence of the claim about them."""
    return table(spark, sf, "orders").selectExpr("concat('customer:', cast(o_custkey AS string)) AS claim_id", "o_orderkey AS occ_ord", "concat('order-', cast(o_orderkey AS string)) AS source_sentence_id", "array(concat('source:orders:', cast(o_orderkey AS string))) AS evidence")


OCCURRENCES = "SELECT concat('customer:', o_custkey) AS claim_id, o_orderkey AS occ_ord, concat('order-', o_orderkey) AS source_sentence_id, concat('source:orders:', o_orderkey) AS evidence FROM orders"
RENDERED = """rendered AS (
  SELECT bundle_id, ordinal, c.claim_id AS claim, status, concat(subj_kind, ':', subj_val) AS subject, concat(pred_kind, ':', pred_val) AS predicate, concat(obj_kind, ':', obj_val) AS object,
    factuality, world, confidence_milli AS confidence, coalesce(k, 0) AS occurrences, src AS source_sentences, CASE WHEN k IS NULL THEN 0 ELSE 1 + 3 * k END::BIGINT AS evidence_count, cited
  FROM claims c LEFT JOIN (
    SELECT claim_id, count(*) AS k, string_agg(source_sentence_id, ',' ORDER BY source_sentence_id) AS src,
      list_sort(flatten(list([concat('occurrence:', claim_id, ':', occ_ord), concat('sentence:', source_sentence_id), evidence]))) AS cited
    FROM occ GROUP BY claim_id) o ON o.claim_id = c.claim_id)"""


def _with(*bundles: str, occ: str = OCCURRENCES) -> str:
    return f"WITH claims AS ({claims_sql(*bundles)}), occ AS ({occ}), {RENDERED} "


NO_OCC = "SELECT '' AS claim_id, 0 AS occ_ord, '' AS source_sentence_id, '' AS evidence WHERE false"


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "claim_id string, occ_ord bigint, source_sentence_id string, evidence array<string>")


def q_claim_scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    q = C.Query(where=C.And((C.Predicate("LocatedAt", ""), C.Object("cluster", "nation:7"), C.EvidenceRequired(True))), project=("claim", "status", "subject", "predicate", "object", "factuality", "world", "confidence", "occurrences", "source_sentences", "evidence_count"))
    return C.execute(q, claims(spark, sf, "customer"), order_occurrences(spark, sf))


def q_claim_boolean_tree(spark: SparkSession, sf: str) -> DataFrame:
    tree = C.And((C.Or((C.Object("cluster", "nation:3"), C.Object("cluster", "nation:5"))), C.Not(C.Subject("cluster", "customer:7")), C.Status("Supported")))
    return C.execute(C.Query(where=tree, project=("claim", "subject", "object")), claims(spark, sf, "customer", "supplier"), _none(spark))


def q_claim_count_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return C.execute(C.Query(intent="Count", where=C.Not(C.Object("cluster", "nation:1")), limit=3), claims(spark, sf, "customer"), order_occurrences(spark, sf))


def q_claim_distinct_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.render(C.with_evidence(claims(spark, sf, "lineitem"), _none(spark)))
    return C.distinct_first(rows.select("subject", "object", "ordinal", "claim"), ["subject", "object"])


def q_claim_sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    return C.execute(C.Query(project=("claim", "confidence", "evidence_count"), order=(("evidence_count", False), ("confidence", True)), limit=25), claims(spark, sf, "customer"), order_occurrences(spark, sf))


def q_claim_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return K.contradictions(claims(spark, sf, "lineitem", "part"), ["SUPPLIED_BY"]).select("subj_val", "pred_val", "world", "claims", "objects", "kind")


def q_claim_contested(spark: SparkSession, sf: str) -> DataFrame:
    base = claims(spark, sf, "lineitem")
    return K.contest(base, K.contradictions(base, [])).groupBy("status").agg(F.count("*").alias("claims"))


def q_claim_signature_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = claims(spark, sf, "lineitem").withColumnRenamed("ordinal", "occ_ord")
    return K.dedupe(rows, ["subj_val", "pred_val", "obj_val"]).select("signature", "first_occurrence", "subj_val", "obj_val", "factuality", "status", "occurrences", "confidence_milli")


def q_boolean_answer_status(spark: SparkSession, sf: str) -> DataFrame:
    return C.boolean_status(claims(spark, sf, "orders"), ["obj_val"])


INTENTS = ["Select", "Count", "Contradiction", "Explain"]


def q_answer_status(spark: SparkSession, sf: str) -> DataFrame:
    """The status of the answer about each nation under every intent; suppliers have no evidence."""
    rows = C.render(C.with_evidence(claims(spark, sf, "customer", "supplier"), order_occurrences(spark, sf)))
    per = [C.answer_status(rows, i, ["bundle_id", "object"]).withColumn("intent", F.lit(i)) for i in INTENTS]
    return reduce(DataFrame.unionByName, per)


def q_boolean_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Yes, no or both over the statuses of all bundles."""
    return C.boolean_status(claims(spark, sf, "lineitem", "orders", "part"), ["pred_val", "obj_kind", "obj_val"])


def q_multi_bundle_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.render(C.with_evidence(claims(spark, sf, "customer", "supplier"), order_occurrences(spark, sf)))
    return C.merge_bundles(C.answer_status(rows, "Select", ["bundle_id", "object"]), ["object"])


def q_evidence_attach(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.with_evidence(claims(spark, sf, "customer"), order_occurrences(spark, sf))
    return rows.select("claim_id", F.array_join("evidence", "|").alias("evidence"), "occurrences")


def q_answer_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.render(C.with_evidence(claims(spark, sf, "customer", "part"), order_occurrences(spark, sf)))
    return C.rank_rows(rows, "customer:11", 20).select("claim", "subject", "object", "evidence_count")


def q_answer_text(spark: SparkSession, sf: str) -> DataFrame:
    nations = claims(spark, sf, "nation").join(table(spark, sf, "nation").selectExpr("concat('nation:', cast(n_nationkey AS string)) AS subj_val", "n_name"), "subj_val")
    return C.answer_text(nations, "n_name", ["obj_val"])


def q_fact_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.render(C.with_evidence(claims(spark, sf, "customer", "orders"), order_occurrences(spark, sf)))
    return rows.groupBy("bundle_id", C.fact_quality().alias("quality")).agg(F.count("*").alias("claims"))


def _nation_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("'nation' AS bundle_id", "concat('nation:', cast(n_nationkey AS string)) AS cluster_id", "n_name AS canonical_name", "array(lower(n_name), concat('N', cast(n_nationkey AS string))) AS aliases")


def q_facts_by_entity_paged(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "nation").selectExpr("concat(' ', upper(n_name)) AS selector")
    facts = C.facts_by_entity(claims(spark, sf, "customer", "supplier", "nation"), _nation_clusters(spark, sf), names)
    return C.page(facts, ["selector"], ["claim_id"], 5, 10).select("selector", "claim_id", "rank", "total", "truncated")


def q_entity_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' claims with the names of suppliers and nations, and the value to show first."""
    rows = C.render(C.with_evidence(claims(spark, sf, "supplier", "nation", "part"), _none(spark)))
    ids = lambda t, k, n, p: table(spark, sf, t).selectExpr(f"concat('{p}:', cast({k} AS string)) AS cluster_id", f"{n} AS canonical_name")
    labelled = C.with_labels(rows, ids("supplier", "s_suppkey", "s_name", "supplier").unionByName(ids("nation", "n_nationkey", "n_name", "nation")))
    return labelled.select("claim", "subject_label", "object_label", C.preferred_value("subject_label", "object_label", "summary").alias("shown"))


def q_fact_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by customer segment's nation, bundle and quality, with the rank of each quality."""
    rows = C.render(C.with_evidence(claims(spark, sf, "customer", "orders"), order_occurrences(spark, sf)))
    return C.quality_groups(rows, ["bundle_id", "object"])


def q_ambiguous_names(spark: SparkSession, sf: str) -> DataFrame:
    clusters = table(spark, sf, "entity_ref").selectExpr("entity_kind AS bundle_id", "cast(entity_id AS string) AS cluster_id", "canonical_name", "array(split(canonical_name, ' ')[0]) AS aliases")
    return C.ambiguous_names(clusters)


def q_entity_links(spark: SparkSession, sf: str) -> DataFrame:
    """The entity of each current mention: by its id where the normalised surface names one exactly, else by the name."""
    mentions = current_rows(table(spark, sf, "mention_resolution_profile"), "mention_id", ["ingested_at"], ["exact_surface", "normalized_surface"])
    ids = table(spark, sf, "entity_ref").groupBy(F.lower("canonical_name").alias("normalized_surface")).agg(F.max("entity_id").alias("entity_id"))
    named = mentions.join(ids, "normalized_surface", "left").select("mention_id", "entity_id", F.lit("NAME").alias("concept"), F.col("exact_surface").alias("name"))
    clusters = table(spark, sf, "entity_ref").selectExpr("entity_id AS cluster_id", "entity_id", "'NAME' AS concept", "canonical_name")
    return K.link_entities(named, clusters).where("cluster_id IS NOT NULL").distinct()


FRAME_KINDS = [r[0] for r in K.FRAME_RULES] + ["Transfer"]
FRAME_ROLES = sorted({r[k] for r in K.FRAME_RULES for k in (1, 4)})


def q_frame_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as frames of every type with every role; each third has a quantity, the first of each customer's status no subject roles."""
    kinds = F.array(*map(F.lit, FRAME_KINDS))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.element_at(kinds, (F.col("o_custkey") % len(FRAME_KINDS) + 1).cast("int")).alias("frame_type"), (F.col("o_orderstatus") == "P").alias("bare"))
    frames = orders.select(F.col("o_orderkey").alias("frame_id"), "frame_type", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("quantity"))
    roles = orders.select(F.col("o_orderkey").alias("frame_id"), "bare", F.explode(F.array(*map(F.lit, FRAME_ROLES))).alias("role")).where("NOT bare OR role = 'Object'")
    return K.frame_triples(frames, roles.select("frame_id", "role", F.concat(F.lower("role"), F.lit(":"), F.col("frame_id").cast("string")).alias("filler")))


def q_value_text(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "part").selectExpr(
        "p_partkey", "element_at(array('decimal','range','quantity','date','frequency','text'), cast(p_partkey % 6 AS int) + 1) AS kind", "CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END AS sign", "cast(p_size AS bigint) AS mantissa", "cast(p_size % 4 AS int) AS scale",
        "cast(p_size AS string) AS low", "cast(p_size + 5 AS string) AS high", "cast(p_size AS string) AS amount", "'kg' AS unit", "1900 + p_size AS year", "CASE WHEN p_size % 3 > 0 THEN p_size % 12 + 1 END AS month", "cast(NULL AS int) AS day", "'day' AS every", "p_name AS text",
    )
    return lines.select("p_partkey", C.value_text().alias("value"))


QUERIES = [q_claim_scan_filter, q_claim_boolean_tree, q_claim_count_evidence, q_claim_distinct_first, q_claim_sort_limit, q_claim_contradictions, q_claim_contested, q_claim_signature_dedupe, q_boolean_answer_status, q_answer_status, q_boolean_answers, q_multi_bundle_merge, q_evidence_attach, q_answer_ranking, q_answer_text, q_fact_quality, q_facts_by_entity_paged, q_entity_labels, q_fact_groups, q_ambiguous_names, q_entity_links, q_frame_triples, q_value_text]

STATUS = "CASE WHEN count(*) = 0 OR coalesce(sum(evidence_count), 0) = 0 THEN 'Unknown' WHEN count(*) = 1 THEN 'Exact' ELSE 'Supported' END"
SQL = {
    "q_claim_scan_filter": _with("customer") + "SELECT claim, status, subject, predicate, object, factuality, world, confidence, occurrences, source_sentences, evidence_count FROM rendered WHERE object = 'cluster:nation:7' AND evidence_count > 0",
    "q_claim_boolean_tree": _with("customer", "supplier", occ=NO_OCC) + "SELECT claim, subject, object FROM rendered WHERE object IN ('cluster:nation:3', 'cluster:nation:5') AND subject <> 'cluster:customer:7' AND status = 'Supported'",
    "q_claim_count_evidence": _with("customer") + "SELECT (SELECT count(*) FROM rendered WHERE object <> 'cluster:nation:1') AS count, 'count' AS mode, count(*) AS evidence_count, bit_xor(('0x' || left(sha256(e), 15))::BIGINT) AS evidence_digest FROM (SELECT DISTINCT unnest(list_append(cited, 'claim:' || claim)) AS e FROM rendered WHERE object <> 'cluster:nation:1' AND cited IS NOT NULL)",
    "q_claim_distinct_first": "SELECT concat('cluster:part:', l_partkey) AS subject, concat('cluster:supplier:', l_suppkey) AS object, min(l_orderkey * 8 + l_linenumber) AS ordinal, concat('lineitem:', min(l_orderkey * 8 + l_linenumber)) AS claim FROM lineitem GROUP BY l_partkey, l_suppkey",
    "q_claim_sort_limit": _with("customer") + "SELECT claim, confidence, evidence_count FROM rendered ORDER BY evidence_count DESC NULLS LAST, confidence NULLS FIRST, claim LIMIT 25",
    "q_claim_contradictions": f"""WITH claims AS ({claims_sql('lineitem', 'part')}) SELECT * FROM (
      SELECT subj_val, pred_val, world, count(*) AS claims, count(DISTINCT (obj_kind, obj_val)) AS objects,
        CASE WHEN bool_or(factuality = 'Negated') THEN 'Polarity' WHEN pred_val = 'SUPPLIED_BY' AND count(DISTINCT (obj_kind, obj_val)) > 1 THEN 'FunctionalValue' END AS kind
      FROM claims GROUP BY subj_val, pred_val, world) WHERE claims >= 2 AND kind IS NOT NULL""",
    "q_claim_contested": f"""WITH claims AS ({claims_sql('lineitem')}), bad AS (SELECT subj_val, pred_val, world FROM claims GROUP BY ALL HAVING count(*) >= 2 AND bool_or(factuality = 'Negated'))
      SELECT CASE WHEN b.subj_val IS NOT NULL THEN 'Contested' ELSE status END AS status, count(*) AS claims FROM claims c LEFT JOIN bad b USING (subj_val, pred_val, world) GROUP BY 1""",
    "q_claim_signature_dedupe": f"""WITH claims AS ({claims_sql('lineitem')}) SELECT sha256(concat('=', subj_val, chr(31), '=', pred_val, chr(31), '=', obj_val)) AS signature, min(ordinal) AS first_occurrence, subj_val, obj_val,
      arg_min(factuality, ordinal) AS factuality, arg_min(status, ordinal) AS status, count(*) AS occurrences, max(confidence_milli) AS confidence_milli FROM claims GROUP BY subj_val, pred_val, obj_val""",
    "q_boolean_answer_status": f"""WITH claims AS ({claims_sql('orders')}) SELECT obj_val, CASE WHEN y AND n THEN 'Conflicting' WHEN y THEN 'Yes' WHEN n THEN 'No' ELSE 'Unknown' END AS answer_status
      FROM (SELECT obj_val, bool_or(status IN ('Supported', 'Contested', 'AttributedOnly')) AS y, bool_or(status IN ('Contradicted', 'NonFactual')) AS n FROM claims GROUP BY obj_val)""",
    "q_answer_status": _with("customer", "supplier") + """SELECT bundle_id, object, intent, CASE WHEN sum(evidence_count) = 0 THEN 'Unknown' WHEN intent = 'Count' THEN 'Exact' WHEN intent = 'Contradiction' AND count(*) > 1 THEN 'Conflicting' WHEN count(*) = 1 THEN 'Exact' ELSE 'Supported' END AS answer_status, count(*) AS answers
      FROM rendered, (SELECT unnest(['Select', 'Count', 'Contradiction', 'Explain']) AS intent) GROUP BY bundle_id, object, intent""",
    "q_boolean_answers": f"""WITH claims AS ({claims_sql('lineitem', 'orders', 'part')}) SELECT pred_val, obj_kind, obj_val, CASE WHEN y AND n THEN 'Conflicting' WHEN y THEN 'Yes' WHEN n THEN 'No' ELSE 'Unknown' END AS answer_status
      FROM (SELECT pred_val, obj_kind, obj_val, bool_or(status IN ('Supported', 'Contested', 'AttributedOnly')) AS y, bool_or(status IN ('Contradicted', 'NonFactual')) AS n FROM claims GROUP BY ALL)""",
    "q_multi_bundle_merge": _with("customer", "supplier") + f"""SELECT object, CASE max(CASE answer_status WHEN 'Supported' THEN 2 WHEN 'Exact' THEN 1 ELSE 0 END) WHEN 2 THEN 'Supported' WHEN 1 THEN 'Exact' ELSE 'Unknown' END AS answer_status, sum(answers)::BIGINT AS answers
      FROM (SELECT bundle_id, object, {STATUS} AS answer_status, count(*) AS answers FROM rendered GROUP BY ALL) GROUP BY object""",
    "q_evidence_attach": _with("customer") + "SELECT claim AS claim_id, CASE WHEN cited IS NULL THEN '' ELSE array_to_string(list_sort(list_prepend(concat('claim:', claim), cited)), '|') END AS evidence, occurrences FROM rendered",
    "q_answer_ranking": _with("customer", "part") + "SELECT claim, subject, object, evidence_count FROM rendered ORDER BY lower(subject) = 'cluster:customer:11' DESC, split_part(object, ':', 1) IN ('text', 'literal'), evidence_count DESC, claim LIMIT 20",
    "q_answer_text": "SELECT concat('region:', n_regionkey) AS obj_val, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS answer FROM nation GROUP BY n_regionkey",
    "q_fact_quality": _with("customer", "orders") + "SELECT bundle_id, CASE WHEN status = 'Contested' THEN 'Contested' WHEN factuality = 'Negated' THEN 'Negated' WHEN factuality = 'Asserted' AND evidence_count > 0 THEN 'Supported' ELSE 'Unsupported' END AS quality, count(*) AS claims FROM rendered GROUP BY ALL",
    "q_facts_by_entity_paged": f"""WITH claims AS ({claims_sql('customer', 'supplier', 'nation')}), hits AS (
        SELECT DISTINCT concat(' ', upper(n_name)) AS selector, claim_id FROM claims JOIN nation n ON concat('nation:', n_nationkey) IN (subj_val, obj_val)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY selector ORDER BY claim_id) AS rank, count(*) OVER (PARTITION BY selector) AS total FROM hits)
      SELECT selector, claim_id, rank::INT AS rank, total, total > 15 AS truncated FROM ranked WHERE rank > 5 AND rank <= 15""",
    "q_entity_labels": f"""WITH claims AS ({claims_sql('supplier', 'nation', 'part')}), l AS (SELECT concat('supplier:', s_suppkey) AS id, s_name AS name FROM supplier UNION ALL SELECT concat('nation:', n_nationkey), n_name FROM nation)
      SELECT claim_id AS claim, coalesce(a.name, subj_val) AS subject_label, coalesce(b.name, coalesce(obj_val, '')) AS object_label, coalesce(a.name, subj_val) AS shown FROM claims LEFT JOIN l a ON a.id = subj_val AND subj_kind = 'cluster' LEFT JOIN l b ON b.id = obj_val AND obj_kind = 'cluster'""",
    "q_fact_groups": _with("customer", "orders") + """, q AS (SELECT *, CASE WHEN status = 'Contested' THEN 'Contested' WHEN factuality = 'Negated' THEN 'Negated' WHEN factuality = 'Asserted' AND evidence_count > 0 THEN 'Supported' ELSE 'Unsupported' END AS quality FROM rendered)
      SELECT bundle_id, object, quality, count(*) AS facts, max(confidence) AS best_confidence, list_position(['Supported', 'Contested', 'Negated', 'Unsupported'], quality)::INT AS group_rank FROM q GROUP BY ALL""",
    "q_ambiguous_names": """SELECT bundle_id, name, meanings FROM (SELECT entity_kind AS bundle_id, lower(trim(alias)) AS name, count(DISTINCT lower(trim(canonical_name))) AS meanings
      FROM (SELECT *, unnest(list_distinct([canonical_name, split_part(canonical_name, ' ', 1)])) AS alias FROM entity_ref) GROUP BY ALL) WHERE meanings > 1""",
    "q_entity_links": """WITH m AS (SELECT * FROM mention_resolution_profile WHERE mention_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at DESC NULLS LAST, exact_surface DESC NULLS LAST, normalized_surface DESC NULLS LAST) = 1),
      n AS (SELECT lower(canonical_name) AS k, min(entity_id) AS low, max(entity_id) AS high FROM entity_ref GROUP BY 1)
      SELECT mention_id, coalesce(b.high, a.low) AS cluster_id FROM m LEFT JOIN n a ON lower(m.exact_surface) = a.k LEFT JOIN n b ON m.normalized_surface = b.k WHERE coalesce(b.high, a.low) IS NOT NULL""",
    "q_frame_triples": f"""WITH r AS (SELECT * FROM (VALUES {', '.join(str(r) for r in K.FRAME_RULES)}) AS r(frame_type, s_role, pred_kind, predicate, o_role)), o AS (SELECT *, ({FRAME_KINDS})[(o_custkey % {len(FRAME_KINDS)} + 1)::INT] AS frame_type FROM orders)
      SELECT o_orderkey AS frame_id, lower(s_role) || ':' || o_orderkey AS subject, pred_kind, predicate, CASE WHEN frame_type = 'Statement' AND o_orderkey % 3 = 0 THEN o_custkey::VARCHAR ELSE lower(o_role) || ':' || o_orderkey END AS object FROM o JOIN r USING (frame_type) WHERE o_orderstatus <> 'P'""",
    "q_value_text": """SELECT p_partkey, CASE p_partkey % 6
        WHEN 0 THEN (CASE WHEN p_size % 2 = 0 AND p_size <> 0 THEN '-' ELSE '' END) || CASE WHEN p_size % 4 > 0 THEN left(d, (length(d) - p_size % 4)::INT) || '.' || right(d, (p_size % 4)::INT) ELSE d END
        WHEN 1 THEN concat(p_size, '..', p_size + 5) WHEN 2 THEN concat(p_size, ' kg')
        WHEN 3 THEN concat_ws('-', lpad((1900 + p_size)::VARCHAR, 4, '0'), CASE WHEN p_size % 3 > 0 THEN lpad((p_size % 12 + 1)::VARCHAR, 2, '0') END)
        WHEN 4 THEN 'every day' ELSE p_name END AS value
      FROM (SELECT *, lpad(p_size::VARCHAR, greatest(length(p_size::VARCHAR), p_size % 4 + 1)::INT, '0') AS d FROM part)""",
}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
