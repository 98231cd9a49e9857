"""Knowledge extraction: frames to claims, signatures, deduplication, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Predicates that have one object.
FUNCTIONAL = ["CAPITAL_OF", "POPULATION", "DATE_OF"]

# Frame, subject role, predicate kind, predicate, object role.
FRAME_RULES = [
    ("Statement", "Theme", "HasProperty", "", "Attribute"),
    ("Location", "Theme", "LocatedAt", "", "Location"),
    ("Possession", "Agent", "Owns", "", "Theme"),
    ("Motion", "Agent", "MovesTo", "", "Goal"),
    ("Creation", "Agent", "Creates", "", "Theme"),
    ("Consumption", "Agent", "Destroys", "", "Patient"),
    ("Perception", "Experiencer", "Perceives", "", "Stimulus"),
    ("Communication", "Agent", "Says", "", "Message"),
    ("Action", "Agent", "ActsOn", "", "Patient"),
    ("Existence", "Theme", "Exists", "", "Location"),
    ("Emotion", "Experiencer", "Feels", "", "Stimulus"),
    ("CAPITAL_OF", "Subject", "Custom", "CAPITAL_OF", "Object"),
    ("LOCATED_IN", "Subject", "Custom", "LOCATED_IN", "Object"),
    ("CREATED_BY", "Subject", "Custom", "CREATED_BY", "Object"),
    ("BORN_IN", "Subject", "Custom", "BORN_IN", "Object"),
    ("WORKS_FOR", "Subject", "Custom", "WORKS_FOR", "Object"),
]


def frame_triples(frames: DataFrame, roles: DataFrame) -> DataFrame:
    """(frame_id, subject, pred_kind, predicate, object) of mapped frames; a numeric quantifier stands for a Statement's object.

    ``frames``: frame_id, frame_type, quantity; ``roles``: frame_id, role, filler.
    Frames of other types (Transfer) and frames without subject give no row.
    """
    rules = frames.sparkSession.createDataFrame(FRAME_RULES, "frame_type string, s_role string, pred_kind string, predicate string, o_role string")
    filler = roles.groupBy("frame_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("role", "filler")))).alias("by_role"))
    joined = frames.join(rules, "frame_type").join(filler, "frame_id")
    value = F.when((F.col("frame_type") == "Statement") & F.col("quantity").isNotNull(), F.col("quantity").cast("string")).otherwise(F.try_element_at("by_role", F.col("o_role")))
    return joined.select("frame_id", F.try_element_at("by_role", F.col("s_role")).alias("subject"), "pred_kind", "predicate", value.alias("object")).where(F.col("subject").isNotNull())


def factuality(question: Column, negated: Column) -> Column:
    """Questioned before Negated before Asserted."""
    return F.when(question, "Questioned").when(negated, "Negated").otherwise("Asserted")


def claim_status(column: str = "factuality") -> Column:
    return F.when(F.col(column) == "Asserted", "Supported").when(F.col(column) == "Negated", "Contradicted").otherwise("NonFactual")


def signature(*parts: str) -> Column:
    """SHA-256 of the parts; a null and an empty part differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("0")) for p in parts]), 256)


def dedupe(occurrences: DataFrame, parts: list[str]) -> DataFrame:
    """One claim per signature: the first occurrence wins, all are counted, the greatest confidence is kept."""
    signed = occurrences.withColumn("signature", signature(*parts))
    first = F.min(F.struct("occ_ord", *parts, "factuality")).alias("f")
    grouped = signed.groupBy("signature").agg(first, F.count("*").alias("occurrences"), F.max("confidence_milli").alias("confidence_milli"))
    return grouped.select("signature", F.col("f.occ_ord").alias("first_occurrence"), *[F.col(f"f.{p}").alias(p) for p in parts], F.col("f.factuality").alias("factuality"), "occurrences", "confidence_milli").withColumn("status", claim_status())


def contradictions(claims: DataFrame, functional: list[str] | None = None) -> DataFrame:
    """Groups of (subject, predicate, world) with at least two claims of which one is negated, or, for functional predicates, with several objects.

    Unresolved subjects say nothing about one thing and are left out.
    """
    functional = FUNCTIONAL if functional is None else functional
    groups = claims.where(F.col("subj_kind") != "Unresolved").groupBy("subj_kind", "subj_val", "pred_val", "world").agg(
        F.count("*").alias("claims"),
        F.max((F.col("factuality") == "Negated").cast("int")).alias("negated"),
        F.count_distinct("obj_kind", "obj_val").alias("objects"),
    )
    kind = F.when(F.col("negated") == 1, "Polarity").when(F.col("pred_val").isin(functional) & (F.col("objects") > 1), "FunctionalValue")
    return groups.withColumn("kind", kind).where((F.col("claims") >= 2) & F.col("kind").isNotNull())


def contest(claims: DataFrame, sets: DataFrame) -> DataFrame:
    """Claims with status Contested where their group is contradictory."""
    key = ["subj_kind", "subj_val", "pred_val", "world"]
    return claims.join(sets.select(*key, F.lit(True).alias("hit")), key, "left").withColumn("status", F.when(F.col("hit"), "Contested").otherwise(F.col("status"))).drop("hit")


def link_entities(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster of each mention: by its id, else by concept and lower-case name (a null name never matches); the first cluster by id.

    ``mentions``: mention_id, entity_id, concept, name; ``clusters``: cluster_id, entity_id, concept, canonical_name.
    """
    by_id = clusters.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.min("cluster_id").alias("by_id"))
    by_name = clusters.where(F.col("canonical_name").isNotNull()).groupBy("concept", F.lower("canonical_name").alias("key")).agg(F.min("cluster_id").alias("by_name"))
    keyed = mentions.withColumn("key", F.lower("name"))
    return keyed.join(by_id, "entity_id", "left").join(by_name, ["concept", "key"], "left").select("mention_id", F.coalesce("by_id", "by_name").alias("cluster_id"))


def decimal_normal(sign: Column, mantissa: Column) -> Column:
    """The sign of a decimal; zero is positive."""
    return F.when(mantissa == 0, F.lit(1)).otherwise(sign)


#: Fixed value: confidence of an occurrence.
CONFIDENCE = 700


def occurrences(mentions: DataFrame) -> DataFrame:
    """Propositions of all documents from the mentions of their frames.

    Columns: doc_id, occ_no (by frame), sentence_no, frame_no, subject,
    pred_kind, predicate, object, factuality, world, confidence_milli, evidence
    (mentions of the sentence that bear the subject's or object's name, by
    number) and spans (theirs, by place). Frames of unmapped types and frames
    without subject give none.
    """
    keys = ["doc_id", "frame_no"]
    frames = mentions.select(*keys, "sentence_no", "frame_type", "factuality").distinct().withColumn("frame_id", F.struct(*keys)).withColumn("quantity", F.lit(None).cast("string"))
    roles = mentions.select(F.struct(*keys).alias("frame_id"), "role", F.col("name").alias("filler"))
    triples = frame_triples(frames, roles).join(frames.select("frame_id", *keys, "sentence_no", "factuality"), "frame_id")
    names = triples.select("frame_id", "doc_id", "sentence_no", F.explode(F.array_distinct(F.array_compact(F.array("subject", "object")))).alias("name")).withColumn("normalized_name", F.lower(F.regexp_replace(F.trim("name"), r"\s+", " ")))
    found = names.join(mentions.select("doc_id", "sentence_no", "normalized_name", "mention_no", "start_byte", "end_byte"), ["doc_id", "sentence_no", "normalized_name"])
    cited = found.groupBy("frame_id").agg(F.array_sort(F.collect_set("mention_no")).alias("evidence"), F.array_sort(F.collect_set(F.struct("start_byte", "end_byte"))).alias("spans"))
    world = F.when(F.col("factuality") == "Questioned", "Question").otherwise("Actual")
    rows = triples.join(cited, "frame_id", "left").withColumn("occ_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("frame_no")) - 1)
    return rows.select("doc_id", "occ_no", "sentence_no", "frame_no", "subject", "pred_kind", "predicate", "object", "factuality", world.alias("world"), F.lit(CONFIDENCE).alias("confidence_milli"), "evidence", "spans")


def document_claims(found: DataFrame) -> DataFrame:
    """Claims of the occurrences: the signature holds the source sentence, ``fact_key`` only what is said; opposed ones are Contested."""
    rows = found.withColumn("signature", signature("doc_id", "sentence_no", "subject", "pred_kind", "predicate", "object")).withColumn("fact_key", signature("subject", "pred_kind", "predicate", "object"))
    grouped = rows.groupBy("signature").agg(
        F.min(F.struct("doc_id", "occ_no", "sentence_no", "subject", "pred_kind", "predicate", "object", "factuality", "world", "fact_key")).alias("f"), F.count("*").alias("occurrences"), F.max("confidence_milli").alias("confidence_milli")
    )
    claims = grouped.select("signature", "f.*", "occurrences", "confidence_milli").withColumn("status", claim_status())
    named = claims.select("*", F.lit("text").alias("subj_kind"), F.col("subject").alias("subj_val"), F.concat("pred_kind", F.lit(":"), "predicate").alias("pred_val"), F.lit("text").alias("obj_kind"), F.col("object").alias("obj_val"))
    return contest(named, contradictions(named, [f"Custom:{p}" for p in FUNCTIONAL])).drop("subj_kind", "subj_val", "pred_val", "obj_kind", "obj_val")


def knowledge_summary(found: DataFrame, claims: DataFrame) -> DataFrame:
    """Per document: occurrences, those with evidence, questions, negations, claims, contested ones."""
    n = lambda c: F.sum(c.cast("int"))
    o = found.groupBy("doc_id").agg(F.count("*").alias("occurrences"), n(F.size("evidence") > 0).alias("with_evidence"), n(F.col("factuality") == "Questioned").alias("questioned"), n(F.col("factuality") == "Negated").alias("negated"))
    c = claims.groupBy("doc_id").agg(F.count("*").alias("claims"), n(F.col("status") == "Contested").alias("contested"))
    return o.join(c, "doc_id", "left")


def knowledge_errors(found: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, error, subject): occurrences without a claim, claims without an occurrence, repeated numbers, spans that end before they begin."""
    key = ["doc_id", "sentence_no", "subject", "pred_kind", "predicate", "object"]
    signed = found.withColumn("signature", signature(*key))
    say = lambda df, error, what: df.select("doc_id", F.lit(error).alias("error"), F.col(what).cast("string").alias("subject"))
    return (
        say(signed.join(claims.select("signature"), "signature", "left_anti"), "MissingClaim", "occ_no")
        .unionByName(say(claims.join(signed.select("signature"), "signature", "left_anti"), "ClaimWithoutOccurrence", "signature"))
        .unionByName(say(found.groupBy("doc_id", "occ_no").count().where("count > 1"), "DuplicateOccurrence", "occ_no"))
        .unionByName(say(found.where(F.exists("spans", lambda x: x.start_byte >= x.end_byte)), "EmptySpan", "occ_no"))
    )


def evidence_detail(claims: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """Each claim with every span that supports it and where it stands: title, source and revision; claims without a valid span have no row."""
    key = ["doc_id", "sentence_no", "subject", "pred_kind", "predicate", "object"]
    spans = found.withColumn("signature", signature(*key)).select("signature", "doc_id", "occ_no", F.explode("spans").alias("s")).where("s.start_byte >= 0 AND s.start_byte < s.end_byte")
    about = documents.select("doc_id", "title", F.col("source").alias("uri"), "revision", F.octet_length("text").alias("size"))
    rows = claims.select("signature", "status").join(spans, "signature").join(about, "doc_id").where("s.end_byte <= size")
    return rows.select("signature", "status", "doc_id", "occ_no", "s.start_byte", "s.end_byte", "title", "uri", "revision")
