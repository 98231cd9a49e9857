"""Queries of the problems on text, over their whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.sources.tables import current_rows, table

from . import codepoints, langid, leakage, packing, sentences, truncation, unify


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return unify.surface_matches(table(spark, sf, "mention_resolution_profile"), table(spark, sf, "entity_ref"))


def p1_surface_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every consistent form of the exact surfaces: its mentions and the number of ways it is written."""
    mentions = current_rows(table(spark, sf, "mention_resolution_profile"), "mention_id", ["ingested_at"], ["exact_surface"])
    forms = unify.with_unified(mentions.where("exact_surface IS NOT NULL"), {"exact_surface": "form"})
    written = forms.groupBy("form", "exact_surface").agg(F.count("*").alias("n"))
    return written.groupBy("form").agg(F.sum("n").alias("mentions"), F.count("*").alias("spellings"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.segment(table(spark, sf, "documents")).select("doc_id", "start_byte", "end_byte")


def p2_units_by_language(spark: SparkSession, sf: str) -> DataFrame:
    units = sentences.segment(table(spark, sf, "documents"))
    return units.groupBy("lang", "boundary_kind").agg(F.count("*").alias("units"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"))


def p4_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(record_kind, record_id, label, text) of all documents and of the current row of each turn."""
    turns = current_rows(table(spark, sf, "debug_turn_context"), "turn_id", ["ingested_at"], ["detected_language", "input_text"])
    documents = table(spark, sf, "documents").where("doc_id IS NOT NULL")
    sides = [
        documents.select(F.lit("document").alias("record_kind"), F.col("doc_id").alias("record_id"), langid.normal_label(F.col("lang")).alias("label"), "text"),
        turns.select(F.lit("turn").alias("record_kind"), F.col("turn_id").alias("record_id"), langid.normal_label(F.col("detected_language")).alias("label"), F.col("input_text").alias("text")),
    ]
    return sides[0].unionByName(sides[1])


def p4_segments(spark: SparkSession, sf: str) -> DataFrame:
    texts = p4_texts(spark, sf)
    return langid.segments(texts, langid.fit(texts)).select("record_kind", "record_id", "label", "segment_no", "lang", F.round("confidence", 4).alias("confidence"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = p4_texts(spark, sf)
    return langid.label_cases(langid.segments(texts, langid.fit(texts))).select("record_kind", "record_id", "segment_no", "lang")


def p6_assignments(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "context_budget"))


def p6_usage(spark: SparkSession, sf: str) -> DataFrame:
    return packing.usage(p6_assignments(spark, sf))


def p7_passages(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_passages(spark, sf).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_documents(table(spark, sf, "documents"))


def p8_cut_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf, "documents"))


def p8_cut_rules(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_rules(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_surface_forms, p2_found, p2_units_by_language, p4_found, p4_segments, p6_assignments, p6_usage, p7_found, p7_passages, p8_found, p8_cut_rates, p8_cut_rules]
    return {f.__name__: f for f in own}


# Letters with accents that print alike, other script -> Latin, and ligatures.
ACCENTED = {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ѐ": "è", "Ѐ": "È", "ά": "á", "ί": "í", "ό": "ó", "ύ": "ú", "Ά": "Á", "Έ": "É", "Ό": "Ó"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _unified_sql(column: str) -> str:
    """The consistent form of a column for DuckDB, from its own normal form and lists of characters, for the scripts of the names."""
    wide = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    single = codepoints.LOOK_ALIKES | ACCENTED | wide
    text = lambda values: "".join(values).replace("'", "''")
    out = f"regexp_replace({column}, '[\\p{{Cf}}\\x{{34f}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    out = f"translate(regexp_replace(regexp_replace({out}, '[\\p{{Zs}}\\t]', ' ', 'g'), '[{codepoints.HYPHENS}]', '-', 'g'), '{text(single)}', '{text(single.values())}')"
    for a, b in LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


def oracle_sql() -> dict[str, str]:
    current = "(SELECT * FROM mention_resolution_profile WHERE mention_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY ingested_at DESC NULLS LAST, exact_surface DESC NULLS LAST) = 1)"
    judged = f"({truncation.duckdb_sql()})"
    return {
        "p1_found": f"""WITH s AS (SELECT mention_id, 'exact_surface' AS field_name, exact_surface AS surface FROM mention_resolution_profile UNION SELECT mention_id, 'normalized_surface', normalized_surface FROM mention_resolution_profile),
      n AS (SELECT entity_id, 'exact_surface' AS field_name, canonical_name AS name FROM entity_ref UNION ALL SELECT entity_id, 'normalized_surface', lower(canonical_name) FROM entity_ref)
      SELECT DISTINCT mention_id, field_name, entity_id FROM (SELECT *, {_unified_sql('surface')} AS look FROM s WHERE mention_id IS NOT NULL AND surface <> '') JOIN (SELECT *, {_unified_sql('name')} AS look FROM n WHERE entity_id IS NOT NULL) USING (field_name, look) WHERE surface <> name""",
        "p1_surface_forms": f"SELECT form, count(*) AS mentions, count(DISTINCT exact_surface) AS spellings FROM (SELECT exact_surface, {_unified_sql('exact_surface')} AS form FROM {current} WHERE exact_surface IS NOT NULL) GROUP BY form",
        "p8_found": f"SELECT DISTINCT doc_id FROM {judged} WHERE rule IS NOT NULL",
        "p8_cut_rates": truncation.SUMS_SQL.replace("{judged}", judged),
        "p8_cut_rules": f"SELECT rule, count(*) AS texts FROM {judged} GROUP BY rule",
    }
