"""Text out of frames: best-effort translation of documents, with its checks.

A frame is put into words by a pattern of its type and the target language. A
sentence without a frame or pattern is copied, or stands as a placeholder, as
asked; blanks around sentences and between paragraphs stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A sentence for each frame type and language; {k} is its k-th role.
PATTERNS = {
    "pl": {"CAPITAL_OF": "{2} ma stolicę: {1}", "LOCATED_NEAR": "{1} leży niedaleko: {2}", "WORKS_FOR": "{1} pracuje dla: {2}, miejsce: {3}", "BORN_IN": "{1}, miejsce urodzenia: {2}", "Transfer": "{1} wysyła: {2}, odbiorca: {3}", "Possession": "{1} ma: {2}, od {3}", "Age": "{1}: {2} lat"},
    "en": {"CAPITAL_OF": "{1} is the capital of {2}", "LOCATED_NEAR": "{1} lies near {2}", "WORKS_FOR": "{1} works for {2} in {3}", "BORN_IN": "{1} was born in {2}", "Transfer": "{1} sends {2} to {3}", "Possession": "{1} has had {2} since {3}", "Age": "{1} is {2} years old"},
}


def realised(language: str) -> Column:
    """The words of ``frame_type`` with ``roles``; null without a frame, a pattern or one of its roles."""
    out = F.lit(None).cast("string")
    for frame, pattern in PATTERNS[language].items():
        pieces = []
        for text, role in _parts(pattern):
            pieces += [F.lit(text)] if text else []
            pieces += [F.nullif(F.try_element_at("roles", F.lit(role)).filler, F.lit(""))] if role else []
        out = F.when(F.col("frame_type") == frame, F.concat(*pieces)).otherwise(out)
    return out


def _parts(pattern: str) -> list[tuple[str, int]]:
    parts, rest = [], pattern
    while "{" in rest:
        text, _, rest = rest.partition("{")
        number, _, rest = rest.partition("}")
        parts.append((text, int(number)))
    return [*parts, (rest, 0)] if rest else parts


def translated_sentences(framed: DataFrame, language: str, fallback: str = "CopySource") -> DataFrame:
    """(doc_id, sentence_no, source, target, status): ``Generated`` with the source's last mark, ``CopySource`` or ``Placeholder``."""
    if fallback not in ("CopySource", "Placeholder"):
        raise ValueError(f"unknown fallback: {fallback}")
    made = F.concat(realised(language), F.regexp_extract("sentence", r"[.!?…]*\z", 0))
    other = F.col("sentence") if fallback == "CopySource" else F.concat(F.lit("[["), F.col("sentence_no").cast("string"), F.lit("]]"))
    return framed.select("doc_id", "sentence_no", "start_byte", "end_byte", F.col("sentence").alias("source"), F.coalesce(made, other).alias("target"), F.when(made.isNull(), fallback).otherwise("Generated").alias("status"))


def translated_documents(documents: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, text, generated, copied): each text with its sentences replaced in place; all between them stays.

    The sentences of a document are gathered in its row, and the text is cut once.
    """
    parts = sentences.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "target"))).alias("parts"),
        F.sum((F.col("status") == "Generated").cast("int")).alias("generated"), F.sum((F.col("status") != "Generated").cast("int")).alias("copied"),
    )
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.encode("text", "utf-8").alias("bytes"))
    before = F.zip_with("parts", F.concat(F.array(F.lit(0).cast("bigint")), F.transform("parts", lambda p: p.end_byte)), lambda p, at: F.concat(F.substring("bytes", at.cast("int") + 1, (p.start_byte - at).cast("int")).cast("string"), p.target))
    tail = F.substring("bytes", F.element_at("parts", -1).end_byte.cast("int") + 1, F.octet_length("bytes")).cast("string")
    text = F.concat(F.array_join(F.filter(before, lambda x: x.isNotNull()), ""), tail)
    rows = docs.join(parts, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(text, F.col("bytes").cast("string")).alias("text"), F.coalesce("generated", F.lit(0)).alias("generated"), F.coalesce("copied", F.lit(0)).alias("copied"))


def translation_errors(framed: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, error): MissingSentence, UnknownSentence, EmptyTarget, ChangedCopy (a copy that isn't its source), LostMark (a generated sentence without the source's terminal)."""
    key = ["doc_id", "sentence_no"]
    say = lambda df, e: df.select(*key, F.lit(e).alias("error"))
    mark = F.regexp_extract("source", r"[.!?…]*\z", 0)
    return (
        say(framed.join(sentences.select(*key), key, "left_anti"), "MissingSentence")
        .unionByName(say(sentences.join(framed.select(*key), key, "left_anti"), "UnknownSentence"))
        .unionByName(say(sentences.where("target IS NULL OR trim(target) = ''"), "EmptyTarget"))
        .unionByName(say(sentences.where("status = 'CopySource' AND target <> source"), "ChangedCopy"))
        .unionByName(say(sentences.where((F.col("status") == "Generated") & ~F.endswith("target", mark)), "LostMark"))
    )
