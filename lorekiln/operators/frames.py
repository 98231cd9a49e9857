"""Sentence templates to frames, question semantics, compilation status and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Template, frame, roles of its groups.
TEMPLATES = [
    (r"^(?:The )?(.+?) is the capital of (.+?)[.!?]*$", "CAPITAL_OF", ("Subject", "Object")),
    (r"^(.+?) lies \d+ kilometres from (.+?)[.!?]*$", "LOCATED_NEAR", ("Subject", "Object")),
    (r"^(.+?) works for (.+?) in (.+?)[.!?]*$", "WORKS_FOR", ("Subject", "Object", "Location")),
    (r"^(.+?) was born in (.+?)[.!?]*$", "BORN_IN", ("Subject", "Object")),
    (r"^(.+?) sends (.+?) to (.+?)[.!?]*$", "Transfer", ("Agent", "Theme", "Recipient")),
    (r"^(.+?) has had an? (.+?) since (\d{4})[.!?]*$", "Possession", ("Agent", "Theme", "Time")),
    (r"^(.+?) is (\d+) years old[.!?]*$", "Age", ("Theme", "Attribute")),
]
# Opening of a question, its kind and predicate.
QUESTIONS = [
    (r"^(?:what|which city) is the capital of", "What", "CAPITAL_OF"),
    (r"^where (?:is|does|was .+ born)|^gdzie", "Where", "LOCATED_IN"),
    (r"^when|^kiedy|^w którym roku", "When", "DATE_OF"),
    (r"^how many|^how far|^ilu|^ile", "HowMany", "POPULATION"),
    (r"^who|^kto", "Who", "IS_A"),
    (r"^does|^is|^czy", "YesNo", "IS_A"),
]


def template_frames(sentences: DataFrame) -> DataFrame:
    """(doc_id, ordinal, frame_type, roles MAP): the first template that fits; others give no row."""
    s = F.col("sentence")
    kind, roles = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for pattern, frame, names in reversed(TEMPLATES):
        fits = s.rlike(pattern)
        kind = F.when(fits, frame).otherwise(kind)
        roles = F.when(fits, F.create_map(*[x for k, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(s, pattern, k))])).otherwise(roles)
    return sentences.select("doc_id", "ordinal", kind.alias("frame_type"), roles.alias("roles")).where(F.col("frame_type").isNotNull())


def question_semantics(text: Column) -> Column:
    """Struct of the kind and predicate of a question; null for other texts."""
    low = F.lower(F.trim(text))
    out = F.lit(None).cast("struct<kind:string,predicate:string>")
    for pattern, kind, predicate in reversed(QUESTIONS):
        out = F.when(low.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(predicate).alias("predicate"))).otherwise(out)
    return F.when(F.contains(low, F.lit("?")), out)


def compile_status(failed: Column, frames: Column, unresolved: Column) -> Column:
    """Failed, Unresolved (no frame), Partial (frames and unresolved parts) or Resolved."""
    return F.when(failed, "Failed").when(frames == 0, "Unresolved").when(unresolved > 0, "Partial").otherwise("Resolved")


def coverage(compiled: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status, share compiled and share usable (Resolved or Partial) of all sentences."""
    is_ = lambda s: F.sum((F.col("status") == s).cast("int"))
    per = compiled.groupBy(*by).agg(F.count("*").alias("sentences"), *[is_(s).alias(s.lower()) for s in ("Failed", "Unresolved", "Partial", "Resolved")])
    return per.withColumn("compiled_ratio", F.round((F.col("sentences") - F.col("failed")) / F.col("sentences"), 6)).withColumn("usable_ratio", F.round((F.col("partial") + F.col("resolved")) / F.col("sentences"), 6))


def detect_by_parse(scores: DataFrame) -> DataFrame:
    """Language of each text by parse results: 1000 per question, 10 per frame, 1 per sentence; ties go to ``en``."""
    points = 1000 * F.col("questions") + 10 * F.col("frames") + F.col("sentences")
    return scores.groupBy("text_id").agg(F.max(F.struct(points.alias("points"), (F.col("lang") == "en").alias("en"), "lang")).alias("b")).select("text_id", "b.lang", "b.points")


def missing_capabilities(required: Column, supported: Column) -> Column:
    return F.array_except(required, supported)


def liquid_rule(frame: Column, is_liquid: Column) -> Column:
    """Eating something liquid is drinking."""
    return F.when((frame == "EAT") & is_liquid, "DRINK").otherwise(frame)


# Stages of a compilation in their order, and severities.
STAGES, SEVERITIES = ["segmentation", "parse", "semantics"], ["error", "warning", "info"]


def diagnostics(framed: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, stage, severity, code, place): what a compilation has to say of each sentence, in the order of stage, severity and code.

    NoTerminal, LongSentence (over 40 words), UnresolvedSentence, EmptyRole,
    RepeatedFiller, QuestionFrame. ``framed``: doc_id, sentence_no, sentence, frame_type, roles.
    """
    fillers = F.transform("roles", lambda r: F.lower(r.filler))
    checks = [
        ("segmentation", "info", "NoTerminal", ~F.col("sentence").rlike("[.!?…][\"'”’»)\\]}]*$")),
        ("segmentation", "warning", "LongSentence", F.size(F.split("sentence", r"[ \t\n\r\f]+")) > 40),
        ("parse", "warning", "UnresolvedSentence", F.col("frame_type").isNull()),
        ("semantics", "error", "EmptyRole", F.exists("roles", lambda r: r.filler == "")),
        ("semantics", "warning", "RepeatedFiller", F.size(F.array_distinct(fillers)) < F.size(fillers)),
        ("semantics", "info", "QuestionFrame", F.col("frame_type").isNotNull() & F.endswith("sentence", F.lit("?"))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(STAGES.index(a)).alias("a"), F.lit(SEVERITIES.index(b)).alias("b"), F.lit(c).alias("code"))) for a, b, c, test in checks]))
    name = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    rows = framed.select("doc_id", "sentence_no", F.posexplode(F.array_sort(found)).alias("place", "d"))
    return rows.select("doc_id", "sentence_no", name(STAGES, F.col("d.a")).alias("stage"), name(SEVERITIES, F.col("d.b")).alias("severity"), "d.code", "place")


def inspection(framed: DataFrame) -> DataFrame:
    """Per document: sentences, resolved ones, frames of each kind of meaning, roles, distinct fillers, questions."""
    n = lambda c: F.sum(c.cast("int"))
    roles = framed.select("doc_id", F.explode("roles").alias("r"))
    per = framed.groupBy("doc_id").agg(F.count("*").alias("sentences"), n(F.col("frame_type").isNotNull()).alias("frames"), n(F.endswith("sentence", F.lit("?"))).alias("questions"), F.count_distinct("frame_type").alias("frame_types"), F.sum(F.coalesce(F.size("roles"), F.lit(0))).alias("roles"))
    return per.join(roles.groupBy("doc_id").agg(F.count_distinct(F.lower("r.filler")).alias("fillers")), "doc_id", "left").na.fill(0, ["fillers"])


def compile_sentences(sentences: DataFrame, compiler, schema: str = "string") -> DataFrame:  # noqa: ANN001
    """(doc_id, sentence_no, status, payload, error): a Python compiler run over all sentences; one that raises gives a Failed row, nothing else is lost.

    ``compiler`` maps a sentence to its payload as text, or to None where it finds nothing (Unresolved).
    """

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            status, payload, error = [], [], []
            for text in batch.column(2).to_pylist():
                try:
                    made, wrong = compiler(text), None
                except Exception as e:  # noqa: BLE001 - any failure belongs to its sentence
                    made, wrong = None, f"{type(e).__name__}: {e}"
                status.append("Failed" if wrong else "Unresolved" if made is None else "Resolved")
                payload.append(made), error.append(wrong)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in (status, payload, error))], names=["doc_id", "sentence_no", "status", "payload", "error"])

    rows = sentences.select(F.col("doc_id").cast("bigint"), F.col("sentence_no").cast("int"), "sentence")
    return rows.mapInArrow(run, "doc_id bigint, sentence_no int, status string, payload string, error string")


def event_profiles(mentions: DataFrame) -> DataFrame:
    """Each frame as an event: polarity, whether it was asked, participants and their names. ``mentions`` as of the document graph."""
    per = mentions.groupBy("doc_id", "frame_no", "sentence_no", "frame_type", "factuality").agg(F.count("*").alias("participants"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role_ordinal", "normalized_name"))), lambda x: x.normalized_name), "|").alias("names"))
    return per.select("doc_id", F.col("frame_no").alias("event_no"), "sentence_no", "frame_type", F.when(F.col("factuality") == "Negated", "Negative").otherwise("Positive").alias("polarity"), (F.col("factuality") == "Questioned").alias("asked"), "participants", "names")
