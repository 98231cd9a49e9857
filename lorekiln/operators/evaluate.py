"""Evaluation: ratios, multiset recall, alignment, overlap, run comparison, glossary, corpus checks, learner merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def symmetric_ratio(a: Column, b: Column) -> Column:
    """Smaller over greater; 1 if both are 0."""
    top = F.greatest(a, b)
    return F.when(top == 0, F.lit(1.0)).otherwise(F.least(a, b) / top)


def multiset_recall(expected: DataFrame, actual: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, matched, expected, recall): the sum of the smaller counts over that of the expected ones."""
    want = expected.groupBy(*by, item).agg(F.count("*").alias("want"))
    have = actual.groupBy(*by, item).agg(F.count("*").alias("have"))
    joined = want.join(have, [*by, item], "left")
    total = joined.groupBy(*by).agg(F.sum(F.least("want", F.coalesce("have", F.lit(0)))).alias("matched"), F.sum("want").alias("expected"))
    return total.withColumn("recall", F.round(F.col("matched") / F.col("expected"), 6))


def alignment(left: DataFrame, right: DataFrame, by: list[str], ordinal: str, value: str) -> DataFrame:
    """Share of ordinals at which both sides have the same value; Approximate where lengths differ."""
    a = left.select(*by, ordinal, F.col(value).alias("a"), F.lit(1).alias("in_a"))
    b = right.select(*by, ordinal, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, [*by, ordinal], "full")
    per = both.groupBy(*by).agg(F.count("in_a").alias("left_n"), F.count("in_b").alias("right_n"), F.sum((F.col("a") == F.col("b")).cast("int")).alias("same"))
    return per.select(*by, "left_n", "right_n", F.coalesce("same", F.lit(0)).alias("same"), F.round(F.coalesce("same", F.lit(0)) / F.greatest("left_n", "right_n"), 6).alias("ratio"), F.when(F.col("left_n") == F.col("right_n"), "Exact").otherwise("Approximate").alias("status"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct members of the first array that the second has; 1 for an empty first."""
    first = F.array_distinct(a)
    return F.when(F.size(first) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(first, b)) / F.size(first))


def exact_match(output: Column, references: Column) -> Column:
    """Whether the normalised output equals any normalised reference."""
    normal = lambda x: F.array_join(F.filter(F.split(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != ""), " ")
    return F.exists(references, lambda r: normal(r) == normal(output))


def role_signature(frame: Column, roles: Column) -> Column:
    """``frame(role=filler,...)`` with sorted roles; proper names (upper-case initial) are marked."""
    return F.concat(frame, F.lit("("), F.array_join(F.array_sort(F.transform(roles, lambda r: F.concat(r.role, F.lit("="), r.filler, F.when(r.filler.rlike(r"^\p{Lu}"), "!").otherwise("")))), ","), F.lit(")"))


def compare_runs(baseline: DataFrame, run: DataFrame) -> DataFrame:
    """Per case Added, Missing, Improved, Regressed or Unchanged over all its metrics.

    Both: case_id, metric, value. A case better on one and worse on another
    metric is Unchanged and flagged ``mixed``; Regressed and Missing are critical.
    """
    a = baseline.select("case_id", "metric", F.col("value").alias("before"))
    b = run.select("case_id", "metric", F.col("value").alias("after"))
    both = a.join(b, ["case_id", "metric"], "full")
    change = F.col("after") - F.col("before")
    per = both.groupBy("case_id").agg(
        F.count("before").alias("before_n"), F.count("after").alias("after_n"), F.coalesce(F.max((change > EPSILON).cast("int")), F.lit(0)).alias("better"), F.coalesce(F.max((change < -EPSILON).cast("int")), F.lit(0)).alias("worse")
    )
    outcome = (
        F.when(F.col("before_n") == 0, "Added")
        .when(F.col("after_n") == 0, "Missing")
        .when((F.col("better") == 1) & (F.col("worse") == 0), "Improved")
        .when((F.col("better") == 0) & (F.col("worse") == 1), "Regressed")
        .otherwise("Unchanged")
    )
    out = per.select("case_id", outcome.alias("outcome"), ((F.col("better") == 1) & (F.col("worse") == 1)).alias("mixed"))
    return out.withColumn("critical", F.col("outcome").isin("Regressed", "Missing"))


def glossary(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Per term: uses and documents, against its least number of uses and forbidden forms.

    ``terms``: term_id, form, forbidden, minimum. Words are counted once for
    all terms, then joined, so no term scans the texts again.
    """
    from .lexicon import words

    uses = documents.select("doc_id", F.explode(words(F.col("text"))).alias("form")).groupBy("form", "doc_id").agg(F.count("*").alias("n"))
    per = uses.groupBy("form").agg(F.sum("n").alias("uses"), F.count("*").alias("documents"))
    joined = terms.join(per, "form", "left").select("term_id", "form", "forbidden", "minimum", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return joined.withColumn("verdict", F.when(F.col("forbidden") & (F.col("uses") > 0), "Forbidden").when(~F.col("forbidden") & (F.col("uses") < F.col("minimum")), "TooFew").otherwise("Kept"))


def invariants(documents: DataFrame) -> DataFrame:
    """(doc_id, invariant, holds): one predicate per kind over a text and what was stored of it."""
    from .segment import paragraph_count, sentence_count

    checks = {
        "HashMatches": F.col("content_sha256").isNull() | (F.sha2("text", 256) == F.col("content_sha256")),
        "LengthMatches": F.col("n_chars") == F.length("text"),
        "HasParagraph": paragraph_count(F.col("text")) > 0,
        "HasSentence": sentence_count(F.col("text")) > 0,
        "PreservesNumber": ~F.col("title").rlike(r"\d") | (F.regexp_extract("title", r"(\d+)", 1) == "") | F.contains("text", F.regexp_extract("title", r"(\d+)", 1)),
        "HasTitle": F.col("title").isNotNull(),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("invariant"), F.coalesce(v, F.lit(False)).alias("holds")) for k, v in checks.items()]))
    return documents.where(F.col("text").isNotNull()).select("doc_id", pairs.alias("c")).select("doc_id", "c.invariant", "c.holds")


def corpus_errors(cases: DataFrame, minimum: int) -> DataFrame:
    """(error, subject, n): repeated ids and sources, ids out of order, splits with too few cases."""
    same_id = cases.groupBy(F.lit("DuplicateId").alias("error"), F.col("item_id").cast("string").alias("subject")).agg(F.count("*").alias("n")).where("n > 1")
    same_text = cases.groupBy(F.lit("DuplicateSource").alias("error"), F.sha2("text", 256).alias("subject")).agg(F.count("*").alias("n")).where("n > 1")
    split = cases.groupBy(F.lit("SplitTooSmall").alias("error"), F.concat_ws("/", "corpus_id", "eval_split").alias("subject")).agg(F.count("*").alias("n")).where(F.col("n") < minimum)
    return same_id.unionByName(same_text).unionByName(split)


def merge_proposals(evidence: DataFrame) -> DataFrame:
    """Per word over ordered sources: the first concept and gloss that isn't null, the best-scored concept, all sources once.

    ``evidence``: word, source_order, source, concept, gloss, score.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("source_order", c)))
    return evidence.groupBy("word").agg(
        first("concept").alias("c"), first("gloss").alias("g"), F.max(F.when(F.col("concept").isNotNull(), F.struct("score", "concept"))).alias("b"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    ).select("word", F.col(f"c.concept").alias("first_concept"), "g.gloss", F.col("b.concept").alias("best_concept"), F.col("b.score").alias("best_score"), "sources")


def new_words(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct words of more than two bytes that the lexicon lacks, with their first document and uses."""
    from .lexicon import words

    found = documents.select("doc_id", F.explode(words(F.col("text"))).alias("word")).where((F.octet_length("word") > 2) & F.col("word").rlike(r"^[\p{L}\p{N}]+$"))
    per = found.groupBy("word").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses"))
    return per.join(known.select(F.col("form").alias("word")).distinct(), "word", "left_anti")


def metric_rows(df: DataFrame, case: str, metrics: dict[tuple[str, str], tuple[Column, Column]]) -> DataFrame:
    """(case_id, metric_group, metric, numerator, denominator, value, status) of every metric of every case.

    A metric is a numerator over a denominator; over 0 it is 1 and Empty, with a
    null part null and Unavailable, else Exact.
    """
    one = [F.struct(F.lit(g).alias("metric_group"), F.lit(m).alias("metric"), n.cast("double").alias("numerator"), d.cast("double").alias("denominator")) for (g, m), (n, d) in metrics.items()]
    rows = df.select(F.col(case).alias("case_id"), F.inline(F.array(*one)))
    missing = F.col("numerator").isNull() | F.col("denominator").isNull()
    value = F.when(missing, None).when(F.col("denominator") == 0, 1.0).otherwise(F.round(F.col("numerator") / F.col("denominator"), 6))
    return rows.withColumn("value", value).withColumn("status", F.when(missing, "Unavailable").when(F.col("denominator") == 0, "Empty").otherwise("Exact"))


def failures(rows: DataFrame) -> DataFrame:
    """Metric rows below 0.9 with their severity: fatal below 0.25, major below 0.6, else minor."""
    return rows.where("value < 0.9").withColumn("severity", F.when(F.col("value") < 0.25, "fatal").when(F.col("value") < 0.6, "major").otherwise("minor"))


def metric_summary(rows: DataFrame) -> DataFrame:
    """Per metric: cases, mean, least value and failures of each severity."""
    per = rows.groupBy("metric_group", "metric").agg(F.count("value").alias("cases"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"))
    n = lambda s: F.sum((F.col("severity") == s).cast("int"))
    bad = failures(rows).groupBy("metric_group", "metric").agg(n("fatal").alias("fatal"), n("major").alias("major"), n("minor").alias("minor"))
    return per.join(bad, ["metric_group", "metric"], "left").na.fill(0, ["fatal", "major", "minor"])


def top_failures(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` worst rows: fatal before major before minor, then by value, metric and case."""
    rank = F.when(F.col("severity") == "fatal", 0).when(F.col("severity") == "major", 1).otherwise(2)
    return failures(rows).orderBy(rank, "value", "metric_group", "metric", "case_id").limit(n)


def concept_by_label(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(word, concept, score): the concept whose label equals a word, capitals aside, at 0.9; the least id if several do."""
    named = entries.where("label IS NOT NULL").groupBy(F.upper("label").alias("key")).agg(F.min("id").alias("concept"))
    return words.withColumn("key", F.upper("word")).join(named, "key").select("word", "concept", F.lit(0.9).alias("score"))


def year_numbers(tokens: DataFrame, reach: int = 2) -> DataFrame:
    """(doc_id, position, token, score): numbers with ``age`` or ``year`` at most ``reach`` words away mean a year, at 0.75.

    Each cue word marks its neighbours' places, which are then joined; no token meets all others.
    """
    near = tokens.where(F.col("token").rlike("^(age|ages|year|years|rok|roku|lat|lata)$")).select("doc_id", F.explode(F.array(*[F.col("position") + k for k in range(-reach, reach + 1) if k])).alias("position")).distinct()
    return tokens.where(F.col("token").rlike("^[0-9]+$")).join(near, ["doc_id", "position"], "left_semi").select("doc_id", "position", "token", F.lit(0.75).alias("score"))
