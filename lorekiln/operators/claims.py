"""The claim query algebra: scan, filter tree, projection, distinct, count, order, limit, evidence, answer.

Claims: bundle_id, claim_id, ordinal, subj_kind, subj_val, pred_kind, pred_val,
obj_kind, obj_val, factuality, world, status, confidence_milli. Occurrences:
claim_id, occ_ord, source_sentence_id, evidence. A query is a tree of small
frozen dataclasses that becomes one Column, so filters reach the scan.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["claim", "status", "subject", "predicate", "object", "factuality", "world", "confidence", "occurrences", "source_sentences", "summary", "evidence_count"]
POSITIVE, NEGATIVE = ["Supported", "Contested", "AttributedOnly"], ["Contradicted", "NonFactual"]


@dataclass(frozen=True)
class Subject:
    kind: str
    value: str


@dataclass(frozen=True)
class Predicate:
    kind: str
    value: str


@dataclass(frozen=True)
class Object:
    kind: str
    value: str


@dataclass(frozen=True)
class Status:
    value: str


@dataclass(frozen=True)
class Claim:
    value: str


@dataclass(frozen=True)
class EvidenceRequired:
    required: bool = True


@dataclass(frozen=True)
class TextContains:
    text: str


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Query:
    intent: str = "Select"  # Select, Count, Boolean, Explain, Contradiction
    where: object = And()
    project: tuple[str, ...] = ("claim", "subject", "object")
    distinct: bool = False
    order: tuple[tuple[str, bool], ...] = (("claim", True),)  # (column, ascending)
    limit: int | None = None
    steps: tuple[str, ...] = field(default=(), compare=False)


def condition(tree: object) -> Column:
    """One boolean Column for a constraint tree; an empty And is true, an empty Or false.

    Tagged references are equal if kind and value are; a null value equals a
    null one. TextContains is refused, since claims hold no text.
    """
    match tree:
        case And(parts):
            return reduce(lambda a, b: a & b, [condition(p) for p in parts], F.lit(True))
        case Or(parts):
            return reduce(lambda a, b: a | b, [condition(p) for p in parts], F.lit(False))
        case Not(part):
            return ~condition(part)
        case Subject(kind, value):
            return F.col("subj_kind").eqNullSafe(kind) & F.col("subj_val").eqNullSafe(value)
        case Predicate(kind, value):
            return F.col("pred_kind").eqNullSafe(kind) & F.col("pred_val").eqNullSafe(value)
        case Object(kind, value):
            return F.col("obj_kind").eqNullSafe(kind) & F.col("obj_val").eqNullSafe(value)
        case Status(value):
            return F.col("status").eqNullSafe(value)
        case Claim(value):
            return F.col("claim_id").eqNullSafe(value)
        case EvidenceRequired(required):
            return (F.coalesce(F.size("evidence"), F.lit(0)) > 0) if required else F.lit(True)
        case _:
            raise ValueError(f"constraint not supported: {tree}")


def query_hash(query: Query) -> str:
    """SHA-256 of the query in canonical JSON."""
    return hashlib.sha256(json.dumps(asdict(query), sort_keys=True, default=str).encode()).hexdigest()


def compile_query(query: Query) -> Query:
    """Check the tree and the projection; the steps describe the plan (Catalyst chooses the physical one)."""
    _walk(query.where)
    if unknown := [c for c in query.project if c not in [*COLUMNS, "evidence"]]:
        raise ValueError(f"unknown columns: {unknown}")
    if query.limit is not None and query.limit < 0:
        raise ValueError("limit is negative")
    scans = {Subject: "ScanBySubject", Predicate: "ScanByPredicate", Object: "ScanByObject"}
    steps = [name for kind, name in scans.items() if any(isinstance(p, kind) for p in _walk(query.where))]
    steps += ["Filter"] if list(_walk(query.where))[1:] else ["UnknownGuard"]
    steps += ["EvidenceAttach"] + ["Aggregate"] * (query.intent == "Count") + ["Distinct"] * query.distinct + ["Sort"] + ["Limit"] * (query.limit is not None)
    return Query(query.intent, query.where, query.project, query.distinct, query.order, query.limit, tuple(steps))


def _walk(tree: object) -> list:
    if isinstance(tree, TextContains):
        raise ValueError("TextContains isn't supported")
    below = tree.parts if isinstance(tree, (And, Or)) else [tree.part] if isinstance(tree, Not) else []
    return [tree, *(x for p in below for x in _walk(p))]


def with_evidence(claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Claims with their number of occurrences, source sentences and sorted, distinct evidence.

    Evidence is ``claim:``, ``occurrence:`` and ``sentence:`` ids and what the
    occurrences cite; a claim without occurrence has none.
    """
    per = occurrences.groupBy("claim_id").agg(
        F.count("*").alias("occurrences"),
        F.array_sort(F.collect_set("source_sentence_id")).alias("source_sentences"),
        F.array_distinct(F.flatten(F.collect_list(F.concat(F.array(F.concat(F.lit("occurrence:"), F.col("claim_id"), F.lit(":"), F.col("occ_ord")), F.concat(F.lit("sentence:"), F.col("source_sentence_id"))), F.coalesce("evidence", F.array().cast("array<string>")))))).alias("cited"),
    )
    evidence = F.when(F.col("cited").isNotNull(), F.array_sort(F.array_union(F.array(F.concat(F.lit("claim:"), F.col("claim_id"))), F.filter("cited", lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))
    return claims.join(per, "claim_id", "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0))).withColumn("evidence", evidence).drop("cited")


def render(df: DataFrame) -> DataFrame:
    """The twelve result columns and the evidence; ``ordinal`` stays for first-wins and ties."""
    tagged = lambda kind, value: F.concat(F.col(kind), F.lit(":"), F.coalesce(F.col(value), F.lit("")))
    return df.select(
        "bundle_id",
        "ordinal",
        F.col("claim_id").alias("claim"),
        "status",
        tagged("subj_kind", "subj_val").alias("subject"),
        tagged("pred_kind", "pred_val").alias("predicate"),
        tagged("obj_kind", "obj_val").alias("object"),
        "factuality",
        "world",
        F.col("confidence_milli").alias("confidence"),
        "occurrences",
        F.array_join("source_sentences", ",").alias("source_sentences"),
        F.concat_ws(" ", "subj_val", "pred_val", "obj_val").alias("summary"),
        F.size("evidence").cast("bigint").alias("evidence_count"),
        "evidence",
    )


def distinct_first(df: DataFrame, columns: list[str], order: str = "ordinal") -> DataFrame:
    """One row per value of ``columns``: the one that comes first by ``order``."""
    rest = [c for c in df.columns if c not in columns]
    first = df.groupBy(*columns).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("first__"))
    return first.select(*columns, *[F.col(f"first__.{c}").alias(c) for c in rest])


def count_with_evidence(df: DataFrame) -> DataFrame:
    """One row: how many, and a digest of all their evidence; no rows count as 0. Order and limit don't matter here.

    The union of the evidence is kept as its number of members and the xor of
    their hashes (the first 60 bits of SHA-256), since a list of all would be
    one row as large as the table.
    """
    members = df.select(F.explode("evidence").alias("e")).groupBy("e").agg(F.lit(1).alias("one"))
    union = members.agg(F.count("*").alias("evidence_count"), F.coalesce(F.bit_xor(F.conv(F.left(F.sha2("e", 256), F.lit(15)), 16, 10).cast("bigint")), F.lit(0).cast("bigint")).alias("evidence_digest"))
    n = df.agg(F.count("*").alias("count"), F.lit("count").alias("mode"))
    return n.withColumn("k", F.lit(1)).join(union.withColumn("k", F.lit(1)), "k").drop("k")


#: Columns by which rows can be ranked before their evidence is gathered.
RANKED = {"claim", "status", "subject", "predicate", "object", "factuality", "world", "confidence", "summary", "occurrences", "evidence_count"}


def top_claims(claims: DataFrame, occurrences: DataFrame, order: tuple[tuple[str, bool], ...], limit: int) -> DataFrame:
    """(claim_id) of the first ``limit`` claims of an order, from counts alone: no evidence list is built for the others."""
    ids = F.concat(F.array(F.concat(F.lit("occurrence:"), F.col("claim_id"), F.lit(":"), F.col("occ_ord")), F.concat(F.lit("sentence:"), F.col("source_sentence_id"))), F.coalesce("evidence", F.array().cast("array<string>")))
    cited = occurrences.select("claim_id", F.explode(ids).alias("e")).groupBy("claim_id").agg((F.count_distinct("e") + 1).alias("evidence_count"))
    counts = occurrences.groupBy("claim_id").agg(F.count("*").alias("occurrences")).join(cited, "claim_id")
    none = F.array().cast("array<string>")
    bare = render(claims.withColumns({"occurrences": F.lit(0), "source_sentences": none, "evidence": none})).drop("occurrences", "evidence_count")
    rows = bare.join(counts.withColumnRenamed("claim_id", "claim"), "claim", "left").na.fill(0, ["occurrences", "evidence_count"])
    keys = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    return rows.orderBy(*keys, "claim").limit(limit).select(F.col("claim").alias("claim_id"))


def execute(query: Query, claims: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Run a query: filter, evidence, distinct or count, order (ties by claim, nulls lowest), limit, project."""
    query = compile_query(query)
    needs = any(isinstance(p, EvidenceRequired) for p in _walk(query.where))
    if query.limit is not None and not (needs or query.distinct or query.intent == "Count") and {c for c, _ in query.order} <= RANKED:
        top = top_claims(claims.where(condition(query.where)), occurrences, query.order, query.limit)
        claims, occurrences = claims.join(top, "claim_id", "left_semi"), occurrences.join(top, "claim_id", "left_semi")
    base = with_evidence(claims if needs else claims.where(condition(query.where)), occurrences)
    rows = render(base.where(condition(query.where)) if needs else base)
    if query.intent == "Count":
        return count_with_evidence(rows)
    if query.distinct:
        rows = distinct_first(rows, [c for c in query.project if c != "evidence"])
    keys = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in query.order]
    rows = rows.orderBy(*keys, "claim")
    if query.limit is not None:
        rows = rows.limit(query.limit)
    return rows.select(*query.project)


def boolean_status(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Yes, No, Conflicting or Unknown from claim statuses, decided before any projection."""
    yes, no = F.max(F.col("status").isin(POSITIVE).cast("int")), F.max(F.col("status").isin(NEGATIVE).cast("int"))
    answer = F.when((yes == 1) & (no == 1), "Conflicting").when(yes == 1, "Yes").when(no == 1, "No").otherwise("Unknown")
    return rows.groupBy(*(by or [])).agg(answer.alias("answer_status"))


def answer_status(rows: DataFrame, intent: str, by: list[str] | None = None) -> DataFrame:
    """Unknown without rows or evidence; Count is Exact; contradictions conflict; one row is Exact, more Supported."""
    n, cited = F.count("*"), F.coalesce(F.sum("evidence_count"), F.lit(0))
    status = (
        F.when((n == 0) | (cited == 0), "Unknown")
        .when(F.lit(intent == "Count"), "Exact")
        .when(F.lit(intent == "Contradiction") & (n > 1), "Conflicting")
        .when(n == 1, "Exact")
        .otherwise("Supported")
    )
    return rows.groupBy(*(by or [])).agg(status.alias("answer_status"), n.alias("answers"))


def answer_text(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values in order, joined by ``; ``."""
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), "; ").alias("answer"))


def merge_bundles(status_rows: DataFrame, by: list[str]) -> DataFrame:
    """One status over bundles: Conflicting before Supported before Exact before Unknown; counts add up."""
    rank = F.max(F.when(F.col("answer_status") == "Conflicting", 3).when(F.col("answer_status") == "Supported", 2).when(F.col("answer_status") == "Exact", 1).otherwise(0))
    return status_rows.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, ["Unknown", "Exact", "Supported", "Conflicting"])), rank + 1).alias("answer_status"), F.sum("answers").alias("answers"))


def rank_rows(rows: DataFrame, title: str, limit: int) -> DataFrame:
    """Rows whose subject is the title, resolved, not literal, with most evidence, first."""
    resolved = F.split("subject", ":")[0].isin("cluster", "entity")
    literal = F.split("object", ":")[0].isin("text", "literal")
    title_match = F.lower(F.regexp_replace("subject", "^[^:]*:", "")) == title.lower()
    return rows.orderBy(title_match.desc(), resolved.desc(), literal.asc(), F.col("evidence_count").desc(), F.col("claim")).limit(limit)


def facts_by_entity(claims: DataFrame, clusters: DataFrame, names: DataFrame, role: str = "any") -> DataFrame:
    """Claims of the entities whose name or alias equals a selector, case and blanks aside.

    ``clusters``: cluster_id, canonical_name, aliases; ``names``: selector.
    ``role`` any, subject or object; the two roles are two equi-joins, a claim
    that matches by both is given once.
    """
    known = clusters.select("cluster_id", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    wanted = names.select("selector", F.lower(F.trim("selector")).alias("key"))
    hit = known.withColumn("key", F.lower(F.trim("name"))).join(wanted, "key").select("selector", "cluster_id").distinct()
    sides = []
    if role in ("any", "subject"):
        sides.append(claims.join(hit, (F.col("subj_kind") == "cluster") & (F.col("subj_val") == F.col("cluster_id"))))
    if role in ("any", "object"):
        sides.append(claims.join(hit, (F.col("obj_kind") == "cluster") & (F.col("obj_val") == F.col("cluster_id"))))
    return reduce(DataFrame.unionByName, sides).drop("cluster_id").dropDuplicates(["selector", "claim_id"])


def ambiguous_names(clusters: DataFrame) -> DataFrame:
    """Names that stand for more than one canonical name within a bundle."""
    long = clusters.select("bundle_id", F.lower(F.trim("canonical_name")).alias("canonical"), F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return long.groupBy("bundle_id", F.lower(F.trim("alias")).alias("name")).agg(F.count_distinct("canonical").alias("meanings")).where("meanings > 1")


def fact_quality() -> Column:
    """Asserted claims with evidence are Supported; contested and negated ones say so (Asserted counts as a fact)."""
    return (
        F.when(F.col("status") == "Contested", "Contested")
        .when(F.col("factuality") == "Negated", "Negated")
        .when((F.col("factuality") == "Asserted") & (F.col("evidence_count") > 0), "Supported")
        .otherwise("Unsupported")
    )


def page(df: DataFrame, by: list[str], order: list[str], offset: int, limit: int, salts: int = 32) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of each group with the total and whether more follow.

    A group is first cut to its top rows in each of ``salts`` parts, so a hot
    one is never sorted in a single task; totals are counted apart.
    """
    salted = df.withColumn("salt__", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = Window.partitionBy(*by, "salt__").orderBy(*order)
    top = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    totals = df.groupBy(*by).agg(F.count("*").alias("total"))
    return ranked.join(totals, by).drop("salt__").withColumn("truncated", F.col("total") > offset + limit)


PREDICATES = {"IS_A": ("HasProperty", ""), "LOCATED_IN": ("LocatedAt", "")}


def predicate_of(name: str) -> Predicate:
    """IS_A and LOCATED_IN have kinds of their own; any other is custom."""
    return Predicate(*PREDICATES.get(name, ("Custom", name)))


def question_query(kind: str, predicate: str, subject: str | None = None, object_: str | None = None, limit: int = 20) -> Query:
    """A question as a query: with the subject known it asks for the object, with the object known for the subject, with both for yes or no."""
    parts: list = [predicate_of(predicate)]
    if subject:
        parts.append(Subject("cluster", subject))
    if object_:
        parts.append(Or((Object("text", object_), Object("cluster", object_))))
    if kind == "HowMany":
        return Query("Count", And(tuple(parts)))
    if subject and object_:
        return Query("Boolean", And(tuple(parts)), ("claim", "status"), limit=limit)
    return Query("Select", And(tuple(parts)), ("object",) if subject else ("subject",), distinct=True, order=(), limit=limit)


def answer_kind(intent: str) -> str:
    return {"Count": "Number", "Boolean": "YesNo", "Contradiction": "Conflict", "Explain": "Explanation"}.get(intent, "Values")


def fallback_sentences(sentences: DataFrame, terms: list[str]) -> DataFrame:
    """Per document the first sentence that holds all terms, case aside."""
    text = F.lower("sentence")
    hit = reduce(lambda a, b: a & b, [F.contains(text, F.lit(t.lower())) for t in terms], F.lit(True))
    return sentences.where(hit).groupBy("doc_id").agg(F.min(F.struct("ordinal", "sentence")).alias("s")).select("doc_id", "s.ordinal", "s.sentence")


def value_text(kind: str = "kind") -> Column:
    """A typed value as text: decimal, range, quantity, partial date, frequency, integer or text.

    Columns: sign, mantissa, scale; low, high; amount, unit; year, month, day; every.
    """
    digits = F.lpad(F.col("mantissa").cast("string"), F.greatest(F.length(F.col("mantissa").cast("string")), F.col("scale") + 1), "0")
    decimal = F.concat(
        F.when((F.col("sign") < 0) & (F.col("mantissa") != 0), "-").otherwise(""),
        F.when(F.col("scale") > 0, F.concat(F.left(digits, F.length(digits) - F.col("scale")), F.lit("."), F.right(digits, F.col("scale")))).otherwise(digits),
    )
    date = F.concat_ws("-", F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0"))
    return (
        F.when(F.col(kind) == "decimal", decimal)
        .when(F.col(kind) == "range", F.concat("low", F.lit(".."), "high"))
        .when(F.col(kind) == "quantity", F.concat("amount", F.lit(" "), "unit"))
        .when(F.col(kind) == "date", date)
        .when(F.col(kind) == "frequency", F.concat(F.lit("every "), "every"))
        .otherwise(F.col("text"))
    )


def with_labels(rows: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("subject", "object")) -> DataFrame:
    """Rendered rows with ``<column>_label``: the canonical name of the cluster a ``cluster:...`` value stands for, other values without their kind.

    ``labels``: cluster_id, canonical_name; the least name if there are several. An unknown cluster keeps its id.
    """
    known = labels.where("canonical_name IS NOT NULL").groupBy("cluster_id").agg(F.min("canonical_name").alias("name"))
    for c in columns:
        bare = F.regexp_replace(c, "^[^:]*:", "")
        key = F.when(F.startswith(c, F.lit("cluster:")), bare)
        rows = rows.withColumn("key__", key).join(known.select(F.col("cluster_id").alias("key__"), F.col("name").alias("name__")), "key__", "left").withColumn(f"{c}_label", F.coalesce("name__", bare)).drop("key__", "name__")
    return rows


def preferred_value(*columns: str) -> Column:
    """The first of the values (say subject, object, text, summary) that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns])


QUALITIES = ["Supported", "Contested", "Negated", "Unsupported"]


def quality_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Facts of each quality in a group, with the rank of the quality: supported ones first."""
    quality = fact_quality()
    rank = F.array_position(F.array(*map(F.lit, QUALITIES)), F.col("quality")).cast("int")
    return rows.withColumn("quality", quality).groupBy(*by, "quality").agg(F.count("*").alias("facts"), F.max("confidence").alias("best_confidence")).withColumn("group_rank", rank)
