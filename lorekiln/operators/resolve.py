"""Entity resolution: profiles, sequential decisions per document, clusters, summaries and checks.

Mentions are taken in document order; each may attach to a mention accepted
before it. That order decides, so a document is worked through in one task
(its size is that of one text); many documents share an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.session import store

# Word lists of the source forms.
PRONOUNS = "i me you he him she her it we us they them ja mnie mi ty ciebie ci on go jego mu ona ją jej ono je my nas nam wy was wam oni one ich im".split()
POSSESSIVES = "my your his her its our their swój".split()
REFLEXIVES = "myself yourself himself herself itself ourselves themselves się siebie sobie sobą".split()
DEMONSTRATIVES = "this that these those ten ta to tamten".split()
# Gender and number that a pronoun's form shows.
GENDERS = {"Masculine": "he him his himself on jego".split(), "Feminine": "she her herself ona jej ją".split(), "Neuter": "it its itself ono".split()}
PLURALS = "we us they them their themselves my nas nam oni one ich im".split()
# Roles that count as subjects.
SUBJECT_ROLES = ["Agent", "Experiencer", "Speaker", "Cognizer", "Topic", "Theme"]
# The limits and points of a decision.
REACH, PLACES, LEAST, MARGIN, ALTERNATIVES = 6, 1, 700, 140, 16
POINTS = {"entity": 10_000, "surface": 850, "concept": 260, "compatible": 120, "sentence": -35, "paragraph": 100, "subjects": 220, "pronoun": 180, "reflexive": 1200, "proper": 200}
EXCLUDED = ["Generic", "Modifier", "Unknown"]
FEATURES = ["gender", "number", "person", "animacy", "countability", "concreteness"]


def source_form(kind: Column, surface: Column, stored: Column) -> Column:
    """The form of a mention, by its kind, its words, then by what was stored.

    Modifiers and groups first; a reflexive, personal (``her`` and ``my`` too),
    possessive or demonstrative word next; then the stored form, one word of
    unknown form being a proper name. ``Unknown`` is left for the rest.
    """
    word = F.lower(F.trim(surface))
    return (
        F.when(kind == "Modifier", "Modifier")
        .when(kind == "CoordinationGroup", "Group")
        .when(stored == "Generic", "Generic")
        .when(word.isin(REFLEXIVES), "ReflexivePronoun")
        .when(word.isin(PRONOUNS), "Pronoun")
        .when(word.isin(POSSESSIVES), "PossessivePronoun")
        .when(word.isin(DEMONSTRATIVES), "DemonstrativeDescription")
        .when(stored.isNotNull() & (stored != ""), stored)
        .when((word != "") & ~F.contains(word, F.lit(" ")), "ProperName")
        .otherwise("Unknown")
    )


def pronoun_gender(surface: Column) -> Column:
    word, out = F.lower(F.trim(surface)), F.lit(None).cast("string")
    for name, words in GENDERS.items():
        out = F.when(word.isin(words), name).otherwise(out)
    return out


def pronoun_number(surface: Column) -> Column:
    word = F.lower(F.trim(surface))
    return F.when(word.isin(PLURALS), "Plural").when(word.isin(sum(GENDERS.values(), [])), "Singular")


PROFILE = ["doc_id", "mention_id", "sentence", "paragraph", "place", "concept", "surface", "form", "subject_like", "entity_id"]
DECISIONS = (
    "doc_id bigint, mention_id bigint, sentence int, form string, concept string, surface string, decision string, target_id bigint, score int, "
    "cluster_no int, alternatives array<struct<target_id:bigint,score:int>>"
)


def _score(m: dict, t: dict) -> int:
    pronouns = ("Pronoun", "ReflexivePronoun", "PossessivePronoun")
    forms = (m["form"], t["form"])
    met = {
        "entity": m["entity_id"] is not None and m["entity_id"] == t["entity_id"],
        "surface": m["surface"] is not None and m["surface"] == t["surface"],
        "concept": True,
        "compatible": True,  # others aren't scored
        "sentence": abs(m["sentence"] - t["sentence"]),
        "paragraph": m["paragraph"] == t["paragraph"],
        "subjects": m["subject_like"] and t["subject_like"],
        "pronoun": any(f in pronouns for f in forms),
        "reflexive": "ReflexivePronoun" in forms,
        "proper": "ProperName" in forms,
    }
    return sum(POINTS[k] * int(v) for k, v in met.items())


def _may_refer(m: dict, t: dict, features: list[str]) -> bool:
    """Near enough, of one concept, no feature against it; pronouns don't reach over paragraphs. Null concepts are equal."""
    if abs(m["sentence"] - t["sentence"]) > REACH or abs(m["place"] - t["place"]) > PLACES or m["concept"] != t["concept"]:
        return False
    if m["paragraph"] != t["paragraph"] and any(x["form"] in ("Pronoun", "ReflexivePronoun", "PossessivePronoun") for x in (m, t)):
        return False
    return all(m[f] is None or t[f] is None or m[f] == t[f] for f in features)


def _decide(rows: list[dict], features: list[str]) -> Iterator[tuple]:
    """Decision, target, score, cluster and alternatives of each mention of one document, in order."""
    accepted: list[dict] = []
    cluster: dict[int, int] = {}
    clusters = 0
    for m in rows:
        while accepted and m["sentence"] - accepted[0]["sentence"] > REACH:
            accepted.pop(0)  # sentences don't go back, so nothing later reaches it either
        scored = sorted(((-_score(m, t), str(t["mention_id"]), t["mention_id"]) for t in accepted if _may_refer(m, t, features)))
        target = None
        if m["form"] in EXCLUDED:
            decision, score = "Excluded", 0
        elif not scored:
            decision, score = "Seeded", 0
        else:
            score = -scored[0][0]
            gap = score + scored[1][0] if len(scored) > 1 else score + (1 << 30)
            if score >= LEAST and gap >= MARGIN:
                target = scored[0][2]
                same = m["entity_id"] is not None and any(t["mention_id"] == target and t["entity_id"] == m["entity_id"] for t in accepted)
                decision = "HardAccepted" if same else "Accepted"
            else:
                decision = "Ambiguous" if score >= LEAST else "Deferred" if score >= LEAST - MARGIN else "Unresolved"
        if decision in ("Seeded", "Accepted", "HardAccepted"):
            if target is None:
                cluster[m["mention_id"]], clusters = clusters, clusters + 1
            else:
                cluster[m["mention_id"]] = cluster[target]
            accepted.append(m)
        yield decision, target, score, cluster.get(m["mention_id"]), [{"target_id": t, "score": -s} for s, _, t in scored[:ALTERNATIVES]]


def resolve(mentions: DataFrame, features: list[str] | None = None) -> DataFrame:
    """One decision per mention; columns as in DECISIONS.

    ``mentions``: the columns of PROFILE (``surface`` normalised; ``paragraph``
    names the paragraph, ``place`` is the sentence's place in it) and those of
    ``features``. Accepted and seeded mentions have a cluster, others none.
    Alternatives are the ALTERNATIVES best antecedents; ties go to the smaller
    id as text. Rows with a null document, mention, sentence or place are left
    out; a repeated mention must be made current before.
    """
    features = features or []
    names = [c.split(" ")[0] for c in DECISIONS.split(", ")]
    options = pa.list_(pa.struct([("target_id", pa.int64()), ("score", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), options]

    def made(documents: list[list[dict]]) -> pa.RecordBatch:
        rows = [r for document in documents for r in document]
        kept = [[r[c] for r in rows] for c in ("doc_id", "mention_id", "sentence", "form", "concept", "surface")]
        found = zip(*(d for document in documents for d in _decide(document, features)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*kept, *map(list, found)], types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[dict] = []  # the document that the next batch may go on with
        for batch in batches:
            whole: list[list[dict]] = []
            for row in batch.to_pylist():
                if last and last[0]["doc_id"] != row["doc_id"]:
                    whole.append(last)
                    last = []
                last.append(row)
            if whole:
                yield made(whole)
        if last:
            yield made([last])

    clean = mentions.select(*PROFILE, *features).where("doc_id IS NOT NULL AND mention_id IS NOT NULL AND sentence IS NOT NULL AND place IS NOT NULL")
    return clean.repartition("doc_id").sortWithinPartitions("doc_id", "sentence", "mention_id").mapInArrow(run, DECISIONS)


def confidence(score: str = "score") -> Column:
    """Score between 0 and 1000."""
    return F.greatest(F.least(F.col(score), F.lit(1000)), F.lit(0))


def alternatives(decided: DataFrame) -> DataFrame:
    """(doc_id, mention_id, rank, target_id, score): the antecedents each mention could have had, the best first."""
    return decided.select("doc_id", "mention_id", F.posexplode("alternatives").alias("k", "a")).select("doc_id", "mention_id", (F.col("k") + 1).alias("rank"), "a.target_id", "a.score")


def clusters(decided: DataFrame) -> DataFrame:
    """(doc_id, cluster_no, representative, mentions, canonical_name, concept): the first mention stands for its cluster, the first name that isn't null is its name."""
    order = F.struct("sentence", "mention_id")
    return decided.where("cluster_no IS NOT NULL").groupBy("doc_id", "cluster_no").agg(
        F.min_by("mention_id", order).alias("representative"),
        F.count("*").alias("mentions"),
        F.min_by("surface", F.when(F.col("surface").isNotNull(), order)).alias("canonical_name"),
        F.min_by("concept", order).alias("concept"),
    )


def resolution_summary(decided: DataFrame) -> DataFrame:
    """Per document: mentions, decisions of each kind (seeded ones count as accepted), clusters with several mentions and with one."""
    n = lambda *kinds: F.sum(F.col("decision").isin(*kinds).cast("int"))
    per = decided.groupBy("doc_id").agg(
        F.count("*").alias("mentions"), n("Accepted", "Seeded").alias("accepted"), n("HardAccepted").alias("hard_accepted"), n("Ambiguous").alias("ambiguous"),
        n("Deferred").alias("deferred"), n("Unresolved").alias("unresolved"), n("Excluded").alias("excluded"),
    )
    sizes = clusters(decided).groupBy("doc_id").agg(F.sum((F.col("mentions") > 1).cast("int")).alias("resolved_clusters"), F.sum((F.col("mentions") == 1).cast("int")).alias("single_clusters"))
    return per.join(sizes, "doc_id", "left").na.fill(0, ["resolved_clusters", "single_clusters"])


def named_clusters(cluster_rows: DataFrame, name: Column) -> DataFrame:
    """Clusters whose canonical name is exactly the given one."""
    return cluster_rows.where(F.col("canonical_name") == name)


def cluster_members(decided: DataFrame) -> DataFrame:
    """(doc_id, cluster_no, mention_id): mentions by cluster."""
    return decided.where("cluster_no IS NOT NULL").select("doc_id", "cluster_no", "mention_id")


def resolution_errors(mentions: DataFrame, decided: DataFrame) -> DataFrame:
    """(doc_id, mention_id, error) of a resolution against its mentions.

    MissingDecision, UnknownMention, DuplicateDecision; MissingCluster and
    UnexpectedCluster by decision; UnknownTarget, LaterTarget and
    ForeignCluster for targets; ConceptMismatch with the cluster's first mention.
    The resolution is run once and stored.
    """
    ids = ["doc_id", "mention_id"]
    decided = store(decided.select(*ids, "sentence", "surface", "concept", "decision", "target_id", "cluster_no"), "decided")  # several checks read it
    n = lambda given, judged: [F.lit(given).alias("given"), F.lit(judged).alias("judged")]
    counts = mentions.select(*ids, *n(1, 0)).unionByName(decided.select(*ids, *n(0, 1))).groupBy(*ids).agg(F.sum("given").alias("given"), F.sum("judged").alias("judged"))
    unequal = F.col("doc_id").isNull() | F.col("mention_id").isNull()  # null ids meet nothing
    target = decided.select("doc_id", F.col("mention_id").alias("target_id"), F.col("sentence").alias("t_sentence"), F.col("cluster_no").alias("t_cluster"), F.lit(True).alias("found"))
    linked = decided.where("target_id IS NOT NULL").join(target, ["doc_id", "target_id"], "left")
    first = clusters(decided).select("doc_id", "cluster_no", F.col("concept").alias("first_concept"))
    inside = F.col("decision").isin("Seeded", "Accepted", "HardAccepted")

    def errors(df: DataFrame, **found: Column) -> DataFrame:
        return df.select(*ids, F.explode(F.array_compact(F.array(*[F.when(where, F.lit(error)) for error, where in found.items()]))).alias("error"))

    return (
        errors(
            counts,
            MissingDecision=(F.col("given") > 0) & ((F.col("judged") == 0) | unequal),
            UnknownMention=(F.col("judged") > 0) & ((F.col("given") == 0) | unequal),
            DuplicateDecision=F.col("judged") > 1,
        )
        .unionByName(errors(decided, MissingCluster=inside & F.col("cluster_no").isNull(), UnexpectedCluster=~inside & F.col("cluster_no").isNotNull()))
        .unionByName(errors(linked, UnknownTarget=F.col("found").isNull(), LaterTarget=F.expr("t_sentence > sentence OR t_sentence = sentence AND target_id >= mention_id"), ForeignCluster=F.expr("found AND NOT t_cluster <=> cluster_no")))
        .unionByName(errors(decided.join(first, ["doc_id", "cluster_no"]), ConceptMismatch=F.expr("NOT concept <=> first_concept")))
    )
