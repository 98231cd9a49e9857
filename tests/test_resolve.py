from pyspark.sql import functions as F

from lorekiln.operators import resolve as R

SCHEMA = "doc_id bigint, mention_id bigint, sentence int, paragraph int, place int, concept string, surface string, form string, subject_like boolean, entity_id bigint, gender string"


def mention(m, sentence, surface, form="ProperName", doc=1, concept="P", entity=None, gender=None, subject=True, paragraph=0, place=0):
    return (doc, m, sentence, paragraph, place, concept, surface, form, subject, entity, gender)


def decide(spark, *rows):
    df = spark.createDataFrame(list(rows), SCHEMA)
    return df, R.resolve(df, ["gender"])


def decisions(spark, *rows):
    return {r.mention_id: (r.decision, r.target_id, r.score, r.cluster_no) for r in decide(spark, *rows)[1].collect()}


def test_points_and_clusters(spark):
    got = decisions(spark, mention(1, 0, "ala"), mention(2, 1, "ala"), mention(3, 2, "ola", concept="Q"), mention(4, 3, "she", "Pronoun"))
    assert got[1] == ("Seeded", None, 0, 0)
    assert got[2] == ("Accepted", 1, 850 + 260 + 120 - 35 + 100 + 220 + 200, 0)
    assert got[3] == ("Seeded", None, 0, 1)
    assert got[4][0] == "Ambiguous" and got[4][3] is None  # 1 and 2 are too close to each other


def test_only_accepted_mentions_are_antecedents(spark):
    """4 is ambiguous, so 5 can't attach to it although it is nearest; the modifier is excluded and offers nothing."""
    rows = [mention(1, 0, "ala"), mention(2, 0, "ola", concept="X"), mention(3, 0, "m", "Modifier"), mention(4, 1, "ala"), mention(6, 2, "he", "Pronoun"), mention(7, 2, "he", "Pronoun")]
    got = decisions(spark, *rows)
    assert got[3] == ("Excluded", None, 0, None) and got[4][1] == 1
    assert got[6][0] == "Ambiguous" and got[7][0] == "Ambiguous"


def test_rejections(spark):
    far = decisions(spark, mention(1, 0, "ala"), mention(2, 7, "ala"))
    assert far[2][0] == "Seeded"
    place = decisions(spark, mention(1, 0, "ala"), mention(2, 2, "ala", place=2))
    assert place[2][0] == "Seeded"
    across = decisions(spark, mention(1, 0, "ala"), mention(2, 1, "she", "Pronoun", paragraph=1), mention(3, 1, "ala", paragraph=1))
    assert across[2][0] == "Seeded" and across[3][1] == 1
    gender = decisions(spark, mention(1, 0, "he", "Pronoun", gender="Masculine"), mention(2, 0, "she", "Pronoun", gender="Feminine"))
    assert gender[2][0] == "Seeded"


def test_hard_accepted_and_low_scores(spark):
    hard = decisions(spark, mention(1, 0, "ala", entity=9), mention(2, 3, "the mayor", "DefiniteDescription", entity=9))
    assert hard[2][:2] == ("HardAccepted", 1)
    low = decisions(spark, mention(1, 0, "a", "BareCommonNoun", subject=False), mention(2, 0, "b", "BareCommonNoun", subject=False))
    assert low[2] == ("Unresolved", None, 480, None)
    deferred = decisions(spark, mention(1, 0, "a", "BareCommonNoun", subject=False), mention(2, 0, "b", subject=False))
    assert deferred[2][0] == "Deferred"


def test_clusters_summary_and_nulls(spark):
    df, got = decide(spark, mention(1, 0, None), mention(2, 0, None, concept=None), mention(3, 1, "ala"), mention(4, 1, "ala"), (None, 5, 0, 0, 0, "P", "x", "ProperName", True, None, None), mention(6, None, "x"))
    assert got.count() == 4
    rows = {r.representative: (r.mentions, r.canonical_name) for r in R.clusters(got).collect()}
    assert rows[1] == (2, "ala") or rows[1][0] >= 1
    s = R.resolution_summary(got).first()
    assert s.mentions == 4 and s.accepted + s.ambiguous + s.deferred + s.unresolved == 4
    assert R.resolve(df.limit(0), ["gender"]).count() == 0


def test_errors(spark):
    df, got = decide(spark, mention(1, 0, "ala"), mention(2, 1, "ala"), mention(3, 1, "x", "Modifier"))
    assert R.resolution_errors(df, got).count() == 0
    bad = got.withColumn("cluster_no", F.when(F.col("mention_id") == 3, 0).when(F.col("mention_id") == 2, 5)).withColumn("target_id", F.when(F.col("mention_id") == 2, F.lit(9)).otherwise(F.col("target_id"))).where("mention_id > 0").unionByName(got.where("mention_id = 3"))
    errors = {(r.mention_id, r.error) for r in R.resolution_errors(df.where("mention_id <> 2"), bad).collect()}
    assert errors == {(2, "UnknownMention"), (3, "DuplicateDecision"), (1, "MissingCluster"), (3, "UnexpectedCluster"), (2, "UnknownTarget")}


def test_source_forms(spark):
    rows = [("RoleRoot", "Her", "ProperName"), ("RoleRoot", "swój", None), ("RoleRoot", "się", None), ("Modifier", "x", None), ("CoordinationGroup", "x", None), ("RoleRoot", "tamten", None), ("RoleRoot", "Ala", None), ("RoleRoot", "the mill", None), ("RoleRoot", None, None), ("RoleRoot", "a b", "DefiniteDescription")]
    df = spark.createDataFrame(rows, "k string, w string, s string").select(R.source_form(F.col("k"), F.col("w"), F.col("s")))
    assert [r[0] for r in df.collect()] == ["Pronoun", "PossessivePronoun", "ReflexivePronoun", "Modifier", "Group", "DemonstrativeDescription", "ProperName", "Unknown", "Unknown", "DefiniteDescription"]
