import random

from lorekiln.operators import resolve as R
from tests.test_resolve import SCHEMA, mention


def test_documents_over_batches(spark):
    """A document may go over Arrow batches or share one: decisions are those of the document alone."""
    pick = random.Random(1)
    rows = [mention(100 * d + m, pick.randrange(9), pick.choice(["ala", "ola", None]), doc=d, entity=pick.choice([None, None, 1])) for d in range(12) for m in range(pick.choice([1, 4, 11]))]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want, names = [], [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for d in range(12):
        own = sorted((dict(zip(names, r)) for r in rows if r[0] == d), key=lambda r: (r["sentence"], r["mention_id"]))
        want += [(d, r["mention_id"], *found[:4], [tuple(a.values()) for a in found[4]]) for r, found in zip(own, R._decide(own, ["gender"]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = [(r.doc_id, r.mention_id, r.decision, r.target_id, r.score, r.cluster_no, list(map(tuple, r.alternatives))) for r in R.resolve(df, ["gender"]).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(want) and len({w[2] for w in want}) > 2


def test_errors_resolve_once(spark):
    """However many checks read the resolution, it is worked out once."""
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.createDataFrame([mention(m, m, "ala") for m in range(5)], SCHEMA)
    got = R.resolve(df, ["gender"])
    assert R.resolution_errors(df, got.mapInArrow(count, got.schema)).count() == 0
    assert runs.value == 5


def test_errors_of_null_documents(spark):
    """Null documents meet nothing: delivered ones have no decision, decided ones no mention."""
    df = spark.createDataFrame([mention(1, 0, "ala", doc=None)], SCHEMA)
    got = R.resolve(spark.createDataFrame([mention(1, 0, "ala")], SCHEMA), ["gender"]).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "* EXCEPT (doc_id)")
    assert {(r.mention_id, r.error) for r in R.resolution_errors(df, got).collect()} == {(1, "MissingDecision"), (1, "UnknownMention")}
