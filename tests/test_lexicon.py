from pyspark.sql import functions as F

from __spark_entry__ import queries
from lorekiln.operators import lexicon

TEXTS = [(1, "The town council met in the town."), (2, "third time this year; third time lucky"), (2, "Third time this, this"), (None, "town"), (None, "council town council"), (4, None), (5, " \n"), (6, "…the"), (7, "railway railway station")]
FORMS = [("town council", "council"), ("town", "town"), ("third time this", "time"), ("this", "this"), ("the", "the"), ("station", "station"), ("railway station", "a"), ("railway station", "b"), ("", "none"), (None, "none")]


def test_multiword_hits(spark):
    """The longest form at each place, the lexicon broadcast or not; rows of one document number count once a place, as in SQL."""
    docs, forms = spark.createDataFrame(TEXTS, "doc_id bigint, text string"), spark.createDataFrame(FORMS, "form string, lemma string")
    best = {}
    for doc, text in TEXTS:
        words = [w for w in (x.strip(".,;…").lower() for x in (text or "").split()) if w]
        for k in range(len(words)):
            met = [(n, form, lemma) for n in (1, 2, 3) if k + n <= len(words) for form, lemma in FORMS if form == " ".join(words[k : k + n])]
            if met:
                best[doc, k] = max(met + ([(0, "", "")] if (doc, k) not in best else [best[doc, k]]))
    want = sorted(((doc, k, form, lemma) for (doc, k), (_, form, lemma) in best.items()), key=repr)
    assert len(want) == 12
    for side in (forms, F.broadcast(forms)):
        assert sorted(map(tuple, lexicon.multiword_hits(docs, side).collect()), key=repr) == want


def moved(df):
    """Rows that the run of ``df`` shuffled, rows it broadcast."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], {"Exchange": 0, "BroadcastExchange": 0}
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName() in rows:
            rows[node.nodeName()] += node.metrics().apply("shuffleRecordsWritten" if node.nodeName() == "Exchange" else "numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows["Exchange"], rows["BroadcastExchange"]


def test_multiword_lookup_keeps_texts_apart(spark, tmp_path):
    """10,002 words, three hits: neither shuffled nor broadcast are the forms of all places, only hits and the lexicon; without a mark the texts aren't broadcast either."""
    spark.createDataFrame([(1, "Railway station " + "zebra " * 10_000)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["q_multiword_lookup"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("railway station", "station", 1), ("station", "station", 1)]
    shuffled, broadcast = moved(got)
    assert 0 < shuffled < 100 and 0 < broadcast < 1000
    plain = lexicon.multiword_hits(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([("zebra zebra", "zebra")], "form string, lemma string"))
    assert len(plain.collect()) == 9_999 and moved(plain)[1] < 10
