from pyspark.sql import functions as F

from lorekiln.llm import langid

EN = "the old mill stands behind the river and nobody knows why it was built there before the war"
DE = "die alte Mühle steht hinter dem Fluss und niemand weiß warum sie dort vor dem Krieg gebaut wurde"
PL = "stary młyn stoi za rzeką i nikt nie wie dlaczego został tam zbudowany przed wielką wojną"


def lines(words, n, k):
    w = words.split()
    return [" ".join(w[(i + j) % len(w)] for j in range(k)).capitalize() + "." for i in range(n)]


def rows():
    out = []
    for lang, words in (("en", EN), ("de", DE), ("pl", PL)):
        out += [(lang, s) for s in lines(words, 60, 8)]
    return out + [("nl", s) for s in lines(DE, 5, 8)]


def test_labels(spark):
    labels = [("EN",), ("en_GB",), (" Polski ",), ("pol",), ("und",), ("-",), (None,), (" ",), ("ja-JP",), ("tlh",)]
    df = spark.createDataFrame(labels, "l string").select(langid.normal_label(F.col("l")))
    assert [r[0] for r in df.collect()] == ["en", "en", "pl", "pl", None, None, None, None, "ja", "tlh"]


def test_fit_and_segments(spark):
    model = langid.fit(spark.createDataFrame(rows(), "label string, text string"))
    assert sorted(model.languages) == ["de", "en", "pl"]  # nl stands only on German texts
    held = [
        ("turn", 1, None, "Nobody knows the river."),
        ("turn", 2, "en", "Niemand kennt den alten Fluss."),
        ("turn", 3, "en", "The old mill was built before the war. " + PL.capitalize() + ". Nobody knows why it stands there."),
        ("turn", 4, "pl", "stary mlyn stoi za rzeka"),
        ("turn", 5, None, None), ("turn", 6, None, ""), ("turn", 7, None, "1984 -- 7!"),
    ]
    df = spark.createDataFrame(held, "record_kind string, record_id bigint, label string, text string")
    found = langid.segments(df, model)
    got = {(r.record_id, r.segment_no): r.lang for r in found.collect()}
    assert got == {(1, 1): "en", (2, 1): "de", (3, 1): "en", (3, 2): "pl", (3, 3): "en", (4, 1): "pl"}
    assert {r.record_id for r in langid.label_cases(found).collect()} == {1, 2, 3}
    assert langid.segments(df.limit(0), model).count() == 0


def test_empty_table(spark):
    model = langid.fit(spark.createDataFrame([], "label string, text string"))
    assert model.languages == []
    df = spark.createDataFrame([("turn", 1, "en", "Text.")], "record_kind string, record_id bigint, label string, text string")
    assert langid.segments(df, model).count() == 0


def test_junk_labels_stay_on_the_cluster(spark):
    """Ten thousand labels that name no language of their own found none, and none of their words is kept."""
    junk = ["".join(c) for c in __import__("itertools").product("bcdfghjkmn", repeat=4)]
    texts = [(label, s) for label, s in zip(junk, lines(EN, 10_000, 8))]
    big = [("xq", " ".join(lines(EN, 60, 8))), ("xz", " ".join(lines(PL, 60, 8)))]
    df = spark.createDataFrame(rows() + texts + big, "raw string, text string").select(langid.normal_label(F.col("raw")).alias("label"), "text")
    assert sorted(langid.fit(df).languages) == ["de", "en", "pl"]


def test_own_script_counts(spark):
    """A Cyrillic word isn't taken for a Latin one of the same look."""
    ru = "сор в поле у реки а там не растёт ничего кроме старой травы и камней"
    data = rows() + [("ru", s) for s in lines(ru, 60, 8)]
    model = langid.fit(spark.createDataFrame(data, "label string, text string"))
    got = {r: s[0][0] for r, s in langid.segments_of(__import__("pyarrow").array(["Сор у реки.", "The old mill."]), model)}
    assert got == {0: "ru", 1: "en"}
