from lorekiln.llm import truncation as T

SCHEMA = "doc_id bigint, source string, text string, cut_inside string"
BODY = "The crew opens the old granary before the market starts. Nobody in the town trusts the museum board.\n\nThe old mill keeps a broken lantern in its archive. "


def texts(*tails):
    rows = [(k, "s", BODY + f"Number {k} stays closed today.\n\nThe crew opens the old granary before the market starts.", "") for k in range(200)]
    return rows + [(1000 + k, None, BODY + t if t is not None else None, "x") for k, t in enumerate(tails)]


def test_cases(spark):
    tails = ["The crew opens the old gran", "The crew opens the old", "The crew opens [...]", "The crew op…", "The crew opens the old granary before the market starts", "The crew opens the old granary before the market starts.", None, "The crew opens the ol�"]
    df = spark.createDataFrame([*texts(*tails), (2000, "s", "", ""), (2001, "s", "x", ""), (None, "s", "The crew op", "")], SCHEMA)
    assert {r.doc_id for r in T.cut_documents(df).collect()} == {1000, 1001, 1002, 1003, 1007}
    rates = {r.source: (r.documents, r.cut_documents) for r in T.cut_rates(df).collect()}
    assert rates[None] == (7, 5) and rates["s"][1] == 0
    rules = {r.doc_id: r.rule for r in T.judged(df).collect()}
    assert rules[1000] == "trigram:word" and rules[1001] == "trigram:sentence" and rules[1004] is None
    assert 2000 not in {r.doc_id for r in T.judged(df).where("rule IS NOT NULL").collect()}


def test_closing_line_is_complete(spark):
    """A line many texts close with, and that has no terminal, isn't a cut."""
    rows = [(k, "s", BODY + f"Number {k} stays closed.\n\nCompiled by the reading room", "") for k in range(60)]
    assert T.cut_documents(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_hot_ending_and_long_token(spark):
    """A third of all texts cut at one place; a token of many letters; repeated rows count once."""
    rows = texts(*["The crew opens the old gran"] * 120) + [(3000, "s", "x" * 20_000 + " The crew opens the ol", ""), (3000, "s", "x" * 20_000 + " The crew opens the ol", "")]
    got = [r.doc_id for r in T.cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [*range(1000, 1120), 3000]


def test_same_in_duckdb(spark):
    import duckdb

    rows = texts("The crew opens the old gran", "The crew opens the", "The crew opens [...]", "Nobody in the", None) + [(5, "s", "ไม่มีใคร อธิบาย", ""), (6, "s", "会議のあとで破れた地図", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    documents = df.toPandas()  # noqa: F841 - DuckDB reads it by name
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(T.duckdb_sql()).fetchall(), key=str) == sorted((tuple(r) for r in T.judged(df).collect()), key=str)


def test_empty(spark):
    assert T.cut_documents(spark.createDataFrame([], SCHEMA)).count() == 0
