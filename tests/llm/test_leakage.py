import random

from lorekiln.llm import leakage as L

ITEM = [f"w{k}" for k in range(60)]


def found(spark, docs, items=((1, " ".join(ITEM)), (2, None), (3, ""))):
    d = spark.createDataFrame(list(docs), "doc_id bigint, text string").selectExpr("*", "1 AS item_id")
    return {(r.doc_id, r.item_id): r.passage_words for r in L.leaks(d, spark.createDataFrame(list(items), "item_id bigint, text string")).collect()}


def test_cases(spark):
    replaced = [*ITEM[10:16], "zz", *ITEM[17:23]]
    docs = [
        (1, "before " + " ".join(ITEM[5:17]) + " after"), (2, " ".join(ITEM[5:16])), (3, " ".join(replaced)), (4, " ".join([*ITEM[10:16], *ITEM[17:23]])),
        (5, ", ".join(ITEM[20:34]).upper()), (6, " ".join(ITEM[20:34]).replace("w", "ｗ")), (7, " ".join([*ITEM[10:15], "x", "y", *ITEM[17:24]])), (8, None), (9, ""), (10, " ".join(ITEM[0:5])), (None, " ".join(ITEM)),
        (11, "w1 " * 3000 + " ".join(ITEM[30:50])),
    ]
    assert set(found(spark, docs)) == {(k, 1) for k in (1, 3, 4, 5, 6, 11)}


def test_empty(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, "a b c")], [(1, "x y")]) == {}


def brute(doc, item):
    for i in range(len(item) - 11):
        for j in range(len(doc) - 10):
            for skip in range(13):
                part = item[i : i + 12]
                if doc[j : j + 12] and sum(a != b for a, b in zip(part, doc[j : j + 12])) <= (len(doc[j : j + 12]) == 12) and part[0] == doc[j] and len(doc[j : j + 12]) == 12 and part[-1] == doc[j + 11]:
                    return True
                if 0 < skip < 11 and part[:skip] + part[skip + 1 :] == doc[j : j + 11]:
                    return True
    return False


def test_against_brute_force(spark):
    random.seed(8)
    item = [random.choice("abcdefgh") + random.choice("xyz") for _ in range(40)]
    docs = []
    for k in range(60):
        at = random.randrange(25)
        part = item[at : at + random.randint(9, 15)]
        for _ in range(random.randint(0, 2)):
            p = random.randrange(len(part))
            part = part[:p] + random.choice([[], ["qq"]]) + part[p + 1 :]
        docs.append((k, ["pad", *part, "pad"]))
    got = found(spark, [(k, " ".join(d)) for k, d in docs], [(1, " ".join(item))])
    assert {k for k, _ in got} == {k for k, d in docs if brute(d, item)}
