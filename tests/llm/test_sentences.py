import random
import time

import pytest

from lorekiln.llm import langid, sentences as S

STATS = S.Statistics({("en", "dr"): False, ("en", "etc"): True, ("en", "no"): False, ("en", "p.m"): True}, {("en", "the"), ("en", "in")}, {("en", S.NUMBER, "band")}, {("en", "etc", 2)})


def cut(text, lang="en"):
    parts = S.paragraphs(text)
    return [text[a:b] for a, b, _ in S.units(text, [lang] * len(parts), STATS, parts)]


@pytest.mark.parametrize(
    "text, units",
    [
        ("", []),
        (" \n\n ", []),
        ("A b. C d! E f?! G", ["A b.", "C d!", "E f?!", "G"]),
        ("Dr. Lee came. The end.", ["Dr. Lee came.", "The end."]),
        ("We sell ropes, lamps, etc. Lee left.", ["We sell ropes, lamps, etc.", "Lee left."]),
        ("And etc. Lee left. The end.", ["And etc. Lee left.", "The end."]),
        ("J. R. Lee signed v2.3 of file_1.txt today.", ["J. R. Lee signed v2.3 of file_1.txt today."]),
        ("He left at 7 p.m. In the meantime", ["He left at 7 p.m.", "In the meantime"]),
        ('"Where is it?" asked Lee. Then', ['"Where is it?" asked Lee.', "Then"]),
        ("„Stój!” — woła Ala. Tak.", ["„Stój!” — woła Ala.", "Tak."]),
        ('Lee said: "It is closed." The end.', ['Lee said: "It is closed."', "The end."]),
        ("They waited... and left. Only he knew… The end.", ["They waited... and left.", "Only he knew…", "The end."]),
        ("Head\n\nOne line\nwraps. Two.\r\rLast", ["Head", "One line\nwraps.", "Two.", "Last"]),
        ("It melts.Then rain.", ["It melts.", "Then rain."]),
        ("Der 2. Band fehlt. Ende.", ["Der 2. Band fehlt.", "Ende."]),
        ("他说：“今天不开门。”天黑了。“在哪里？”他问道。等了……后来走了。", ["他说：“今天不开门。”", "天黑了。", "“在哪里？”他问道。", "等了……后来走了。"]),
        ("彼は「休みです！」と言いました。はい。", ["彼は「休みです！」と言いました。", "はい。"]),
        ("หนึ่ง สอง 3 สาม สี่", ["หนึ่ง", "สอง 3 สาม", "สี่"]),
        ("यह है। वह है!", ["यह है।", "वह है!"]),
    ],
)
def test_units(text, units):
    assert cut(text) == units


def test_spans_cover_the_text(spark):
    rows = [(1, "  Żółw. A\n\nB.  ", "pl"), (2, None, "pl"), (3, "", None), (4, " \n ", "en"), (None, "x", "x")] + [(k, "The cat sat here. Dr. Lee came. It rains! The end? Yes.", "en") for k in range(5, 25)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumnRenamed("doc_id", "doc_id")
    got = S.segment(df).collect()
    assert {r.doc_id for r in got} == {1, *range(5, 25)}
    one = sorted((r.raw_start, r.raw_end, r.start_byte, r.end_byte) for r in got if r.doc_id == 1)
    assert one[0][0] == 0 and one[-1][1] == len(rows[0][1].encode()) and all(a[1] == b[0] for a, b in zip(one, one[1:]))
    assert [rows[0][1].encode()[a:b].decode() for *_, a, b in one] == ["Żółw.", "A", "B."]


def learnt(spark, text, copies=30):
    model = langid.build({"en": {w: 5 for w in text.lower().split()}})
    return S.learn(S.summed(S.read_once(spark.createDataFrame([(k, text) for k in range(copies)], "doc_id bigint, text string"), model)))


def test_learns_abbreviations(spark):
    text = "The crew saw Dr. Lee at the mill. It was old! Then Dr. Moss left the mill? Yes, the old mill burned down. " * 3
    found = learnt(spark, text)
    assert found.abbreviations["en", "dr"] is False and ("en", "mill") not in found.abbreviations
    assert found.abbreviations.get(("en", "down"), True)  # it only ever closes paragraphs, so it ends units either way


def test_same_abbreviations_at_any_size(spark):
    """A rare slip (an abbreviation without its period) doesn't weigh more in a larger input."""
    text = "They saw Prof. Lee at the mill. Nobody asked Prof. Moss about the crew! " * 60 + "Then prof Lee left."
    small, large = learnt(spark, text, 120), learnt(spark, text, 1200)
    assert ("en", "prof") in small.abbreviations and small.abbreviations == large.abbreviations


def test_learns_collocations_and_places(spark):
    random.seed(3)
    kinds = ["On the 3. May they left the mill.", "Winter 1846 r. Lee saw the old mill.", "The crew went to the market in 1846 r.", "Moss saw number 7.", "Lee went home with Moss.", "Nobody saw the market."]
    rows = [" ".join(random.choice(kinds) for _ in range(6)) for _ in range(400)]
    found = learnt(spark, "\n\n".join(rows), 1)
    assert {c for c in found.collocations if c[1] == S.NUMBER} == {("en", S.NUMBER, "may")}
    assert found.abbreviations["en", "r"] is True and ("en", "r", 3) in found.inner and ("en", "r", S.PLACES) not in found.inner


@pytest.mark.parametrize("text", ["a. b " * 200_000, "x" * 1_000_000, "Mr. Lee, \"no. 4\" and, " * 45_000, "(((. " * 200_000, ". " * 500_000, "\"" * 1_000_000])
def test_linear_in_length(text):
    """A single unit of a megabyte takes about a second, not minutes."""
    begun = time.time()
    parts = S.paragraphs(text)
    S.units(text, ["en"] * len(parts), STATS, parts)
    S.count_paragraphs([text], {})
    assert time.time() - begun < 8
