import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekiln.llm import unify
from lorekiln.llm.codepoints import narrow, portions, unify_array, widen

LETTERS = st.text(st.sampled_from([*"aeiouszAEIłß가각", *map(chr, range(0x300, 0x315)), *map(chr, [0x323, 0x328, 0x1100, 0x1161, 0x11A8, 0x212B, 0x1E69, 0x9C7, 0x9BE, 0x958, 0x3B9, 0x345])]), max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=8))
def test_plain_composition_is_nfc(texts):
    assert unify_array(pa.array(texts, pa.string()), visual=False).to_pylist() == [t and unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=5))
def test_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    codes, bounds = widen(pa.array(texts, pa.string()))
    assert narrow(codes, bounds).to_pylist() == texts


@pytest.mark.parametrize(
    "text, to",
    [("Ｂａｄ　Ｘ", "Bad X"), ("Теѕ́kа", "Teśka"), ("z​o⁠e﻿\xad", "zoe"), ("a\xa0b c", "a b c"), ("No‐1‑2", "No-1-2"), ("Tarnﬁ", "Tarnfi"), ("x²", "x²"), ("H₂", "H₂"), ("A", "A"), ("é", "é"), ("", ""), (None, None), ("‍", ""), ("́a", "́a"), ("Օɡ", "Og"), ("ᏚᎡ", "SR"), ("ӏ", "l")],
)
def test_visual_forms(text, to):
    assert unify_array(pa.array(["q", text, "q"], pa.string())).to_pylist()[1] == to


def test_slices_and_portions():
    a = pa.array(["aa", None, "é", "ż" * 50, ""]).slice(1)
    assert unify_array(a).to_pylist() == [None, "é", "ż" * 50, ""]
    batch = pa.RecordBatch.from_arrays([a], names=["t"])
    assert pa.Table.from_batches(list(portions([batch], 0, 10))).column(0).to_pylist() == a.to_pylist()


def test_matches(spark):
    mentions = spark.createDataFrame(
        [(1, "Аnna", "аnna"), (1, "Аnna", "аnna"), (2, "Anna", "anna"), (3, None, ""), (4, "ANNA", "Ánna"), (5, "An na", None), (None, "Аnna", None)],
        "mention_id bigint, exact_surface string, normalized_surface string",
    )
    names = spark.createDataFrame([(7, "Anna"), (8, None), (9, "An na")], "entity_id bigint, canonical_name string")
    assert {tuple(r) for r in unify.surface_matches(mentions, names).collect()} == {(1, "exact_surface", 7), (1, "normalized_surface", 7)}
    assert unify.surface_matches(mentions.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        unify.with_unified(mentions, {"exact_surface": "mention_id"})


def test_letters_can_keep_their_script():
    from lorekiln.llm.codepoints import tables, unify_codes

    codes, bounds = unify_codes(*widen(pa.array(["ｓор", "e\u0301\xad"])), tables(True, False))
    assert narrow(codes, bounds).to_pylist() == ["sор", "é"]


def test_plain_composition_of_all_code_points():
    every = [chr(c) + x for c in range(0xA0, 0x3200) if unicodedata.category(chr(c)) != "Cn" for x in ("", "\u0323\u0301", "\u0dca")]
    assert unify_array(pa.array(every), visual=False).to_pylist() == [unicodedata.normalize("NFC", t) for t in every]
