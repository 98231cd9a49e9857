import json

import pytest

from lorekiln.operators import shred as S

SCHEMA = "event_id bigint, run_id string, stage string, payload string, ingested_at timestamp, label string"


def events(spark, payloads):
    return spark.createDataFrame([(k, " ", "s", p, None, "clash") for k, p in payloads], SCHEMA)


def links(spark, payloads):
    return {tuple(r) for r in S.element_links(S.shred(events(spark, payloads))).collect()}


def test_paths_and_owners(spark):
    deep = {"a": [{"b": {"c": [{"d": 1}, 2]}}, 3], "grid": [[{"x": 1}], []], "text": '[{"no": 1}]'}
    assert links(spark, [(1, json.dumps(deep))]) == {(1, "$", "$.a[0]"), (1, "$.a[0]", "$.a[0].b.c[0]"), (1, "$", "$.grid[0][0]")}


def test_bare_elements_and_strings(spark):
    rows = [(1, json.dumps({"spans": [{"lo": 1}]})), (2, json.dumps({"spans": {"lo": 2}})), (3, json.dumps(json.dumps({"spans": json.dumps({"lo": 3}), "only": {"k": 1}})))]
    assert links(spark, rows) == {(k, "$", "$.spans[0]") for k in (1, 2, 3)}
    assert S.bare_fields(events(spark, rows)) == {("", "spans")}


def test_broken_missing_and_repeated(spark):
    good = json.dumps({"a": [{"b": None}]})
    assert links(spark, [(1, good), (1, good), (2, None), (3, ""), (4, good[:-3]), (5, "NaN"), (None, good), (6, "7")]) == {(1, "$", "$.a[0]")}
    assert links(spark, []) == set()


def test_entity_table(spark):
    nodes = S.shred(events(spark, [(1, json.dumps({"a": [{"x": 1, "y": "t"}, {"x": None}, {"z": {"x": 5}}]}))]))
    rows = {(r.child_path, r.x, r.y, r.run_id) for r in S.entity_table(nodes, "a", ["x", "y"]).collect()}
    assert rows == {("$.a[0]", "1", "t", None), ("$.a[1]", None, None, None), ("$.a[2]", None, None, None)}
    with pytest.raises(ValueError):
        S.entity_table(nodes, "a", ["run_id"])


def test_round_trip(spark):
    value = {"k": [1, {"m": [True, None, 2.5]}, []], "o": {"p": "q"}}
    rows = S.shred(events(spark, [(1, json.dumps(value))])).collect()
    below = {}
    for r in rows:
        below.setdefault(r.parent_id, []).append(r)

    def build(r):
        under = below.get(r.node_id, [])
        if r.kind == "object":
            return {c.label: build(c) for c in under}
        if r.kind == "array":
            return [build(c) for c in sorted(under, key=lambda c: c.ordinal)]
        return {"null": None, "boolean": r.scalar == "true"}.get(r.kind, json.loads(r.scalar) if r.kind == "number" else r.scalar)

    assert build(below[None][0]) == value


def test_all_entities(spark):
    value = {"Top": 1, "top": None, "stage": "in", "a.b": 2, "a": {"b": 3, "rows": [{"x": 1, "anchor": {"kind": "k"}, "flags": ["p", None, [4]]}]}, "": {"x": 9}}
    nodes = S.shred(events(spark, [(1, json.dumps(value)), (2, "7"), (3, '["q", {}]')]))
    rows = {(r.event_id, r.entity, r.parent_path, r.child_path): {k: v for k, v in r.asDict().items() if v is not None and k not in ("event_id", "run_id", "stage", "entity", "parent_path", "child_path")} for r in S.entities(nodes).collect()}
    assert rows == {
        (1, "$", None, "$"): {"Top": "1", "stage#2": "in", "a\\.b": "2", "a.b": "3", ".x": "9"},
        (1, "rows", "$", "$.a.rows[0]"): {"x": "1", "anchor.kind": "k"},
        (2, "$", None, "$"): {"$": "7"},
        (3, "$", None, "$"): {},
        (3, "", "$", "$[1]"): {},
    }
    assert {tuple(r)[3:] for r in S.scalar_elements(nodes).collect()} == {
        ("$.a.rows[0]", "$.a.rows[0].flags[0]", "flags[]", 0, "p"),
        ("$.a.rows[0]", "$.a.rows[0].flags[1]", "flags[]", 1, None),
        ("$.a.rows[0]", "$.a.rows[0].flags[2][0]", "flags[][]", 0, "4"),
        ("$", "$[0]", "[]", 0, "q"),
    }
