import random

from lorekiln.operators import hierarchy as H

SCHEMA = "id string, parent string, revision int, ingested_at timestamp, label string"


def brute(parents):
    out = {}
    for i in parents:
        seen, x = [], i
        while True:
            if x in seen:
                loop = seen[seen.index(x) :]
                out[i] = ("cycle" if i in loop else "into_cycle", min(loop), -1, "")
                break
            seen.append(x)
            p = parents[x]
            if p is None or p not in parents:
                out[i] = ("tree" if p is None else "orphan", x, len(seen) - 1, ">".join(reversed(seen)))
                break
            x = p
    return out


def found(spark, rows):
    return {r.id: (r.link_status, r.root_id, r.tree_depth, r.tree_path) for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_brute_force(spark):
    random.seed(5)
    names = [f"n{k:03d}" for k in range(120)]
    parents = {n: random.choice([None, "gone", *names, *names[:5], *names[:5]]) for n in names}
    parents |= {f"deep{k}": f"deep{k - 1}" if k else None for k in range(40)} | {f"leaf{k}": "deep39" for k in range(90)}
    rows = [(k, f"\t{v} " if v and k[-1] == "3" else v, 1, None, "x") for k, v in parents.items()]
    rows += [("n000", "n001", 0, None, None), rows[5], (None, "n1", 9, None, None), ("  ", "n1", 9, None, None)]
    assert found(spark, rows) == brute(parents)


def test_edge_cases(spark):
    assert found(spark, []) == {}
    assert found(spark, [("a", "a", 1, None, None), ("b", " ", None, None, None), ("c", None, 1, None, None)]) == {"a": ("cycle", "a", -1, ""), "b": ("tree", "b", 0, "b"), "c": ("tree", "c", 0, "c")}


def test_descendants(spark):
    rows = [("r", None, 1, None, ""), ("a", "r", 1, None, ""), ("b", "a", 1, None, ""), ("c", "r", 1, None, "")]
    _, ranges, _ = H.forest(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(x) for x in H.descendants(ranges).collect()} == {("r", "a", 1), ("r", "b", 2), ("r", "c", 1), ("a", "b", 1)}


def test_blocks_smaller_than_trees(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 3)
    parents = {f"d{k:02d}": f"d{(k - 1) // 2:02d}" if k else None for k in range(40)}
    assert found(spark, [(k, v, 1, None, "") for k, v in parents.items()]) == brute(parents)
