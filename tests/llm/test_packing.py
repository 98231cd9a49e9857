import random

from lorekiln.llm import packing as P

SCHEMA = "doc_id bigint, text string, budget_id int"


def least(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    random.seed(4)
    for _ in range(400):
        capacity = random.randint(6, 40)
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        counts = P.Counts({s: items.count(s) for s in set(items)}, capacity)
        fixed = P.reduce(counts, capacity)
        rest = [s for s in range(1, capacity + 1) for _ in range(counts.n[s])]
        assert sum(p.repeats for p in fixed) + (least(rest, capacity) if rest else 0) == least(items, capacity)


def test_plan_places_every_item_once():
    random.seed(6)
    for capacity in (30, 512):
        counts = {random.randint(1, capacity): random.randint(1, 400) for _ in range(60)}
        fixed, rest = P.plan(counts, capacity)
        got = {}
        for p in fixed + rest:
            assert sum(s * k for s, k in p.sizes) <= capacity
            for s, k in p.sizes:
                got[s] = got.get(s, 0) + k * p.repeats
        assert got == counts


def test_pack(spark):
    words = "the rope is old "
    rows = [(1, None, 0), (2, "", 0), (3, words * 40, 0), (4, words * 40, 0), (None, "x", 0)] + [(k, words * (k % 7 + 1), 0) for k in range(10, 60)]
    budgets = spark.createDataFrame([(1, "a", 64), (2, "b", 200), (3, "c", None), (4, "d", 0)], "budget_id int, budget_name string, capacity_tokens int")
    got = P.pack(spark.createDataFrame(rows, SCHEMA), budgets).collect()
    assert {r.budget_id for r in got} == {1, 2} and {r.doc_id for r in got} == {r[0] for r in rows if r[0]}
    used = {}
    for r in got:
        if r.container_id:
            used[r.budget_id, r.container_id] = used.get((r.budget_id, r.container_id), 0) + r.token_end - r.token_start
    assert all(used[b, c] <= {1: 64, 2: 200}[b] for b, c in used)
    for b in (1, 2):
        ids = sorted(c for x, c in used if x == b)
        assert ids == list(range(1, len(ids) + 1))
    pieces = sorted((r.piece_no, r.token_start, r.token_end) for r in got if r.doc_id == 3 and r.budget_id == 1)
    assert all(x[2] == y[1] for x, y in zip(pieces, pieces[1:])) and pieces[0][1] == 0
    assert [r.container_id for r in got if r.doc_id in (1, 2)] == [None] * 4
    assert P.pack(spark.createDataFrame([], SCHEMA), budgets).count() == 0
