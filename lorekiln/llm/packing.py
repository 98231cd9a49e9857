"""Problem 6: texts into containers of a fixed number of tokens, with little unused space.

Sizes are whole numbers below the capacity, so everything the packing needs to
know is how many items there are of each size: at most ``capacity`` numbers,
however many texts. On these counts

1. Martello and Toth's dominance reduction fixes containers that provably
   belong to some best packing: the largest item alone if nothing fits beside
   it; with an item that fills the container exactly; with the largest that
   fits, if only one can be added or if it is at least as large as any pair
   that can; with the pair that no other pair can beat;
2. the rest is packed by best fit, largest first.

Equal containers are planned together as one pattern with a number of repeats,
so the plan is bounded by the capacity too. The items are then numbered within
their size (over hash buckets, as many as the rows ask for, so that a size
that a third of all texts share is no single task) and find their container by number.

A text larger than the capacity is split into full containers and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.session import store

#: Rows that one hash bucket of a size holds about; the number of buckets follows from that of the rows.
BUCKET_ROWS = 200_000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text, in tokens of the rank file at ``tokenizer``; null and empty texts have 0.

    The driver reads the file (about a megabyte) and ships it with the job.
    """
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens bigint")


class Pattern(NamedTuple):
    sizes: tuple[tuple[int, int], ...]  # (size, how many of it)
    repeats: int


class Counts:
    """How many items there are of each size from 1 to the capacity."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 2, np.int64)
        for size, k in counts.items():
            if not 0 < size <= capacity:
                raise ValueError(f"size {size} doesn't fit {capacity}")
            self.n[size] += k
        # the next size at or below (above) each that isn't used up; items only ever go, so links only ever grow
        self.down = list(range(capacity + 3))
        self.up = list(range(capacity + 3))

    def _next(self, link: list[int], at: int, step: int) -> int:
        """Follow the links from a size to the next with items (0 or the end if none), shortening them on the way."""
        n, end, to = self.n, len(self.n) - 1, at
        while 0 < to < end and not n[to]:
            if link[to] == to:
                link[to] = to + step
            to = link[to]
        while at != to and 0 < at < end:
            link[at], at = to, link[at]
        return to

    def largest(self, most: int) -> int:
        """The largest size there is up to ``most``, or 0."""
        return max(0, self._next(self.down, min(most, len(self.n) - 2), -1)) if most > 0 else 0

    def smallest(self, k: int, above: int = 0, without: int = 0) -> list[int]:
        """The k smallest items above a size, one item of ``without`` left out."""
        out: list[int] = []
        size, end = self._next(self.up, above + 1, 1), len(self.n) - 1
        while size < end and len(out) < k:
            out += [size] * int(min(k, self.n[size] - (size == without)))
            size = self._next(self.up, size + 1, 1)
        return out[:k]

    def take(self, sizes: list[int], once: bool = False) -> Pattern | None:
        """Remove the container as often as the items allow."""
        need = {s: sizes.count(s) for s in sizes}
        times = min(int(self.n[s]) // k for s, k in need.items())
        if times == 0:
            return None
        times = 1 if once else times
        for s, k in need.items():
            self.n[s] -= k * times
        return Pattern(tuple(sorted(need.items(), reverse=True)), times)


def best_pair(c: Counts, space: int, largest_item: int) -> tuple[int, int]:
    """The two items (beside one of ``largest_item``) with the greatest sum up to ``space``; (0, 0) if none."""
    n = c.n[: space + 1].copy()
    if largest_item <= space:
        n[largest_item] -= 1
    there = n > 0
    below = np.maximum.accumulate(np.where(there, np.arange(len(n)), 0))
    a = np.flatnonzero(there[: space + 1])
    if not len(a):
        return 0, 0
    b = below[np.minimum(space - a, a)]  # the second is at most as large
    single = (b == a) & (n[a] < 2)
    b = np.where(single, below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    k = int(total.argmax())
    return (int(a[k]), int(b[k])) if total[k] else (0, 0)


def dominated(c: Counts, w: int, capacity: int) -> list[int] | None:
    """A container for the largest item that dominates every other that holds it, or None."""
    space = capacity - w
    fits = c.smallest(3, without=w)
    fits = [x for k, x in enumerate(fits) if sum(fits[: k + 1]) <= space]
    if not fits:
        return [w]
    partner = c.largest(space)
    if partner == w and c.n[w] == 1:
        partner = c.largest(w - 1)  # the item itself is no partner
    if partner == space or len(fits) == 1:
        return [w, partner]
    if len(fits) == 2:
        a, b = best_pair(c, space, w)
        if partner >= a + b:
            return [w, partner]
        if partner == a:
            above = c.smallest(2, above=b, without=w)
            if len(above) < 2 or sum(above) > space:
                return [w, a, b]
    return None


def reduce(c: Counts, capacity: int) -> list[Pattern]:
    """Fix dominating containers, the largest items first, until a pass over all sizes fixes nothing."""
    fixed: list[Pattern] = []
    while True:
        before = len(fixed)
        w = c.largest(capacity)
        while w:
            sizes = dominated(c, w, capacity)
            made = c.take(sizes) if sizes else None
            if made:
                fixed.append(made)
            if not made or not c.n[w]:
                w = c.largest(w - 1)
        if len(fixed) == before:
            return fixed


def best_fit(c: Counts, capacity: int) -> list[Pattern]:
    """Best fit, largest first; containers of equal content are handled together."""
    groups: dict[int, list[tuple[tuple, int]]] = {}  # space left -> (content as linked pairs, how many)
    spaces: list[int] = []  # those of the groups, in order

    def put(space: int, content: tuple, many: int) -> None:
        if space not in groups:
            insort(spaces, space)
        groups.setdefault(space, []).append((content, many))

    w = c.largest(capacity)
    while w:
        n = int(c.n[w])
        while n:
            k = bisect_left(spaces, w)
            if k < len(spaces):
                space = spaces[k]
                content, many = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[k]
            else:
                space, content = capacity, ()
                many = -(-n // (capacity // w))
            each = space // w
            full = min(many, n // each)
            if full:
                put(space - each * w, (content, w, each), full)
                n -= full * each
            if many > full and n:
                put(space - n * w, (content, w, n), 1)
                n, full = 0, full + 1
            if many > full:
                put(space, content, many - full)
        c.n[w] = 0
        w = c.largest(w - 1)
    out = []
    for space in sorted(groups):
        for content, many in groups[space]:
            sizes = []
            while content:
                content, w, k = content
                sizes.append((w, k))
            out.append(Pattern(tuple(reversed(sizes)), many))
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], list[Pattern]]:
    """Patterns fixed by dominance, and those of the rest."""
    c = Counts(counts, capacity)
    fixed = reduce(c, capacity)
    return fixed, best_fit(c, capacity)


def runs(patterns: list[Pattern]) -> list[tuple[int, int, int, int]]:
    """(size, first number, first container, items of that size per container), numbers and containers from 0."""
    used: dict[int, int] = {}
    out, container = [], 0
    for p in patterns:
        for size, k in p.sizes:
            out.append((size, used.get(size, 0), container, k))
            used[size] = used.get(size, 0) + k * p.repeats
        container += p.repeats
    return out


ASSIGNED = "budget_id int, capacity_tokens int, container_id bigint, doc_id bigint, piece_no int, token_start bigint, token_end bigint"


def _numbered(items: DataFrame, salts: int) -> DataFrame:
    """Number the items of each (budget, size) from 0, by hash bucket and id."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    group = ["budget_id", "size"]
    sizes = salted.groupBy(*group, "salt").agg(F.count("*").alias("here"))
    skip = sizes.withColumn("skip", F.sum("here").over(Window.partitionBy(*group).orderBy("salt")) - F.col("here")).drop("here")
    own = F.row_number().over(Window.partitionBy(*group, "salt").orderBy("doc_id")) - 1
    return salted.withColumn("own", own).join(skip, [*group, "salt"]).withColumn("number", F.col("own") + F.col("skip")).drop("salt", "own", "skip")


def pack(documents: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece of a text and budget: its container and its token range.

    Containers are numbered from 1 within a budget; first come the full pieces
    of texts above the capacity, whose container is theirs alone. Texts without
    tokens (null, empty) need no space: one row with a null container. Budgets
    with a null or non-positive capacity are left out; a repeated doc_id is
    packed once per row.
    """
    spark = documents.sparkSession
    caps = {int(r[0]): int(r[1]) for r in budgets.select("budget_id", "capacity_tokens").where("budget_id IS NOT NULL AND capacity_tokens > 0").collect()}
    if not caps:
        return spark.createDataFrame([], ASSIGNED)
    sized = store(token_counts(documents, tokenizer), "token-counts")
    salts = 64 + sized.count() // BUCKET_ROWS
    offers = F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity_tokens")) for b, c in sorted(caps.items())])
    each = sized.select("doc_id", "tokens", F.explode(offers).alias("b")).select("b.budget_id", "b.capacity_tokens", "doc_id", "tokens")
    each = each.withColumn("pieces", F.floor(F.col("tokens") / F.col("capacity_tokens"))).withColumn("size", F.col("tokens") % F.col("capacity_tokens"))
    counted = each.groupBy("budget_id", "size").agg(F.count("*").alias("n"), F.sum("pieces").alias("full")).collect()  # at most one row per size below each capacity
    starts: dict[int, int] = {}
    table = []
    for b, c in sorted(caps.items()):
        rows = [r for r in counted if r.budget_id == b]
        starts[b] = sum(r.full for r in rows)
        fixed, rest = plan({r["size"]: r.n for r in rows if r["size"]}, c)
        table += [(b, *r) for r in runs(fixed + rest)]
    table.sort()
    columns = [np.array(x, np.int64) for x in zip(*table)] if table else [np.zeros(0, np.int64)] * 5
    shared = spark.sparkContext.broadcast((columns, starts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (budget, size, first, container, per), starts = shared.value
        group = budget * (1 << 32) + size
        heads, at = np.unique(group, return_index=True)
        ends = np.append(at[1:], len(group))
        for batch in batches:
            b, cap, doc, tokens, s, number = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            found = np.zeros(len(b), np.int64)
            of = np.searchsorted(heads, b * (1 << 32) + s)
            for k in np.unique(of):
                mine = of == k
                run = at[k] + np.searchsorted(first[at[k] : ends[k]], number[mine], side="right") - 1
                found[mine] = container[run] + (number[mine] - first[run]) // per[run]
            found += 1 + np.array([starts[int(x)] for x in b], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.array(cap, pa.int32()), pa.array(found), pa.array(doc), pa.array(tokens // cap + 1, pa.int32()), pa.array(tokens - s), pa.array(tokens)],
                names=[c.split()[0] for c in ASSIGNED.split(", ")],
            )

    rest = _numbered(each.where("size > 0"), salts).select("budget_id", "capacity_tokens", "doc_id", "tokens", "size", "number").mapInArrow(place, ASSIGNED)
    whole = each.where("pieces > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    before = whole.groupBy("budget_id", "salt").agg(F.sum("pieces").alias("here"))
    before = before.withColumn("skip", F.sum("here").over(Window.partitionBy("budget_id").orderBy("salt")) - F.col("here")).drop("here")
    own = F.sum("pieces").over(Window.partitionBy("budget_id", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("pieces")
    split = (
        whole.withColumn("own", own)
        .join(before, ["budget_id", "salt"])
        .select("budget_id", "capacity_tokens", "doc_id", (F.col("own") + F.col("skip")).alias("from"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pieces"))).alias("piece"))
        .select(
            F.col("budget_id").cast("int").alias("budget_id"),
            F.col("capacity_tokens").cast("int").alias("capacity_tokens"),
            (F.col("from") + F.col("piece")).alias("container_id"),
            "doc_id",
            F.col("piece").cast("int").alias("piece_no"),
            ((F.col("piece") - 1) * F.col("capacity_tokens")).alias("token_start"),
            (F.col("piece") * F.col("capacity_tokens")).alias("token_end"),
        )
    )
    nothing = each.where("tokens = 0").select(
        F.col("budget_id").cast("int").alias("budget_id"),
        F.col("capacity_tokens").cast("int").alias("capacity_tokens"),
        F.lit(None).cast("bigint").alias("container_id"),
        "doc_id",
        F.lit(1).alias("piece_no"),
        F.lit(0).cast("bigint").alias("token_start"),
        F.lit(0).cast("bigint").alias("token_end"),
    )
    return rest.unionByName(split).unionByName(nothing)


def usage(assigned: DataFrame) -> DataFrame:
    """Per budget: containers, tokens, the least possible number of containers, and the unused share."""
    filled = assigned.where("container_id IS NOT NULL").groupBy("budget_id", "capacity_tokens", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    return filled.groupBy("budget_id", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("used").alias("tokens"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_containers"),
        F.max("used").alias("most_used"),
        F.round(1 - F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 6).alias("unused_share"),
    )
