"""Problem 7: passages of held-out test items inside training documents.

A distributed positional inverted index holds (term, document, position) of
every document word that occurs in the test items, with the terms next to it.
For each run of SEED test words the rarest one (by its postings) is looked up
first; the three terms before or the three behind must agree at once (a run of
six around it holds one of these triples). Then the offset-adjusted postings of
the rest of the run are intersected: what holds all of them is an exact phrase.
The surviving alignments are laid over all words of their item, and their runs
are joined over one replaced or omitted word to the asked-for passage.

A passage counts if at least MIN_WORDS consecutive item words stand in the
document in order, beginning and ending with a word that does, and among any
ONE_IN of them at most one is replaced or left out ("one word in eight" is
read as a bound everywhere, not as an average). Such a passage always holds one
of at least MIN_WORDS words with at most one change: with two changes it has
16 words or more, and cutting it at its first or last change leaves twelve.
So one change is what is tested, and since 12 words with one change leave an
exact run of six, the seeds lose nothing.

Nothing of the documents or items comes to the driver but a filter of BITS bits
that keeps most other words out of the index; what it lets through is dropped
by an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.session import store

from . import words as W
from .codepoints import portions

SEED, MIN_WORDS, ONE_IN = 6, 12, 8
#: Bits of the filter, whatever the number of test words.
BITS = 1 << 24
INDEX = "doc_id bigint, position int, term bigint, before bigint, behind bigint"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in its row and 64-bit term of every word; case and visually identical characters don't count."""
    codes, bounds = W.unified(texts)
    codes = W.classes()[1][codes]
    start, end, row = W.spans(codes, bounds)
    if not len(row):
        return row, row, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row, number, W.keys(codes, start, end).view(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, ipos, term, before, behind) of the test items, stored; null ids and texts give no rows, repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            row, number, term = _terms(batch.column(1))
            near = [pa.array(x, pa.int64()) for x in _triples(term, row)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(term, pa.int64()), *near], names=["item_id", "ipos", "term", "before", "behind"])

    texts = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    return store(texts.mapInArrow(run, "item_id bigint, ipos int, term bigint, before bigint, behind bigint").distinct(), "item-terms")


def _places(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of each term."""
    bits = term.view(np.uint64)
    return (bits % np.uint64(BITS)).astype(np.int64), ((bits >> np.uint64(24)) % np.uint64(BITS)).astype(np.int64)


def word_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms as BITS booleans, put together on the cluster from words of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(_places(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 5, pa.int64()), pa.array(np.int64(1) << (place & 31), pa.int64())], names=["word", "bits"])

    words = terms.select("term").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BITS / 32 rows
    packed = np.zeros(BITS // 32, np.uint32)
    packed[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)


def _triples(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of the three terms before and of the three behind each term of its row; 0 where there are fewer."""
    n = len(term)
    if n < 4:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    bits = term.view(np.uint64)
    with np.errstate(over="ignore"):
        key = (bits[:-2] * W.P + bits[1:-1]) * W.P + bits[2:]  # of the triple that begins here
    key |= np.uint64(1)
    whole = row[:-2] == row[2:]
    before, behind = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[3:] = np.where(whole[:-1] & (row[2:-1] == row[3:]), key[:-1], 0)
    behind[:-3] = np.where(whole[1:] & (row[1:-2] == row[:-3]), key[1:], 0)
    return before.view(np.int64), behind.view(np.int64)


def positional_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, position, term, before, behind) of the document words that occur in the items, stored clustered by term.

    Positions count all words of the text, also those that aren't stored; so do
    the triples before and behind. Documents with a null id or text have no postings.
    """
    wanted = documents.sparkSession.sparkContext.broadcast(word_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            row, number, term = _terms(batch.column(1))
            a, b = _places(term)
            keep = np.flatnonzero(wanted.value[a] & wanted.value[b])
            near = [x[keep] for x in _triples(term, row)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[keep])), pa.array(number[keep], pa.int32()), pa.array(term[keep], pa.int64()), *(pa.array(x, pa.int64()) for x in near)],
                names=["doc_id", "position", "term", "before", "behind"],
            )

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    postings = texts.mapInArrow(run, INDEX).join(terms.select("term").distinct(), "term", "left_semi")
    return store(postings.select("doc_id", "position", "term", "before", "behind"), "postings", ["term", "doc_id", "position"])


SEEDS_SQL = f"""
WITH counted AS (SELECT term, count(*) AS postings FROM {{index}} GROUP BY term
), placed AS (SELECT t.*, coalesce(postings, 0) AS postings FROM {{terms}} t LEFT JOIN counted c ON c.term = t.term
), runs AS (
  SELECT item_id, min(struct(postings, ipos, term, before, behind)) OVER w AS rarest, count(*) OVER w AS words FROM placed
  WINDOW w AS (PARTITION BY item_id ORDER BY ipos ROWS BETWEEN CURRENT ROW AND {SEED - 1} FOLLOWING))
SELECT DISTINCT item_id, rarest.ipos, rarest.term, rarest.before, rarest.behind FROM runs WHERE words = {SEED} AND rarest.postings > 0
"""
#: The words around each look-up that may be in one run with it.
NEIGHBOURS_SQL = f"""
SELECT n.item_id, n.ipos, n.step, t.term FROM (SELECT item_id, ipos, ipos + step AS at, step FROM {{seeds}} LATERAL VIEW explode(sequence({1 - SEED}, {SEED - 1})) AS step WHERE step <> 0) n
JOIN {{terms}} t ON t.item_id = n.item_id AND t.ipos = n.at
"""
HITS_SQL = """
SELECT DISTINCT doc_id, item_id, s.ipos, position - s.ipos AS shift FROM {index} i JOIN {seeds} s ON s.term = i.term WHERE i.before = s.before AND s.before <> 0 OR i.behind = s.behind AND s.behind <> 0
"""
RUNS_OF_SEED = " OR ".join(f"bits & {sum(1 << k for k in range(SEED - 1 - j, 2 * SEED - 1 - j) if k != SEED - 1)} = {sum(1 << k for k in range(SEED - 1 - j, 2 * SEED - 1 - j) if k != SEED - 1)}" for j in range(SEED))
PHRASES_SQL = f"""
SELECT DISTINCT doc_id, item_id, shift FROM (
  SELECT doc_id, item_id, shift, ipos, bit_or(shiftleft(1, step + {SEED - 1})) AS bits FROM (
    SELECT doc_id, h.item_id, shift, h.ipos, step, shift + h.ipos + step AS position, n.term FROM {{hits}} h JOIN {{neighbours}} n ON n.item_id = h.item_id AND n.ipos = h.ipos) p
  LEFT SEMI JOIN {{index}} i ON i.doc_id = p.doc_id AND i.position = p.position AND i.term = p.term
  GROUP BY doc_id, item_id, shift, ipos)
WHERE {RUNS_OF_SEED}
"""
#: The alignments of each document with the words of their items, at most CHUNK in a row, and the document's own postings.
CHUNK = 256
CHUNKS_SQL = f"""
WITH words AS (SELECT item_id, transform(array_sort(collect_list(struct(ipos, term))), x -> x.term) AS words FROM {{terms}} GROUP BY item_id
), alignments AS (  -- also one word on: there the run before an omitted word begins
  SELECT DISTINCT doc_id, item_id, shift + d AS shift FROM {{phrases}} LATERAL VIEW explode(array(0, 1)) AS d
), asked AS (
  SELECT p.doc_id, p.item_id, p.shift, w.words, div(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.item_id, p.shift) - 1, {CHUNK}) AS chunk FROM alignments p JOIN words w ON w.item_id = p.item_id
), asked_by_doc AS (SELECT doc_id, chunk, collect_list(struct(item_id, shift, words)) AS asked FROM asked GROUP BY doc_id, chunk
), postings AS (SELECT doc_id, collect_set(struct(position, term)) AS postings FROM {{near}} LEFT SEMI JOIN {{phrases}} USING (doc_id) GROUP BY doc_id)
SELECT a.doc_id, a.asked, p.postings FROM asked_by_doc a JOIN postings p ON p.doc_id = a.doc_id
"""


def _runs(match: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Length of the unbroken run of matches that ends at each place; a run never goes beyond a begin."""
    at = np.arange(1, len(match) + 1)
    stop = np.where(match, 0, at)
    stop[begins] = np.maximum(stop[begins], at[begins] - 1)
    return at - np.maximum.accumulate(stop)


def align(doc: np.ndarray, words: np.ndarray, lengths: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For alignments laid end to end: the longest passage of each with at most one change (words, begin), and the words in exact runs.

    ``words`` holds the items' words end to end, ``doc`` the document's by
    position. A replaced word stays in its alignment, behind an omitted one the
    document is one word behind.
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    of = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - begins[of]

    def matches(extra: int) -> np.ndarray:
        at = place + shifts[of] + extra
        return (at >= 0) & (at < len(doc)) & (doc[np.clip(at, 0, len(doc) - 1)] == words)

    back = lambda m: _runs(m[::-1], (len(m) - ends)[::-1])[::-1]
    here = matches(0)
    before = _runs(here, begins)
    best, start = before.copy(), place + 1 - before
    for later in (here, matches(-1)):
        after = back(later)
        inside = np.flatnonzero((place[1:-1] > 0) & (place[1:-1] < lengths[of[1:-1]] - 1)) + 1  # the changed word
        left, right = before[inside - 1], after[inside + 1]
        total = np.where((left > 0) & (right > 0), left + 1 + right, 0)
        longer = total > best[inside]
        best[inside[longer]] = total[longer]
        start[inside[longer]] = place[inside[longer]] - left[longer]
    order = np.lexsort((start, best, of))
    top = order[ends - 1]  # the longest of each alignment, the last begin among equals
    whole = before + back(here) - 1 >= SEED
    return best[top], start[top], here & whole


FOUND_SQL = f"""
SELECT doc_id, item_id, best.a AS item_start, best.words AS passage_words, covered AS covered_words FROM (
  SELECT doc_id, item_id, max(struct(words, a)) AS best, size(array_distinct(flatten(collect_list(covered)))) AS covered FROM {{passages}} GROUP BY doc_id, item_id)
WHERE best.words >= {MIN_WORDS}
"""


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_start, passage_words, covered_words): one row per document and leaked item.

    ``covered_words`` counts the item words in exact runs of SEED or more. All
    documents are indexed, every test item is a query. Empty tables, null texts
    and texts shorter than a passage give no rows; a repeated document counts
    once.
    """
    spark = documents.sparkSession
    terms = item_terms(items)
    index = positional_index(documents, terms)
    seeds = store(spark.sql(SEEDS_SQL, index=index, terms=terms), "seeds")
    hits = store(spark.sql(HITS_SQL, index=index, seeds=seeds), "hits")
    near = store(index.select("doc_id", "position", "term").join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "near")
    neighbours = spark.sql(NEIGHBOURS_SQL, seeds=seeds, terms=terms)
    phrases = store(spark.sql(PHRASES_SQL, hits=hits, neighbours=neighbours, index=near), "phrases")
    schema = "doc_id bigint, item_id bigint, words int, a int, covered array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, asked, posted in zip(batch.column(0), batch.column(1), batch.column(2)):
                position, term = (posted.values.field(k).to_numpy() for k in ("position", "term"))
                doc = np.zeros(int(position.max()) + 1, np.int64)
                doc[position] = term
                item, shift, words = (asked.values.field(k) for k in ("item_id", "shift", "words"))
                lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
                best, start, covered = align(doc, words.flatten().to_numpy(), lengths, shift.to_numpy().astype(np.int64))
                at = np.flatnonzero(covered)
                ends = np.cumsum(lengths)
                offsets = np.concatenate(([0], np.searchsorted(at, ends)))
                places = at - np.repeat(ends - lengths, np.diff(offsets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * len(lengths), pa.int64()),
                        item,
                        pa.array(best, pa.int32()),
                        pa.array(start, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32())),
                    ],
                    names=["doc_id", "item_id", "words", "a", "covered"],
                )

    passages = spark.sql(CHUNKS_SQL, terms=terms, phrases=phrases, near=near).mapInArrow(run, schema)
    return spark.sql(FOUND_SQL, passages=passages)
