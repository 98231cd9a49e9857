"""Problem 4: the language of each text, and of each segment of a mixed one.

Word-first backoff. A word seen in training is scored by its log frequency in
each language; an unseen word by its character 5-grams, else 4-grams, and so
on down to single characters. Sentences take the sum over their words; a text
takes the most likely sequence of languages over its sentences, where each
change costs SWITCH.

The model is fitted on the labels the rows came with, counted over all rows:
which labels are languages of their own is decided from the words (see
own_languages), so a wrong label that only ever stands on texts of another
language founds none. Most of those are rejected on the cluster: labels with
fewer than FOUNDS words, and labels outside the table of languages whose words
the languages in it explain. What comes to the driver is at most 1 / SHARE
words of each label that is left.

Letters keep their script here (a Cyrillic word stays Cyrillic); width,
composition and invisible characters don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.session import store

from . import words as W
from .codepoints import portions

#: A word enters the model if it makes up this share of its label's words; so a label has at most 1 / SHARE words.
SHARE = 5e-6
#: A label founds a language only with so many words.
FOUNDS = 200
#: Cost of changing the language between two sentences, in nats.
SWITCH = 9.0
#: Share of a label's words that other, larger labels may explain before it counts as none of its own.
EXPLAINED = 0.75
ORDERS = (5, 4, 3, 2, 1)
EDGE = np.uint32(0x2)  # stands for the blank before and after a word

# ISO 639-1 code, then its 639-2 codes and names as labels write them.
LANGUAGES = """
pl pol polski polish polnisch
en eng english englisch angielski
de deu ger german deutsch niemiecki
cs ces cze czech čeština cestina český czeski
sk slk slo slovak slovenčina
uk ukr ukrainian українська ukraiński
ru rus russian русский
bg bul bulgarian български
es spa spanish español espanol castellano hiszpański
pt por portuguese português
fr fra fre french français
it ita italian italiano
nl nld dut dutch nederlands
ja jpn japanese 日本語 japoński
zh zho chi cmn chinese 中文 汉语 chiński
hi hin hindi हिन्दी हिंदी
th tha thai ไทย ภาษาไทย
ko kor korean 한국어
ar ara arabic العربية
sv swe swedish svenska
da dan danish dansk
no nor norwegian norsk
fi fin finnish suomi
hu hun hungarian magyar
ro ron rum romanian română
el ell gre greek ελληνικά
tr tur turkish türkçe
vi vie vietnamese
id ind indonesian
lt lit lithuanian lietuvių
"""
NAMES = {name: line.split()[0] for line in LANGUAGES.strip().splitlines() for name in line.split()}
# Labels that say nothing.
PLACEHOLDERS = ["", "-", "--", "?", "xx", "xxx", "zz", "und", "unk", "unknown", "n/a", "na", "none", "null", "nil", "other", "mul", "mis", "zxx", "auto"]


def normal_label(column: Column) -> Column:
    """ISO 639-1 code of a label in any usual spelling; null where it says nothing.

    Case, blanks, region parts (``en_GB``, ``pl-PL``) and a leading ``język``
    or ``language`` don't matter. Another code of two or three letters stays, in
    lower case: it is a label, only not of a language in the table. Other text
    names no language and gives null.
    """
    text = F.lower(F.trim(F.regexp_replace(column, r"[\s\u00a0]+", " ")))
    text = F.regexp_replace(text, r"^(?:język|language|lang|jazyk|sprache)[ :=]+", "")
    short = F.regexp_replace(text, r"[-_ ].*$", "")
    named = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    code = F.coalesce(F.try_element_at(named, text), F.try_element_at(named, short), F.when(short.rlike("^[a-z]{2,3}$"), short))
    return F.when(column.isNull() | text.isin(PLACEHOLDERS) | short.isin(PLACEHOLDERS), None).otherwise(code)


def word_counts(texts: DataFrame) -> DataFrame:
    """(label, word, n) over all rows of (label, text); counted per batch before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = W.classes()[1]
        for batch in portions(batches, 1):
            labels = batch.column(0).to_pylist()
            names, label_of = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
            codes, bounds = W.unified(batch.column(1), alike=False)
            codes = lower[codes]
            start, end, row = W.spans(codes, bounds)
            if not len(start):
                continue
            with np.errstate(over="ignore"):
                key = W.keys(codes, start, end) + (label_of[row].astype(np.uint64) + np.uint64(1)) * W.P
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[label_of[row[first]]].tolist(), pa.string()), pa.array(W.texts_of(codes, start[first], end[first]), pa.string()), pa.array(n, pa.int64())],
                names=["label", "word", "n"],
            )

    labelled = texts.where(F.col("label").isNotNull() & F.col("text").isNotNull()).select("label", "text")
    counted = labelled.mapInArrow(run, "label string, word string, n bigint")
    return counted.groupBy("label", "word").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    languages: list[str]
    words: np.ndarray  # sorted keys
    word_scores: np.ndarray  # log frequency, a row per key, a column per language
    grams: dict[int, np.ndarray]
    gram_scores: dict[int, np.ndarray]

    def look_up(self, table: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Row of each key in a sorted table, -1 where it is missing."""
        if not len(table):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(table, key), len(table) - 1)
        return np.where(table[at] == key, at, -1)

    def score(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log scores of every word (lower case), a column per language, centred on the best; each distinct word is scored once."""
        key, first, back = np.unique(W.keys(codes, start, end), return_index=True, return_inverse=True)
        start, end = start[first], end[first]
        out = np.zeros((len(start), len(self.languages)), np.float32)
        at = self.look_up(self.words, key)
        out[at >= 0] = self.word_scores[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        left = left[~is_digit(codes[start[left]])]
        for order in ORDERS:
            if not len(left):
                break
            padded, begin, of = pad(codes, start[left], end[left], order)
            found = self.look_up(self.grams[order], W.keys(padded, begin, begin + order))
            of, found = of[found >= 0], found[found >= 0]
            if not len(of):
                continue
            head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            n = np.diff(np.append(head, len(of)))
            out[left[of[head]]] = np.add.reduceat(self.gram_scores[order][found], head, axis=0, dtype=np.float64) / n[:, None]
            left = np.delete(left, of[head])
        out -= out.max(axis=1, keepdims=True) if len(out) else 0
        return out[back]


def is_digit(codes: np.ndarray) -> np.ndarray:
    return (codes >= 0x30) & (codes < 0x3A)


def pad(codes: np.ndarray, start: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between two edge marks laid end to end; begin of each n-gram and the word it is of."""
    size = end - start + 2
    total = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(start)), size)
    within = np.arange(total[-1]) - total[of]
    source = np.clip(start[of] + within - 1, 0, max(len(codes) - 1, 0))
    padded = np.where((within == 0) | (within == size[of] - 1), EDGE, codes[source]).astype(np.uint32)
    fits = within + order <= size[of]
    if order == 1:
        fits &= padded != EDGE
    return padded, np.flatnonzero(fits), of[fits]


def own_languages(counts: dict[str, dict[str, int]]) -> list[str]:
    """Labels that are languages of their own here, the largest first.

    In order of size, a label is left out if labels accepted before it explain
    at least EXPLAINED of its words, a word being explained where one of them
    uses it at least a tenth as often.
    """
    mass = {label: sum(words.values()) for label, words in counts.items()}
    accepted: list[str] = []
    for label in sorted(counts, key=lambda x: (-mass[x], x)):
        known = sum(n for w, n in counts[label].items() if any(counts[m].get(w, 0) / mass[m] >= 0.1 * n / mass[label] for m in accepted))
        if mass[label] and known < EXPLAINED * mass[label]:
            accepted.append(label)
    return accepted


def build(counts: dict[str, dict[str, int]], languages: list[str] | None = None) -> Model:
    """Fit the tables: words (also without their accents, as in careless typing) and n-grams of each order."""
    languages = own_languages(counts) if languages is None else languages
    everything: dict[str, np.ndarray] = {}
    bare = W.classes()[2]
    for k, language in enumerate(languages):
        for word, n in counts[language].items():
            everything.setdefault(word, np.zeros(len(languages)))[k] += n
    for word, n in list(everything.items()):
        plain = "".join(chr(bare[ord(c)]) for c in word)
        if plain != word:
            if plain in everything:
                everything[plain] = everything[plain] + n
            else:
                everything[plain] = n.copy()
    names = list(everything)
    matrix = np.array([everything[w] for w in names]).reshape(len(names), len(languages))
    codes, bounds = W.widen(pa.array(names, pa.string()))
    start, end = bounds[:-1], bounds[1:]
    grams, gram_scores = {}, {}
    weight = np.sqrt(matrix)  # so that n-grams don't only repeat the most frequent words
    for order in ORDERS:
        padded, begin, of = pad(codes, start, end, order)
        key, inverse = np.unique(W.keys(padded, begin, begin + order), return_inverse=True)
        n = np.zeros((len(key), len(languages)))
        np.add.at(n, inverse, weight[of])
        grams[order], gram_scores[order] = key, logs(n)
    key = W.keys(codes, start, end)
    order = np.argsort(key)
    return Model(languages, key[order], logs(matrix)[order], grams, gram_scores)


def logs(n: np.ndarray) -> np.ndarray:
    """Smoothed log relative frequencies by column."""
    if not n.size:
        return n.astype(np.float32)
    total = np.maximum(n.sum(axis=0, keepdims=True), 1)
    return np.log((n / total) + 2e-5).astype(np.float32)


def fit(texts: DataFrame) -> Model:
    """Fit a model on (label, text); see the module text for what comes to the driver."""
    counts = store(word_counts(texts), "language-words")
    totals = counts.groupBy("label").agg(F.sum("n").alias("total")).where(F.col("total") >= FOUNDS)
    kept = store(counts.join(totals, "label").where(F.col("n") >= F.col("total") * SHARE), "kept-words")
    named = F.col("label").isin(sorted(set(NAMES.values())))
    share = F.col("n") / F.col("total")
    best = kept.where(named).groupBy("word").agg(F.max(share).alias("best"))
    unnamed = kept.where(~named).join(best, "word", "left").groupBy("label").agg(
        F.sum(F.when(F.col("best") >= 0.1 * share, F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("all")
    )
    new = unnamed.where(F.col("known") < EXPLAINED * F.col("all")).select("label")
    by_label: dict[str, dict[str, int]] = {}
    for r in kept.where(named).unionByName(kept.where(~named).join(new, "label", "left_semi")).select("label", "word", "n").toLocalIterator():
        by_label.setdefault(r[0], {})[r[1]] = r[2]
    return build(by_label)


TERMINAL = np.array([ord(c) for c in ".!?…。！？।॥؟"], np.uint32)


def chunk_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True where a sentence-like chunk begins: after a terminal with a blank or without (unspaced scripts), after an empty line, after a blank in Thai."""
    kind = W.classes()[0][codes]
    n = len(codes)
    after = np.zeros(n + 1, bool)
    terminal = np.isin(codes, TERMINAL)
    solo_mark = terminal & (codes >= 0x3000)
    blank = kind == W.SPACE
    newline = codes == 10
    thai = (codes >= 0xE00) & (codes < 0xE80)
    nxt = np.concatenate((blank[1:], [True]))
    upper = W.classes()[1][codes] != codes
    lower_before = np.concatenate(([False], (kind == W.WORD)[:-1] & ~upper[:-1]))
    glued = np.concatenate((upper[1:], [False]))
    after[1:] |= terminal & nxt | solo_mark | terminal & lower_before & glued
    after[1:] |= newline & np.concatenate((newline[1:], [False]))
    after[1:] |= blank & np.concatenate(([False], thai[:-1]))
    after[bounds] = True
    return after[:-1]


def best_path(scores: np.ndarray) -> np.ndarray:
    """Most likely language of each chunk, a change costing SWITCH."""
    n, k = scores.shape
    total, back = scores[0].astype(np.float64), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = total.argmax()
        stay = total >= total[top] - SWITCH
        back[i] = np.where(stay, np.arange(k), top)
        total = np.where(stay, total, total[top] - SWITCH) + scores[i]
    path = np.zeros(n, np.int64)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segments_of(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[tuple[str, float, int, int]]]]:
    """For each row that has words: its segments (language, confidence, first and last word).

    The confidence is the share of the best language in the exponential of the
    mean word scores.
    """
    codes, bounds = W.unified(texts, alike=False)
    begins = chunk_starts(codes, bounds)
    codes = W.classes()[1][codes]
    start, end, row = W.spans(codes, bounds)
    kind = W.classes()[0][codes[start]]
    digit = is_digit(codes[start])
    if not len(start) or not model.languages:
        return
    scores = model.score(codes, start, end)
    scores[kind == W.SOLO] *= 0.5  # a letter says less than a word
    chunk = np.cumsum(begins)[start]
    head = np.flatnonzero(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1]))))
    sums = np.add.reduceat(scores, head, axis=0)
    counted = np.add.reduceat((~digit).astype(np.int64), head)
    rows = row[head]
    edges = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    stop = np.concatenate((head[1:], [len(start)]))
    last = np.append(edges[1:], len(rows))
    best = sums.argmax(axis=1)
    words = np.add.reduceat(counted, edges)
    whole, alone = np.add.reduceat(sums, edges, axis=0), np.minimum.reduceat(best, edges) == np.maximum.reduceat(best, edges)

    def sure(total: np.ndarray, n: np.ndarray) -> np.ndarray:
        mean = total / np.maximum(1, n)[:, None]
        return 1 / np.exp(mean - mean.max(axis=1, keepdims=True)).sum(axis=1)

    confidence, names = sure(whole, words).tolist(), model.languages
    for k in np.flatnonzero(words > 0).tolist():
        a, b = int(edges[k]), int(last[k])
        if alone[k]:
            yield int(rows[a]), [(names[best[a]], confidence[k], 0, int(stop[b - 1] - head[a]))]
            continue
        path = best_path(sums[a:b])
        cuts = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1))
        shares = sure(np.add.reduceat(sums[a:b], cuts, axis=0), np.add.reduceat(counted[a:b], cuts))
        ends = np.append(cuts[1:], b - a)
        yield int(rows[a]), [(names[path[x]], float(c), int(head[a + x] - head[a]), int(stop[a + y - 1] - head[a])) for x, y, c in zip(cuts, ends, shares)]


def segments(texts: DataFrame, model: Model) -> DataFrame:
    """(record_kind, record_id, label, text) to one row per segment, with language and confidence.

    Texts without words, null and empty ones give no row.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 3):
            at, no, many, lang, confidence, first, last = [], [], [], [], [], [], []
            for r, found in segments_of(batch.column(3), shared.value):
                for k, (code, c, a, b) in enumerate(found, 1):
                    at.append(r), no.append(k), many.append(len(found)), lang.append(code), confidence.append(c), first.append(a), last.append(b)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(3)), pa.array(no, pa.int32()), pa.array(many, pa.int32()), pa.array(lang, pa.string()), pa.array(confidence, pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                names=["record_kind", "record_id", "label", "segment_no", "segments", "lang", "confidence", "first_word", "end_word"],
            )

    return texts.select("record_kind", "record_id", "label", "text").mapInArrow(
        run, "record_kind string, record_id bigint, label string, segment_no int, segments int, lang string, confidence double, first_word int, end_word int"
    )


def label_cases(found: DataFrame) -> DataFrame:
    """Segments of texts whose label is missing, wrong, or that mix languages."""
    wrong = F.col("label").isNull() | (F.col("segments") > 1) | (F.col("label") != F.col("lang"))
    return found.where(wrong)
