"""Problem 2: sentence units of texts in many languages and scripts.

Unsupervised, per language (Kiss and Strunk's approach): from counts over all
texts, log-likelihood ratios tell which words are abbreviations (they keep
their period too often, are short, and hardly stand without it), which words
begin sentences, and which pairs of words around a period are collocations
(``3. Mai``). Each period is then classified with these statistics. Other
terminals, quotations, ellipses and unspaced scripts follow fixed rules.

Besides the usual counts an abbreviation is asked whether it also ends
sentences: how often its period stands before a paragraph end, against that of
all words. Such a one (``etc.``) ends a unit before a capital letter, another
(``Dr.``) only before a word that is known to begin sentences. The same ratio
is taken by the number of words before it: ``r.`` may end sentences in
general, but never as their third word (``Zimą 1846 r.``).

Scores are those of at most PER uses, so that a word is judged alike in small
and large inputs. The work on a text is linear in its length: words are looked
for at positions, at most REACH letters back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.session import store

from . import langid
from .codepoints import portions

#: Thresholds of the log-likelihood scores, as published.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: An abbreviation's score is that of so many uses at most.
PER = 100
#: Share of its capitalised uses at definite sentence starts that makes a word a starter.
STARTS = 0.8
#: An abbreviation ends sentences if its periods stand before paragraph ends at this part of the usual rate.
FINAL = 0.2
#: A collocation holds this share of the second word's uses behind periods, this one of the first word's periods, and more cases than repeated texts make.
BOUND, SEEN, REPEATS = 0.5, 0.001, 3
#: Words before a period are counted up to so many.
PLACES = 8
#: Letters that are looked at to find the word before a period or behind it.
REACH = 64
#: Number of words in one row of counts that stands for any number.
NUMBER = "##number##"

BREAKS = r"\n\r\x0b\x0c\x85\u2028\u2029"
NEWLINE = f"(?:\\r\\n|[{BREAKS}])"
PARAGRAPH = re.compile(f"{NEWLINE}(?:[^\\S{BREAKS}]*{NEWLINE})+|\\u2029")
HIDDEN = r"\u00ad\u200b-\u200f\u2060\ufeff"
IGNORED = re.compile(f"[{HIDDEN}]")
#: Letters, digits, combining marks, Devanagari signs and what can't be seen.
LETTER = rf"[\w\u0300-\u036f\u0900-\u0963\u0971-\u097f{HIDDEN}]"
WORD = rf"{LETTER}(?:(?:{LETTER}|[.'\u2019\u2010\u2011-])*{LETTER})?"
WORDS = re.compile(WORD)
BACKWARD = re.compile(rf"{LETTER}(?:(?:{LETTER}|[.'\u2019\u2010\u2011-])*{LETTER})?")  # for reversed text
NEXT_WORD = re.compile(rf"{LETTER}{{1,{REACH}}}")
VISIBLE = re.compile(r"\S")
CLOSERS = "\"'”’“»›)］]）」』】〉》"
CANDIDATE = re.compile(f"([.!?…。！？｡।॥؟]+)([{re.escape(CLOSERS)}]*)")
QUOTES = set("\"”’“»›」』")
OPENERS = set("\"„“‚‘«‹「『»")
UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff、。，！？「」『』“”（）…]")
THAI = re.compile(r"[\u0e00-\u0e7f]")
HIRAGANA = re.compile(r"[\u3040-\u309f]")
OPEN_MARKS = "\"'„“‚‘«‹([¿¡（「『—–-"


def word_type(word: str) -> str:
    """A word as counted: lower case, without invisible characters; all numbers are one type."""
    word = IGNORED.sub("", word).lower()
    return NUMBER if word[:1].isdigit() and not any(c.isalpha() for c in word) else word


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Begin and end of every stretch between empty or blank lines, blanks at its ends left out."""
    out, at = [], 0
    for begin, end in [*((m.start(), m.end()) for m in PARAGRAPH.finditer(text)), (len(text), len(text))]:
        part = text[at:begin]
        left = len(part) - len(part.lstrip())
        if left < len(part):
            out.append((at + left, at + len(part.rstrip())))
        at = end
    return out


#: Marks behind which a word is at a definite start, or perhaps at one.
EVENT = re.compile(rf"([.:!?…{re.escape(''.join(sorted(OPENERS)))}][^\w\s]*)(\s*)")
BEHIND = re.compile(rf"[^\w\s]*({WORD})")


def word_before(text: str, at: int, begin: int) -> str:
    """The word that ends at a place, looked for at most REACH letters back."""
    m = BACKWARD.match(text[max(begin, at - REACH) : at][::-1])
    return m.group()[::-1] if m else ""


def period_type(text: str, at: int, begin: int) -> str:
    """The type of the word before the period at ``at``; letters set apart (``a. m.``) are one type."""
    word = word_before(text, at, begin)
    kind = word_type(word)
    if len(word) == 1 and (m := LETTERS_APART.search(text, max(begin, at - 8), at)):
        return f"{m.group(1).lower()}. {kind}"
    return kind


def place_of(text: str, at: int, begin: int) -> int:
    """Number of words between the begin of a unit and a period, the last one included, at most PLACES."""
    return min(PLACES, len(text[max(begin, at - REACH * 2) : at].split()))


Counts = dict[tuple[str, "str | None", "int | None"], list[int]]  # (type, following type, place) -> numbers by KINDS
KINDS = ["uses", "dot", "starts", "inside", "end"]
USES, DOT, START, INSIDE, END = range(5)


def count_paragraphs(texts: list[str], counts: Counts) -> None:
    """Add the words of paragraphs in one language to ``counts``.

    Three kinds of rows: a word alone (uses, periods, capitalised at definite
    starts and inside, periods at paragraph ends); with the word behind its
    period; and with its place among the words of the unit.
    """

    def row(kind: str, other: str | None = None, place: int | None = None) -> list[int]:
        return counts.setdefault((kind, other, place), [0] * len(KINDS))

    surfaces: Counter = Counter()
    for text in texts:
        surfaces.update(WORDS.findall(text))
        unit = 0
        if (m := BEHIND.match(text)) and m.group(1)[0].isupper():
            first = row(word_type(m.group(1)))
            first[START] += 1
            first[INSIDE] -= 1
        for m in EVENT.finditer(text):
            marks, gap = m.groups()
            if marks == "." and not gap and NEXT_WORD.match(text, m.end()):
                continue  # within a word (``v2.3``)
            after = BEHIND.match(text, m.end())
            word = after.group(1) if after else ""
            follow = word_type(word)
            sure = gap and ("!" in marks or "?" in marks) and not any(c in QUOTES for c in marks)
            if word[:1].isupper():
                at_start = row(follow)
                at_start[INSIDE] -= 1
                at_start[START] += bool(sure)
            if marks[0] == "." and marks[1:2] != ".":
                kind = period_type(text, m.start(), 0)
                if kind:
                    alone, placed = row(kind), row(kind, None, place_of(text, m.start(), unit))
                    alone[DOT] += 1
                    placed[DOT] += 1
                    if " " in kind:
                        alone[USES] += 1
                    if not text[m.end() : m.end() + 1]:
                        alone[END] += 1
                        placed[END] += 1
                    elif gap and word[:1].isalpha():
                        row(kind, follow)[DOT] += 1
            if gap and marks[0] in ".!?…":
                unit = m.end()
    for word, n in surfaces.items():
        one = row(word_type(word))
        one[USES] += n
        if word[0].isupper():
            one[INSIDE] += n


def paragraph_languages(texts: list[str], model: langid.Model) -> list[str]:
    """The main language of each paragraph; ``""`` where there are no words."""
    out = [""] * len(texts)
    for row, found in langid.segments_of(pa.array(texts, pa.string()), model):
        out[row] = max(found, key=lambda s: s[3] - s[2])[0]
    return out


COUNT = "struct<lang:string,type:string,other:string,place:int," + ",".join(f"{k}:bigint" for k in KINDS) + ">"
READ = f"doc_id bigint, text string, langs array<string>, counts array<{COUNT}>"


def read_once(texts: DataFrame, model: langid.Model) -> DataFrame:
    """The texts with the language of each paragraph, and the counts of each portion in a row of its own; stored."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    count = pa.struct([("lang", pa.string()), ("type", pa.string()), ("other", pa.string()), ("place", pa.int32()), *((k, pa.int64()) for k in KINDS)])
    types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = [paragraphs(t) for t in texts]
            flat = [t[a:b] for t, p in zip(texts, parts) for a, b in p]
            langs = paragraph_languages(flat, shared.value)
            by_lang: dict[str, list[str]] = {}
            for lang, part in zip(langs, flat):
                by_lang.setdefault(lang, []).append(part)
            columns: list[list] = [[] for _ in count]
            for lang, some in by_lang.items():
                counts: Counts = {}
                count_paragraphs(some, counts)
                for key, numbers in counts.items():
                    for column, value in zip(columns, (lang, *key, *numbers)):
                        column.append(value)
            rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, count)], fields=list(count))
            own = iter(langs)
            # one more row for the counts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids, None], types[0]),
                    pa.array([*texts, None], types[1]),
                    pa.array([*([next(own) for _ in p] for p in parts), None], types[2]),
                    pa.ListArray.from_arrays(pa.array([0] * (len(ids) + 1) + [len(rows)], pa.int32()), rows),
                ],
                names=["doc_id", "text", "langs", "counts"],
            )

    return store(texts.mapInArrow(run, READ), "read")


def summed(read: DataFrame) -> DataFrame:
    """(lang, type, other, place, numbers) over all texts, stored: read by each statistic."""
    rows = read.where(F.size("counts") > 0).select(F.inline("counts"))
    return store(rows.groupBy("lang", "type", "other", "place").agg(*[F.sum(k).alias(k) for k in KINDS]), "word-counts")


class Statistics(NamedTuple):
    abbreviations: dict[tuple[str, str], bool]  # (lang, type) -> does it end sentences too
    starters: set[tuple[str, str]]
    collocations: set[tuple[str, str, str]]  # (lang, type before a period, type behind it)
    inner: set[tuple[str, str, int]]  # (lang, abbreviation, place) where it doesn't end a sentence


def _ratio(n, k, p, q):  # noqa: ANN001 - Spark columns
    """Twice the log-likelihood ratio of k successes in n under q against p."""
    eps = F.lit(1e-10)
    return 2 * (k * (F.log(q + eps) - F.log(p + eps)) + (n - k) * (F.log(1 - q + eps) - F.log(1 - p + eps)))


def learn(counts: DataFrame) -> Statistics:
    """The statistics of every language from summed(); only what passes a test leaves the cluster.

    Collocations are asked for where a period would end a unit: behind numbers
    and behind abbreviations that end sentences too. Each holds at least SEEN of
    the first word's periods, so there are at most 1 / SEEN for each of those.
    """
    number = F.col("type") == NUMBER
    alone = counts.where("other IS NULL AND place IS NULL")
    totals = alone.groupBy("lang").agg(F.sum("uses").alias("tokens"), F.sum("dot").alias("dots"), F.sum("end").alias("ends"), F.sum("starts").alias("all_starts"))
    few = F.broadcast(totals)  # a row for each language of the model
    c = alone.where("dot > 0 OR starts > 0").join(few, "lang").withColumn("n", F.greatest("uses", "dot"))
    n, free = F.col("n"), F.greatest(F.col("n") - F.col("dot"), F.lit(0))
    letters = F.length(F.regexp_replace("type", r"[. ]", ""))
    periods = F.length(F.regexp_replace("type", r"[^.]", "")) + 1
    scale = F.least(F.lit(1.0), PER / n)
    keeps = _ratio(n, F.col("dot"), F.try_divide("dots", "tokens"), F.lit(0.99)) * scale
    score = keeps * F.exp(-letters) * periods * F.exp(-free * scale * F.log(F.greatest(letters, F.lit(1))))
    is_abbreviation = (F.col("dot") > 0) & ~number & (score >= ABBREVIATION)
    ends_too = F.try_divide("end", "dot") >= FINAL * F.try_divide("ends", "dots")
    capital = F.col("starts") + F.greatest(F.col("inside"), F.lit(0))
    share, usual = F.try_divide(F.col("starts"), n), F.try_divide("all_starts", "tokens")
    starter = (share > usual) & (_ratio(n, F.col("starts"), usual, share) >= STARTER) & (F.col("starts") >= STARTS * capital)
    judged = c.select("lang", "type", is_abbreviation.alias("abbreviation"), ends_too.alias("ends_too"), starter.alias("starter")).where("abbreviation OR starter")
    judged = store(judged, "judged-words")
    found = Statistics({}, set(), set(), set())
    for r in judged.toLocalIterator():
        if r.abbreviation:
            found.abbreviations[r.lang, r.type] = bool(r.ends_too)
        if r.starter:
            found.starters.add((r.lang, r.type))
    final = judged.where("abbreviation AND ends_too").select("lang", "type")
    inside = counts.where("place IS NOT NULL").join(final, ["lang", "type"]).join(few, "lang")
    rate, usual_end = F.try_divide("end", "dot"), F.try_divide("ends", "dots")
    rarely = inside.where((rate < FINAL * usual_end) & (_ratio(F.col("dot"), F.col("end"), usual_end, rate) >= COLLOCATION))
    for r in rarely.select("lang", "type", "place").toLocalIterator():
        found.inner.add((r.lang, r.type, r.place))
    pairs = counts.where("other IS NOT NULL").select("lang", "type", "other", F.col("dot").alias("both"))
    behind = pairs.groupBy("lang", "other").agg(F.sum("both").alias("of_other"))
    before = pairs.groupBy("lang", "type").agg(F.sum("both").alias("of_type"))
    all_pairs = F.broadcast(pairs.groupBy("lang").agg(F.sum("both").alias("of_all")))
    asked = final.unionByName(few.select("lang", F.lit(NUMBER).alias("type")))
    starters = judged.where("starter").select("lang", F.col("type").alias("other"))
    likely = _ratio(F.col("of_type"), F.col("both"), F.try_divide(F.col("of_other") - F.col("both"), F.greatest(F.col("of_all") - F.col("of_type"), F.lit(1))), F.try_divide("both", "of_type"))
    tied = (
        pairs.join(asked, ["lang", "type"]).join(before, ["lang", "type"]).where((F.col("both") > REPEATS) & (F.col("both") >= SEEN * F.col("of_type")))
        .join(behind, ["lang", "other"]).join(all_pairs, "lang").where((F.col("both") >= BOUND * F.col("of_other")) & (likely >= COLLOCATION))
        .join(starters, ["lang", "other"], "left_anti")
    )
    for r in tied.select("lang", "type", "other").toLocalIterator():
        found.collocations.add((r.lang, r.type, r.other))
    return found


LETTERS_APART = re.compile(r"(?:(?<=[\s(])|^)([^\W\d_])\.\s+\w$")


class Part:
    """One paragraph with what is asked about its places; each answer costs a bounded or amortised constant time."""

    def __init__(self, text: str, lang: str) -> None:
        self.text, self.lang, self.unit = text, lang, 0
        self._marks = {c: [m.start() for m in re.finditer(c, text)] for c in "\"„“" if c in text}

    def first(self, at: int) -> str:
        """The first visible letter from a place on, or an empty string."""
        m = VISIBLE.search(self.text, at)
        return m.group() if m else ""

    def count(self, mark: str, begin: int, end: int) -> int:
        places = self._marks.get(mark, [])
        return bisect_left(places, end) - bisect_left(places, begin)

    def opens(self, at: int) -> bool:
        """Whether a straight or rounded quotation mark at a place opens one: no other is open in the unit."""
        if self.text[at] == '"':
            return self.count('"', self.unit, at) % 2 == 0
        return self.text[at] == "“" and not self.count("„", self.unit, at) and not self.count("“", self.unit, at)


def period_ends(part: Part, dot: int, at: int, closed: bool, s: Statistics) -> bool:
    """Whether a single period at ``dot`` ends a unit at ``at``, behind its closing marks."""
    text, lang = part.text, part.lang
    word = word_before(text, dot, part.unit)
    kind = period_type(text, dot, part.unit)
    behind = VISIBLE.search(text, at)
    begin = behind.start() if behind else len(text)
    nxt, gap = text[begin : begin + 1], begin > at
    bare = begin
    while bare < min(len(text), begin + REACH) and (text[bare] in OPEN_MARKS or text[bare].isspace()):
        bare += 1
    m = NEXT_WORD.match(text, bare)
    follow = m.group() if m else ""
    opened = bool(nxt) and nxt in OPEN_MARKS
    first = follow[:1]
    if not gap and not closed:
        if opened and nxt not in "-–—'":
            return True  # a quotation or bracket begins right behind it
        long = len(IGNORED.sub("", word).rpartition(".")[2]) > 1
        return first.isupper() and not nxt.isdigit() and long and (lang, kind) not in s.abbreviations and len(follow) > 1
    if nxt and nxt in ",;:" or nxt in ("—", "–", "-") and closed:
        return False
    if first.islower() and not (opened and nxt in "(["):
        return False
    after = word_type(follow)
    if (lang, kind, after) in s.collocations:
        return False
    if kind == NUMBER or closed:
        return True
    starter = (lang, after) in s.starters
    if len(word) == 1 and word.isupper():
        return starter  # an initial
    final = s.abbreviations.get((lang, kind))
    if final is None:
        return True
    if final and (lang, kind, place_of(text, dot, part.unit)) not in s.inner:
        return True
    return starter and not first.isdigit()


def units(text: str, lang_of: list[str], s: Statistics, parts: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Sentence units (begin, end, boundary kind) of a text, blanks at their ends left out."""
    out: list[tuple[int, int, str]] = []
    for (begin, stop), lang in zip(parts, lang_of):
        part = Part(text[begin:stop], lang)
        cuts: list[tuple[int, str]] = []
        if THAI.search(part.text):
            for m in re.finditer(r"\s+", part.text):
                a, b = part.text[m.start() - 1], part.text[m.end() : m.end() + 1]
                if (THAI.match(a) or THAI.match(b)) and not a.isdigit() and not b.isdigit():
                    cuts.append((m.start(), "EndOfPhrase"))
        thai = [x for x, _ in cuts]
        for m in CANDIDATE.finditer(part.text):
            if m.end() >= len(part.text):
                break
            if thai and (k := bisect_right(thai, m.start())) and thai[k - 1] > part.unit:
                part.unit = thai[k - 1]
            at = _ends(part, m, s)
            if at:
                cuts.append((at, "TerminalPunctuation"))
                part.unit = at
        at = 0
        for cut, kind in [*sorted(set(cuts)), (len(part.text), "")]:
            piece = part.text[at:cut]
            left = len(piece) - len(piece.lstrip())
            right = len(piece.rstrip())
            if left < right:
                if not kind:
                    last = piece.rstrip().rstrip("\"'”’“»›)]）」』】")[-1:]
                    kind = "TerminalPunctuation" if last and last in ".!?…。！？।॥" else "EndOfParagraph"
                out.append((begin + at + left, begin + at + right, "TerminalPunctuation" if kind == "TerminalPunctuation" else "EndOfParagraph"))
            at = cut
    return out


def _ends(part: Part, m: re.Match, s: Statistics) -> int:
    """Where the unit ends at this terminal, or 0 if it goes on."""
    terminal, closers = m.group(1), m.group(2)
    at = m.end()
    if closers and closers[-1] in "\"“" and part.text[at : at + 1].strip() and part.opens(at - 1):
        closers, at = closers[:-1], at - 1  # the mark opens the next quotation
    return at if _breaks(part, m.start(), terminal, closers, at, s) else 0


def _breaks(part: Part, dot: int, terminal: str, closers: str, at: int, s: Statistics) -> bool:
    text = part.text
    behind = VISIBLE.search(text, at)
    if not behind:
        return True
    gap, nxt = behind.start() > at, behind.group()
    quoted = any(c in QUOTES for c in closers)
    wide = bool(UNSPACED.match(nxt)) and not gap
    if quoted:
        if nxt in ",;，、：:" or nxt in "—–-":
            return False
        if HIRAGANA.match(nxt):
            return False  # Japanese quotation particle
        if nxt.islower():
            return False
        begun = part.first(part.unit)
        if begun in OPENERS and not nxt.isupper() and nxt not in OPEN_MARKS:
            return False  # scripts without case: the reporting clause follows its quotation
        if begun in OPENERS and nxt in OPEN_MARKS and nxt in "—–-":
            return False
        return True
    if terminal in ("…", "……", "...", "....") or set(terminal) <= {"…", "."} and len(terminal) > 1:
        if wide or not gap:
            return False
        bare = behind.start()
        while bare < min(len(text), behind.start() + REACH) and (text[bare] in OPEN_MARKS or text[bare].isspace()):
            bare += 1
        return not text[bare : bare + 1].islower() and nxt not in ",;"
    if terminal == ".":
        return period_ends(part, dot, at, bool(closers), s)
    if nxt in ",;，、" or nxt in "—–" and not gap:
        return False
    if nxt.islower() and gap and not any(c in "।॥。！？" for c in terminal):
        return False
    return True


UNITS = "doc_id bigint, document_ordinal int, raw_start bigint, raw_end bigint, start_byte bigint, end_byte bigint, boundary_kind string, lang string"


def sentence_units(read: DataFrame, statistics: Statistics) -> DataFrame:
    """One row per sentence unit of every text of read_once(), offsets in UTF-8 bytes.

    The content span has no blanks at its ends; the raw spans of a text lie end
    to end and cover it. Null, empty and blank texts give no rows; a repeated
    row gives its units again.
    """
    shared = read.sparkSession.sparkContext.broadcast(statistics)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = shared.value
        for batch in portions(batches, 1):
            rows: list[tuple] = []
            for doc_id, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                spans = paragraphs(text)
                found = units(text, own, statistics, spans)
                ascii_only = text.isascii()
                at = done = raw = 0

                def byte(to: int) -> int:
                    nonlocal at, done
                    done += to - at if ascii_only else len(text[at:to].encode("utf-8", "replace"))
                    at = to
                    return done

                ends = [b for _, b in spans]
                for k, (a, b, kind) in enumerate(found):
                    x, y = byte(a), byte(b)
                    z = byte(found[k + 1][0] if k + 1 < len(found) else len(text))
                    rows.append((doc_id, k, raw, z, x, y, kind, own[bisect_right(ends, a)]))
                    raw = z
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in UNITS.split(", ")])

    return read.where("text IS NOT NULL").select("doc_id", "text", "langs").mapInArrow(run, UNITS)


def segment(documents: DataFrame) -> DataFrame:
    """Fit the language model and the period statistics on (doc_id, lang, text), then cut all texts."""
    model = langid.fit(documents.select(langid.normal_label(F.col("lang")).alias("label"), "text"))
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    read = read_once(texts, model)
    return sentence_units(read, learn(summed(read)))
