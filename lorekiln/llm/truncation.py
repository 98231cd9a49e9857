"""Problem 8: texts that were cut inside a word or a sentence, in SQL.

Every text becomes tokens (words, numbers as ``0``, single letters of Chinese
and Japanese, whole runs of Thai, single marks), with a sign for each
paragraph end. All trigrams of all texts are counted, inside against at ends:
a word stands at an end before a terminal or a paragraph end, a mark before a
paragraph end. Their sums are the counts of bigrams and single tokens. The
final trigrams are then joined with these counts: a trigram that is frequent
inside but almost never terminal was cut off.

The last word may be cut itself, so it is looked up as the beginning of longer
words too, each of which is a case inside. A final trigram, bigram or token
with X cases as a beginning of longer words and n as a whole word, of which e
at ends, is judged by log-likelihood ratios (threshold LIKELY) against rates of
the corpus itself, the trigram first, a shorter one only where the longer has
too few cases:

 * ``word``: it is hardly ever a whole word (n of X + n, against the usual
   share of beginnings that are whole words) and almost never at an end;
 * ``sentence`` (``word`` if most cases are beginnings): it is almost never at
   an end, that is at most RARELY times as often as words (marks) usually are;
 * complete: it stands at ends more often than that.

The last trigram of a text is never its own evidence. Ends of other texts
count as ends only where they are too many for cuts at random places. A mark
that cuts leave behind (``[...]``, an ellipsis, the replacement character) is
taken off first; what stands before it is judged. Two rules remain where the
n-grams find no cut: ``unseen:word`` (too few cases; nowhere a whole word, but
the beginning of known ones) and ``mark`` (a bracketed ellipsis or replacement
character, which nothing but a cut leaves).

Null texts give no row; empty ones and those without tokens aren't cut. A
repeated doc_id with several texts is cut if one of them is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.session import hot_join, store

#: Threshold of all log-likelihood ratios (0.5 %).
LIKELY = 7.88
#: "Almost never": at most this part of the usual rate of ends.
RARELY = 0.1
#: "Hardly ever a whole word": at most this share of its cases.
HARDLY = 0.01
#: Prefixes of one context are spread over so many tasks.
SALTS = 8

INVISIBLE = r"[­​-‏‪-‮⁠-⁤﻿]"
TERMINAL = [".", "!", "?", "…", "...", "。", "！", "？", "।", "॥"]
CLOSER = ['"', "'", "”", "“", "’", "»", "«", ")", "]", "）", "」", "』", "】", "›"]
ELLIPSIS = ["…", "...", "……"]
CUT_MARK = ["[...]", "[…]", "�"]
#: Scripts of single-letter tokens, and Thai, as ranges, since script look-ups and intersections are slow in regular expressions.
SOLO, THAI = r"぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿", r"฀-๿"
#: Letters and marks of all other scripts: what is no blank, punctuation, symbol, number or control.
LETTERS = rf"[^\p{{Z}}\p{{P}}\p{{S}}\p{{N}}\p{{C}}{SOLO}{THAI}]+"
TOKEN = rf"{LETTERS}(?:['’]{LETTERS})*|[{THAI}]+|\[(?:\.{{3}}|…)\]|\.{{2,}}|…+|[^\s\p{{Z}}]"
NUMBER = r"\p{N}+(?:[.,:]\p{N}+)*"
PARAGRAPH = r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*"
BLANKS = " \t\n\r\u00a0\u2028\u2029\u3000"

#: Patterns, handed to the SQL as parameters.
PATTERNS = {"invisible": INVISIBLE, "token": TOKEN, "number": NUMBER, "paragraph": PARAGRAPH, "blanks": BLANKS}


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(text, args={k: v for k, v in PATTERNS.items() if f":{k}" in text}, **tables)


TOKENS_SQL = """
SELECT doc_id, source, xxhash64(text) AS content,
       concat(array('^', '^'), regexp_extract_all(
         regexp_replace(regexp_replace(rtrim(:blanks, regexp_replace(text, :invisible, '')), :paragraph, ' ¶ '), :number, '0'), :token, 0)) AS t
FROM {documents} WHERE doc_id IS NOT NULL AND text IS NOT NULL
"""
#: Adds the mark a cut left behind and the number of tokens before it.
ENDS = f"""
  CASE WHEN element_at(t, -1) IN ({_list(CUT_MARK)}) THEN 'cut' WHEN element_at(t, -1) IN ({_list(ELLIPSIS)}) THEN 'ellipsis' ELSE '' END AS mark"""
LAST_SQL = f"""
SELECT doc_id, source, content, mark, t[n - 3] AS w1, t[n - 2] AS w2, t[n - 1] AS w3
FROM (SELECT *, size(t) - CASE WHEN mark = '' THEN 0 ELSE 1 END AS n FROM (SELECT *, {ENDS} FROM {{tokens}})) WHERE n > 2
"""
MARKED = f"w3 IN ({_list(TERMINAL + CLOSER)})"
IS_THAI = "w3 BETWEEN '฀' AND '๿'"
#: Whether a trigram stands at an end; ``x`` is the token behind it.
AT_END = f"CASE WHEN {MARKED} THEN x = '¶' WHEN {IS_THAI} THEN x <> '0' ELSE x = '¶' OR x IN ({_list(TERMINAL)}) END"

GRAMS_SQL = f"""
SELECT c3, c2, w3, count(*) AS n, count_if(at_end) AS ends FROM (
  SELECT xxhash64(w1, w2) AS c3, xxhash64(w2) AS c2, w3, {AT_END} AS at_end
  FROM (SELECT t, size(t) - CASE WHEN mark = '' THEN 3 ELSE 4 END AS n FROM (SELECT *, {ENDS} FROM {{tokens}}))
  LATERAL VIEW inline(arrays_zip(slice(t, 1, n), slice(t, 2, n), slice(t, 3, n), slice(t, 4, n))) AS w1, w2, w3, x
  WHERE n > 0)
WHERE w3 <> '¶'
GROUP BY c3, c2, w3
"""
#: Final trigrams, each once, with the number of different texts that end in it.
CLOSING_SQL = """
SELECT w1, w2, w3, mark, count(*) AS texts FROM (SELECT DISTINCT w1, w2, w3, mark, content FROM {last}) GROUP BY w1, w2, w3, mark
"""
ONE_SQL = f"""
SELECT w3, sum(n) AS n, sum(ends) AS ends, {MARKED} AS marked, upper(w3) <> lower(w3) AS cased FROM {{grams}} GROUP BY w3
"""
RATES_SQL = """
SELECT coalesce(sum(n), 0) AS tokens,
       sum(CASE WHEN cased THEN ends END) / sum(CASE WHEN cased THEN n END) AS words_end, sum(CASE WHEN marked THEN ends END) / sum(CASE WHEN marked THEN n END) AS marks_end,
       sum(CASE WHEN cased THEN n END) / sum(CASE WHEN cased THEN n * length(w3) END) AS whole
FROM {one}
"""
#: Contexts of the final tokens and the lengths that are asked for there.
ASKED_SQL = f"""
SELECT level, ctx, k, salt FROM (
  SELECT DISTINCT level, ctx, length(w3) AS k FROM (
    SELECT w3, inline(array(struct(3 AS level, xxhash64(w1, w2) AS ctx), struct(2 AS level, xxhash64(w2) AS ctx))) FROM {{closing}}))
LATERAL VIEW explode(sequence(0, {SALTS - 1})) AS salt
"""
LENGTHS_SQL = "SELECT array_sort(collect_set(length(w3))) FROM {closing}"
COUNTED = "sum(CASE WHEN k < length(w3) THEN n ELSE 0 END) AS longer, sum(CASE WHEN k = length(w3) THEN n ELSE 0 END) AS n, sum(CASE WHEN k = length(w3) THEN ends ELSE 0 END) AS ends"
EVIDENCE_SQL = f"""
SELECT xxhash64(level, ctx, substr(w3, 1, k)) AS key, {COUNTED} FROM (
  SELECT c.level, c.ctx, w3, n, ends, k FROM (
    SELECT 3 AS level, c3 AS ctx, w3, n, ends FROM {{grams}}
    UNION ALL SELECT 2, c2, w3, sum(n), sum(ends) FROM {{grams}} GROUP BY c2, w3) c
  JOIN {{asked}} a ON a.level = c.level AND a.ctx = c.ctx AND a.salt = pmod(hash(w3), {SALTS})
  WHERE k <= length(w3)
  UNION ALL
  SELECT 1, 0L, w3, n, ends, k FROM {{one}} LATERAL VIEW explode(filter(:lengths, k -> k <= length(w3))) AS k)
GROUP BY key
"""
KEYS_SQL = """
SELECT w1, w2, w3, mark, texts, level, xxhash64(level, ctx, w3) AS key FROM (
  SELECT *, inline(array(struct(3 AS level, xxhash64(w1, w2) AS ctx), struct(2 AS level, xxhash64(w2) AS ctx), struct(1 AS level, 0L AS ctx))) FROM {closing})
"""


def _ratio(k: str, n: str, p: str) -> str:
    """Twice the log-likelihood ratio of k cases in n against the rate p, as SQL."""
    left = f"({n} - {k})"
    return f"2 * (CASE WHEN {k} > 0 THEN {k} * ln({k} / ({n} * {p})) ELSE 0 END + CASE WHEN {left} > 0 THEN {left} * ln({left} / ({n} * (1 - {p}))) ELSE 0 END)"


def _decision() -> str:
    """The CASE over all levels; ``complete`` ends it without a cut."""
    steps = []
    for level, name in ((3, "trigram"), (2, "bigram"), (1, "token")):
        x, n, k, whole = f"x{level}", f"cases{level}", f"ends{level}", f"n{level}"
        enough = f"{n} > 0 AND {k} / {n} <= {RARELY} * usual"
        steps += [
            f"WHEN {x} > 0 AND {whole} <= {HARDLY} * ({x} + {whole}) AND {enough} AND {_ratio(whole, f'({x} + {whole})', ':whole')} >= {LIKELY} THEN '{name}:word'",
            f"WHEN {enough} AND {_ratio(k, n, 'usual')} >= {LIKELY} THEN CASE WHEN {x} > {n} - {x} - {k} THEN '{name}:word' ELSE '{name}:sentence' END",
            f"WHEN {n} > 0 AND {k} / {n} > {RARELY} * usual AND {_ratio(k, n, f'({RARELY} * usual)')} >= {LIKELY} THEN 'complete'",
        ]
    return f"CASE {' '.join(steps)} WHEN x1 > 0 AND n1 = 0 AND ends1 = 0 THEN 'unseen:word' END"


def _cases(level: int) -> str:
    """Cases and ends of a level; other texts' ends count where they are too many for cuts at random."""
    n = f"(x{level} + n{level})"
    many = f"texts > 1 AND (texts - 1) / ({n} + texts - 1) > :hazard AND {_ratio('(texts - 1)', f'({n} + texts - 1)', ':hazard')} >= {LIKELY}"
    return f"{n} + CASE WHEN {many} THEN texts - 1 ELSE 0 END AS cases{level}, e{level} + CASE WHEN {many} THEN texts - 1 ELSE 0 END AS ends{level}"


JUDGED_SQL = f"""
SELECT w1, w2, w3, mark, coalesce(nullif({_decision()}, 'complete'), CASE WHEN mark = 'cut' THEN 'mark' END) AS rule FROM (
  SELECT *, {", ".join(_cases(k) for k in (3, 2, 1))} FROM (
    SELECT w1, w2, w3, mark, texts, CASE WHEN {MARKED} THEN :marks_end ELSE :words_end END AS usual,
      {", ".join(f"sum(CASE WHEN level = {k} AND NOT {MARKED} THEN longer ELSE 0 END) AS x{k}, sum(CASE WHEN level = {k} THEN n ELSE 0 END) AS n{k}, sum(CASE WHEN level = {k} THEN ends ELSE 0 END) AS e{k}" for k in (3, 2, 1))}
    FROM {{met}} GROUP BY w1, w2, w3, mark, texts))
"""
SUMS_SQL = """
SELECT source, count(*) AS documents, count(rule) AS cut_documents, round(count(rule) / count(*), 6) AS cut_rate
FROM {judged} GROUP BY source
"""


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, rule) of every non-null text that has tokens; ``rule`` is null where it isn't cut.

    ``rule`` names the n-gram that decided and what it says: ``trigram:word``,
    ``trigram:sentence``, ``bigram:...``, ``token:...``, ``unseen:word`` or ``mark``.
    """
    spark = documents.sparkSession
    tokens = store(_sql(spark, TOKENS_SQL, documents=documents.select("doc_id", "source", "text")), "tokens")
    last = store(_sql(spark, LAST_SQL, tokens=tokens), "last-trigrams")
    grams = store(_sql(spark, GRAMS_SQL, tokens=tokens), "trigrams")
    one = store(_sql(spark, ONE_SQL, grams=grams), "words")
    closing = store(_sql(spark, CLOSING_SQL, last=last), "closing-trigrams")
    rates = _sql(spark, RATES_SQL, one=one).first()
    hazard = last.count() / max(1, rates.tokens)
    lengths = _sql(spark, LENGTHS_SQL, closing=closing).first()[0]
    evidence = spark.sql(EVIDENCE_SQL, args={"lengths": F.array(*map(F.lit, lengths or [0]))}, grams=grams, asked=_sql(spark, ASKED_SQL, closing=closing), one=one)
    met = hot_join(_sql(spark, KEYS_SQL, closing=closing), evidence, ["key"])
    found = spark.sql(
        JUDGED_SQL,
        args={"hazard": min(max(hazard, 1e-9), 0.5), "words_end": _rate(rates.words_end), "marks_end": _rate(rates.marks_end), "whole": _rate(rates.whole)},
        met=met,
    )
    return hot_join(last, store(found, "judged"), ["w1", "w2", "w3", "mark"]).select("doc_id", "source", "rule")


def _rate(value: float | None) -> float:
    """A rate strictly between 0 and 1, also where nothing was counted."""
    return min(max(value or 0.0, 1e-9), 1 - 1e-9)


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of every text that was cut; a repeated doc_id counts once."""
    return judged(documents).where("rule IS NOT NULL").select("doc_id").distinct()


def cut_rates(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut texts and their share; a null source is a group of its own."""
    found = judged(documents)
    return _sql(found.sparkSession, SUMS_SQL, judged=found)


def cut_rules(documents: DataFrame) -> DataFrame:
    """(rule, texts): how many texts each rule found; the null rule holds the complete ones."""
    return judged(documents).groupBy("rule").agg(F.count("*").alias("texts"))


def duckdb_sql() -> str:
    """judged() for DuckDB, which joins the strings themselves and counts every beginning of every token."""
    cleaned = f"regexp_replace(regexp_replace(rtrim(regexp_replace(text, '{INVISIBLE}', '', 'g'), '{BLANKS}'), '{PARAGRAPH}', ' ¶ ', 'g'), '{NUMBER}', '0', 'g')"
    token = TOKEN.replace("'", "''")
    rates = {":words_end": "(SELECT words_end FROM rates)", ":marks_end": "(SELECT marks_end FROM rates)", ":whole": "(SELECT whole FROM rates)", ":hazard": "(SELECT hazard FROM rates)"}
    judged_sql = JUDGED_SQL
    for name, value in rates.items():
        judged_sql = judged_sql.replace(name, value)
    ends = ENDS.replace("element_at(t, -1)", "t[-1]")
    return f"""
WITH tokens AS MATERIALIZED (
  SELECT *, len(t) - CASE WHEN mark = '' THEN 0 ELSE 1 END AS size FROM (SELECT *, {ends} FROM (
    SELECT doc_id, source, text AS content, list_concat(['^', '^'], regexp_extract_all({cleaned}, '{token}')) AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL))),
last AS (SELECT doc_id, source, content, mark, t[size - 2] AS w1, t[size - 1] AS w2, t[size] AS w3 FROM tokens WHERE size > 2),
grams AS MATERIALIZED (SELECT w1, w2, w3, count(*) AS n, count(*) FILTER ({AT_END}) AS ends
  FROM (SELECT t[i] AS w1, t[i + 1] AS w2, t[i + 2] AS w3, t[i + 3] AS x FROM (SELECT t, unnest(range(1, size - 2)) AS i FROM tokens)) WHERE w3 <> '¶' GROUP BY ALL),
one AS (SELECT w3, sum(n) AS n, sum(ends) AS ends, {MARKED} AS marked, upper(w3) <> lower(w3) AS cased FROM grams GROUP BY w3),
rates AS MATERIALIZED (SELECT tokens, words_end, marks_end, whole, (SELECT count(*) FROM last) / tokens AS hazard FROM ({RATES_SQL.replace('{one}', 'one')})),
closing AS (SELECT w1, w2, w3, mark, count(DISTINCT content) AS texts FROM last GROUP BY ALL),
begun AS (SELECT w1, w2, substr(w3, 1, k) AS w3, n * (k < length(w3))::INT AS longer, n * (k = length(w3))::INT AS n, ends * (k = length(w3))::INT AS ends
  FROM (SELECT *, unnest(range(1, length(w3) + 1)) AS k FROM grams)),
evidence AS (
  SELECT 3 AS level, w1, w2, w3, sum(longer) AS longer, sum(n) AS n, sum(ends) AS ends FROM begun GROUP BY ALL
  UNION ALL SELECT 2, '', w2, w3, sum(longer), sum(n), sum(ends) FROM begun GROUP BY ALL
  UNION ALL SELECT 1, '', '', w3, sum(longer), sum(n), sum(ends) FROM begun GROUP BY ALL),
met AS (
  SELECT c.*, l.level, e.longer, e.n, e.ends FROM closing c JOIN (VALUES (1), (2), (3)) AS l(level) ON true
  LEFT JOIN evidence e ON e.level = l.level AND e.w3 = c.w3 AND e.w2 = CASE WHEN l.level > 1 THEN c.w2 ELSE '' END AND e.w1 = CASE WHEN l.level > 2 THEN c.w1 ELSE '' END),
decided AS ({judged_sql.replace('{met}', 'met')})
SELECT doc_id, source, rule FROM last LEFT JOIN decided USING (w1, w2, w3, mark)"""
