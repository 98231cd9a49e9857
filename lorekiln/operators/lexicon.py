"""Tokens, lexicon look-ups, morphology and ontology features as expressions and dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words for days relative to now.
DEICTIC = {"dziś": 0, "dzisiaj": 0, "wczoraj": -1, "jutro": 1, "przedwczoraj": -2, "pojutrze": 2, "today": 0, "yesterday": -1, "tomorrow": 1}
# Cardinal words.
CARDINALS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "jeden": 1, "dwa": 2, "trzy": 3, "cztery": 4, "pięć": 5, "sześć": 6, "siedem": 7, "osiem": 8, "dziewięć": 9, "dziesięć": 10}


def words(text: Column) -> Column:
    """Metric tokens: split at blanks, trim what isn't a letter or digit, lower case, drop the empty."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda x: x != "")


def surface_tokens(text: Column) -> Column:
    """Tokens with case, trimmed of ASCII punctuation."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda x: F.regexp_replace(x, r"^\p{Punct}+|\p{Punct}+$", "")), lambda x: x != "")


def normal_name(name: Column) -> Column:
    """Trimmed, single blanks, lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def token_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, position, token) of all texts."""
    return documents.select("doc_id", F.posexplode(words(F.col("text"))).alias("position", "token"))


def context_windows(documents: DataFrame, word: str, reach: int) -> DataFrame:
    """(doc_id, position, context): the tokens around every use of a word; only those slices leave the row."""
    tokens = documents.select("doc_id", words(F.col("text")).alias("tokens"))
    places = F.filter(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.element_at("tokens", i) == word)
    begin = lambda i: F.greatest(i - reach, F.lit(1))
    hits = F.transform(places, lambda i: F.struct((i - 1).alias("position"), F.array_join(F.slice("tokens", begin(i), i + reach + 1 - begin(i)), " ").alias("context")))
    return tokens.where(F.array_contains("tokens", word)).select("doc_id", F.inline(hits))


def multiword_hits(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, position, form, lemma): lexicon forms of three, two or one words, the longest at each place.

    Only places whose word begins a form are spread into their three forms.
    The spread texts look small to the planner, which only knows the files, so
    they must not be the side that is broadcast: the lexicon is, if it is marked
    for it, else both are shuffled.
    """
    t = documents.select("doc_id", words(F.col("text")).alias("t")).where(F.size("t") > 0)
    place = t.select("doc_id", F.posexplode(F.arrays_zip("t", F.slice("t", F.lit(2), F.size("t")).alias("u"), F.slice("t", F.lit(3), F.size("t")).alias("v"))).alias("position", "w")).select("doc_id", "position", "w.t", "w.u", "w.v")
    begun = place.join(lexicon.select(F.substring_index("form", " ", 1).alias("t")), "t", "left_semi")
    forms = F.array(F.struct(F.lit(3).alias("n"), F.concat("t", F.lit(" "), "u", F.lit(" "), "v").alias("form")), F.struct(F.lit(2).alias("n"), F.concat("t", F.lit(" "), "u").alias("form")), F.struct(F.lit(1).alias("n"), F.col("t").alias("form")))
    hits = begun.select("doc_id", "position", F.inline(forms)).where(F.col("form").isNotNull()).hint("merge").join(lexicon, "form")
    return hits.groupBy("doc_id", "position").agg(F.max(F.struct("n", "form", "lemma")).alias("m")).select("doc_id", "position", "m.form", "m.lemma")


def look_up(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entry of each (token): its form, else its form without ``s`` or ``ed``, else the concept PERSON (unknown).

    The winner among entries of one form is the least (concept, pos, lemma).
    """
    best = lexicon.groupBy("form").agg(F.min(F.struct("concept", "pos", "lemma")).alias("e"))
    forms = [F.col("token"), F.regexp_extract("token", "^(.+)s$", 1), F.regexp_extract("token", "^(.+)ed$", 1)]
    out = tokens
    for k, form in enumerate(forms):
        out = out.withColumn(f"f{k}", form).join(best.select(F.col("form").alias(f"f{k}"), F.col("e").alias(f"e{k}")), f"f{k}", "left")
    entry = F.coalesce("e0", "e1", "e2")
    return out.select("token", entry.lemma.alias("lemma"), F.coalesce(entry.pos, F.lit("Unknown")).alias("pos"), F.coalesce(entry.concept, F.lit("PERSON")).alias("concept"))


def cardinal(token: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CARDINALS.items() for x in p]), token), token.try_cast("int"))


def relative_days(token: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in DEICTIC.items() for x in p]), token)


def unknown_bucket(word: Column, concepts: list[str], context: int = 0) -> Column:
    """A concept by length and vowels of an unknown word."""
    vowels = F.length(word) - F.length(F.regexp_replace(word, "[aeiouyąęó]", ""))
    return F.element_at(F.array(*map(F.lit, concepts)), F.pmod(F.length(word) + vowels + context, F.lit(len(concepts))) + 1)


def apply_rules(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """Surface of each (stem, features) by the first rule whose conditions all hold.

    ``rules``: rule_ord, conditions MAP<STRING,STRING>, operation, a, b.
    Operations: AddSuffix(a), ReplaceSuffix(a, b), Truncate(a letters),
    Prefix(a), ConsonantAlternate(a, b at the end), DoubleFinalConsonant(a).
    A stem without a rule keeps its form.
    """
    key = F.explode(F.map_keys("features"))
    # a rule that asks for several features is met through its first one, the rest is checked on the row
    rule = rules.withColumn("first", F.coalesce(F.array_min(F.map_keys("conditions")), F.lit("")))
    offered = stems.withColumn("row", F.struct("stem", "features")).select("stem", "features", key.alias("first")).unionByName(stems.select("stem", "features", F.lit("").alias("first")))
    met = offered.join(rule, "first").where(F.forall(F.map_entries("conditions"), lambda e: F.try_element_at(F.col("features"), e.key).eqNullSafe(e.value)))
    best = met.groupBy("stem", F.to_json("features").alias("k")).agg(F.min(F.struct("rule_ord", "operation", "a", "b")).alias("r"))
    s, a, b = F.col("stem"), F.col("r.a"), F.col("r.b")
    made = (
        F.when(F.col("r.operation") == "AddSuffix", F.concat(s, a))
        .when(F.col("r.operation").isin("ReplaceSuffix", "ConsonantAlternate"), F.when(F.endswith(s, a), F.concat(F.left(s, F.length(s) - F.length(a)), b)).otherwise(s))
        .when(F.col("r.operation") == "Truncate", F.left(s, F.greatest(F.length(s) - a.try_cast("int"), F.lit(0))))
        .when(F.col("r.operation") == "Prefix", F.concat(a, s))
        .when(F.col("r.operation") == "DoubleFinalConsonant", F.concat(s, F.right(s, F.lit(1)), a))
        .otherwise(s)
    )
    return stems.withColumn("k", F.to_json("features")).join(best, ["stem", "k"], "left").select("stem", "features", made.alias("surface"))


def analyse(surfaces: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(surface, stem, feature) of every suffix rule that fits, whatever its length.

    ``suffixes``: suffix, restore, feature. Surfaces meet the rules of their
    last letter, then the whole suffix is compared.
    """
    rules = suffixes.withColumn("last", F.right("suffix", F.lit(1)))
    met = surfaces.withColumn("last", F.right("surface", F.lit(1))).join(rules, "last").where(F.endswith("surface", F.col("suffix")) & (F.length("surface") > F.length("suffix")))
    return met.select("surface", F.concat(F.left("surface", F.length("surface") - F.length("suffix")), F.coalesce("restore", F.lit(""))).alias("stem"), "feature")


def inherited(pairs: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """(id, value, distance): the nearest ancestor's value, one's own first. ``pairs``: ancestor, descendant, distance."""
    all_pairs = pairs.unionByName(own.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).cast("bigint").alias("distance")))
    held = own.where(F.col(value).isNotNull()).select(F.col("id").alias("ancestor"), value)
    near = all_pairs.join(held, "ancestor").groupBy("descendant").agg(F.min(F.struct("distance", value)).alias("n"))
    return near.select(F.col("descendant").alias("id"), F.col(f"n.{value}").alias(value), "n.distance")


def clause_groups(tokens: DataFrame, conjunctions: list[str]) -> DataFrame:
    """Tokens with the number of their clause, a conjunction beginning a new one."""
    w = Window.partitionBy("doc_id").orderBy("position")
    return tokens.withColumn("clause", F.sum(F.col("token").isin(conjunctions).cast("int")).over(w))
