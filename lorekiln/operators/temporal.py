"""Temporal values and relations, discourse cues, closure and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure

# First words of a sentence that tie it to the one before.
CUES = {"because": "cause", "ponieważ": "cause", "bo": "cause", "therefore": "result", "więc": "result", "zatem": "result", "then": "sequence", "potem": "sequence", "następnie": "sequence", "however": "contrast", "jednak": "contrast", "tymczasem": "contrast"}
BEFORE, AFTER = ["before", "przed", "zanim"], ["after", "po"]


def iso_parts(text: Column) -> Column:
    """Struct of year, month, day, hour, minute and zone offset in minutes of an ISO text; missing parts are null."""
    part = lambda p, k: F.regexp_extract(text, p, k).try_cast("int")
    date, clock, zone = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", r"[T ](\d{2}):(\d{2})", r"([+-])(\d{2}):?(\d{2})$"
    sign = F.when(F.regexp_extract(text, zone, 1) == "-", -1).when(F.regexp_extract(text, zone, 1) == "+", 1)
    offset = F.when(F.endswith(text, F.lit("Z")), 0).otherwise(sign * (part(zone, 2) * 60 + part(zone, 3)))
    return F.struct(part(date, 1).alias("year"), part(date, 2).alias("month"), part(date, 3).alias("day"), part(clock, 1).alias("hour"), part(clock, 2).alias("minute"), offset.alias("offset_minutes"))


def expression_kind(text: Column) -> Column:
    """Absolute (ISO), Duration, Frequency, Deictic or Symbolic."""
    low = F.lower(text)
    return (
        F.when(text.rlike(r"^\d{4}(-\d{2}){0,2}"), "Absolute")
        .when(low.rlike(r"^(for|przez)?\s*\d+\s*(day|days|dni|dzień)"), "Duration")
        .when(low.rlike(r"^(every|co|każd)"), "Frequency")
        .when(low.isin("today", "yesterday", "tomorrow", "dziś", "wczoraj", "jutro"), "Deictic")
        .otherwise("Symbolic")
    )


def time_relation(kind: Column, offset_days: Column) -> Column:
    """Event against time: durations overlap, absolute times are simultaneous, else the sign of the offset."""
    return F.when(kind == "Duration", "Overlaps").when(kind == "Absolute", "Simultaneous").when(offset_days < 0, "Before").when(offset_days > 0, "After").otherwise("Simultaneous")


def cues(sentences: DataFrame, strip_marks: bool = False, table: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, ordinal, cue, relation, previous): sentences whose first token is a cue; null previous is a warning.

    The token is compared as it stands, so ``However,`` is none unless strip_marks.
    """
    table = CUES if table is None else table
    first = F.lower(F.split(F.trim("sentence"), r"\s+")[0])
    first = F.regexp_replace(first, r"\p{Punct}+$", "") if strip_marks else first
    relation = F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), first)
    previous = F.lag("ordinal").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return sentences.select("doc_id", "ordinal", first.alias("cue"), relation.alias("relation"), previous.alias("previous")).where(F.col("relation").isNotNull())


def sentence_order(sentences: DataFrame) -> DataFrame:
    """Before or After relations of a sentence to the one before it, by its words; never for the first."""
    words = F.split(F.lower(F.trim("sentence")), r"\s+")
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    kind = F.when(F.exists(words, lambda x: x.isin(BEFORE)), "Before").when(F.exists(words, lambda x: x.isin(AFTER)), "After")
    return sentences.select("doc_id", "ordinal", F.lag("ordinal").over(w).alias("previous"), kind.alias("relation")).where(F.col("previous").isNotNull() & F.col("relation").isNotNull())


def before_closure(relations: DataFrame) -> DataFrame:
    """(src, dst): all pairs of which the first is before the second; After pairs are turned round."""
    turned = relations.select(F.when(F.col("relation") == "After", F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("relation") == "After", F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return closure(turned)


def order_conflicts(closed: DataFrame) -> DataFrame:
    """Pairs that stand in both directions, each once (a node before itself too)."""
    back = closed.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closed.join(back, ["src", "dst"]).where("src <= dst").distinct()


def event_groups(events: DataFrame, by: list[str]) -> DataFrame:
    """Events of one key as one cluster, the first as its head; each event alone where the key is null."""
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.concat(F.lit("#"), F.col("event_id").cast("string"))) for c in by]), 256)
    return events.withColumn("k", key).groupBy("k").agg(F.min("event_id").alias("cluster"), F.count("*").alias("events")).drop("k")
