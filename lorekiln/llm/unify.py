"""Problem 1: text that looks the same but consists of other characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import unify_array


def with_unified(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, for each ``{source: new}``, the consistent form of a string column.

    Null gives null, an empty string (or one of invisible characters only) an
    empty string; other columns pass through. A new name that exists already
    is refused. One Arrow pass, no shuffle.
    """
    if clash := [c for c in columns.values() if c in df.columns]:
        raise ValueError(f"columns exist already: {clash}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [unify_array(batch.column(batch.schema.get_field_index(c))) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *columns.values()])

    return df.mapInArrow(run, schema)


def surface_matches(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions whose surface looks like a name yet isn't equal to it.

    ``mentions``: mention_id, exact_surface, normalized_surface; ``names``:
    entity_id, canonical_name. The exact surface is held against the name, the
    normalized one against its lower-case form. Both sides are unified, then
    joined on equality. Rows with a null id are left out; a repeated mention
    counts once; two names of one look both match.
    """
    long = mentions.where(F.col("mention_id").isNotNull()).select(
        "mention_id",
        F.explode(
            F.array(
                F.struct(F.lit("exact_surface").alias("field_name"), F.col("exact_surface").alias("surface")),
                F.struct(F.lit("normalized_surface").alias("field_name"), F.col("normalized_surface").alias("surface")),
            )
        ).alias("f"),
    )
    long = long.select("mention_id", "f.field_name", "f.surface").where(F.length("surface") > 0)
    sides = names.where(F.col("entity_id").isNotNull() & F.col("canonical_name").isNotNull()).select(
        "entity_id",
        F.explode(
            F.array(
                F.struct(F.lit("exact_surface").alias("field_name"), F.col("canonical_name").alias("name")),
                F.struct(F.lit("normalized_surface").alias("field_name"), F.lower("canonical_name").alias("name")),
            )
        ).alias("f"),
    )
    sides = with_unified(sides.select("entity_id", "f.field_name", "f.name"), {"name": "look"})
    seen = with_unified(long, {"surface": "look"})
    return (
        seen.join(sides, ["field_name", "look"])
        .where(F.col("surface") != F.col("name"))
        .select("mention_id", "field_name", "entity_id")
        .distinct()
    )
