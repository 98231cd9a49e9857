"""Snapshots, lineage hashes, traces, budgets and report sinks."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hard limits per document.
BUDGET = {"source_bytes": 1_000_000, "sentences": 5_000, "frames": 10_000, "claims": 10_000}


def document_hash(lang: Column, text: Column) -> Column:
    """SHA-256 over language, a zero byte and text."""
    return F.sha2(F.concat(F.encode(F.coalesce(lang, F.lit("")), "utf-8"), F.lit(b"\x00"), F.encode(text, "utf-8")), 256)


def document_id(lang: Column, text: Column) -> Column:
    return F.concat(F.lit("doc-"), F.coalesce(lang, F.lit("")), F.lit("-"), F.left(document_hash(lang, text), F.lit(32)))


def tampered(documents: DataFrame) -> DataFrame:
    """Documents whose stored hash isn't that of their text (a missing hash says nothing)."""
    return documents.where(F.col("content_sha256").isNotNull() & (F.sha2("text", 256) != F.col("content_sha256"))).select("doc_id", "content_sha256")


def over_budget(documents: DataFrame, sentences: Column, budget: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, limit_name, amount, allowed) of each exceeded limit: a table of rejects, not a failed job."""
    budget = BUDGET if budget is None else budget
    found = F.explode(F.array(F.struct(F.lit("source_bytes").alias("limit_name"), F.octet_length("text").cast("bigint").alias("amount"), F.lit(budget["source_bytes"]).cast("bigint").alias("allowed")), F.struct(F.lit("sentences").alias("limit_name"), sentences.cast("bigint").alias("amount"), F.lit(budget["sentences"]).cast("bigint").alias("allowed"))))
    return documents.where(F.col("text").isNotNull()).select("doc_id", found.alias("b")).select("doc_id", "b.*").where("amount > allowed")


def newest_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON snapshots, the newest file of each source (by file name), with a check of the content hash."""
    rows = spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_name"))
    last = rows.groupBy("source_id").agg(F.max(F.struct("file", *[c for c in rows.columns if c not in ("file", "source_id")])).alias("s")).select("source_id", "s.*")
    return last.withColumn("verified", F.sha2("text", 256).eqNullSafe(F.col("content_sha256")))


def save_session(df: DataFrame, root: str, snapshot: str) -> None:
    """An immutable snapshot folder, then the pointer to it, replaced in one step."""
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,96}", snapshot):
        raise ValueError("snapshot name isn't a plain name")
    df.write.mode("error").parquet(f"{root}/snapshot_id={snapshot}")
    digest = snapshot_digest(df)
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/.current.new", "w") as f:
        json.dump({"snapshot": snapshot, "digest": digest}, f)
    os.replace(f"{root}/.current.new", f"{root}/current.json")


def snapshot_digest(df: DataFrame) -> str:
    """Order-free digest of all rows: number, sum and xor of their hashes."""
    row = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return f"{r.n}:{r.s}:{r.x}"


def load_session(spark: SparkSession, root: str) -> DataFrame:
    """The current snapshot; refused if its rows aren't those that were saved."""
    with open(f"{root}/current.json") as f:
        pointer = json.load(f)
    df = spark.read.parquet(f"{root}/snapshot_id={pointer['snapshot']}")
    if snapshot_digest(df) != pointer["digest"]:
        raise ValueError("snapshot was changed after it was saved")
    return df


def quarantine(root: str) -> str:
    """Move a broken session aside."""
    to = f"{root}.corrupt"
    os.rename(root, to)
    return to


def numbered_trace(events: DataFrame) -> DataFrame:
    """Events of each run numbered from 1 by time, to be appended as JSON."""
    from lorekiln.operators.ordered import numbered

    return numbered(events, ["run_id"], "recorded_at", "event_id", "sequence")


def write_report(df: DataFrame, path: str, kind: str) -> None:
    if kind == "json":
        df.write.json(path)
    elif kind == "tsv":
        df.write.csv(path, sep="\t", header=True)
    else:
        raise ValueError(f"unknown report: {kind}")


def batch_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line-based input ``PL->EN: text`` and ``DIALOGUE:PL->EN: a ||| b``; comments and blank lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    pattern = r"^(DIALOGUE:)?([A-Z]{2})->([A-Z]{2}):\s*(.*)$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    return lines.where(F.col("value").rlike(pattern)).select(F.lower(part(2)).alias("source_lang"), F.lower(part(3)).alias("target_lang"), (part(1) != "").alias("dialogue"), F.posexplode(F.split(part(4), r"\s*\|\|\|\s*")).alias("turn", "text"))


def redacted(column: Column, secret: str) -> Column:
    return F.regexp_replace(column, secret, "[redacted]")
