"""Lines, paragraphs, gaps and sentences as relations; spans are half-open UTF-8 byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSERS = "\"'”’»)\\]}"
# Abbreviations whose period doesn't end a sentence.
ABBREVIATIONS = {"en": ["mr", "mrs", "ms", "dr", "prof", "etc", "e.g", "i.e"], "pl": ["dr", "prof", "np", "inż", "mgr", "ul", "tj"]}


LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\z|(?<=[\r\n])\z|^\z"


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, start_byte, end_byte, full_end, blank): lines by LF, CRLF or CR.

    ``end_byte`` leaves the terminator out, ``full_end`` takes it in. Null texts
    give no rows, an empty text one empty line.
    """
    raw = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(LINE), F.lit(0))).alias("line_no", "raw"))
    line = F.rtrim("raw", F.lit("\r\n"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw")).over(w), F.lit(0))
    return (
        raw.withColumn("start_byte", start)
        .select("doc_id", "line_no", line.alias("line"), "start_byte", (F.col("start_byte") + F.octet_length(line)).alias("end_byte"), (F.col("start_byte") + F.octet_length("raw")).alias("full_end"))
        .withColumn("blank", F.col("line").rlike(r"^[\s\p{Z}]*\z"))
    )


def paragraphs(line_rows: DataFrame) -> DataFrame:
    """Maximal runs of lines that aren't blank: (doc_id, paragraph_no, first_line, lines, start_byte, end_byte)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    runs = line_rows.withColumn("island", F.sum(F.col("blank").cast("int")).over(w)).where(~F.col("blank"))
    spans = runs.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))
    return spans.withColumn("paragraph_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1).drop("island")


def blocks(documents: DataFrame, paragraph_rows: DataFrame) -> DataFrame:
    """Paragraphs and the gaps between, before and behind them: a partition of the text into blocks."""
    sizes = documents.where(F.octet_length("text") > 0).select("doc_id", F.octet_length("text").alias("size"))
    w = Window.partitionBy("doc_id").orderBy("start_byte")
    inside = paragraph_rows.select("doc_id", F.lit("Paragraph").alias("kind"), "start_byte", "end_byte")
    before = inside.select("doc_id", F.lit("PreservedWhitespace").alias("kind"), F.coalesce(F.lag("end_byte").over(w), F.lit(0)).cast("bigint").alias("from"), F.col("start_byte").alias("to"))
    behind = sizes.join(paragraph_rows.groupBy("doc_id").agg(F.max("end_byte").alias("last")), "doc_id", "left").select(
        "doc_id", F.lit("PreservedWhitespace").alias("kind"), F.coalesce("last", F.lit(0)).cast("bigint").alias("from"), F.col("size").cast("bigint").alias("to")
    )
    gaps = before.unionByName(behind).where(F.col("from") < F.col("to")).select("doc_id", "kind", F.col("from").alias("start_byte"), F.col("to").alias("end_byte"))
    return inside.unionByName(gaps).withColumn("block_no", F.row_number().over(w) - 1)


def partition_errors(documents: DataFrame, block_rows: DataFrame) -> DataFrame:
    """Documents whose blocks overlap, leave a gap, are empty or don't cover the text: (doc_id, error, places)."""
    w = Window.partitionBy("doc_id").orderBy("start_byte", "end_byte")
    sizes = documents.where(F.octet_length("text") > 0).select("doc_id", F.octet_length("text").alias("size"))
    joined = block_rows.join(sizes, "doc_id").withColumn("before", F.lag("end_byte").over(w)).withColumn("after", F.lead("start_byte").over(w))
    error = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("start_byte") < F.col("before"), "Overlap"),
                F.when(F.col("start_byte") > F.coalesce("before", F.lit(0)), "Gap"),
                F.when(F.col("start_byte") >= F.col("end_byte"), "Empty"),
                F.when(F.col("after").isNull() & (F.col("end_byte") != F.col("size")), "Coverage"),
            )
        )
    )
    return joined.select("doc_id", error.alias("error")).groupBy("doc_id", "error").agg(F.count("*").alias("places"))


def reconstructed(documents: DataFrame, block_rows: DataFrame) -> DataFrame:
    """(doc_id, blocks, same): whether the blocks laid end to end give the text back.

    The spans of a document are gathered, not copies of its text, and cut out of it in one row.
    """
    spans = block_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "start_byte", "end_byte"))).alias("spans"))
    joined = spans.join(documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.encode("text", "utf-8").alias("bytes")), "doc_id")
    piece = lambda x: F.substring(F.col("bytes"), x.start_byte.cast("int") + 1, (x.end_byte - x.start_byte).cast("int")).cast("string")
    return joined.select("doc_id", F.size("spans").cast("bigint").alias("blocks"), (F.array_join(F.transform("spans", piece), "") == F.col("text")).alias("same"))


#: Two code points that never are characters, so no text holds them.
HIDDEN, CUT = "\ufdd0", "\ufdd1"


def rule_sentences(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Sentences of a text by rules, as an array, all in built-in expressions.

    Periods that don't end a sentence (abbreviations, between letters or
    digits, initials) are hidden, the rest marked, then split. An empty list of
    abbreviations gives the engine-compatible mode.
    """
    words = ABBREVIATIONS["en"] if abbreviations is None else abbreviations
    opened = r"(^|[\s(\[{\"“„])"
    hidden = text
    if words:
        dotted = [w for w in words if "." in w]
        for w in dotted:
            hidden = F.regexp_replace(hidden, f"(?i){opened}{w.replace('.', chr(92) + '.')}\\.", "$1" + w.replace(".", HIDDEN) + HIDDEN)
        hidden = F.regexp_replace(hidden, f"(?i){opened}({'|'.join(w for w in words if '.' not in w)})\\.(\\s|$)", "$1$2" + HIDDEN + "$3")
    for _ in range(2):  # matches overlap
        hidden = F.regexp_replace(hidden, r"([\p{L}\p{N}])\.([\p{L}\p{N}])", "$1" + HIDDEN + "$2")
    for _ in range(2):
        hidden = F.regexp_replace(hidden, opened + r"(\p{L})\.(\s*\p{L}[\p{L}." + HIDDEN + "])", "$1$2" + HIDDEN + "$3")
    marked = F.regexp_replace(hidden, f"([.!?…]+[{CLOSERS}]*)[\\s]*", "$1" + CUT)
    pieces = F.transform(F.split(marked, CUT), lambda x: F.regexp_replace(F.regexp_replace(x, HIDDEN, "."), r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda x: x != "")


def simple_sentences(text: Column) -> Column:
    """Pieces up to each ``.``, ``?`` or ``!``, and the rest."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.?!]*[.?!]|[^.?!]+$"), 0), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), lambda x: F.trim(x) != ""))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[.!?]"), lambda x: F.trim(x) != ""))


def span_relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """equal, contains, inside, overlaps or apart, for half-open spans."""
    return (
        F.when((a0 == b0) & (a1 == b1), "equal")
        .when((a0 <= b0) & (b1 <= a1), "contains")
        .when((b0 <= a0) & (a1 <= b1), "inside")
        .when((a0 < b1) & (b0 < a1), "overlaps")
        .otherwise("apart")
    )


def line_of_offset(offsets: DataFrame, line_rows: DataFrame) -> DataFrame:
    """Line and column in characters (both from 1) of each (doc_id, offset): the last line that begins at or before it.

    Both sides are sorted together and the last line carried forward, so no
    offset meets every line of its document. An offset inside a character
    counts as behind it, one behind the line's end as in a column beyond it.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    starts = line_rows.select("doc_id", F.col("start_byte").alias("at"), F.lit(0).alias("side"), F.struct(F.col("line_no").cast("int").alias("no"), F.col("start_byte").alias("start"), "line").alias("line"), nothing("bigint").alias("offset"))
    asked = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("side"), nothing("struct<no:int,start:bigint,line:string>").alias("line"), F.col("offset").cast("bigint").alias("offset"))
    w = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(asked).withColumn("line", F.last("line", ignorenulls=True).over(w)).where("side = 1")
    size = (F.col("offset") - F.col("line.start")).cast("int")
    inside = F.length(F.substring(F.encode("line.line", "utf-8"), F.lit(1), size).cast("string"))
    beyond = F.greatest(size - F.octet_length("line.line"), F.lit(0))
    return both.select("doc_id", "offset", (F.col("line.no") + 1).alias("line"), (inside + beyond + 1).cast("bigint").alias("char_column"))


def assemble(sentences: DataFrame, order: str, generated: str, raw: str) -> DataFrame:
    """Per document the raw spans in order, the content of each replaced where something was generated; blanks around it stay.

    A document is one row of the result, as it was before it was cut.
    """
    blank = lambda p: F.regexp_extract(F.col(raw), p, 0)
    piece = F.when(F.col(generated).isNull(), F.col(raw)).otherwise(F.concat(blank(r"^\s*"), F.col(generated), F.when(F.trim(raw) == "", "").otherwise(blank(r"\s*\z"))))
    return sentences.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece.alias("s")))), lambda x: x.s), "").alias("text"))
