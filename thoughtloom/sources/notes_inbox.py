"""Markdown / text notes: folder scan and chunking by headings and blank lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.functions.rules import NOTE_SUFFIXES
from thoughtloom.functions.text import strip

# Front matter fences, heading lines, generated-note markers.
_FRONT_MATTER = r"(?sU)\A[^\S\n]*---[^\S\n]*\n(?:.*?\n)??[^\S\n]*---[^\S\n]*(?:\n|\z)"
_HEADING = r"(?mU)^[^\S\n]*#{1,6}[^\S\n]+(\S.*?)[^\S\n]*$"
_BLANK_LINES = r"(?U)\n(?:[^\S\n]*\n)+"
_LINE_END_SPACE = r"(?mU)[^\S\n]+$"
_HEAD_LINES = 30
GENERATED_MARKERS = ("note_id:", "source_atoms:")
_CUT, _TITLE_END = "\u0001", "\u0002"


def is_allowed_note(path: Column) -> Column:
    """Note suffix, and no path part that starts with a dot."""
    folded = F.lower(path)
    suffix = F.lit(False)
    for ending in NOTE_SUFFIXES:
        suffix = suffix | F.endswith(folded, F.lit(ending))
    return suffix & ~F.rlike(folded, F.lit(r"(^|/)\.[^/]"))


def is_generated_note(content: Column) -> Column:
    head = F.lower(F.substring_index(content, "\n", _HEAD_LINES))
    result = F.lit(True)
    for marker in GENERATED_MARKERS:
        result = result & F.contains(head, F.lit(marker))
    return result


def strip_front_matter(content: Column) -> Column:
    return F.regexp_replace(content, _FRONT_MATTER, "")


def note_chunks(content: Column) -> Column:
    """Blocks between blank lines, each prefixed by the heading it stands under."""
    unix = F.regexp_replace(content, r"\r\n?", "\n")
    trimmed = F.regexp_replace(unix, _LINE_END_SPACE, "")
    sections = F.split(F.concat(F.lit(_TITLE_END), F.regexp_replace(trimmed, _HEADING, f"{_CUT}$1{_TITLE_END}")), _CUT)

    def blocks(section: Column) -> Column:
        title = F.substring_index(section, _TITLE_END, 1)
        bodies = F.transform(F.split(F.substring_index(section, _TITLE_END, -1), _BLANK_LINES), strip)
        filled = F.filter(bodies, lambda body: body != "")
        return F.transform(
            filled, lambda body: F.when(title == "", body).otherwise(F.concat(title, F.lit("\n\n"), body))
        )

    return F.flatten(F.transform(sections, blocks))


def chunk_notes(notes: DataFrame, prefix: str = "note-inbox") -> DataFrame:
    """(path, content, rel_path, timestamp) -> numbered chunks as turns; no shuffle."""
    body = strip_front_matter(F.col("content"))
    return (
        notes.where(~is_generated_note(F.col("content")))
        .select("path", "rel_path", "timestamp", F.posexplode(note_chunks(body)).alias("chunk", "text"))
        .select(
            F.col("path").alias("source_file"),
            F.concat(F.lit(prefix + ":"), F.col("rel_path"), F.lit(":chunk["), F.col("chunk").cast("string"), F.lit("]")).alias("source"),
            F.lit("note").alias("role"),
            "text",
            "timestamp",
            F.struct(
                F.lower("path").alias("file"), F.col("chunk").cast("bigint").alias("major"), F.lit(0).cast("bigint").alias("minor")
            ).alias("scan_order"),
        )
    )


def read_notes(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Allowed note files below the given folders, with UTC modification time."""
    result = None
    for root in roots:
        base = root.rstrip("/") + "/"
        instant = F.to_utc_timestamp(F.col("_metadata.file_modification_time"), F.current_timezone())
        stamp = F.concat(
            F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(F.date_format(instant, "SSSSSS") == "000000", F.lit("")).otherwise(F.date_format(instant, ".SSSSSS")),
            F.lit("+00:00"),
        )
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .text(base, wholetext=True)
            .select(
                F.col("_metadata.file_path").alias("path"),
                F.col("value").alias("content"),
                stamp.alias("timestamp"),
            )
            .withColumn("rel_path", F.substring_index("path", base, -1))
            .where(is_allowed_note(F.col("rel_path")))
        )
        result = files if result is None else result.unionByName(files)
    if result is None:
        raise ValueError("no note folders")
    return result
