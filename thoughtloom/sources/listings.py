"""File listings: allow / deny rules, snapshot and manifest differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.functions.rules import CHAT_SUFFIXES, DENIED_PATH_PARTS


def read_listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, modified) of every file below ``paths``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(paths))
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def is_allowed_source(path: Column, suffixes: Sequence[str] = CHAT_SUFFIXES, denied: Sequence[str] = DENIED_PATH_PARTS) -> Column:
    folded = F.lower(path)
    allowed = F.lit(False)
    for suffix in suffixes:
        allowed = allowed | F.endswith(folded, F.lit(suffix))
    for part in denied:
        allowed = allowed & ~F.contains(folded, F.lit(part))
    return allowed


def select_source_files(
    listing: DataFrame, suffixes: Sequence[str] = CHAT_SUFFIXES, denied: Sequence[str] = DENIED_PATH_PARTS
) -> DataFrame:
    """Allowed files, once each; sort by ``lower(path)`` when an order is shown."""
    return listing.where(is_allowed_source(F.col("path"), suffixes, denied)).dropDuplicates(["path"])


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) for added, modified and removed files by (size, modified)."""
    before = old.select("path", F.struct("size", "modified").alias("before"))
    after = new.select("path", F.struct("size", "modified").alias("after"))
    change = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .when(F.col("before") != F.col("after"), F.lit("modified"))
    )
    return before.join(after, "path", "full_outer").select("path", change.alias("change")).where(
        F.col("change").isNotNull()
    )


def manifest_diff(manifest: DataFrame, listing: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(note ids, distinct atom ids) touched by edits since the manifest was written.

    ``sources`` is the long (note_id, atom_id) table. Files that vanished and notes no
    longer known are skipped.
    """
    current = listing.select("path", F.col("size").alias("now_size"), F.col("modified").alias("now_modified"))
    changed = (
        manifest.join(current, "path")
        .where((F.col("size") != F.col("now_size")) | (F.col("modified") != F.col("now_modified")))
        .select("id")
    )
    sources = sources.select(F.col("note_id").alias("id"), "atom_id")
    touched_notes = changed.join(sources, "id", "left_semi")
    touched_atoms = sources.join(touched_notes, "id", "left_semi").select(F.col("atom_id").alias("id")).distinct()
    return touched_notes, touched_atoms
