"""Incremental ingestion of files that grow in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.sources.chat import read_chat
from thoughtloom.sources.listings import select_source_files, snapshot_diff

_BATCH_FILES = 10_000


def changed_files(old_listing: DataFrame, new_listing: DataFrame) -> DataFrame:
    """Allowed files added or modified since the old listing.

    A file stream remembers paths and would miss lines appended to a file it
    has seen, so listings are compared by size and modification time.
    """
    diff = snapshot_diff(select_source_files(old_listing), select_source_files(new_listing))
    return diff.where(F.col("change") != "removed")


def sources_changed(old_listing: DataFrame, new_listing: DataFrame) -> bool:
    return not snapshot_diff(select_source_files(old_listing), select_source_files(new_listing)).isEmpty()


def incremental_turns(spark: SparkSession, old_listing: DataFrame, new_listing: DataFrame):
    """Turns of the changed files only, in batches of paths.

    Reading named files needs their paths on the driver, so they are streamed
    there and handed to the scan in batches of bounded size.
    """
    lines: list[str] = []
    documents: list[str] = []
    for row in changed_files(old_listing, new_listing).toLocalIterator():
        (lines if row["path"].lower().endswith(".jsonl") else documents).append(row["path"])
        if len(lines) + len(documents) >= _BATCH_FILES:
            yield read_chat(spark, lines=lines, documents=documents)
            lines, documents = [], []
    if lines or documents:
        yield read_chat(spark, lines=lines, documents=documents)
