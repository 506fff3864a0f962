"""Run and usage rows: what answered runs and feedback append to the memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions import text
from thoughtloom.functions.rules import POSITIVE_FEEDBACK

# Names in stored usage events.
RUN_EVENT, FEEDBACK_EVENT, RUN_TARGET = "inspire_run", "inspire_feedback", "inspire_run"


def run_id(runs: DataFrame) -> Column:
    return F.col("id" if "id" in runs.columns else "run_id")


def run_rows(runs: DataFrame, now: Column) -> DataFrame:
    """Rows of the run table for answered runs; a missing column is empty."""
    have = set(runs.columns)
    words = lambda name: (F.col(name) if name in have else F.lit("")).cast("string").alias(name)
    ids = lambda name: (F.col(name) if name in have else F.array()).cast("array<string>").alias(name)
    return runs.select(
        run_id(runs).alias("id"), words("question"), ids("focus_atom_ids"), ids("latent_atom_ids"), words("output_text"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def _event(event: str, target: Column, metadata: dict[str, Column], key: Column, now: Column) -> list[Column]:
    entries = [x for name, value in metadata.items() for x in (F.lit(name), F.coalesce(value.cast("string"), F.lit("")))]
    return [
        text.short_id(F.lit(event), target, key.cast("string")).alias("id"),
        F.lit(event).alias("event"),
        F.lit(RUN_TARGET).alias("target_type"),
        target.alias("target_id"),
        F.create_map(*entries).alias("metadata"),
        now.alias("created_at"),
    ]


def run_events(rows: DataFrame, now: Column) -> DataFrame:
    """One usage event per row of the run table."""
    return rows.select(*_event(RUN_EVENT, F.col("id"), {"question": F.col("question")}, F.lit(""), now))


def feedback_events(resolved: DataFrame, now: Column) -> DataFrame:
    """One usage event per resolved feedback; bridges are counted where it strengthens any."""
    n = F.size("atom_ids").cast("long")
    applied = F.col("status").isin(*POSITIVE_FEEDBACK) & (F.col("amount") > 0)
    suggestion = F.col("suggestion_id") if "suggestion_id" in resolved.columns else F.lit("")
    details = {
        "status": F.col("status"),
        "atom_ids": F.array_join("atom_ids", ","),
        "suggestion_id": suggestion,
        "bridges_strengthened": F.when(applied, F.expr("size(atom_ids) * (size(atom_ids) - 1) div 2")).otherwise(F.lit(0)),
        "atoms_touched": F.when(applied, n).otherwise(F.lit(0)),
    }
    return resolved.select(*_event(FEEDBACK_EVENT, F.col("run_id"), details, F.col("feedback_id"), now))


def append_new(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``stored`` and the rows whose id it lacks, so that an append may be repeated."""
    if stored is None:
        return rows
    fresh = rows.join(stored.select("id"), "id", "left_anti")
    return stored.unionByName(fresh.select(*rows.columns), allowMissingColumns=True)


def touch_runs(runs: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Runs that got feedback carry its time as ``updated_at``."""
    if "updated_at" not in runs.columns:
        return runs
    given = resolved.select(F.col("run_id").alias("id"), F.lit(True).alias("_given")).distinct()
    updated = F.when(F.coalesce("_given", F.lit(False)), now).otherwise(F.col("updated_at"))
    return runs.join(given, "id", "left").withColumn("updated_at", updated).select(*runs.columns)


def unknown_runs(resolved: DataFrame, runs: DataFrame) -> DataFrame:
    """(feedback_id, run_id) rows on a run that the table does not hold."""
    known = runs.select(run_id(runs).alias("run_id"))
    return resolved.join(known, "run_id", "left_anti").select("feedback_id", "run_id")
