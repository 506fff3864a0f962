"""Suggestion blocks in a model's free-text answer -> one row per suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions.text import rstrip, strip

# The block header, the citation line, an id's word boundary.
_HEADER = r"(?imU)^([^\S\n]*suggestion_id[^\S\n]*:[^\S\n]*([A-Za-z0-9_.-]+)[^\S\n]*)$"
_CITED = r"(?imU)^[^\S\n]*cited_atom_ids[^\S\n]*:[^\S\n]*(\S.*?)[^\S\n]*$"
_BEFORE, _AFTER = r"(?U)(?<![\w.-])\Q", r"\E(?![\w.-])"
_MARK = "\u0001"


def _known_ids(cited: Column, known: Column) -> Column:
    """Known ids that occur in the citation line as whole words, by position."""
    hits = F.filter(known, lambda i: F.rlike(cited, F.concat(F.lit(_BEFORE), i, F.lit(_AFTER))))
    placed = F.transform(F.array_distinct(hits), lambda i: F.struct(F.call_function("instr", cited, i).alias("at"), i.alias("id")))
    return F.sort_array(placed)["id"]


def _listed_ids(cited: Column) -> Column:
    inner = F.regexp_replace(cited, r"^[\[\]]+|[\[\]]+$", "")
    items = F.transform(F.split(inner, r"[,\s]+"), lambda t: F.regexp_replace(t, "^['\"`]+|['\"`]+$", ""))
    return F.filter(items, lambda t: t != "")


def extract_suggestions(runs: DataFrame, known_ids: bool = True) -> DataFrame:
    """(run_id, position, suggestion_id, cited_atom_ids, text) from ``output_text``.

    With ``known_ids`` only ids of the run's focus and latent sets count;
    otherwise the citation list is split on commas and blanks. Blocks without
    a citation are dropped. All work happens inside the run's own row.
    """
    marked = F.split(F.regexp_replace(F.col("output_text"), _HEADER, _MARK + "$1"), _MARK)
    blocks = F.slice(marked, F.lit(2), F.size(marked))
    lines = F.transform(F.split(F.col("block"), r"\r\n|\n|\r"), rstrip)
    cited = F.regexp_extract(F.col("block"), _CITED, 1)
    if known_ids:
        known = F.concat("focus_atom_ids", "latent_atom_ids")
        ids = _known_ids(F.col("cited"), known)
        context = ["run_id", "focus_atom_ids", "latent_atom_ids"]
    else:
        ids = _listed_ids(F.col("cited"))
        context = ["run_id"]
    return (
        runs.select(*context, F.posexplode(blocks).alias("position", "block"))
        .withColumn("cited", cited)
        .select(
            "run_id",
            F.col("position").cast("int").alias("position"),
            F.regexp_extract("block", _HEADER, 2).alias("suggestion_id"),
            ids.alias("cited_atom_ids"),
            strip(F.array_join(lines, "\n")).alias("text"),
        )
        .where(F.size("cited_atom_ids") > 0)
    )


def upsert_suggestions(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Next suggestion table; rows without an id or citations are skipped, last wins."""
    valid = new.where((strip(F.col("suggestion_id")) != "") & (F.size("cited_atom_ids") > 0))
    latest = valid.groupBy("run_id", "suggestion_id").agg(
        F.max_by(F.struct("text", "cited_atom_ids"), F.col(order)).alias("_new")
    )
    joined = old.select("run_id", "suggestion_id", F.col("text").alias("_text"), F.col("cited_atom_ids").alias("_cited")).join(
        latest, ["run_id", "suggestion_id"], "full_outer"
    )
    return joined.select(
        "run_id",
        "suggestion_id",
        F.coalesce("_new.text", "_text").alias("text"),
        F.coalesce("_new.cited_atom_ids", "_cited").alias("cited_atom_ids"),
    )
