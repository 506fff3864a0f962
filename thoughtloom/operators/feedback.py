"""Feedback on retrieval runs: validation, bridge pairs, edge merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions.rounding import round_half_even
from thoughtloom.functions.rules import FEEDBACK_STATUSES, POSITIVE_FEEDBACK
from thoughtloom.functions.text import casefold, strip
from thoughtloom.schemas import EVIDENCE

# Edge relation, and the status each rating stands for.
RELATION = "inspire_feedback"
RATINGS = {"up": "useful", "down": "wrong"}


def feedback_amount(status: Column, amount: Column | None = None) -> Column:
    """Given amount, else the one its status implies, else zero."""
    implied = F.lit(0.0)
    for name, value in POSITIVE_FEEDBACK.items():
        implied = F.when(status == name, F.lit(value)).otherwise(implied)
    return implied if amount is None else F.coalesce(amount, implied)


def normalise_status(status: Column) -> Column:
    """Folded status; an unsupported one fails the job."""
    folded = casefold(strip(status))
    return F.when(folded.isin(*FEEDBACK_STATUSES), folded).otherwise(
        F.raise_error(F.concat(F.lit("unsupported feedback status: "), status)).cast("string")
    )


def resolve_feedback(feedback: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Feedback rows with normalised status, sorted distinct atom ids and amount.

    Ids of the named suggestion are added to the row's own ids; a row without
    any id is an error, as is an unknown suggestion.
    """
    rows = feedback.withColumn("status", normalise_status(F.col("status")))
    if "suggestion_id" in feedback.columns:
        rows = rows.withColumn("suggestion_id", strip(F.col("suggestion_id")))
    own = F.coalesce("atom_ids", F.array().cast("array<string>"))
    if suggestions is not None:
        cited = suggestions.select("run_id", "suggestion_id", F.col("cited_atom_ids").alias("_cited"))
        rows = rows.join(cited, ["run_id", "suggestion_id"], "left")
        named = F.coalesce(F.col("suggestion_id"), F.lit("")) != ""
        extra = F.when(named & F.col("_cited").isNull(), F.raise_error(F.lit("unknown suggestion")).cast("array<string>"))
        ids = F.concat(own, F.coalesce(extra, F.coalesce("_cited", F.array().cast("array<string>"))))
    else:
        ids = own
    ids = F.sort_array(F.array_distinct(ids))
    checked = F.when(F.size(ids) > 0, ids).otherwise(
        F.raise_error(F.lit("feedback requires at least one atom id or suggestion id")).cast("array<string>")
    )
    given = F.col("amount") if "amount" in feedback.columns else None
    return rows.withColumns(
        {"atom_ids": checked, "amount": feedback_amount(F.col("status"), given)}
    ).drop("_cited")


def unknown_citations(resolved: DataFrame, atoms: DataFrame) -> DataFrame:
    """(feedback_id, atom_id) rows that cite an atom the table does not hold."""
    cited = resolved.select("feedback_id", F.explode("atom_ids").alias("id"))
    return cited.join(atoms.select("id"), "id", "left_anti").select("feedback_id", F.col("id").alias("atom_id"))


def _is_applied() -> Column:
    return F.col("status").isin(*POSITIVE_FEEDBACK) & (F.col("amount") > 0)


def feedback_pairs(resolved: DataFrame) -> DataFrame:
    """Bridge pairs (from_id < to_id) of the atoms one positive feedback cites."""
    ids = F.col("atom_ids")
    return (
        resolved.where(_is_applied() & (F.size(ids) > 1))
        .select("*", F.posexplode(ids).alias("_at", "from_id"))
        .withColumn("to_id", F.explode(F.slice(ids, F.col("_at") + 2, F.size(ids))))
        .drop("_at")
    )


def feedback_touches(resolved: DataFrame) -> DataFrame:
    """(id, amount, feedback_id): activation gains of positive feedback."""
    return resolved.where(_is_applied()).select(F.explode("atom_ids").alias("id"), "amount", "feedback_id")


def touch_by_feedback(atoms: DataFrame, resolved: DataFrame) -> DataFrame:
    """Activation after all positive feedback of the batch.

    Gains are positive and only capped from above, so their order does not
    matter and a decimal sum per atom (combinable) replaces the event list.
    """
    gains = (
        feedback_touches(resolved)
        .groupBy("id")
        .agg(F.sum(F.col("amount").cast("decimal(20,9)")).cast("double").alias("_gain"))
    )
    raised = F.least(F.lit(1.0), F.col("activation") + F.coalesce("_gain", F.lit(0.0)))
    return atoms.join(gains, "id", "left").withColumn("activation", raised).drop("_gain")


def feedback_edge_deltas(pairs: DataFrame, order: str) -> DataFrame:
    """One row per bridge: summed weight, first and summed confidence, last evidence."""
    gain = F.least(F.lit(1.0), F.col("amount"))
    confidence = round_half_even(F.least(F.lit(0.95), F.lit(0.55) + F.col("amount")), 3)
    carried = [c for c in ("run_id", "feedback_id", "status", "atom_ids", "note", "suggestion_id", "created_at") if c in pairs.columns]
    return (
        pairs.withColumns({"_gain": gain, "_confidence": confidence})
        .groupBy("from_id", "to_id")
        .agg(
            F.sum(F.col("_gain").cast("decimal(20,9)")).cast("double").alias("gain"),
            F.min_by("_confidence", order).alias("first_confidence"),
            F.sum(F.col("_confidence").cast("decimal(20,9)")).cast("double").alias("confidence_sum"),
            F.count("*").alias("events"),
            F.max_by(F.struct(*carried), F.col(order)).alias("last"),
        )
    )


def _whole_evidence(edges: DataFrame) -> Column:
    """Stored evidence with all its fields, those it lacks as nulls; null without any."""
    if "evidence" not in edges.columns:
        return F.lit(None).cast(EVIDENCE)
    stored = edges.schema["evidence"].dataType.names
    wanted = F.lit(None).cast(EVIDENCE)
    names = edges.select(wanted.alias("e")).schema["e"].dataType
    fields = [
        (F.col(f"evidence.{f.name}") if f.name in stored else F.lit(None)).cast(f.dataType).alias(f.name) for f in names.fields
    ]
    return F.when(F.col("evidence").isNotNull(), F.struct(*fields))


def merge_feedback_edges(edges: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """Next version of the feedback edges, with their evidence and the number of events merged.

    Edges the batch touches get the evidence of its last event and, where the edges
    have ``last_used``, its time (null if the pairs have none); others keep theirs.
    """
    deltas = feedback_edge_deltas(pairs, order)
    known = edges.where(F.col("relation") == RELATION).select(
        "from_id",
        "to_id",
        F.col("weight").alias("old_weight"),
        F.col("confidence").alias("old_confidence"),
        _whole_evidence(edges).alias("old_evidence"),
        (F.col("last_used") if "last_used" in edges.columns else F.lit(None)).cast("timestamp").alias("old_used"),
    )
    joined = known.join(deltas, ["from_id", "to_id"], "full_outer")
    fresh = F.col("old_weight").isNull()
    later_confidence = F.when(fresh, F.col("confidence_sum") - F.col("first_confidence")).otherwise(F.col("confidence_sum"))
    base_confidence = F.when(fresh, F.col("first_confidence")).otherwise(F.col("old_confidence"))
    touched = F.col("events").isNotNull()
    weight = F.least(F.lit(1.0), F.coalesce("old_weight", F.lit(0.0)) + F.col("gain"))
    confidence = F.when(fresh & (F.col("events") == 1), F.col("first_confidence")).otherwise(
        F.least(F.lit(0.95), base_confidence + later_confidence * F.lit(0.25))
    )
    nothing, carried = F.lit(None).cast("array<string>"), deltas.schema["last"].dataType.names
    of_last = lambda name: (F.col(f"last.{name}") if name in carried else F.lit(None)).cast("string").alias(name)
    evidence = F.struct(
        F.lit(RELATION).alias("type"),
        *[nothing.alias(name) for name in ("shared_tags", "left_tags", "right_tags")],
        *[of_last(name) for name in ("run_id", "feedback_id", "status")],
        (F.col("last.atom_ids") if "atom_ids" in carried else nothing).alias("atom_ids"),
        *[of_last(name) for name in ("note", "suggestion_id")],
    )
    used = (F.col("last.created_at") if "created_at" in carried else F.lit(None)).cast("timestamp")
    return joined.select(
        "from_id",
        "to_id",
        F.lit(RELATION).alias("relation"),
        F.when(touched, weight).otherwise(F.col("old_weight")).alias("weight"),
        F.when(touched, confidence).otherwise(F.col("old_confidence")).alias("confidence"),
        F.when(touched, used).otherwise(F.col("old_used")).alias("last_used"),
        F.when(touched, evidence.cast(EVIDENCE)).otherwise(F.col("old_evidence")).alias("evidence"),
        F.coalesce("events", F.lit(0)).cast("bigint").alias("events"),
    )


def rating_statuses(suggestions: DataFrame, ratings: DataFrame, rating_map: dict[str, str] = RATINGS) -> DataFrame:
    """Status of every suggestion of a run: unrated -> ignored, unknown rating -> error."""
    joined = suggestions.join(ratings, ["run_id", "suggestion_id"], "left")
    rating = F.coalesce("rating", F.lit(""))
    status = F.when(rating == "", F.lit("ignored"))
    for value, name in rating_map.items():
        status = status.when(rating == value, F.lit(name))
    status = status.otherwise(F.raise_error(F.concat(F.lit("unsupported rating: "), rating)).cast("string"))
    return joined.select("run_id", "suggestion_id", status.alias("status"))


def latest_run(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Id of the newest run: second resolution first, then insertion order."""
    newest = F.max_by("id", F.struct(F.date_trunc("second", "created_at").alias("s"), F.col(seq).alias("n")))
    return runs.agg(newest.alias("id"))
