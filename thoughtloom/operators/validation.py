"""Quality verdicts over review sheets, notes and the feedback loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions import text
from thoughtloom.functions.rounding import round_half_even
from thoughtloom.functions.rules import NEGATIVE_FEEDBACK, POSITIVE_FEEDBACK
from thoughtloom.operators.evaluation import score_columns

# Verdict thresholds.
MIN_SCORED = 30
MAX_PARSE_ERRORS = 0.03
MAX_DUPLICATES = 0.10
MAX_TOOL_NOISE = 0.05
MAX_MISSES = 0.15
MIN_HANDOFF = 0.75
MAX_DUPLICATE_TITLES = 0.20
MIN_POSITIVE_PER_RUN = 0.25


def _ratio(n: Column, d: Column) -> Column:
    return F.coalesce(round_half_even(F.try_divide(n.cast("double"), d.cast("double")), 4), F.lit(0.0))


def _verdict(enough: Column, good: Column) -> Column:
    return F.when(~enough, F.lit("needs_data")).when(good, F.lit("pass")).otherwise(F.lit("fail"))


def duplicate_surplus(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows beyond the first of every key value."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus")
    )


def _strict(sheet: DataFrame, column: str) -> Column:
    fields = {field.name for field in sheet.schema[column].dataType.fields}
    return F.col(f"{column}.strict_keep" if "strict_keep" in fields else f"{column}.keep")


def validate_scout(sheet: DataFrame) -> DataFrame:
    """One row of extraction metrics and a verdict."""
    human, predicted = _strict(sheet, "human"), _strict(sheet, "prediction")
    no = F.lit(False)
    counted = sheet.agg(
        *score_columns(sheet),
        F.count_if(F.array_contains("prediction.tags", "extractor-error")).alias("parse_error_count"),
        F.count_if(F.coalesce(predicted, no) & text.is_disposable(F.col("text"))).alias("tool_noise_retained_count"),
        F.count_if(F.coalesce(human, no) & ~F.coalesce(predicted, F.lit(True))).alias("false_negative_count"),
        F.count_if(~F.coalesce(human, F.lit(True)) & F.coalesce(predicted, no)).alias("false_positive_count"),
    )
    surplus = duplicate_surplus(sheet, text.fingerprint(F.col("text")))
    total, scored = F.col("total_cases"), F.col("scored_cases")
    metrics = (
        counted.withColumn("duplicate_count", surplus.select("surplus").scalar())
        .select(
            "total_cases",
            "scored_cases",
            F.lit(MIN_SCORED).alias("minimum_scored_cases"),
            "pass_rate",
            "keep_agreement",
            "route_agreement",
            "handoff_sufficient_rate",
            "parse_error_count",
            _ratio(F.col("parse_error_count"), total).alias("parse_error_rate"),
            "duplicate_count",
            _ratio(F.col("duplicate_count"), total).alias("duplicate_rate"),
            "tool_noise_retained_count",
            _ratio(F.col("tool_noise_retained_count"), total).alias("tool_noise_retained_rate"),
            "false_negative_count",
            _ratio(F.col("false_negative_count"), scored).alias("false_negative_rate"),
            "false_positive_count",
            _ratio(F.col("false_positive_count"), scored).alias("false_positive_rate"),
        )
    )
    good = (
        (F.col("parse_error_rate") <= MAX_PARSE_ERRORS)
        & (F.col("duplicate_rate") <= MAX_DUPLICATES)
        & (F.col("tool_noise_retained_rate") <= MAX_TOOL_NOISE)
        & (F.col("false_negative_rate") <= MAX_MISSES)
        & (F.col("false_positive_rate") <= MAX_MISSES)
        & (F.col("handoff_sufficient_rate") >= MIN_HANDOFF)
    )
    enough = (F.col("total_cases") > 0) & (F.col("scored_cases") >= MIN_SCORED)
    return metrics.withColumn("verdict", _verdict(enough, good))


def dangling_sources(sources: DataFrame, atoms: DataFrame) -> DataFrame:
    """(note_id, atom_id) rows of notes that cite an atom the table lacks."""
    cited = sources.select("note_id", F.col("atom_id").alias("id"))
    return cited.join(atoms.select("id"), "id", "left_anti").select("note_id", F.col("id").alias("atom_id"))


def validate_notes(notes: DataFrame, sources: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row of note metrics and a verdict; ``sources`` is the long (note, atom) table."""
    per_note = sources.groupBy(F.col("note_id").alias("id")).agg(
        F.lit(True).alias("has_atoms"),
        F.bool_or(text.strip(F.col("source")) != "").alias("has_spans"),
    )
    flags = notes.join(per_note, "id", "left").agg(
        F.count("*").alias("notes_count"),
        F.count_if(F.coalesce("has_atoms", F.lit(False)) & F.coalesce("has_spans", F.lit(False))).alias("notes_with_sources"),
        F.count_if((text.strip(F.col("summary")) == "") & (F.size("key_points") == 0)).alias("empty_note_count"),
    )
    missing = dangling_sources(sources, atoms).select(F.count_distinct("note_id")).scalar()
    titles = duplicate_surplus(notes, text.casefold(F.col("title"))).scalar()
    n = F.col("notes_count")
    metrics = flags.withColumns(
        {
            "atoms_count": atoms.select(F.count("*")).scalar(),
            "missing_source_note_count": missing,
            "duplicate_title_count": titles,
        }
    ).select(
        "atoms_count",
        "notes_count",
        "notes_with_sources",
        _ratio(F.col("notes_with_sources"), n).alias("notes_with_sources_rate"),
        "empty_note_count",
        _ratio(F.col("empty_note_count"), n).alias("empty_note_rate"),
        "missing_source_note_count",
        _ratio(F.col("missing_source_note_count"), n).alias("missing_source_note_rate"),
        "duplicate_title_count",
        _ratio(F.col("duplicate_title_count"), n).alias("duplicate_title_rate"),
    )
    good = (
        (F.col("notes_with_sources_rate") >= 1.0)
        & (F.col("empty_note_count") == 0)
        & (F.col("missing_source_note_count") == 0)
        & (F.col("duplicate_title_rate") <= MAX_DUPLICATE_TITLES)
    )
    return metrics.withColumn("verdict", _verdict(F.col("notes_count") > 0, good))


def latent_citations(suggestions: DataFrame, runs: DataFrame) -> DataFrame:
    """Suggestions with ``cites_latent``: any cited atom is latent in their run."""
    latent = runs.select(F.col("id").alias("run_id"), "latent_atom_ids")
    return suggestions.join(latent, "run_id", "left").withColumn(
        "cites_latent", F.coalesce(F.arrays_overlap("cited_atom_ids", "latent_atom_ids"), F.lit(False))
    )


def validate_feedback(runs: DataFrame, suggestions: DataFrame, feedback: DataFrame, events: DataFrame) -> DataFrame:
    """One row of feedback-loop metrics and a verdict."""
    status = text.casefold(F.col("status"))
    by_status = feedback.agg(
        F.count("*").alias("feedback_count"),
        F.count_if(status.isin(*POSITIVE_FEEDBACK)).alias("positive_feedback_count"),
        F.count_if(status.isin(*NEGATIVE_FEEDBACK)).alias("negative_feedback_count"),
        F.count_if(status == "ignored").alias("ignored_feedback_count"),
    )
    answered = runs.select(F.col("id").alias("run_id")).join(feedback.select("run_id"), "run_id", "left_semi")
    cited = latent_citations(suggestions, runs)
    event_counts = events.agg(
        F.count("*").alias("all"),
        F.count_if(F.col("event") == "inspire_run").alias("run"),
        F.count_if(F.col("event") == "inspire_feedback").alias("feedback"),
    ).select(F.struct("*")).scalar()
    n, s = F.col("runs_count"), F.col("suggestions_count")
    metrics = by_status.withColumns(
        {
            "runs_count": runs.select(F.count("*")).scalar(),
            "suggestions_count": suggestions.select(F.count("*")).scalar(),
            "runs_with_feedback": answered.select(F.count("*")).scalar(),
            "latent_citation_count": cited.select(F.count_if("cites_latent")).scalar(),
            "usage": event_counts,
        }
    ).select(
        "runs_count",
        "suggestions_count",
        "feedback_count",
        "positive_feedback_count",
        "negative_feedback_count",
        "ignored_feedback_count",
        "runs_with_feedback",
        _ratio(F.col("runs_with_feedback"), n).alias("runs_with_feedback_rate"),
        _ratio(F.col("positive_feedback_count"), n).alias("positive_feedback_per_run"),
        _ratio(s, n).alias("suggestions_per_run"),
        "latent_citation_count",
        _ratio(F.col("latent_citation_count"), s).alias("latent_citation_rate"),
        F.col("usage.all").alias("usage_events_count"),
        F.col("usage.run").alias("inspire_run_event_count"),
        F.col("usage.feedback").alias("inspire_feedback_event_count"),
    )
    return metrics.withColumn(
        "verdict", _verdict(F.col("runs_count") > 0, F.col("positive_feedback_per_run") >= MIN_POSITIVE_PER_RUN)
    )


def combined_verdict(*sections: DataFrame) -> DataFrame:
    """fail beats needs_data beats pass over the sections' verdicts."""
    verdicts = sections[0].select("verdict")
    for section in sections[1:]:
        verdicts = verdicts.unionByName(section.select("verdict"))
    failed, open_ = F.bool_or(F.col("verdict") == "fail"), F.bool_or(F.col("verdict") == "needs_data")
    return verdicts.agg(
        F.when(failed, F.lit("fail")).when(F.coalesce(open_, F.lit(True)), F.lit("needs_data")).otherwise(F.lit("pass")).alias("verdict"),
        F.count("*").alias("sections"),
    )
