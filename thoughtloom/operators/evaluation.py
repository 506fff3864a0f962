"""Evaluation sheets: sampling, cleaning, scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions.text import strip
from thoughtloom.operators.dedupe import DEFAULT_THRESHOLD, near_duplicate_filter
from thoughtloom.operators.extraction import rules_prediction
from thoughtloom.operators.fragments import cap_per_group, clean_fragments

HUMAN_FIELDS = (
    "keep", "route", "signal_found", "noise_marked", "handoff_sufficient",
    "summary_quality", "structure_quality", "noise", "useful",
)


def blank_review() -> Column:
    nothing = F.lit(None).cast("boolean")
    return F.struct(
        nothing.alias("keep"),
        F.lit("").alias("route"),
        nothing.alias("signal_found"),
        nothing.alias("noise_marked"),
        nothing.alias("handoff_sufficient"),
        nothing.alias("useful"),
        F.lit("").alias("notes"),
    )


def build_eval(
    turns: DataFrame,
    *,
    order: str = "scan_order",
    limit: int = 20,
    min_chars: int = 40,
    max_chars: int | None = 1600,
    per_file_limit: int | None = None,
    dedupe: bool = False,
    conservative: bool = True,
    threshold: float = DEFAULT_THRESHOLD,
    contains: Sequence[str] = (),
    extractor_name: str = "rules",
    predict=None,
    **rules,
) -> DataFrame:
    """Sample of cleaned fragments with predictions and blank review fields."""
    fragments = clean_fragments(turns, min_chars=min_chars, max_chars=max_chars, contains=contains)
    decided = near_duplicate_filter(
        fragments, "text", order, threshold, dedupe=dedupe, conservative=conservative
    ).where("keep").drop("keep", "reason", "fingerprint")
    capped = cap_per_group(decided, per_file_limit, [F.asc(order)], group="source_file")
    sample = cap_per_group(capped, limit, [F.asc(order)])
    predicted = rules_prediction(sample, **rules) if predict is None else predict(sample)
    return predicted.select(
        "id",
        "source_file",
        "source",
        "role",
        "text",
        F.lit(extractor_name).alias("extractor"),
        "prediction",
        blank_review().alias("human"),
        order,
    )


def clean_eval(sheet: DataFrame, order: str, *, threshold: float = DEFAULT_THRESHOLD, dedupe: bool = True, conservative: bool = True) -> DataFrame:
    """Sheet with keep / reason per case under the duplicate and noise rules."""
    return near_duplicate_filter(sheet, "text", order, threshold, dedupe=dedupe, conservative=conservative)


def clean_summary(decided: DataFrame) -> DataFrame:
    """One row: cases, kept, dropped duplicates, dropped disposables."""
    return decided.agg(
        F.count("*").alias("total_cases"),
        F.count_if("keep").alias("kept_cases"),
        F.count_if(F.col("reason") == "near-duplicate").alias("dropped_duplicates"),
        F.count_if(F.col("reason") == "disposable-fragment").alias("dropped_disposable"),
    )


def _human(sheet: DataFrame, name: str, kind: str) -> Column:
    known = {field.name for field in sheet.schema["human"].dataType.fields}
    return F.col(f"human.{name}") if name in known else F.lit(None).cast(kind)


def is_scored(sheet: DataFrame) -> Column:
    """Any review field filled in; sheets read from files carry it ready-made."""
    if "is_scored" in sheet.columns:
        return F.col("is_scored")
    result = F.coalesce(_human(sheet, "route", "string"), F.lit("")) != ""
    for name in HUMAN_FIELDS:
        if name != "route":
            result = result | _human(sheet, name, "boolean").isNotNull()
    return result


def _rate(hit: Column, base: Column) -> Column:
    n = F.count_if(base)
    return F.coalesce(F.try_divide(F.count_if(base & hit).cast("double"), n.cast("double")), F.lit(0.0))


def agreement(left: Column, right: Column) -> Column:
    return left == right


def score_eval(sheet: DataFrame) -> DataFrame:
    """One row of review metrics from a single aggregation pass."""
    return sheet.agg(*score_columns(sheet))


def score_columns(sheet: DataFrame) -> list[Column]:
    """The aggregates of ``score_eval``, to be combined with others in one pass."""

    def flag(name: str) -> Column:
        return _human(sheet, name, "boolean")

    useful, noise = flag("useful"), flag("noise")
    found, marked, handoff = flag("signal_found"), flag("noise_marked"), flag("handoff_sufficient")
    summary_q, structure_q = _human(sheet, "summary_quality", "double"), _human(sheet, "structure_quality", "double")
    scored = is_scored(sheet)
    yes, no = F.lit(True), F.lit(False)

    def true(column: Column) -> Column:
        return F.coalesce(column, no)

    scout = found.isNotNull() | marked.isNotNull() | handoff.isNotNull()
    scout_pass = true(useful) & true(found) & true(handoff) & F.coalesce(marked, yes)
    legacy_pass = (
        true(useful)
        & ~true(noise)
        & F.coalesce(summary_q >= 3, yes)
        & F.coalesce(structure_q >= 3, yes)
    )
    passed = F.when(scout, scout_pass).otherwise(legacy_pass)
    keep_h, keep_p = flag("keep"), F.col("prediction.keep")
    route_h = strip(F.coalesce(_human(sheet, "route", "string"), F.lit("")))
    route_p = strip(F.coalesce(F.col("prediction.route"), F.lit("")))
    quality = [F.coalesce(F.avg(F.when(scored, q.cast("double"))), F.lit(0.0)) for q in (summary_q, structure_q)]
    return [
        F.count("*").alias("total_cases"),
        F.count_if(scored).alias("scored_cases"),
        _rate(passed, scored).alias("pass_rate"),
        _rate(noise, scored & noise.isNotNull()).alias("noise_rate"),
        _rate(agreement(keep_h, keep_p), scored & keep_h.isNotNull() & keep_p.isNotNull()).alias("keep_agreement"),
        _rate(agreement(route_h, route_p), scored & (route_h != "") & (route_p != "")).alias("route_agreement"),
        _rate(found, scored & found.isNotNull()).alias("signal_found_rate"),
        _rate(marked, scored & marked.isNotNull()).alias("noise_marked_rate"),
        _rate(handoff, scored & handoff.isNotNull()).alias("handoff_sufficient_rate"),
        quality[0].alias("avg_summary_quality"),
        quality[1].alias("avg_structure_quality"),
    ]
