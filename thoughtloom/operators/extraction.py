"""Model-assisted extraction: caller-supplied functions and raw-output parsing."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thoughtloom.functions import scoring, text
from thoughtloom.functions.rules import (
    PLACEHOLDER_NOISE,
    PLACEHOLDER_NOISE_PARTS,
    SIGNAL_KINDS,
    SIGNAL_ROUTES,
)
from thoughtloom.operators.fragments import rules_atoms
from thoughtloom.schemas import SIGNAL

MIN_CONFIDENCE = 0.55
_FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
_SIGNAL_FIELDS = (
    "keep", "kind", "summary", "tags", "confidence", "reason", "route", "signals", "noise", "handoff",
)
_DEFAULTS = {
    "keep": False, "kind": "note", "summary": "", "tags": [], "confidence": 0.0,
    "reason": "", "route": "other", "signals": [], "noise": [], "handoff": "",
}


def extract(fragments: DataFrame, fn: Callable[[str, str], Mapping]) -> DataFrame:
    """Run ``fn(text, role) -> signal fields`` on Arrow batches.

    Adds ``signal`` and ``error``; an exception fills ``error`` for its row only.
    """
    inner = SIGNAL[len("struct<"):-1]

    @F.pandas_udf(f"struct<{inner}, error:string>")
    def run(body: pd.Series, role: pd.Series) -> pd.DataFrame:
        rows = []
        for content, speaker in zip(body, role):
            try:
                rows.append({**_DEFAULTS, **fn(content, speaker), "error": None})
            except Exception as problem:  # a failing row must not fail its batch
                rows.append({**_DEFAULTS, "tags": ["extractor-error"], "reason": str(problem), "error": str(problem)})
        return pd.DataFrame(rows, columns=[*_SIGNAL_FIELDS, "error"])

    return (
        fragments.withColumn("_out", run("text", "role"))
        .withColumn("signal", F.struct(*[F.col(f"_out.{name}").alias(name) for name in _SIGNAL_FIELDS]))
        .withColumn("error", F.col("_out.error"))
        .drop("_out")
    )


def _first_object(raw: pd.Series) -> pd.Series:
    """First decodable JSON object inside a text, or null."""
    decoder = json.JSONDecoder()

    def find(content):
        if content is None:
            return None
        at = content.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(content, at)
                return json.dumps(value, ensure_ascii=False)
            except json.JSONDecodeError:
                at = content.find("{", at + 1)
        return None

    return raw.map(find, na_action="ignore")


def _field(name: str) -> Column:
    return F.try_variant_get(F.col("_json"), f"$.{name}", "variant")


def _as_text(value: Column) -> Column:
    """Text of a JSON value; booleans and null read True / False / None."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(plain))
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), F.to_json(value))
        .otherwise(plain)
    )


def _text_field(name: str) -> Column:
    return F.coalesce(text.strip(_as_text(_field(name))), F.lit(""))


def _list_field(name: str, limit: int) -> Column:
    value = _field(name)
    kind = F.schema_of_variant(value)
    items = F.when(kind == "STRING", F.split(F.try_variant_get(value, "$", "string"), ",")).when(
        F.startswith(kind, F.lit("ARRAY")),
        F.transform(F.try_variant_get(value, "$", "array<variant>"), _as_text),
    )
    stripped = F.filter(F.transform(items, text.strip), lambda item: item != "")
    return F.coalesce(F.slice(stripped, 1, limit), F.array().cast("array<string>"))


def _truthy(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.coalesce(
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", plain != "")
        .when(F.startswith(kind, F.lit("ARRAY")), F.size(F.try_variant_get(value, "$", "array<variant>")) > 0)
        .when(F.startswith(kind, F.lit("OBJECT")), F.to_json(value) != "{}")
        .otherwise(F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )


def normalise_signals(df: DataFrame, raw_col: str, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Raw model output -> typed ``signal`` and ``error`` columns.

    Outputs that are one JSON object (alone or fenced) never leave the JVM;
    only the others visit Python to find their first decodable object.
    """
    stripped = text.strip(F.col(raw_col))
    fenced = F.regexp_extract(stripped, _FENCED, 1)
    body = F.when(fenced != "", fenced).otherwise(stripped)
    whole = F.when(F.startswith(F.col("_body"), F.lit("{")), F.try_parse_json(F.col("_body")))
    degenerate = text.is_degenerate_output(F.col(raw_col))
    parsed = (
        df.withColumn("_body", body)
        .withColumn("_whole", whole)
        .withColumn("_found", F.pandas_udf(_first_object, T.StringType())(F.when(F.col("_whole").isNull() & ~degenerate, F.col("_body"))))
        .withColumn("_json", F.coalesce(F.col("_whole"), F.try_parse_json(F.col("_found"))))
    )
    kind = F.when(F.col("_kind").isin(*SIGNAL_KINDS), F.col("_kind")).otherwise(F.lit("note"))
    # A falsy route (absent, null, "", false) is replaced before it is read.
    route = F.when(F.col("_route").isin(*SIGNAL_ROUTES), F.col("_route")).otherwise(text.route_from_kind(kind))
    noise = F.filter(
        _list_field("noise", 8),
        lambda item: ~text.casefold(item).isin(*PLACEHOLDER_NOISE)
        & ~F.contains(item, F.lit(PLACEHOLDER_NOISE_PARTS[0]))
        & ~F.contains(item, F.lit(PLACEHOLDER_NOISE_PARTS[1])),
    )
    tags = _list_field("tags", 6)
    number = F.coalesce(F.try_variant_get(_field("confidence"), "$", "double"), F.lit(0.0))
    fields = parsed.withColumns(
        {
            "_kind": _text_field("kind"),
            "_route": F.when(_truthy(_field("route")), text.casefold(_text_field("route"))).otherwise(F.lit("")),
            "_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)),
            "_reason": _text_field("reason"),
        }
    )
    low = F.col("_confidence") < min_confidence
    signal = F.struct(
        (_truthy(_field("keep")) & ~low).alias("keep"),
        kind.alias("kind"),
        _text_field("summary").alias("summary"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("uncategorized"))).alias("tags"),
        F.col("_confidence").alias("confidence"),
        F.when(low, F.concat(F.lit("below min_confidence: "), F.col("_reason"))).otherwise(F.col("_reason")).alias("reason"),
        route.alias("route"),
        _list_field("signals", 5).alias("signals"),
        noise.alias("noise"),
        _text_field("handoff").alias("handoff"),
    )
    error = F.when(degenerate, F.lit("degenerate model output")).when(
        F.col("_json").isNull(), F.lit("no JSON object in model output")
    )
    return fields.withColumn("error", error).withColumn(
        "signal", F.when(F.col("error").isNull(), signal)
    ).drop("_body", "_whole", "_found", "_json", "_kind", "_route", "_confidence", "_reason")


def model_atoms(extracted: DataFrame) -> DataFrame:
    """Atoms from kept signals."""
    body = F.col("text")

    def filled(column: Column) -> Column:
        return F.when(column != "", column)

    kept = extracted.where(F.col("error").isNull() & F.col("signal.keep"))
    importance = scoring.model_importance(F.col("signal.confidence"))
    metadata = F.create_map(
        F.lit("source_file"), F.col("source_file"),
        F.lit("extractor"), F.lit("model"),
        F.lit("extractor_confidence"), F.col("signal.confidence").cast("string"),
        F.lit("extractor_reason"), F.col("signal.reason"),
        F.lit("extractor_route"), F.col("signal.route"),
        F.lit("extractor_signals"), F.to_json("signal.signals"),
        F.lit("extractor_noise"), F.to_json("signal.noise"),
        F.lit("extractor_handoff"), F.col("signal.handoff"),
    )
    return kept.withColumns(
        {
            "summary": F.coalesce(filled(F.col("signal.handoff")), filled(F.col("signal.summary")), text.summarize(body)),
            "kind": F.col("signal.kind"),
            "tags": F.col("signal.tags"),
            "importance": importance,
            "metadata": metadata,
        }
    ).withColumn("activation", scoring.initial_activation(F.col("importance"), 0.55, 0.08)).drop("signal", "error")


def atoms_with_policy(extracted: DataFrame, on_reject: str = "drop", **rules) -> DataFrame:
    """Atoms under a rejection policy: ``drop`` rejected rows, or label them by ``rules``."""
    accepted = model_atoms(extracted)
    if on_reject == "drop":
        return accepted
    if on_reject == "rules":
        rejected = extracted.where(F.col("error").isNotNull() | ~F.col("signal.keep")).drop("signal", "error")
        return accepted.unionByName(rules_atoms(rejected, **rules))
    raise ValueError("on_reject must be 'drop' or 'rules'")


def outcomes(extracted: DataFrame) -> DataFrame:
    """(id, outcome, error, atom_id) rows of a queue batch."""
    failed = F.col("error").isNotNull()
    skipped = ~F.col("signal.keep")
    reason = F.when(F.col("signal.reason") != "", F.col("signal.reason")).otherwise(F.lit("extractor returned keep=false"))
    return extracted.select(
        "id",
        F.when(failed, F.lit("error")).when(skipped, F.lit("skipped")).otherwise(F.lit("done")).alias("outcome"),
        F.when(failed, F.col("error")).when(skipped, reason).otherwise(F.lit("")).alias("error"),
        F.when(~failed & ~skipped, F.col("id")).alias("atom_id"),
    )


def extraction_requests(fragments: DataFrame) -> DataFrame:
    """One request text per fragment for the caller's model."""
    request = F.concat(
        F.lit("Role: "),
        F.col("role"),
        F.lit("\nFragment (JSON string): "),
        F.to_json(F.struct(F.col("text"))),
        F.lit(
            "\n\nAnswer with a single JSON object with the keys keep, route, kind, summary, signals, "
            "noise, handoff, tags, confidence, reason.\n"
            f"route: one of {', '.join(SIGNAL_ROUTES)}.\n"
            f"kind: one of {', '.join(SIGNAL_KINDS)}.\n"
            "keep: whether the fragment is worth remembering. signals: at most five facts. "
            "noise: throw-away words taken from the fragment. confidence: a number from 0 to 1."
        ),
    )
    return fragments.select("id", request.alias("request"))


def rules_prediction(df: DataFrame, **rules) -> DataFrame:
    """Add the rules-only ``prediction`` struct that serves as the baseline."""
    labelled = rules_atoms(df.withColumn("source_file", F.lit("")) if "source_file" not in df.columns else df, **rules)
    prediction = F.struct(
        F.lit(True).alias("keep"),
        text.route_from_kind(F.col("kind")).alias("route"),
        F.col("kind").alias("kind"),
        F.col("summary").alias("summary"),
        F.col("tags").alias("signals"),
        F.array().cast("array<string>").alias("noise"),
        F.col("summary").alias("handoff"),
        F.col("tags").alias("tags"),
        F.col("importance").alias("confidence"),
        F.lit("rules baseline").alias("reason"),
    )
    return labelled.select(*df.columns, prediction.alias("prediction"))


def extractor_prediction(extracted: DataFrame) -> DataFrame:
    """``prediction`` struct from extractor output; errors become rejected rows."""
    failed = F.struct(
        F.lit(False).alias("keep"), F.lit("other").alias("route"), F.lit("note").alias("kind"), F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("signals"), F.array().cast("array<string>").alias("noise"),
        F.lit("").alias("handoff"), F.array(F.lit("extractor-error")).alias("tags"), F.lit(0.0).alias("confidence"),
        F.col("error").alias("reason"),
    )
    names = ["keep", "route", "kind", "summary", "signals", "noise", "handoff", "tags", "confidence", "reason"]
    good = F.struct(*[F.col(f"signal.{name}").alias(name) for name in names])
    return extracted.withColumn("prediction", F.when(F.col("error").isNotNull(), failed).otherwise(good)).drop(
        "signal", "error"
    )
