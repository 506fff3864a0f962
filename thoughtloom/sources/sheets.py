"""Review sheets stored as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thoughtloom.functions.text import variant_bool

_FLAGS = ("keep", "signal_found", "noise_marked", "handoff_sufficient", "useful", "noise")
_NUMBERS = ("summary_quality", "structure_quality")


def read_eval_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Typed sheet; a malformed line fails the job.

    Review fields may be booleans, numbers or words. ``is_scored`` records
    whether any of them was filled in, ``strict_keep`` only real booleans.
    """
    raw = ", ".join(f"{name}: variant" for name in (*_FLAGS, *_NUMBERS, "route"))
    schema = (
        "id string, source_file string, source string, role string, text string, extractor string, "
        "prediction struct<keep: variant, route: string, kind: string, summary: string, signals: array<string>, "
        "noise: array<string>, handoff: string, tags: array<string>, confidence: double, reason: string>, "
        f"human struct<{raw}, notes: string>"
    )
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)

    def strict(name: str):
        value = F.col(name)
        return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))

    filled = F.lit(False)
    for name in (*_FLAGS, *_NUMBERS, "route"):
        value = F.col(f"human.{name}")
        text = F.try_variant_get(value, "$", "string")
        present = value.isNotNull() & ~F.is_variant_null(value) & (F.coalesce(text, F.lit("?")) != "")
        filled = filled | F.coalesce(present, F.lit(False))
    human = F.struct(
        *[variant_bool(F.col(f"human.{name}")).alias(name) for name in _FLAGS],
        *[F.try_variant_get(F.col(f"human.{name}"), "$", "double").alias(name) for name in _NUMBERS],
        F.try_variant_get(F.col("human.route"), "$", "string").alias("route"),
        F.col("human.notes").alias("notes"),
        strict("human.keep").alias("strict_keep"),
    )
    prediction = F.struct(
        variant_bool(F.col("prediction.keep")).alias("keep"),
        *[
            F.col(f"prediction.{name}").alias(name)
            for name in ("route", "kind", "summary", "signals", "noise", "handoff", "tags", "confidence", "reason")
        ],
        strict("prediction.keep").alias("strict_keep"),
    )
    return rows.withColumn("is_scored", filled).withColumn("human", human).withColumn("prediction", prediction)


def write_eval_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
