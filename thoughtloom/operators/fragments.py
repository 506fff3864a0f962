"""Turns -> cleaned fragments -> atoms, and the keyed table versions they feed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thoughtloom.functions import scoring, text
from thoughtloom.functions.rules import DEFAULT_KIND_RULES, DEFAULT_TAG_RULES, Rules


def cap_per_group(df: DataFrame, limit: int | None, order: Sequence[Column], group: str | None = None) -> DataFrame:
    """First ``limit`` rows of every group (or of the whole frame) in ``order``.

    The grouped form is a ``row_number() <= n`` filter, which Spark prunes in
    every map task before the shuffle; the global form is a distributed top-n.
    """
    if limit is None:
        return df
    if group is None:
        return df.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def clean_fragments(
    turns: DataFrame,
    *,
    min_chars: int = 12,
    max_chars: int | None = None,
    contains: Iterable[str] = (),
) -> DataFrame:
    """Cleaned, noise-free fragments with their deterministic id (narrow)."""
    kept = turns.where(
        text.fragment_filter(F.col("text"), min_chars=min_chars, max_chars=max_chars, contains=contains)
    )
    cleaned = kept.withColumn("text", text.clean_text(F.col("text")))
    return cleaned.withColumn("id", text.short_id(F.col("source"), F.col("text")))


def rules_atoms(
    fragments: DataFrame,
    *,
    kind_rules: Rules = DEFAULT_KIND_RULES,
    tag_rules: Rules = DEFAULT_TAG_RULES,
    whole_words: bool = False,
    metadata: Column | None = None,
) -> DataFrame:
    """Atoms labelled by rule tables; a narrow projection over fragments."""
    body = F.col("text")
    if metadata is None:
        metadata = F.create_map(F.lit("source_file"), F.col("source_file"))
    # A column used by many rules stays a projection of its own, so the text is
    # folded once per row rather than once per rule.
    labelled = (
        fragments.withColumn("_folded", text.casefold(body))
        .withColumns(
            {
                "summary": text.summarize(body),
                "kind": text.kind_of(F.col("_folded"), kind_rules, whole_words=whole_words),
                "tags": text.tags_of(F.col("_folded"), tag_rules, whole_words=whole_words),
            }
        )
        .drop("_folded")
    )
    scored = labelled.withColumn(
        "importance", scoring.score_importance(F.col("role"), body, F.col("kind"), F.col("tags"))
    )
    return scored.withColumns(
        {"activation": scoring.initial_activation(F.col("importance")), "metadata": metadata}
    )


def upsert(
    old: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    *,
    order: str,
    now: Column,
    keep_max: Sequence[str] = ("activation",),
    precedence: Column | None = None,
) -> DataFrame:
    """Next version of a keyed table: the last batch row wins, maxima survive.

    The batch is first reduced to one row per key with a combinable
    aggregate, so a key repeated in a third of the batch never meets in one
    task; then one full join on the key. ``precedence`` (a condition on the
    old row, columns prefixed ``old_``) keeps the old content where it holds.
    """
    content = [c for c in batch.columns if c not in {*key, order}]
    latest = batch.groupBy(*key).agg(
        F.max_by(F.struct(*content), F.col(order)).alias("_new"),
        *[F.max(c).alias(f"_max_{c}") for c in keep_max],
    )
    before = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in key])
    joined = before.join(latest, list(key), "full_outer")
    incoming = F.col("_new").isNotNull()
    overwrite = incoming if precedence is None else incoming & ~F.coalesce(precedence, F.lit(False))
    existed = F.col("old_created_at").isNotNull()

    def column(name: str) -> Column:
        if name == "created_at":
            return F.coalesce(F.col("old_created_at"), now)
        if name == "updated_at":
            return F.when(incoming, now).otherwise(F.col("old_updated_at"))
        if name in keep_max:
            return F.greatest(F.col(f"old_{name}"), F.col(f"_max_{name}"))
        if name not in content:
            return F.col(f"old_{name}")
        return F.when(overwrite | ~existed, F.col(f"_new.{name}")).otherwise(F.col(f"old_{name}"))

    return joined.select(*key, *[column(c).alias(c) for c in old.columns if c not in key])


def with_audit(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumns({"created_at": now, "updated_at": now})


def by_key(df: DataFrame, **key) -> DataFrame:
    """Point lookup; an empty frame means the key is unknown."""
    for name, value in key.items():
        df = df.where(F.col(name) == value)
    return df


def group_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row per table name with its row count."""
    parts = [
        table.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, table in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
