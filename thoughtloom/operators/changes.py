"""Change feeds between two versions of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions.text import set_digest

_DIGEST = ("rows", "sum_0", "sum_1")


def content_digests(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows, sum_0, sum_1): what a version holds, in a row per key, without its contents.

    A key may have several rows; they count together and in any order. Rows are digested
    where they are scanned, so only digests are shuffled.
    """
    content = [c for c in table.columns if c not in keys]
    row = F.to_json(F.struct(*content), {"ignoreNullFields": "false"}) if content else F.lit("")
    return table.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[s.alias(f"sum_{k}") for k, s in enumerate(set_digest(row))]
    )


def change_feed(seen: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): keys added, modified or removed between two digest tables; null is a key too."""
    digest = F.struct(*_DIGEST)
    sides = seen.select(*keys, digest.alias("before"), F.lit(None).cast(current.select(digest).schema[0].dataType).alias("after"))
    sides = sides.union(current.select(*keys, F.lit(None).cast(seen.select(digest).schema[0].dataType), digest))
    change = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .when(F.col("before") != F.col("after"), F.lit("modified"))
    )
    met = sides.groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    return met.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def changed_rows(table: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the current version under added or modified keys."""
    wanted = feed.where(F.col("change") != "removed").select(*[F.col(k).alias(f"_{k}") for k in keys])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return table.join(wanted, met, "left_semi")
