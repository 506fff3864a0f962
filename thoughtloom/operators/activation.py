"""Activation: one-step touch and decay, and exact replay of event histories.

Every operation is a clamped affine map ``x -> min(hi, max(lo, a*x + b))`` and
these compose into maps of the same form. ``replay`` range-partitions events by
(key, time), so a key with a third of all events is spread over many tasks;
each task folds its slice of a key to one map, and at most one map per
partition and key is combined at the end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Touch on use, decay per tick.
TOUCH_AMOUNT = 0.2
RETRIEVAL_TOUCH = 0.08
EDIT_TOUCH = 0.15
DECAY_FACTOR = 0.92
DECAY_FLOOR = 0.05
_OPEN = 1e300


def touch(df: DataFrame, ids: DataFrame, amount: float = TOUCH_AMOUNT, *, now: Column | None = None) -> DataFrame:
    """Raise activation once per occurrence of an id in ``ids`` (column ``id``)."""
    counts = ids.groupBy("id").agg(F.count("*").alias("_touches"))
    current = F.col("activation")
    if amount > 0:
        # The cap is reached after 1/amount steps, so longer runs need no more.
        steps = F.least(F.col("_touches"), F.lit(int(1.0 / amount) + 2)).cast("int")
        touched = F.aggregate(F.sequence(F.lit(1), steps), current, lambda x, _: F.least(F.lit(1.0), x + F.lit(amount)))
    else:
        touched = F.least(F.lit(1.0), current + F.col("_touches") * F.lit(amount))
    hit = F.col("_touches").isNotNull()
    joined = df.join(counts, "id", "left")
    result = joined.withColumn("activation", F.when(hit, touched).otherwise(current))
    if now is not None and "updated_at" in df.columns:
        result = result.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return result.drop("_touches")


def decay(df: DataFrame, factor: float = DECAY_FACTOR, floor: float = DECAY_FLOOR) -> DataFrame:
    return df.withColumn("activation", F.greatest(F.lit(floor), F.col("activation") * F.lit(factor)))


def touch_map(amount: Column) -> Column:
    return _map(F.lit(1.0), amount, F.lit(-_OPEN), F.lit(1.0))


def decay_map(factor: Column, floor: Column) -> Column:
    return _map(factor, F.lit(0.0), floor, F.lit(_OPEN))


def _map(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    return F.struct(
        a.cast("double").alias("a"), b.cast("double").alias("b"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi")
    )


def _compose_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One composed map per key of a sorted partition."""
    piece = TaskContext.get().partitionId()
    rows: list[tuple] = []
    key = None
    a, b, lo, hi = 1.0, 0.0, -_OPEN, _OPEN
    columns = ["key", "piece", "a", "b", "lo", "hi"]
    for batch in batches:
        for k, a2, b2, lo2, hi2 in zip(
            batch["key"].tolist(), batch["a"].tolist(), batch["b"].tolist(), batch["lo"].tolist(), batch["hi"].tolist()
        ):
            if k != key:
                if key is not None:
                    rows.append((key, piece, a, b, lo, hi))
                key, a, b, lo, hi = k, a2, b2, lo2, hi2
                continue
            a, b = a2 * a, a2 * b + b2
            lo = min(hi2, max(lo2, a2 * lo + b2))
            hi = min(hi2, max(lo2, a2 * hi + b2))
        if rows:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if key is not None:
        yield pd.DataFrame([(key, piece, a, b, lo, hi)], columns=columns)


def replay(initial: DataFrame, events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Final activation per key.

    ``initial`` has (key, activation); ``events`` has key, the ``order``
    columns and a ``step`` built by ``touch_map`` / ``decay_map``. Starting
    values enter as constant maps in front of the history, which makes the
    result bit-identical to a sequential fold for every key whose history lies
    in one partition.
    """
    places = {name: events.schema[name].dataType for name in order}
    start = initial.select(
        "key",
        F.lit(0).alias("_stage"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in places.items()],
        _map(F.lit(0.0), F.col("activation"), F.lit(-_OPEN), F.lit(_OPEN)).alias("step"),
    )
    history = events.select("key", F.lit(1).alias("_stage"), *order, "step")
    placed = start.unionByName(history)
    keys = ["key", "_stage", *order]
    key_type = events.schema["key"].dataType.simpleString()
    pieces = (
        placed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("key", "step.*")
        .mapInPandas(_compose_slices, f"key {key_type}, piece int, a double, b double, lo double, hi double")
    )
    chain = F.sort_array(F.collect_list(F.struct("piece", "a", "b", "lo", "hi")))
    return (
        pieces.groupBy("key")
        .agg(chain.alias("chain"))
        .select(
            "key",
            F.aggregate(
                "chain", F.lit(0.0), lambda x, m: F.least(m["hi"], F.greatest(m["lo"], m["a"] * x + m["b"]))
            ).alias("activation"),
        )
    )
