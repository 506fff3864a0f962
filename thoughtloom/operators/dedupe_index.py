"""Near-duplicate filter of a table that grows batch by batch.

What batches had and kept is stored as tables with a folder a batch: ``sets`` (what one pass
over the texts gives, hashes of all tokens among it), ``kept`` (row, fingerprint and digest)
and ``index`` (the signatures of each kept set). A signature depends on its set alone, so
those of all batches meet. A batch is filtered together with the sets kept before, which are
unlike each other and earlier than its rows, so only its rows go. All batches together keep
what ``near_duplicate_filter`` keeps of the whole, rows ordered by (batch, order).

A batch reads folders of earlier batches only and overwrites its own, so it may be
replayed after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thoughtloom.operators import dedupe as dd
from thoughtloom.session import materialise


class KeptIndex:
    """Tables below ``path`` as batch ``batch_id`` sees and extends them."""

    def __init__(self, path: str, batch_id: int):
        self.path, self.batch_id = path, batch_id

    def before(self, name: str, like: DataFrame) -> DataFrame:
        """What earlier batches stored; ``like`` has its columns."""
        if self.batch_id == 0:
            return like.limit(0)
        stored = like.sparkSession.read.schema(like.schema).option("basePath", f"{self.path}/{name}").parquet(
            *[f"{self.path}/{name}/batch={k}" for k in range(self.batch_id)]
        )
        return stored.select(*like.columns)

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` as they are stored."""
        path = f"{self.path}/{name}/batch={self.batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)


def filter_batch(
    batch: DataFrame,
    batch_id: int,
    path: str,
    text_col: str,
    order: str,
    threshold: float = dd.DEFAULT_THRESHOLD,
    *,
    scope: str | None = None,
    conservative: bool = True,
) -> DataFrame:
    """``batch`` with ``keep`` and ``reason``, judged after all earlier batches below ``path``.

    ``batch_id`` counts from 0 without gaps; ``order`` is unique in the batch.
    """
    stored = KeptIndex(path, batch_id)
    rid = F.struct(F.lit(batch_id).cast("bigint").alias("batch"), F.col(order).alias("place"))
    rows = batch.withColumn("_rid", rid)
    read = stored.add("sets", dd._reading(rows, text_col, "_rid", threshold, scope, conservative))
    firsts = dd._first_rows(read)
    earlier = stored.before("kept", firsts)
    fresh = firsts.join(earlier.select("scope", "fingerprint"), ["scope", "fingerprint"], "left_anti")
    fresh = materialise(fresh.join(earlier.select("scope", "digest"), ["scope", "digest"], "left_anti").select(*firsts.columns))
    sets = materialise(dd._distinct_sets(fresh, read))

    either = read.unionByName(stored.before("sets", read))
    dropped = dd._dropped(sets.unionByName(stored.before("index", sets)), either, threshold)
    kept_sets = stored.add("index", sets.join(dropped, "rid", "left_anti"))
    kept = materialise(fresh.where(F.col("n") == 0).select("rid").unionByName(kept_sets.select("rid")))
    stored.add("kept", fresh.join(kept, "rid", "left_semi").select(*firsts.columns))

    marked = read.select("rid", "disposable").join(kept.withColumn("_kept", F.lit(True)), "rid", "left")
    keep = F.coalesce(F.col("_kept"), F.lit(False))
    reason = F.when(F.col("_disposable"), F.lit("disposable-fragment")).when(keep, F.lit("keep")).otherwise(F.lit("near-duplicate"))
    marked = marked.select(F.col("rid").alias("_rid"), F.col("disposable").alias("_disposable"), "_kept")
    return rows.join(marked, "_rid", "left").select(*batch.columns, keep.alias("keep"), reason.alias("reason"))
