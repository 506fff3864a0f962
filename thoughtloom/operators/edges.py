"""Shared-tag edges, kept factored, and the bounded graph view.

Two atoms sharing a tag form an edge, so a tag on a third of the atoms means
a ninth of all pairs. The full edge set is therefore never listed: an edge's
relation, weight and confidence depend only on the shared tag set and the two
tag-set sizes, and ``edge_counts`` gives the exact number of edges of every
such kind in time linear in the atoms. Listed edges are produced for a
bounded node set (the graph view).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.functions import scoring
from thoughtloom.functions.rounding import round_half_even
from thoughtloom.session import materialise

UNTAGGED = "uncategorized"
# Tag sets up to this size are counted through their subsets; larger ones
# (rare by construction) are paired through an equi-join on tags.
_SUBSET_LIMIT = 10
_COUNT = "decimal(38,0)"


def tag_set(tags: Column) -> Column:
    return F.sort_array(F.array_distinct(tags))


def _weight(shared: Column, left_size: Column, right_size: Column) -> Column:
    product = F.greatest(left_size, F.lit(1)).cast("double") * F.greatest(right_size, F.lit(1))
    return F.least(F.lit(1.0), shared / F.sqrt(product))


def _edge_columns(shared_tags: Column, left_size: Column, right_size: Column) -> dict[str, Column]:
    weight = _weight(F.size(shared_tags), left_size, right_size)
    return {
        "relation": F.concat(F.lit("shared_tags:"), F.array_join(shared_tags, ",")),
        "weight": round_half_even(weight, 3),
        "confidence": round_half_even(F.least(F.lit(0.95), F.lit(0.45) + weight * F.lit(0.4)), 3),
    }


def _is_edge(shared_tags: Column, min_shared: int) -> Column:
    only_untagged = (F.size(shared_tags) == 1) & (F.element_at(shared_tags, 1) == UNTAGGED)
    return (F.size(shared_tags) >= max(min_shared, 1)) & ~only_untagged


def tag_set_sizes(atoms: DataFrame) -> DataFrame:
    """Distinct tag sets with their number of atoms (map-side combined)."""
    return (
        atoms.select(tag_set(F.col("tags")).alias("tag_set"))
        .groupBy("tag_set")
        .agg(F.count("*").cast(_COUNT).alias("atoms"))
    )


def _subsets(tags: Column) -> Column:
    """All non-empty subsets of a short sorted array, each sorted."""
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(tags)) - 1)
    subsets = F.transform(
        masks,
        lambda mask: F.filter(
            tags, lambda _, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1
        ),
    )
    return F.when(F.size(tags) > 0, subsets)


def _narrow_counts(sets: DataFrame) -> DataFrame:
    """Pairs by exact shared set among short tag sets, by inclusion-exclusion.

    ``containing(S, a)`` atoms of size ``a`` hold ``S``; pairs sharing at least
    ``S`` follow by products, pairs sharing exactly ``S`` by an alternating sum
    over supersets.
    """
    containing = (
        sets.select(F.size("tag_set").alias("n"), "atoms", F.explode(_subsets(F.col("tag_set"))).alias("shared"))
        .groupBy("shared", "n")
        .agg(F.sum("atoms").cast(_COUNT).alias("atoms"))
    )
    by_size = containing.groupBy("shared").agg(F.sort_array(F.collect_list(F.struct("n", "atoms"))).alias("sizes"))
    at_least = (
        by_size.withColumn("low", F.explode("sizes"))
        .withColumn("high", F.explode(F.filter("sizes", lambda s: s["n"] >= F.col("low.n"))))
        .select(
            "shared",
            F.col("low.n").alias("low_size"),
            F.col("high.n").alias("high_size"),
            F.when(
                F.col("low.n") == F.col("high.n"),
                F.expr("cast(low.atoms * (low.atoms - 1) / 2 as decimal(38,0))"),
            )
            .otherwise(F.expr("cast(low.atoms * high.atoms as decimal(38,0))"))
            .alias("pairs"),
        )
        .where(F.col("pairs") > 0)
    )
    signed = at_least.withColumn("subset", F.explode(_subsets(F.col("shared")))).withColumn(
        "signed",
        F.when((F.size("shared") - F.size("subset")) % 2 == 0, F.col("pairs")).otherwise(-F.col("pairs")),
    )
    return (
        signed.groupBy(F.col("subset").alias("shared"), "low_size", "high_size")
        .agg(F.sum("signed").cast(_COUNT).alias("edges"))
        .where(F.col("edges") > 0)
    )


def _wide_counts(wide: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with at least one long tag set, at the level of distinct tag sets."""
    left = wide.select(F.col("tag_set").alias("l"), F.col("atoms").alias("l_atoms"), F.explode("tag_set").alias("tag"))
    right = sets.select(F.col("tag_set").alias("r"), F.col("atoms").alias("r_atoms"), F.explode("tag_set").alias("tag"))
    once = (F.size("r") <= _SUBSET_LIMIT) | (F.col("l") <= F.col("r"))
    pairs = left.join(right, "tag").where(once).select("l", "r", "l_atoms", "r_atoms").distinct()
    return pairs.select(
        F.sort_array(F.array_intersect("l", "r")).alias("shared"),
        F.least(F.size("l"), F.size("r")).alias("low_size"),
        F.greatest(F.size("l"), F.size("r")).alias("high_size"),
        F.when(F.col("l") == F.col("r"), F.expr("cast(l_atoms * (l_atoms - 1) / 2 as decimal(38,0))"))
        .otherwise(F.expr("cast(l_atoms * r_atoms as decimal(38,0))"))
        .alias("edges"),
    ).where(F.col("edges") > 0)


def edge_counts(atoms: DataFrame, min_shared: int = 1) -> DataFrame:
    """Every kind of shared-tag edge with its exact number of edges."""
    sets = materialise(tag_set_sizes(atoms))
    narrow = sets.where(F.size("tag_set") <= _SUBSET_LIMIT)
    wide = sets.where(F.size("tag_set") > _SUBSET_LIMIT)
    counted = _narrow_counts(narrow).unionByName(_wide_counts(wide, sets))
    return (
        counted.where(_is_edge(F.col("shared"), min_shared))
        .groupBy("shared", "low_size", "high_size")
        .agg(F.sum("edges").cast(_COUNT).alias("edges"))
        .withColumns(_edge_columns(F.col("shared"), F.col("low_size"), F.col("high_size")))
        .select("relation", "low_size", "high_size", "weight", "confidence", "edges")
    )


def shared_tag_edges(nodes: DataFrame, min_shared: int = 1) -> DataFrame:
    """Listed edges among ``nodes``, which must be a bounded selection of atoms."""
    tagged = nodes.select("id", tag_set(F.col("tags")).alias("tag_set"))
    keyed = tagged.withColumn("tag", F.explode("tag_set"))
    left = keyed.select(F.col("id").alias("from_id"), F.col("tag_set").alias("left_tags"), "tag")
    right = keyed.select(F.col("id").alias("to_id"), F.col("tag_set").alias("right_tags"), "tag")
    pairs = (
        left.join(right, "tag")
        .where(F.col("from_id") < F.col("to_id"))
        .groupBy("from_id", "to_id", "left_tags", "right_tags")
        .agg(F.sort_array(F.collect_set("tag")).alias("shared"))
        .where(_is_edge(F.col("shared"), min_shared))
    )
    return pairs.withColumns(
        _edge_columns(F.col("shared"), F.size("left_tags"), F.size("right_tags"))
    ).select(
        "from_id",
        "to_id",
        "relation",
        "weight",
        "confidence",
        F.struct(
            F.lit("shared_tags").alias("type"),
            F.col("shared").alias("shared_tags"),
            "left_tags",
            "right_tags",
            F.lit("").alias("status"),
        ).alias("evidence"),
    )


def replace_shared_edges(edges: DataFrame, new_shared: DataFrame) -> DataFrame:
    """Swap the shared-tag edges of a table, keeping every other relation."""
    others = edges.where(~F.startswith(F.col("relation"), F.lit("shared_tags:")))
    return others.unionByName(new_shared, allowMissingColumns=True)


def graph_nodes(atoms: DataFrame, limit: int = 160) -> DataFrame:
    """The ``limit`` warmest atoms with their display state."""
    return (
        atoms.orderBy(
            F.desc("activation"), F.desc("importance"), F.desc(F.coalesce("timestamp", F.lit(""))), F.asc("id")
        )
        .limit(limit)
        .withColumn("state", scoring.activation_state(F.col("activation"), scoring.GRAPH_STATE))
    )


def _status() -> Column:
    """Status in an edge's evidence; empty without evidence."""
    return F.coalesce(F.col("evidence.status"), F.lit("")).alias("status")


def graph_edges(nodes: DataFrame, other_edges: DataFrame | None = None, min_shared: int = 1) -> DataFrame:
    """Edges with both ends among the graph nodes."""
    listed = shared_tag_edges(nodes, min_shared)
    if other_edges is not None:
        ids = nodes.select("id")
        inside = (
            other_edges.where(~F.startswith(F.col("relation"), F.lit("shared_tags:")))
            .join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
            .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        )
        listed = listed.select(
            "from_id", "to_id", "relation", "weight", "confidence", _status()
        ).unionByName(
            inside.select(
                "from_id", "to_id", "relation", "weight", "confidence", _status()
            )
        )
    else:
        listed = listed.withColumn("status", _status())
    return listed.withColumn("type", scoring.edge_type(F.col("relation")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, focus and latent counts."""
    focus, latent = scoring.GRAPH_STATE
    per_node = nodes.agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("activation") >= focus).alias("focus"),
        F.count_if(F.col("activation") <= latent).alias("latent"),
    )
    return per_node.select("nodes", edges.select(F.count("*")).scalar().alias("edges"), "focus", "latent")
