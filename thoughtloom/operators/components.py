"""Connected components of the tag graph and their anchors.

Atoms connect only through tags, so components are computed on the tag
vocabulary: each distinct tag set contributes a star of edges, the graph is
contracted round by round (every tag hooks onto its smallest neighbour), and
the atom table is joined once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thoughtloom.operators.edges import UNTAGGED
from thoughtloom.session import materialise


def groupable_tags(tags: Column, kind: Column) -> Column:
    """Sorted distinct tags without the placeholder; untagged atoms use their kind."""
    real = F.sort_array(F.array_distinct(F.filter(tags, lambda tag: tag != UNTAGGED)))
    return F.when(F.size(real) > 0, real).otherwise(F.array(kind))


def _contract(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: hook every tag on its smallest neighbour, jump once, contract."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hooked = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("parent"))
    above = hooked.select(F.col("u").alias("parent"), F.col("parent").alias("grand"))
    parents = materialise(
        hooked.join(above, "parent", "left").select("u", F.coalesce("grand", "parent").alias("parent"))
    )
    relabelled = labels.join(parents.withColumnRenamed("u", "component"), "component", "left").select(
        "tag", F.coalesce("parent", "component").alias("component")
    )
    left = parents.select("u", F.col("parent").alias("pu"))
    right = parents.select(F.col("u").alias("v"), F.col("parent").alias("pv"))
    contracted = (
        edges.join(left, "u")
        .join(right, "v")
        .where(F.col("pu") != F.col("pv"))
        .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        .distinct()
    )
    return materialise(contracted), relabelled


def tag_components(atoms: DataFrame) -> DataFrame:
    """(tag, component) for every groupable tag; the label is the smallest tag."""
    sets = materialise(
        atoms.select(groupable_tags(F.col("tags"), F.col("kind")).alias("tags")).distinct()
    )
    labels = sets.select(F.explode("tags").alias("tag")).distinct().withColumn("component", F.col("tag"))
    edges = sets.where(F.size("tags") > 1).select(
        F.element_at("tags", 1).alias("u"), F.explode(F.slice("tags", 2, 2147483647)).alias("v")
    ).distinct()
    while not edges.isEmpty():
        edges, labels = _contract(edges, labels)
    return materialise(labels)


def with_component(atoms: DataFrame, components: DataFrame) -> DataFrame:
    """Attach the component of each atom through its first groupable tag."""
    keyed = atoms.withColumn("tag", F.element_at(groupable_tags(F.col("tags"), F.col("kind")), 1))
    return keyed.join(components, "tag").drop("tag")


def tag_frequencies(atoms: DataFrame) -> DataFrame:
    return (
        atoms.select(F.explode(groupable_tags(F.col("tags"), F.col("kind"))).alias("tag"))
        .groupBy("tag")
        .agg(F.count("*").alias("n"))
    )


def component_anchor(atoms: DataFrame, components: DataFrame) -> DataFrame:
    """Most frequent groupable tag of each component, ties alphabetical."""
    return (
        tag_frequencies(atoms)
        .join(components, "tag")
        .groupBy("component")
        .agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("tag"))).alias("best"))
        .select("component", F.col("best.tag").alias("anchor"), (-F.col("best.rank")).alias("anchor_atoms"))
    )
