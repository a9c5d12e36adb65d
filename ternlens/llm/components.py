"""Connected components of a growing link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternlens.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); label is the component's smallest node.

    Each round hooks every node to the least label about it and halves the paths to the
    labels; aggregations combine before the shuffle, so a node with very many links isn't
    gathered anywhere.  Rounds are staged: a lost executor costs one round's tasks.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links", slim=True)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    labels = staged(labels, "labels", slim=True)
    while True:
        around = (both.join(labels.withColumnRenamed("node", "b"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        hooked = staged(labels.join(around, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "hooked", slim=True)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = staged(hooked.join(up, "label").select("node", F.col("higher").alias("label"), "was"), "labels", slim=True)
        changed = new.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``links``: only the links between components are worked on."""
    if labels is None:
        return components(links)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    between = (links.join(of("a"), "a", "left").join(of("b"), "b", "left")
               .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b").distinct())
    roots = components(between)
    moved = roots.select(F.col("node").alias("label"), F.col("label").alias("root"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    fresh = roots.join(labels.select("node"), "node", "left_anti")
    return staged(old.union(fresh), "labels", slim=True)
