"""Connected components by joins: labels go along links and jump to the labels of their labels, until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of links (a, b) reaches. Links may repeat; an empty table gives none."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        # A label is itself a vertex with a label; the smaller one is taken from a map of labels, which has each label once.
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        jumped = labels.join(near, "v", "left").join(up, "label", "left")
        new = stored(jumped.select("v", F.least("label", "near", "up").alias("label"), F.col("label").alias("was")), "labels")
        moved = new.where("label <> was").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            out = labels.select("v", "label")
            out._netloom_path = labels._netloom_path  # for discard()
            return out
