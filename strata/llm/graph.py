"""Connected components of a link table by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable) for every node of `links`. Each round is a staged table;
    the driver sees one count a round."""
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = staged(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        seen = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
        hooked = labels.join(seen, F.col("node") == F.col("u")).select("node", "label", F.least("label", "least").alias("next"))
        # Hooking a label's own node brings whole trees together, not one node at a time.
        roots = hooked.groupBy("label").agg(F.min("next").alias("root")).withColumnRenamed("label", "r")
        jumped = hooked.join(roots, F.col("next") == F.col("r"), "left").select("node", "label", F.least("next", F.coalesce("root", "next")).alias("next"))
        after = staged(jumped, "labels")
        moved = after.filter("next <> label").limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not moved:
            return labels.withColumnRenamed("label", "component")
