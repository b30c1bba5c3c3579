"""Connected components of a graph given as a table of links, by hooking and pointer jumping.

Every round moves each node's label to the least label among its neighbours' and then to that label's own label, so the
number of rounds follows the logarithm of a component's length, not its size. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import drop_stage, stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b): the least node that it reaches."""
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        seen = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        hooked = seen.select("node", "to").union(seen.select(F.col("label").alias("node"), "to")).groupBy("node").agg(F.min("to").alias("to"))
        jumped = hooked.alias("x").join(hooked.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.least("to", "next").alias("label"))
        after = stage(jumped, "labels")
        moved = after.alias("x").join(labels.alias("y"), "node").where("x.label < y.label").limit(1).count()
        drop_stage(labels)
        labels = after
        if not moved:
            drop_stage(both)
            return labels.select("node", F.col("label").alias("component"))
