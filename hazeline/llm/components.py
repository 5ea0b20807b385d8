"""Connected components of a graph of links, by rounds of least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of links (a, b).

    Each round a node takes the least label around it and then its label's label, so a chain of n links
    takes about log n rounds. Rounds are written to the shared folder; nothing but a count reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter(F.col("a") != F.col("b")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around, F.col("node") == F.col("a"), "left")
        lower = lower.select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = lower.select(F.col("node").alias("to"), F.col("label").alias("their"))
        jumped = lower.join(target, F.col("label") == F.col("to"), "left")
        jumped = jumped.select("node", "old", F.least("label", F.coalesce("their", "label")).alias("label"))
        after = stored(jumped, "labels")
        if not after.filter(F.col("label") != F.col("old")).limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")
