"""Connected components of a link table, by minimum labels and pointer jumping; nothing is collected but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that can be reached.

    Every round takes the least label among the neighbours and then the label of one's label,
    so that a chain's labels travel twice as far each time. A node with very many links is
    reduced by map-side minima, and the joins are ones that adaptive execution can split.
    Null ends, loops and repeated links change nothing; an empty table gives an empty one.
    """
    pairs = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a is not null and b is not null")
    both = materialize(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), f"{name}-0")
    before, turn = labels, 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = hooked.join(jump, "component").select("id", F.least("component", "next").alias("component"), (F.least("component", "next") != F.col("old")).alias("moved"))
        now = materialize(moved, f"{name}-{turn}")
        discard(before)
        before, labels = now, now.select("id", "component")
        if now.where("moved").isEmpty():
            discard(both)
            return labels
