"""Story resolution: items that share an identity key are one story."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, settled


def key_components(keys: DataFrame, item: str = "item", key: str = "key", rounds: int = 100) -> DataFrame:
    """(item, component): the smallest item that shared keys reach.

    Labels run over the bipartite graph of items and keys: a key takes the least label of its items, an item the least of its keys and of the item
    that its label names (pointer jumping, so long chains shorten twofold). A key of any number of items is a grouped minimum, never a list.
    """
    edges = settled(keys.select(item, key).distinct(), "edges")
    labels = settled(edges.groupBy(item).agg(F.min(item).alias("component")), "labels")
    for _ in range(rounds):
        by_key = edges.join(labels, item).groupBy(key).agg(F.min("component").alias("component"))
        low = edges.join(by_key, key).groupBy(item).agg(F.min("component").alias("low"))
        jump = low.join(labels.select(F.col(item).alias("low"), F.col("component").alias("jump")), "low", "left")
        new = jump.select(item, F.least("low", "jump").alias("component"))
        new = settled(new.join(labels.select(item, F.col("component").alias("was")), item), "labels")
        moved = not new.where("component <> was").isEmpty()
        discard(labels)
        labels = new
        if not moved:
            discard(edges)
            return labels.drop("was")
    raise RuntimeError("the components did not settle")
