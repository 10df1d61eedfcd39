"""Connected components of a table of links, as repeated Spark joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (id, label) for every id in ``links`` (a, b): label is the smallest id that can be reached.

    Each round takes the smallest label among an id's neighbours (an aggregate that combines before the shuffle) and then
    jumps to the label's own label, so a chain shortens by half or more in a round. The tables of a round are written to
    the shared folder: the joins read plain tables on both sides, so adaptive execution can split a hot id, and a lost
    executor costs one round at most. Links may repeat; ids without links give no row.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), slim=True)
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), slim=True)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = written(lower, slim=True)
        # every label is itself an id, for only linked ids are ever labels
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("next")).filter("label <> next")
        following = written(lower.join(jump, "label", "left").select("id", "was", F.coalesce("next", "label").alias("label")), slim=True)
        labels = following.select("id", "label")
        if following.filter("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
