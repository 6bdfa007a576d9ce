"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import pin


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every end of a link ``a, b``; ``comp`` is the least node reachable.

    Every round, both a node and its present label hook to the least label next to them, then
    labels jump to their label's label, so long chains shrink by halves. Rounds are written tables
    in the shared folder. A hub's links meet in pre-aggregated minima, and joins have the unique
    labels on one side, so a hub does not land in one task.
    """
    ends = links.select("a", "b").where("a <> b")
    edges = pin(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = pin(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("comp").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("lb"))
        apart = pin(edges.join(of_a, "a").join(of_b, "b").where("lb < la").select("a", "la", "lb"), "apart")
        if apart.isEmpty():
            return labels
        hooks = apart.select(F.explode(F.array("a", "la")).alias("node"), F.col("lb").alias("comp"))
        hooked = pin(labels.union(hooks).groupBy("node").agg(F.min("comp").alias("comp")), "hooked")
        over = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        labels = pin(
            hooked.join(over, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp")),
            "labels",
        )


def extended(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``labels`` of ``components`` after further links, and what became of the old labels, as ``node, comp``.

    Only links between different labels take part, and they meet as links of the labels. A node
    that had no link yet counts as a label of its own.
    """
    of_a = labels.select(F.col("node").alias("a"), F.col("comp").alias("la"))
    of_b = labels.select(F.col("node").alias("b"), F.col("comp").alias("lb"))
    ends = links.join(of_b, "b", "left").join(of_a, "a", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(ends)
    over = moved.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    old = labels.join(over, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return pin(old.union(moved.join(labels, "node", "left_anti").select("node", "comp")), "labels"), moved
