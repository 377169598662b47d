"""Connected components by contraction, with Spark's aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stage


def components(edges: DataFrame) -> DataFrame:
    """v, label: for every vertex of edges (u, v) the name of its component; names are vertices.

    Each round every vertex takes the least of itself and its neighbours, edges are renamed, and
    those within one name go. A vertex that is no local minimum disappears, so rounds are few. A hot
    vertex is only aggregated with a partial minimum, or joined as the skewed side. Joins never broadcast:
    all tables grow with the input.
    """
    with scratch():
        left = stage(edges.select("u", "v").where("u <> v").distinct(), "component-edges")
        names = left.select("u").union(left.select("v")).distinct().select(F.col("u").alias("v"), F.col("u").alias("label"))
        names = stage(names, "component-names")
        while not left.isEmpty():
            both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
            step = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("to")), "component-step")
            moved = names.join(step.hint("merge"), names["label"] == step["u"], "left").select("v", F.coalesce("to", "label").alias("label"))
            names = stage(moved, "component-names")
            first = left.join(step.hint("merge"), "u").select(F.col("to").alias("a"), F.col("v").alias("u"))
            second = first.join(step.hint("merge"), "u").select(F.least("a", "to").alias("u"), F.greatest("a", "to").alias("v"))
            left = stage(second.where("u <> v").distinct(), "component-edges")
        return stage(names, "components", outer=True)
