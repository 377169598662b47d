"""Files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRENGTH, COCHANGES, MONTHS = 0.3, 3, 6


def co_changes(members: DataFrame, most_members: int | None = None) -> DataFrame:
    """a, b, n_ab, n_a, n_b, strength for each pair a < b of one change set or more.

    members: change, item. A pair needs ``n`` changes of both, so items are counted first, and with
    thresholds in mind callers drop rare items before the pairing (see :func:`coupled`). A change set
    of n items has n**2 / 2 pairs; ``most_members`` leaves out larger ones, by default none.
    """
    each = members.select("change", "item").distinct()
    if most_members is not None:
        sizes = each.groupBy("change").count().where(F.col("count") <= most_members).select("change")
        each = each.join(sizes, "change", "left_semi")
    counts = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return _paired(each, counts)


def _paired(each: DataFrame, counts: DataFrame) -> DataFrame:
    pairs = each.withColumnRenamed("item", "a").join(each.withColumnRenamed("item", "b"), "change").where("a < b")
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    out = both.join(counts.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "n_ab", "n_a", "n_b", (F.col("n_ab") / F.greatest("n_a", "n_b", F.lit(1))).alias("strength"))


def coupled(members: DataFrame, strength: float = STRENGTH, cochanges: int = COCHANGES) -> DataFrame:
    """Pairs over both thresholds. Items with fewer changes than ``cochanges`` can't pass and aren't paired."""
    each = members.select("change", "item").distinct()
    counts = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    frequent = each.join(counts.where(F.col("n") >= cochanges).select("item"), "item", "left_semi")
    return _paired(frequent, counts).where((F.col("strength") >= strength) & (F.col("n_ab") >= cochanges))


def coupling_edges(pairs: DataFrame, months: int = MONTHS) -> DataFrame:
    """Rows of co_changed_with; the caller maps items to file ids first."""
    return pairs.select(F.col("a").cast("string").alias("src_id"), F.col("b").cast("string").alias("dst_id"), "strength", F.col("n_ab").alias("cochanges"), F.lit(months).cast("bigint").alias("months"))


def get_coupling(edges: DataFrame, item: str | None = None, min_strength: float = STRENGTH, min_cochanges: int = COCHANGES, limit: int = 200) -> DataFrame:
    """Pairs seen from either end, best first; all thresholds hold whether or not an item is named."""
    columns = ["strength", "cochanges", "months"]
    both = edges.select("src_id", "dst_id", *columns).unionByName(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), *columns))
    found = both.where((F.col("strength") >= min_strength) & (F.col("cochanges") >= min_cochanges))
    found = found.where(F.col("src_id").contains(item)) if item is not None else found
    return found.orderBy(F.desc("strength"), F.desc("cochanges"), "src_id", "dst_id").limit(limit)


def change_sets(lines: DataFrame, marker: str = "commit ") -> DataFrame:
    """change, item: of a log of numbered lines (log, line_no, line), a marker line opening each change set.

    The running count of markers numbers the change sets within a log.
    """
    mark = F.col("line").startswith(marker)
    numbered = lines.withColumn("change", F.expr(f"sum(int(startswith(line, '{marker}'))) over (partition by log order by line_no)"))
    return numbered.where(~mark & (F.trim("line") != "") & (F.col("change") > 0)).select(F.concat_ws(":", "log", "change").alias("change"), F.trim("line").alias("item")).distinct()
