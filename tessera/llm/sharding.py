"""Sharding by best-fit-decreasing bin packing.

Indivisible groups, sorted by size, enter the bin with the tightest remaining capacity, which a
balanced tree finds. Every group passes through it, however many there are: Spark counts groups by
size, and the packer places runs of equal sizes, each as its members one by one would go. A run goes
into the tightest bin that holds its size until that holds no more, then into the next. Sizes are
compared to BITS leading bits, rounded up, so that their number, and the plan's, is bounded at any
input size. Members of a size are then numbered by counted ranges and take their bins in that order.

Cases: a null text counts as an empty one; rows of equal text form one group and share a shard;
equal rows get different slots; very long texts are groups like others, and one over the mean of a
bin gets a bin of its own; ids may be null or repeated; other columns are ignored, or kept where
asked for, whatever their names; an empty table gives an empty result. A 64-bit hash names a group:
two texts that share one share a shard, which breaks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, stage

#: Leading bits of a size that count: below 2**BITS sizes are exact, above they differ by 1/2**(BITS - 1) at most.
BITS = 12
#: Groups, or rows, that one range numbers at most, about.
RANGE_ROWS = 20_000


class RemainingTree:
    """A treap of (remaining capacity, bin) with the successor search that best fit needs.

    Priorities come from a fixed multiplicative generator, so that runs agree.
    """

    def __init__(self) -> None:
        self.root = None
        self.seed = 0x9E3779B97F4A7C15

    def _priority(self) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % 2**64
        return self.seed >> 16

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._priority()]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin that still holds size; the lower bin number wins ties."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            left, rest = self._split(self.root, best)
            _, right = self._split(rest, (best[0], best[1] + 1))
            self.root = self._merge(left, right)
        return best


#: Of each size, the bins that its groups enter, in order: (bin, number of groups).
Plan = dict[int, list[tuple[int, int]]]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> Plan | None:
    """Bins of ``sizes`` (size, number of groups), or None if more than ``most`` bins were needed.

    Groups over the capacity get a bin each. Equal groups that follow one another enter one bin until
    it is full, as it stays the tightest; so a run is placed at once.
    """
    tree, plan, opened = RemainingTree(), {}, 0
    for size, n in sorted(sizes, reverse=True):
        runs = plan.setdefault(size, [])
        while n:
            found = tree.take(size)
            if found is None:
                if most is not None and opened == most:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            k = min(n, found[0] // size)
            runs.append((found[1], k))
            tree.add((found[0] - k * size, found[1]))
            n -= k
    return plan


def least_capacity(sizes: list[tuple[int, int]], bins: int) -> int:
    """The smallest capacity, to 1/10,000, at which a search by halves finds that ``bins`` bins suffice."""
    low = high = max(max(s for s, _ in sizes), -(-sum(s * n for s, n in sizes) // bins))
    while best_fit_decreasing(sizes, high, bins) is None:
        low, high = high + 1, high + max(1, high // 64)
    while high - low > max(1, low // 10_000):
        middle = (low + high) // 2
        low, high = (low, middle) if best_fit_decreasing(sizes, middle, bins) is not None else (middle, high)
    return high


def pack_into(sizes: list[tuple[int, int]], bins: int) -> Plan:
    """The plan of the fixed capacity that makes best-fit-decreasing fill no more than ``bins`` bins.

    A group over the mean of what is left gets a bin of its own first, so that one huge group doesn't
    set the capacity of all others.
    """
    plan, first, left = {}, 0, dict(sizes)
    total = sum(s * n for s, n in sizes)
    while left and bins - first > 1 and max(left) * (bins - first) > total:
        size = max(left)
        plan.setdefault(size, []).append((first, 1))
        left[size] -= 1
        left = {s: n for s, n in left.items() if n}
        first, total = first + 1, total - size
    if left:
        rest = list(left.items())
        for size, runs in best_fit_decreasing(rest, least_capacity(rest, bins - first)).items():
            plan.setdefault(size, []).extend((first + b, k) for b, k in runs)
    return plan


def rounded(size: Column) -> Column:
    """A size, rounded up to BITS leading bits."""
    drop = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return (F.ceil(size / unit) * unit).cast("long")


def numbered(rows: DataFrame, by: str, order: list[str], ranges: Column, out: str, slim: DataFrame | None = None) -> DataFrame:
    """Rows numbered from 0 without gaps for each value of ``by``, as column ``out``.

    Ranges of about RANGE_ROWS rows, by a hash of the ``order`` columns, are counted first (over
    ``slim``, if given, which has the same rows with fewer columns); a value with very many rows
    spreads over its ranges. ``ranges``: how many a value has.
    """
    named = lambda df: df.withColumn("__range", F.pmod(F.xxhash64(*order, F.lit(out)), ranges).cast("int"))
    counts = named(slim if slim is not None else rows).groupBy(by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = f"coalesce(sum(__n) over (partition by {by} order by __range rows between unbounded preceding and 1 preceding), 0)"
    starts = stage(counts.select(by, "__range", F.expr(before).alias("__start")), "range-starts")
    nth = F.expr(f"row_number() over (partition by {by}, __range order by {', '.join(order)})")
    joined = named(rows).withColumn("__nth", nth).join(bounded(starts), [by, "__range"])
    return joined.withColumn(out, F.col("__start") + F.col("__nth") - 1).drop("__range", "__start", "__nth")


def placed(slim: DataFrame, bins: int) -> DataFrame:
    """group_key, shard, staged: every group's bin."""
    spark = slim.sparkSession
    groups = slim.groupBy("group_key").agg(F.sum("size").alias("s")).select("group_key", rounded(F.col("s")).alias("class"))
    groups = stage(groups, "shard-groups")
    counts = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]  # 2**BITS for each doubling of the size, at most
    rows = []
    for size, runs in pack_into(counts, bins).items():
        ends, at = [], 0
        for b, k in runs:
            at += k
            ends.append((at, b))
        rows.append((size, -(-at // RANGE_ROWS), ends))
    # a row for each size; a size enters each bin once at most
    plan = F.broadcast(spark.createDataFrame(rows, "class long, ranges int, ends array<struct<upto: long, shard: int>>"))
    members = numbered(groups.join(plan.select("class", "ranges"), "class"), "class", ["group_key"], F.col("ranges"), "nth")
    shard = F.element_at(F.filter("ends", lambda e: F.col("nth") < e["upto"]), 1)["shard"]
    return stage(members.join(plan.select("class", "ends"), "class").select("group_key", shard.alias("shard")), "group-shards")


def shards(docs: DataFrame, bins: int, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot and grown_shard for every row; with ``keep`` the
    row's other columns first, but for those whose names these take."""
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    others = [c for c in docs.columns if c.lower() not in (*own, "doc_id")] if keep else []
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("group_key"),
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("__others")] if others else []),
    )
    slim = stage(rows.select("doc_id", "size", "text_crc32", "group_key"), "shard-sizes")
    where = placed(slim, bins)
    small = stage(slim.join(bounded(where), "group_key"), "shard-rows")
    ranges = F.lit(max(1, -(-small.count() // RANGE_ROWS)))
    # slots are counted over sizes alone; the rows themselves move once, when they are numbered
    out = numbered(rows.join(bounded(where), "group_key") if others else small, "shard", ["doc_id", "text_crc32", "size", "group_key"], ranges, "slot", small)
    return out.select(
        *[F.col(f"__others.c{i}").alias(c) for i, c in enumerate(others)], "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op5_best_fit_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
