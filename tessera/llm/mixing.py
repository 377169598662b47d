"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. Tokens are summed by source and hash bucket; the bucket in
which a source's running sum crosses its budget is the boundary bucket, and only that one is
divided again, until it is a single hash value. A document is taken when its hash lies below the
threshold found, so nothing is sorted and larger budgets take supersets of smaller ones.

The driver holds a few numbers for each source, as targets depend on all of them; documents never
reach it. Tables of sources are broadcast up to BROADCAST_SOURCES rows, and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, stage, words_in

#: Weights of sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: Times that a source may be repeated at most.
REPEATS = 2.0
#: Bits of the hash that each histogram looks at, and the number of histograms.
BITS, LEVELS = 12, 5
SPACE = BITS * LEVELS
#: Sources up to this number are broadcast with their thresholds; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def targets(sizes: list[int], share: float = SHARE, repeats: float = REPEATS, weights=WEIGHTS) -> list[float]:
    """Words for each source: in proportion to weight, stopped at ``repeats`` times its size, the excess dealt again."""
    open_, out = [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    left = share * sum(sizes)
    while open_:
        per = left / sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if per * weights[i % len(weights)] > repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = per * weights[i % len(weights)]
            break
        for i in over:
            out[i] = repeats * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def by_source(table: DataFrame, sources: int, outer: bool = False) -> DataFrame:
    """A table with a row for each source, cut from its lineage, to be joined as its size allows."""
    if sources <= BROADCAST_SOURCES:
        return F.broadcast(table.sparkSession.createDataFrame(table.collect(), table.schema))
    return stage(table, "mix-sources", outer).hint("merge")


def thresholds(slim: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """source, threshold: hashes below it hold the budget as nearly as one hash value allows.

    One histogram per level over the boundary buckets alone; a source has 2**BITS sums in each at most.
    """
    edge = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("low"))
    for level in range(LEVELS):
        shift = SPACE - BITS * (level + 1)
        inside = slim.withColumnRenamed("source", "s").join(by_source(edge, sources), F.col("s").eqNullSafe(F.col("source")))
        if level:
            inside = inside.where(F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS))
        sums = inside.groupBy("source", "left", "low", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = sums.withColumn("through", F.expr("sum(words) over (partition by source order by bucket)"))
        # the boundary is the first bucket whose running sum passes the budget; a budget is less than its source's words
        found = run.where(F.col("through") > F.col("left")).groupBy("source", "left").agg(F.min(F.struct("bucket", "through", "words")).alias("at"))
        edge = found.select("source", (F.col("left") - (F.col("at.through") - F.col("at.words"))).alias("left"), F.shiftleft(F.col("at.bucket"), shift).alias("low"))
    # the last boundary holds one hash value, whose words are the bucket's; it is taken if that comes nearer to the budget
    edge = found.select("source", "left", F.col("at.bucket").alias("low"), F.col("at.words").alias("words"), (F.col("left") - (F.col("at.through") - F.col("at.words"))).alias("rest"))
    return edge.select("source", F.when(F.col("words") < 2 * F.col("rest"), F.col("low") + 1).otherwise(F.col("low")).alias("threshold"))


def hash_of() -> Column:
    """A document's fixed hash of SPACE bits, from its id and text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))), 1, SPACE // 4), 16, 10).cast("long")


def source_of(docs: DataFrame) -> Column:
    """A document's source; null for all where the table has none."""
    return (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string")


def slim_of(docs: DataFrame) -> DataFrame:
    return stage(docs.select("doc_id", source_of(docs).alias("source"), words_in(F.col("text")).alias("size"), hash_of().alias("h")), "mix-sizes")


def plan(slim: DataFrame, share: float = SHARE, repeats: float = REPEATS, weights=WEIGHTS) -> DataFrame:
    """mix_source, source_size, target, whole, threshold: a source is taken ``whole`` times, and once more below the threshold."""
    spark = slim.sparkSession
    sums = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()  # a row for each source
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    want = targets([r.n for r in sums], share, repeats, weights)
    rows = []
    for r, t in zip(sums, want, strict=True):
        whole = min(int(t // r.n), int(repeats)) if r.n else 0
        rows.append((r.source, r.n, t, whole, float(t - whole * r.n)))
    sources = spark.createDataFrame(rows, "source string, source_size long, target double, whole int, budget double")
    cut = thresholds(slim, sources.select("source", "budget"), len(rows))
    both = sources.alias("a").join(cut.alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    return by_source(both.select(F.col("a.source").alias("mix_source"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0).cast("long")).alias("threshold")), len(rows), outer=True)


def copies(repeats: float = REPEATS) -> Column:
    """Times that a row with a plan's columns and its hash ``h`` is taken."""
    return F.least(F.col("whole") + (F.col("h") < F.col("threshold")).cast("int"), F.lit(int(repeats)))


def mix(docs: DataFrame, share: float = SHARE, repeats: float = REPEATS, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row.

    A null text has no words; a null source is a source of its own, after all others. Rows with equal
    id and text have one hash, so they are taken alike. Sources without words have target 0. An empty
    table gives an empty result. ``taken`` is a whole number of times the document's size.
    """
    slim = slim_of(docs)
    joined = slim.join(plan(slim, share, repeats, weights), F.col("source").eqNullSafe(F.col("mix_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(repeats)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, share: float = SHARE, repeats: float = REPEATS, weights=WEIGHTS) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    with scratch():
        found = plan(slim_of(docs), share, repeats, weights)
    table = found.select(F.struct("whole", "threshold").alias("__plan"), F.col("mix_source").alias("__source"))
    joined = docs.withColumn("__h", hash_of()).join(table, source_of(docs).eqNullSafe(F.col("__source")))
    times = F.least(F.col("__plan.whole") + (F.col("__h") < F.col("__plan.threshold")).cast("int"), F.lit(int(repeats)))
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(0), times))).where("__n > 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_hash_threshold_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with recursive doc as (
  select doc_id, cast(source as varchar) as source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents
), src as (
  select source, n, cast([5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as w
  from (select source, cast(sum(size) as bigint) as n from doc group by source)
), rounds as (
  select 0 as r, source, n, w, cast(null as double) as fixed, 1.5 * sum(cast(n as double)) over () as rest from src where n > 0
  union all
  select r + 1, source, n, w, case when over_ then 2.0 * n else fixed end, rest - sum(case when over_ then 2.0 * n else 0 end) over ()
  from (select *, fixed is null and per * w > 2.0 * n as over_, bool_or(fixed is null and per * w > 2.0 * n) over () as again
        from (select *, rest / sum(case when fixed is null then w end) over () as per from rounds))
  where again
), last as (
  select source, n, coalesce(fixed, rest / sum(case when fixed is null then w end) over () * w) as target from rounds where r = (select max(r) from rounds)
), goal as (
  select source, src.n, coalesce(target, 0.0) as target, case when src.n > 0 then least(floor(target / src.n), 2) else 0 end as whole
  from src left join (select source as s, target from last) l on src.source is not distinct from l.s
), cum as (
  select source, h, sum(size) over (partition by source order by h) as through, sum(size) over (partition by source, h) as words from doc
), edge as (
  select cum.source, min(cum.h) as h, arg_min(through - words, cum.h) as before, arg_min(words, cum.h) as words, any_value(target - whole * n) as budget
  from cum join goal on cum.source is not distinct from goal.source where through > target - whole * n group by cum.source
), cut as (select source, case when words < 2 * (budget - before) then h + 1 else h end as threshold from edge)
select doc_id, cast(size as bigint) as size, n as source_size, target, cast(size * least(whole + (case when h < coalesce(threshold, 0) then 1 else 0 end), 2) as bigint) as taken
from doc join goal on doc.source is not distinct from goal.source left join cut on doc.source is not distinct from cut.source
"""
