"""Ranking over symbols: BM25, edit similarity, vectors, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.runtime import stage

K1, B = 1.2, 0.75
RRF_K = 60
LOW_CONFIDENCE = 0.05
#: Rows that a list's ranking is dealt into ranges of; a range is ranked by one task.
RANK_RANGE = 100_000


def token_table(docs: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """key, token, tf, dl: the search index, made at ingest and reused by queries."""
    each = docs.select(key, T.tokens(text).alias("ts")).select(key, F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    return each.groupBy(key, "token", "dl").agg(F.count(F.lit(1)).alias("tf"))


def _is(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, text: Column, query: str, key: str = "id") -> DataFrame:
    """key, score for every document; 0 where nothing matches, no row at all for a query without tokens.

    Only the query's terms are counted: the documents are scanned once, and what is kept of each is a
    row of term counts, written because both totals and scores need it.
    """
    spark = docs.sparkSession
    words = [r.t for r in spark.range(1).select(F.explode(T.tokens(F.lit(query))).alias("t")).collect()]
    if not words:
        return spark.createDataFrame([], docs.select(key).schema.add("score", "double"))
    terms = sorted(set(words))
    ts = docs.select(key, T.tokens(text).alias("ts"))
    counted = stage(ts.select(key, F.size("ts").alias("dl"), *[F.size(F.filter("ts", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)]), "term-counts")
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))))
        score = score + words.count(t) * idf * weight
    return joined.select(key, score.alias("score"))


def fuzzy(docs: DataFrame, name: Column, query: str, key: str = "id") -> DataFrame:
    """key, score by edit similarity of the whole query and the name."""
    return docs.select(key, T.similarity(F.lit(query), name).alias("score"))


def semantic(docs: DataFrame, vector: Column, query_vector: Column, key: str = "id") -> DataFrame:
    """key, score by cosine, of documents that have a vector."""
    return docs.where(vector.isNotNull()).select(key, T.cosine(vector, query_vector).alias("score"))


def ranked(scores: DataFrame, key: str = "id") -> DataFrame:
    """key, rank from 1 by descending score, ties by key, without one task that sees all rows.

    Rows are dealt to ranges of (score, key) and counted; a row's rank is the count of the ranges
    before plus its place in its own. As the key is part of the range, a score that most rows share
    (0, most often) spreads over many ranges.
    """
    n = scores.count()
    if n <= RANK_RANGE:
        return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).select(key, "rank")
    parts = -(-n // RANK_RANGE)
    sorted_parts = stage(
        scores.select(key, "score").repartitionByRange(parts, F.desc("score"), F.col(key)).withColumn("part", F.spark_partition_id()), "ranked"
    )
    counts = sorted(sorted_parts.groupBy("part").count().collect())
    starts, at = [], 0
    for part, c in counts:
        starts.append((part, at))
        at += c
    offsets = F.broadcast(scores.sparkSession.createDataFrame(starts, "part int, before long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), key))
    return sorted_parts.withColumn("place", place).join(offsets, "part").select(key, (F.col("before") + F.col("place")).cast("int").alias("rank"))


def rrf(lists: list[DataFrame], key: str = "id", k: int = RRF_K) -> DataFrame:
    """key, score: the sum of 1 / (k + rank) over ranked lists that hold the key."""
    union = lists[0].select(key, "rank")
    for more in lists[1:]:
        union = union.unionByName(more.select(key, "rank"))
    return union.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def boosted(rows: DataFrame, query: str, score: Column) -> Column:
    """Score halved for tests, raised for methods and classes, and five-fold for an exact name."""
    q = query.strip().lower()
    exact = (F.lower("name") == q) | (F.lower("fqname") == q)
    return (
        score
        * F.when(F.col("is_test"), 0.5).otherwise(1.0)
        * F.when(F.col("kind").isin("method", "class"), 1.2).otherwise(1.0)
        * F.when(exact, 5.0).otherwise(1.0)
    )


def hybrid(symbols: DataFrame, query: str, k: int = 20, query_vector: Column | None = None) -> DataFrame:
    """The k best symbols with score and low_confidence.

    symbols: id, kind, name, fqname, is_test, and embedding where there are vectors. Ties go to the
    smaller id. low_confidence tells that even the best score is what lists without an exact name give.
    """
    lists = [ranked(bm25(symbols, F.concat_ws(" ", "name", "fqname"), query)), ranked(fuzzy(symbols, F.col("name"), query))]
    if query_vector is not None and "embedding" in symbols.columns:
        lists.append(ranked(semantic(symbols, F.col("embedding"), query_vector)))
    fused = symbols.join(rrf(lists).withColumnRenamed("score", "rrf"), "id")
    best = fused.withColumn("score", boosted(symbols, query, F.col("rrf"))).orderBy(F.desc("score"), "id").limit(k)
    top = F.max("score").over(Window.partitionBy(F.lit(0)))  # over k rows
    return best.withColumn("low_confidence", top < LOW_CONFIDENCE).drop("rrf")


def embedding_key(model: str, dim: int, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{model}|{dim}|"), F.coalesce(text, F.lit(""))))


def embedded(symbols: DataFrame, cache: DataFrame, text: Column, embed, model: str = "hash", dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """Symbols with vectors, and the cache with those that it lacked; ``embed`` maps a text column to a vector.

    Each different text is embedded once, and only if the cache lacks it.
    """
    keyed = symbols.withColumn("__text", text).withColumn("__key", embedding_key(model, dim, text))
    missing = keyed.select(F.col("__key").alias("key"), "__text").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    full = cache.unionByName(missing.select("key", embed(F.col("__text")).cast("array<float>").alias("embedding")))
    full = stage(full, "embeddings")
    return keyed.drop("embedding").join(full.withColumnRenamed("key", "__key"), "__key", "left").drop("__key", "__text"), full


def with_context(hits: DataFrame, in_community: DataFrame, communities: DataFrame, in_flow: DataFrame, most: int = 3) -> DataFrame:
    """Hits with their community label and up to ``most`` flows."""
    named = in_community.join(communities, F.col("dst_id") == F.col("id")).select(F.col("src_id").alias("id"), F.col("label").alias("community"))
    first = named.groupBy("id").agg(F.min("community").alias("community"))
    flows = in_flow.groupBy(F.col("src_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set(F.struct("depth", F.col("dst_id").alias("flow_id")))), 1, most).alias("flows"))
    return hits.join(first, "id", "left").join(flows, "id", "left")


def with_snippets(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits (file_id, line) with the lines around their declaration; sources: file_id, content as text."""
    return hits.join(sources, "file_id", "left").withColumn("snippet", T.snippet(F.col("content"), F.col("line"))).drop("content")


def resolve_ids(symbols: DataFrame, query: str, most: int = 50) -> DataFrame:
    """Ids that a query names: the id itself, name or qualified name, or a part of it; best kinds of match first."""
    q = query.lower()
    how = (
        F.when(F.col("id") == query, 0)
        .when(F.lower("name") == q, 1)
        .when(F.lower("fqname") == q, 2)
        .when(F.lower("fqname").contains(q), 3)
    )
    return symbols.withColumn("how", how).where("how is not null").orderBy("how", "id").limit(most).select("id", "how")


def find_symbol(classes: DataFrame, methods: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """kind, id, name, fqname, project_id of classes and methods that a query names, ``limit`` of each kind."""
    q = query.lower()
    c = classes.where((F.lower("name") == q) | (F.lower("fqname") == q) | F.lower("fqname").contains(q))
    m = methods.where((F.lower("name") == q) | F.lower("fqname").contains(q))
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "name", "fqname", "project_id").orderBy((F.lower("name") != q), "id").limit(limit)
    return pick(c, "class").unionByName(pick(m, "method"))
