"""Benchmark decontamination over a distributed positional inverted index.

The index holds, for each document, its term sequence as 64-bit hashes: the posting list of a term
is read from it as (document, position) rows. Corpus counts of the test terms tell which term of
each test window is rarest. Only the postings of those anchors are taken as candidates; each list is
moved by the term's offset, and the window's other terms are intersected in order of rarity, so that
nearly all candidates end at the second one. Only DataFrame functions are used.

Windows are broadcast in blocks of at most BLOCK anchor terms, one pass over the index for each
block, so that no broadcast grows with the benchmark.

Cases: null or empty texts have no words and are clean; items without words never match; a null
item_id counts as the id 'null'; rows with equal id and text get equal results; several rows of one
item_id count as one item; very long texts are one row of the index, never one task's group; other
columns are ignored; empty tables give an empty or an all-clean result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, documents, scratch, stage

WINDOW = 10
#: What separates the words of a lower-cased text; splitting costs a seventh of extracting matches.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Anchor terms that are looked for in one pass over the index; their windows are broadcast with them.
BLOCK = 20_000
#: Proximity: so many of a window's different terms within so many words around one of them.
NEAR_TERMS, NEAR_REACH = 8, 15


def terms(text: Column) -> Column:
    """Hashes of a text's words in order; none for null."""
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def build_index(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, terms: the stored positional postings, by document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), terms(F.col("text")).alias("terms"))
    return stage(rows.select("doc_id", "text_key", F.size("terms").cast("long").alias("n_words"), "terms"), "postings")


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, start, terms: each run of ``window`` words of an item, or all words of a shorter one."""
    each = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    each = each.withColumn("len", F.least(F.size("t"), F.lit(window)))
    starts = each.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("len"))))
    return starts.select("item", "start", F.slice("t", F.col("start") + 1, F.col("len")).alias("terms"))


def in_blocks(table: DataFrame, key: str, most: int = BLOCK) -> list[DataFrame]:
    """Parts of a staged table of at most about ``most`` different keys each, by a hash of the key."""
    parts = -(-table.select(key).distinct().count() // most)
    return [table] if parts <= 1 else [table.where(F.pmod(F.xxhash64(key), F.lit(2 * parts)) == i) for i in range(2 * parts)]


def term_counts(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, n: occurrences in the index of the terms of the staged vocabulary that it has at all."""
    posted = index.select(F.explode("terms").alias("term"))
    parts = [posted.join(F.broadcast(v), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for v in in_blocks(vocabulary, "term", 100 * BLOCK)]
    return reduce(DataFrame.unionByName, parts)


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """anchor, item, at, len, rest: windows all of whose terms occur, by rarest term.

    A window is told apart by its terms, as rows of one item may differ in text. ``at`` is the anchor's offset in the window; ``rest`` has the other terms with their offsets from
    the anchor, rarest first. Ties go to the smaller offset.
    """
    each = windows.select("item", "terms", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "term"))
    known = each.join(counts, "term").groupBy("item", "terms", "len")
    ordered = known.agg(F.array_sort(F.collect_set(F.struct("n", "offset", "term"))).alias("by_count")).where(F.size("by_count") == F.col("len"))
    first = F.element_at("by_count", 1)
    rest = F.transform(F.slice("by_count", 2, F.col("len")), lambda x: F.struct((x["offset"] - first["offset"]).alias("shift"), x["term"].alias("term")))
    return ordered.select(first["term"].alias("anchor"), "item", first["offset"].alias("at"), "len", rest.alias("rest")).distinct()


def candidates(index: DataFrame, block: DataFrame, reach: int) -> DataFrame:
    """doc_id, text_key, pos, low, around, and the window's columns: postings of the block's anchors.

    ``around`` has the terms within ``reach`` words, from position ``low`` on. Positions are picked
    inside the row, so that its terms aren't copied for each of them.
    """
    wanted = [r.anchor for r in block.select("anchor").distinct().collect()]  # BLOCK numbers at most
    at = F.filter(F.transform("terms", lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
    low = lambda i: F.greatest(i - reach, F.lit(0))
    near = F.transform(at, lambda i: F.struct(i.alias("pos"), F.get("terms", i).alias("anchor"), low(i).alias("low"), F.slice("terms", low(i) + 1, F.lit(2 * reach + 1)).alias("around")))
    return index.select("doc_id", "text_key", F.explode(near).alias("x")).select("doc_id", "text_key", "x.*").join(F.broadcast(block), "anchor")


def phrase_matches(index: DataFrame, anchors: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, item, first, after: every exact occurrence of a test window, end exclusive."""
    same = F.forall("rest", lambda r: F.coalesce(F.get("around", F.col("pos") - F.col("low") + r["shift"]) == r["term"], F.lit(False)))
    first = F.col("pos") - F.col("at")
    parts = [
        candidates(index, b, window - 1).where((first >= 0) & same).select("doc_id", "text_key", "item", first.alias("first"), (first + F.col("len")).alias("after"))
        for b in in_blocks(anchors, "anchor")
    ]
    return reduce(DataFrame.unionByName, parts)


def near_anchored(windows: DataFrame, counts: DataFrame, need: int = NEAR_TERMS) -> DataFrame:
    """anchor, item, at, len, rest: windows of which ``need`` different terms occur, by each of their rarest terms.

    So many of the rarest are anchors that any ``need`` of a window's terms include one of them. Shifts are unused.
    """
    each = windows.select("item", "terms").distinct().withColumn("term", F.explode(F.array_distinct("terms")))
    known = each.join(counts, "term").groupBy("item", "terms").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("by_count"))
    anchors = F.explode(F.slice("by_count", F.lit(1), F.size("by_count") - need + 1)).alias("first")
    each = known.where(F.size("by_count") >= need).select("item", F.size("terms").alias("len"), "by_count", anchors)
    others = F.filter("by_count", lambda x: x["term"] != F.col("first.term"))
    rest = F.transform(others, lambda x: F.struct(F.lit(0).alias("shift"), x["term"].alias("term")))
    return each.select(F.col("first.term").alias("anchor"), "item", F.lit(0).alias("at"), "len", rest.alias("rest"))


def proximity_matches(index: DataFrame, anchors: DataFrame, need: int = NEAR_TERMS, reach: int = NEAR_REACH) -> DataFrame:
    """doc_id, text_key, item, pos: anchors that take part in a match, which is an occurrence of any term
    of a window with at least ``need`` different terms of that window within ``reach`` words of it."""
    own = F.concat(F.array("anchor"), F.transform("rest", lambda r: r["term"]))
    shared = lambda words: F.size(F.array_intersect(words, own))
    here = (F.col("pos") - F.col("low")).cast("int")
    around = lambda c: F.slice("around", F.greatest(c - reach, F.lit(0)) + 1, F.least(c, F.lit(reach)) + reach + 1)
    centres = F.sequence(F.greatest(here - reach, F.lit(0)), F.least(here + reach, F.size("around") - 1))
    close = F.exists(centres, lambda c: F.array_contains(own, F.get("around", c)) & (shared(around(c)) >= need))
    parts = [candidates(index, b, 2 * reach).where(shared(F.col("around")) >= need).where(close).select("doc_id", "text_key", "item", "pos") for b in in_blocks(anchors, "anchor")]
    return reduce(DataFrame.unionByName, parts)


def test_terms(index: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The windows of a test set, and how often each of their terms occurs."""
    windows = stage(test_windows(items, window), "test-windows")
    vocabulary = stage(windows.select(F.explode("terms").alias("term")).distinct(), "test-terms")
    return windows, stage(term_counts(index, vocabulary), "test-term-counts")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The index, and its exact matches with a test set."""
    index = build_index(docs)
    anchors = stage(anchored(*test_terms(index, items, window)), "test-anchors")
    return index, phrase_matches(index, anchors, window)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items, near_items (sorted strings) of every row, staged; the index is dropped.

    ``items`` have exact matches, ``near_items`` proximity matches; both are read from one index.
    """
    with scratch():
        index = build_index(docs)
        windows, counts = test_terms(index, items, window)
        exact = _hits(phrase_matches(index, stage(anchored(windows, counts), "test-anchors"), window))
        near = proximity_matches(index, stage(near_anchored(windows, counts), "test-near-anchors"))
        near = near.groupBy(F.col("doc_id").alias("n_doc"), F.col("text_key").alias("n_key")).agg(F.array_sort(F.collect_set("item")).alias("near_items"))
        rows = index.select("doc_id", "text_key", "n_words")
        for hits, doc, key in ((exact, "h_doc", "h_key"), (near, "n_doc", "n_key")):
            hits = bounded(stage(hits, "test-hits"))
            rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("text_key") == F.col(key)), "left")
        none = F.array().cast("array<string>")
        return stage(
            rows.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")),
            "contamination", outer=True,
        )


def _hits(found: DataFrame) -> DataFrame:
    """h_doc, h_key, n_hit, items of documents with exact matches."""
    # the union of a document's hit ranges: what each adds beyond the furthest end before it
    before = F.expr("max(after) over (partition by doc_id, text_key order by first, after rows between unbounded preceding and 1 preceding)")
    added = F.greatest(F.lit(0), F.col("after") - F.greatest(F.col("first"), F.coalesce(before, F.lit(0))))
    # rows with equal id and text are all matched: each of them has added the same ranges, of which the union is kept
    return found.withColumn("added", added).groupBy(F.col("doc_id").alias("h_doc"), F.col("text_key").alias("h_key")).agg(F.sum("added").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any occurrence of a test window, columns unchanged."""
    with scratch():
        _, found = matches(docs, items, window)
        dirty = stage(found.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct(), "contaminated", outer=True)
    same = docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(bounded(dirty), same, "left_anti")


def op1_positional_index(spark, sf_dir: str) -> DataFrame:
    found = report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        digest("near_items").alias("near_items_sha256"),
    )


OP1_SQL = r"""
with item as (
  select coalesce(cast(item_id as varchar), 'null') as item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), win as (
  select distinct item, list_slice(w, s, s + least(len(w), 10) - 1) as g, least(len(w), 10) as n
  from item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as u(s) where len(w) > 0
), doc as (
  select row_number() over () as r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), lens as (select distinct n from win), gram as (
  select r, s, n, list_slice(w, s, s + n - 1) as g from doc, lens, unnest(range(1, len(w) - n + 2)) as u(s) where len(w) >= n
), hit as (select r, s, gram.n as n, item from gram join win using (g)),
pos as (select r, count(distinct p) as n_hit from hit, unnest(range(s, s + n)) as u(p) group by r),
its as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as l from hit group by r),
wins as (select row_number() over () as wid, item, list_distinct(g) as ts from win where len(list_distinct(g)) >= 8),
wt as (select wid, unnest(ts) as term from wins),
dp as (select r, p, w[p] as term from doc, unnest(range(1, len(w) + 1)) as u(p) where w[p] in (select term from wt)),
pair as (select r, wid from (select distinct r, term from dp) join wt using (term) group by all having count(*) >= 8),
spot as (select r, wid, p, term from pair join wt using (wid) join dp using (r, term)),
near as (select r, wid, list_unique(list(term) over (partition by r, wid order by p range between 15 preceding and 15 following)) as c from spot),
nits as (select r, count(distinct item) as n_near, string_agg(distinct item, ',' order by item) as nl from near join wins using (wid) where c >= 8 group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
       coalesce(n_near, 0) as n_near_items, sha256(coalesce(nl, '')) as near_items_sha256
from doc left join pos using (r) left join its using (r) left join nits using (r)
"""
