"""The engine's operators over the driver's tables, each with the SQL that gives the same rows.

Source graphs aren't among the tables, so an operator is applied to what plays the part: parts are
symbols, orders are change sets, consecutive lines of an order are call edges, documents are files.
Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import text as T
from tessera.operators import community, coupling, deadcode, graph, ingest, resolve, search, stats, versions
from tessera.sources import java, overlay, workspace
from tessera.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# what plays the part of the graph

EDGES_SQL = """edges as (
  select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_partkey <> b.l_partkey)"""

SYMBOLS_SQL = """symbols as (
  select p_partkey as id, case p_size % 3 when 0 then 'method' when 1 then 'class' else 'field' end as kind, p_name as name,
         p_brand || '.' || p_type || '.' || p_name as fqname, p_size % 2 = 0 as is_test, p_brand as project_id, p_size from part)"""

TOKENS_SQL = (
    "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'), "
    "'([0-9]+)', ' \\1 ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda x: x <> '')"
)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls between parts: consecutive lines of an order."""
    line = _t(spark, d, "lineitem")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src_id"))
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst_id"))
    found = a.join(b, ["l_orderkey", "l_linenumber"]).where("src_id <> dst_id").select("src_id", "dst_id").distinct()
    return found.withColumn("confidence", F.lit(1.0)).withColumn("reason", F.lit("next_line"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "method").when(F.col("p_size") % 3 == 1, "class").otherwise("field")
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_type", "p_name").alias("fqname"),
        (F.col("p_size") % 2 == 0).alias("is_test"), F.col("p_brand").alias("project_id"), "p_size",
    )


ROOTS_SQL = "select p_partkey as id from part where lower(p_name) = 'red bolt' order by lpad(p_partkey::varchar, 12, '0') limit 50"


def roots(spark: SparkSession, d: str) -> DataFrame:
    """What the name 'red bolt' resolves to."""
    s = symbols(spark, d).where(F.lower("name") == "red bolt").withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))
    return search.resolve_ids(s, "Red Bolt").select(F.col("id").cast("bigint").alias("node"))


HALVES_SQL = "edges as (select a.p_partkey as src, b.p_partkey as dst from part a join part b on b.p_partkey = a.p_partkey // 2)"


def halves(spark: SparkSession, d: str) -> DataFrame:
    """Calls of every part to the one of half its number."""
    p = _t(spark, d, "part")
    half = p.select(F.col("p_partkey").alias("src_id"), F.floor(F.col("p_partkey") / 2).alias("dst_id"))
    return half.join(p.select(F.col("p_partkey").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id", F.lit(1.0).alias("confidence"), F.lit("half").alias("reason"))


# ranking


@query("sr_tokenize", f"select doc_id, cast(len(ts) as bigint) as n_tokens, sha1(array_to_string(ts, ' ')) as digest from (select doc_id, {TOKENS_SQL.format('text')} as ts from documents)")
def _(spark, d):
    ts = _t(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return ts.select("doc_id", F.size("ts").cast("bigint").alias("n_tokens"), F.sha1(F.array_join("ts", " ")).alias("digest"))


BM25_QUERY = "the eron tion eron"
BM25_SQL = f"""with d as (select doc_id as id, {TOKENS_SQL.format('text')} as ts from documents),
q as (select unnest({TOKENS_SQL.format("'" + BM25_QUERY + "'")}) as token), s as (select count(*) as n, avg(len(ts)) as avgdl from d),
tf as (select id, token, count(*) as tf from (select id, unnest(ts) as token from d) group by all),
df as (select token, count(*) as df from tf group by token),
sc as (select tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avgdl))) as score
  from q join tf using (token) join df using (token) join d on d.id = tf.id cross join s group by tf.id)
select d.id, round(coalesce(score, 0), 6) as score from d left join sc using (id)"""


@query("sr_bm25", BM25_SQL)
def _(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, F.col("text"), BM25_QUERY).select("id", F.round("score", 6).alias("score"))


@query("sr_fuzzy_rank", "select p_partkey as id, round(1 - levenshtein('smal rnig', lower(p_name)) / greatest(length('smal rnig'), length(p_name), 1), 6) as score from part")
def _(spark, d):
    return search.fuzzy(symbols(spark, d), F.col("name"), "Smal Rnig").select("id", F.round("score", 6).alias("score"))


@query("sr_levenshtein", "select p_partkey, cast(levenshtein(p_name, p_type) as bigint) as distance from part")
def _(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"))


@query(
    "sr_cosine",
    """select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as score
    from embeddings a, (select embedding from embeddings where vec_id = 0) b""",
)
def _(spark, d):
    vectors = _t(spark, d, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@query(
    "sr_semantic_rank",
    """select vec_id, rank from (select vec_id, cast(row_number() over (order by round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) desc, vec_id) as int) as rank
    from embeddings a, (select embedding from embeddings where vec_id = 0) b)""",
)
def _(spark, d):
    vectors = _t(spark, d, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = vectors.crossJoin(F.broadcast(one)).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    return search.ranked(scored, "vec_id")


HASH_SQL = """with w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as w from part),
v as (select p_partkey, cast(('0x' || substr(sha1(w), 1, 4)) as bigint) % 64 as i, 1 - 2 * (cast(('0x' || substr(sha1(w), 5, 2)) as bigint) % 2) as s from w where w <> ''),
g as (select p_partkey, i, sum(s) as s from v group by all), n as (select p_partkey, sqrt(sum(s * s)) as n from g group by 1)
select p_partkey, i, round(s / n, 6) as value from g join n using (p_partkey) where s <> 0"""


@query("sr_hash_vector", HASH_SQL)
def _(spark, d):
    v = _t(spark, d, "part").select("p_partkey", F.posexplode(T.hash_vector(F.col("p_name"), 64)).alias("i", "value"))
    return v.where("value <> 0").select("p_partkey", F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


RRF_SQL = f"""with {SYMBOLS_SQL}, f as (select id, row_number() over (order by 1 - levenshtein('red bolt', lower(name)) / greatest(length(name), 8) desc, id) as r from symbols),
g as (select id, row_number() over (order by p_size desc, id) as r from symbols)
select id, round(sum(1.0 / (60 + r)), 9) as score from (select * from f union all select * from g) group by id"""


@query("sr_rrf", RRF_SQL)
def _(spark, d):
    s = symbols(spark, d)
    lists = [search.ranked(search.fuzzy(s, F.col("name"), "red bolt")), search.ranked(s.select("id", F.col("p_size").cast("double").alias("score")))]
    return search.rrf(lists).select("id", F.round("score", 9).alias("score"))


HYBRID_SQL = f"""with {SYMBOLS_SQL}, d as (select id, {TOKENS_SQL.format("name || ' ' || fqname")} as ts from symbols),
q as (select unnest(['red', 'bolt']) as token), st as (select count(*) as n, avg(len(ts)) as avgdl from d),
tf as (select id, token, count(*) as tf from (select id, unnest(ts) as token from d) group by all), df as (select token, count(*) as df from tf group by token),
b as (select tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / avgdl))) as score
  from q join tf using (token) join df using (token) join d on d.id = tf.id cross join st group by tf.id),
rb as (select d.id, row_number() over (order by round(coalesce(score, 0), 9) desc, d.id) as r from d left join b using (id)),
rf as (select id, row_number() over (order by 1 - levenshtein('red bolt', lower(name)) / greatest(length(name), 8) desc, id) as r from symbols),
x as (select id, sum(1.0 / (60 + r)) as rrf from (select * from rb union all select * from rf) group by id),
z as (select s.id, s.name, rrf * (case when is_test then 0.5 else 1 end) * (case when kind in ('method', 'class') then 1.2 else 1 end) * (case when lower(name) = 'red bolt' or lower(fqname) = 'red bolt' then 5 else 1 end) as score from x join symbols s using (id))
select id, name, round(score, 9) as score, max(score) over () < 0.05 as low_confidence from (select * from z order by round(score, 12) desc, id limit 20)"""


@query("sr_hybrid", HYBRID_SQL)
def _(spark, d):
    return search.hybrid(symbols(spark, d), "red bolt").select("id", "name", F.round("score", 9).alias("score"), "low_confidence")


@query(
    "sr_find_symbol",
    f"""with {SYMBOLS_SQL} select kind, id, name, fqname, project_id from (select *, row_number() over (partition by kind order by lower(name) <> 'red bolt', id) as n
    from symbols where kind in ('class', 'method') and (lower(name) = 'red bolt' or contains(lower(fqname), 'red bolt'))) where n <= 20""",
)
def _(spark, d):
    s = symbols(spark, d)
    return search.find_symbol(s.where("kind = 'class'"), s.where("kind = 'method'"), "Red Bolt")


@query(
    "sr_resolve_ids",
    f"""with {SYMBOLS_SQL} select id, how from (select id, case when lower(name) = 'red bolt' then 1 when lower(fqname) = 'red bolt' then 2 when contains(lower(fqname), 'red bolt') then 3 end as how from symbols)
    where how is not null order by how, id limit 50""",
)
def _(spark, d):
    s = symbols(spark, d).withColumn("id", F.col("id").cast("string"))
    # ids are numbers here; their order as text would differ, so they are padded
    padded = s.withColumn("id", F.lpad("id", 12, "0"))
    return search.resolve_ids(padded, "Red Bolt").select(F.col("id").cast("bigint").alias("id"), "how")


@query(
    "sr_attach_context",
    """select p_partkey as id, p_type as community, coalesce(n, 0) as flows from part left join
    (select l_partkey, least(count(distinct l_suppkey), 3) as n from lineitem group by 1) on l_partkey = p_partkey""",
)
def _(spark, d):
    p, line = _t(spark, d, "part"), _t(spark, d, "lineitem")
    hits = p.select(F.col("p_partkey").alias("id"))
    kinds = p.select(F.col("p_type").alias("id"), F.col("p_type").alias("label")).distinct()
    found = search.with_context(hits, p.select(F.col("p_partkey").alias("src_id"), F.col("p_type").alias("dst_id")), kinds, line.select(F.col("l_partkey").alias("src_id"), F.col("l_suppkey").alias("dst_id"), F.lit(1).alias("depth")))
    return found.select("id", "community", F.coalesce(F.size("flows"), F.lit(0)).cast("bigint").alias("flows"))


@query("sr_attach_snippet", "select conv_id, turn, case when l is not null and turn - 1 <= len(l) then array_to_string(l[greatest(turn - 1, 1):turn + 3], chr(10)) end as snippet from (select conv_id, turn, string_split(text, chr(10)) as l from conversations)")
def _(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text", F.concat_ws(":", "conv_id", "turn").alias("file_id"))
    hits = c.select("conv_id", "turn", "file_id", (F.col("turn") + 1).alias("line"))
    return search.with_snippets(hits, c.select("file_id", F.col("text").alias("content"))).select("conv_id", "turn", "snippet")


@query("sink_embed_cache", "select count(distinct p_name) as vectors, (select count(*) from part) as symbols, count(distinct p_name) filter (where p_partkey >= 50) as seen from part")
def _(spark, d):
    s = symbols(spark, d)
    cached = s.where("id < 50").select(search.embedding_key("hash", 16, F.col("name")).alias("key")).distinct().withColumn("embedding", F.array_repeat(F.lit(0.5), 16).cast("array<float>"))
    with_vectors, cache = search.embedded(s, cached, F.col("name"), lambda t: T.hash_vector(t, 16), "hash", 16)
    counts = with_vectors.agg(F.count("embedding").alias("symbols"), F.count_distinct(F.when(F.col("id") >= 50, F.col("name"))).alias("seen"))
    return cache.agg(F.count(F.lit(1)).alias("vectors")).crossJoin(counts)  # one row each


@query("ag_overlay_summary", "select 'p' || (o_orderkey % 50) as project_id, count(*) filter (where o_orderstatus = 'P') as dirty_files, count(*) filter (where o_orderstatus = 'F') as deleted_files from orders group by 1")
def _(spark, d):
    o = _t(spark, d, "orders")
    project = F.concat(F.lit("p"), F.col("o_orderkey") % 50).alias("project_id")
    entry = F.map_from_entries(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.struct(F.col("o_orderkey").cast("string"), F.lit(1)))))
    documents = o.groupBy(project).agg(entry.alias("dirty_files"), F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("deleted_files"))
    return overlay.summary(documents)


# graphs


@query("gr_entry_methods", f"with {SYMBOLS_SQL} select id as node from symbols where name = 'main' or is_test")
def _(spark, d):
    return graph.entry_methods(symbols(spark, d))


@query("gr_flow_lookup", f"with {SYMBOLS_SQL} select id as node from symbols where lower(name) = 'red bolt' or contains(lower(fqname), 'red bolt') order by id limit 10")
def _(spark, d):
    s = symbols(spark, d).withColumn("signature", F.col("fqname"))
    return graph.flow_entries(s.withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0")), "Red Bolt").select(F.col("node").cast("bigint").alias("node"))


@query("gr_method_meta", "select p_partkey as node, p_name as name, p_brand || '#' || p_name || '()' as fqname, n_name as file_path from part join nation on n_nationkey = cast(replace(p_brand, 'Brand#', '') as int)")
def _(spark, d):
    p, n = _t(spark, d, "part"), _t(spark, d, "nation")
    methods = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat("p_name", F.lit("()")).alias("signature"), F.col("p_brand").alias("class_id"))
    classes = p.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("fqcn"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("file_id")).distinct()
    files = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"), F.lit("x").alias("project_id"))
    found = graph.with_method_meta(methods.select(F.col("id").alias("node")), methods, classes, files)
    return found.where("name is not null").select("node", "name", "fqname", "file_path")


@query("gr_symbol_community", "select p_partkey as symbol_id, p_name as name, p_type as label from part where lower(p_name) = 'red bolt' order by p_partkey limit 20")
def _(spark, d):
    s = symbols(spark, d).withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))
    found = _t(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("symbol_id"), F.col("p_type").alias("label"))
    return community.symbol_community(found, s, "Red Bolt").select(F.col("symbol_id").cast("bigint").alias("symbol_id"), "name", "label")


WALK_SQL = """, walk as (
  select id as node, 0 as depth from (""" + ROOTS_SQL + """)
  union select {to}, w.depth + 1 from walk w join edges e on e.{at} = w.node where w.depth < {most})"""


@query(
    "gr_impact",
    f"""with recursive {EDGES_SQL} {WALK_SQL.format(to='src', at='dst', most=4)}, best as (select node, min(depth) as depth from walk group by node)
    select node, depth, case depth when 1 then '1' when 2 then '2' else '3+' end as bucket, p_name as name from best join part on p_partkey = node where depth > 0""",
)
def _(spark, d):
    found = graph.impact(edges(spark, d), roots(spark, d), 4)
    named = _t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    return found.join(named, "node").select("node", "depth", "bucket", "name")


@query(
    "gr_impact_summary",
    f"""with recursive {EDGES_SQL} {WALK_SQL.format(to='src', at='dst', most=4)}, best as (select node, min(depth) as depth from walk group by node)
    select case depth when 1 then '1' when 2 then '2' else '3+' end as bucket, count(*) as callers from best where depth > 0 group by 1""",
)
def _(spark, d):
    return graph.impact_summary(graph.impact(edges(spark, d), roots(spark, d), 4))


@query(
    "gr_flow",
    f"""with recursive {HALVES_SQL}, walk as (select p_partkey as entry, p_partkey as node, 0 as depth from part where p_name = 'main' or p_size % 2 = 0
      union select w.entry, e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < 6),
    best as (select entry, node, min(depth) as depth from walk group by all)
    select entry, node, depth, case when count(*) over (partition by entry) > 12 then 'cross_community' else 'intra_community' end as kind from best""",
)
def _(spark, d):
    return graph.flows(halves(spark, d), graph.entry_methods(symbols(spark, d)))


@query(
    "gr_neighborhood",
    f"""with {EDGES_SQL}, t as (select p_partkey as target, p_brand, p_size from part), h as (select a.p_partkey as src, b.p_partkey as dst from part a join part b on b.p_partkey = a.p_partkey // 2)
    select target, 'caller' as role, src as node from t join edges on dst = target
    union all select target, 'callee', dst from t join edges on src = target
    union all select target, 'sibling', p_partkey from t join part using (p_brand, p_size) where p_partkey <> target
    union all select src, 'overrides', dst from h union all select dst, 'overridden_by', src from h""",
)
def _(spark, d):
    methods = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("class_id"))
    return graph.neighbourhood(methods.select(F.col("id").alias("target")), edges(spark, d), methods, halves(spark, d))


DEAD_SQL = """with m as (select p_partkey as method_id, p_name as name, p_brand as class_fqcn, p_size % 2 = 0 as is_test,
  case p_size % 3 when 0 then 'private' when 1 then 'public' else 'final' end as modifier, p_type from part
  where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 45)),
x as (select *, case when is_test then 'test_method' when p_type = 'PROMO' then 'annotation:Test' end as exempt from m)"""


def _dead_methods(spark, d):
    p = _t(spark, d, "part")
    marks = F.array(F.when(F.col("p_size") % 3 == 0, "private").when(F.col("p_size") % 3 == 1, "public").otherwise("final"), F.when(F.col("p_type") == "PROMO", "@org.Test(1)").otherwise("static"))
    return p.select(
        F.col("p_partkey").alias("method_id"), F.col("p_name").alias("name"), F.concat("p_name", F.lit("()")).alias("signature"), marks.alias("modifiers"), F.col("p_brand").alias("class_fqcn"),
        F.lit(False).alias("is_constructor"), (F.col("p_size") % 2 == 0).alias("is_test"), F.concat(F.lit("/x/"), "p_type").alias("file_path"),
    )


def _dead_calls(spark, d):
    return _t(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("dst_id"))


def _no_overrides(spark):
    return spark.createDataFrame([], "src_id bigint, dst_id bigint")


@query(
    "gr_deadcode",
    DEAD_SQL + " select method_id, name, case modifier when 'private' then 'high' when 'public' then 'low' else 'medium' end as confidence from x where exempt is null order by method_id limit 200",
)
def _(spark, d):
    return deadcode.dead_methods(_dead_methods(spark, d), _dead_calls(spark, d), _no_overrides(spark)).select("method_id", "name", "confidence")


@query("gr_dead_exemptions", DEAD_SQL + " select split_part(exempt, ':', 1) as reason, count(*) as n from x where exempt is not null group by 1")
def _(spark, d):
    return deadcode.exemption_stats(deadcode.classified(_dead_methods(spark, d), _dead_calls(spark, d), _no_overrides(spark)))


@query(
    "gr_dead_strict",
    DEAD_SQL + " select 'dead' as state, count(*) as n from x where exempt is null union all select 'exempt', count(*) from x where exempt is not null",
)
def _(spark, d):
    found = deadcode.classified(_dead_methods(spark, d), _dead_calls(spark, d), _no_overrides(spark), strict=True)
    return found.agg(F.count_if(F.col("exempt").isNull()).alias("dead"), F.count_if(F.col("exempt").isNotNull()).alias("exempt")).select(F.expr("stack(2, 'dead', dead, 'exempt', exempt) as (state, n)"))


PAIRS_SQL = """with m as (select distinct l_orderkey as c, l_partkey as i from lineitem), n as (select i, count(*) as n from m group by 1),
p as (select a.i as a, b.i as b, count(*) as n_ab from m a join m b on a.c = b.c and a.i < b.i group by all)"""


@query("gr_coupling_pairs", PAIRS_SQL + " select a, b, n_ab, x.n as n_a, y.n as n_b, round(n_ab / greatest(x.n, y.n, 1), 9) as strength from p join n x on x.i = a join n y on y.i = b")
def _(spark, d):
    members = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("item"))
    return coupling.co_changes(members).withColumn("strength", F.round("strength", 9))


@query("gr_coupling", PAIRS_SQL + " select a, b, n_ab, round(n_ab / greatest(x.n, y.n, 1), 9) as strength from p join n x on x.i = a join n y on y.i = b where n_ab >= 3 and n_ab / greatest(x.n, y.n, 1) >= 0.03")
def _(spark, d):
    members = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("item"))
    return coupling.coupled(members, 0.03, 3).select("a", "b", "n_ab", F.round("strength", 9).alias("strength"))


@query(
    "gr_get_coupling",
    PAIRS_SQL + """, e as (select a, b, n_ab, n_ab / greatest(x.n, y.n, 1) as s from p join n x on x.i = a join n y on y.i = b where n_ab >= 3 and n_ab / greatest(x.n, y.n, 1) >= 0.03),
    u as (select a, b, n_ab, s from e union all select b, a, n_ab, s from e)
    select cast(a as varchar) as src_id, cast(b as varchar) as dst_id, round(s, 9) as strength, n_ab as cochanges, cast(6 as bigint) as months from u
    where s >= 0.03 order by s desc, n_ab desc, cast(a as varchar), cast(b as varchar) limit 200""",
)
def _(spark, d):
    members = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("item"))
    found = coupling.coupling_edges(coupling.coupled(members, 0.03, 3))
    return coupling.get_coupling(found, None, 0.03, 3).withColumn("strength", F.round("strength", 9))


def _communities(spark, d):
    members = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("item"))
    pairs = coupling.coupled(members, 0.03, 3).select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"))
    none = spark.createDataFrame([], "a bigint, b bigint")
    return community.communities(symbols(spark, d).select("id", "fqname"), community.symbol_edges(none, pairs))


def _label_rounds(rounds: int = community.ROUNDS) -> str:
    """Label propagation as one common table for each round; a fixed point repeats itself."""
    said = "select g.v, l.label from both_ways g join l{0} l on l.v = g.w union all select v, label from l{0}"
    best = "row_number() over (partition by v order by count(*) desc, label) as place"
    one = f"l{{1}} as materialized (select v, label from (select v, label, {best} from ({said}) group by v, label) where place = 1)"
    return ", ".join(["l0 as (select distinct v, v as label from both_ways)", *(one.format(k, k + 1) for k in range(rounds))])


COMMUNITY_SQL = f"""{PAIRS_SQL}, e as materialized (select a, b from p join n x on x.i = a join n y on y.i = b where n_ab >= 3 and n_ab / greatest(x.n, y.n, 1) >= 0.03),
both_ways as materialized (select a as v, b as w from e union all select b, a from e), {_label_rounds()},
good as (select v, 'graph:' || label as place from l{community.ROUNDS} where label in (select label from l{community.ROUNDS} group by label having count(*) >= 2)),
named as (select p_partkey as id, split_part(p_brand, '#', 1) as bucket from part),
placed as (select id, bucket, coalesce(place, 'pkg:' || bucket) as community_id from named left join good on v = id),
sized as (select *, count(*) over (partition by community_id) as size, count(*) over () as total from placed),
buckets as (select community_id, bucket as label, row_number() over (partition by community_id order by count(*) desc, bucket) as place from placed group by community_id, bucket),
found as (select id as symbol_id, community_id, label, size, least(1.0, size / total) as cohesion from sized join buckets using (community_id) where place = 1 and size >= 2)"""


@query("gr_community", COMMUNITY_SQL + " select symbol_id, community_id, label, size, cohesion from found")
def _(spark, d):
    return _communities(spark, d)


@query("gr_community_sort", COMMUNITY_SQL + " select distinct community_id, label, size, cohesion from found order by size desc, label desc, community_id")
def _(spark, d):
    return community.community_table(_communities(spark, d))


BUCKET_SQL = """select p_partkey as symbol_id, 'pkg:' || replace(p_brand, '#', '') || '.' || p_type as community_id, replace(p_brand, '#', '') || '.' || p_type as label, count(*) over (partition by p_brand, p_type) as size,
  least(1.0, count(*) over (partition by p_brand, p_type) / count(*) over ()) as cohesion from part"""


@query("gr_community_merge", f"select symbol_id, community_id, label, size, round(cohesion, 9) as cohesion from ({BUCKET_SQL}) where size >= 2")
def _(spark, d):
    none = spark.createDataFrame([], "a bigint, b bigint")
    plain = symbols(spark, d).select("id", F.replace("fqname", F.lit("#"), F.lit("")).alias("fqname"))
    found = community.communities(plain, none)
    return found.withColumn("cohesion", F.round("cohesion", 9))


@query("gr_package_bucket", "select page_id, case when len(p) <= 2 then array_to_string(p, '.') else array_to_string(p[1:least(len(p) - 1, 5)], '.') end as bucket from (select page_id, list_filter(string_split(split_part(split_part(url, '://', 2), '/', 1), '.'), lambda x: x <> '') as p from pages)")
def _(spark, d):
    host = F.substring_index(F.substring_index("url", "://", -1), "/", 1)
    return _t(spark, d, "pages").select("page_id", T.package_bucket(host).alias("bucket"))


# versions


def _orders(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base = o.where("o_orderkey % 10 <> 0")
    head = o.where("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return base, head


@query(
    "gr_branch_diff",
    """select o_orderkey, case o_orderkey % 10 when 0 then 'added' when 1 then 'removed' else 'modified' end as status,
    case when o_orderkey % 10 <> 0 then o_totalprice end as base_price, case when o_orderkey % 10 <> 1 then o_totalprice + (case when o_orderkey % 10 = 2 then 1 else 0 end) end as head_price
    from orders where o_orderkey % 10 in (0, 1, 2)""",
)
def _(spark, d):
    base, head = _orders(spark, d)
    found = versions.diff(base, head, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return found.select("o_orderkey", "status", F.col("base_o_totalprice").alias("base_price"), F.col("head_o_totalprice").alias("head_price"))


@query("st_except", "select o_orderkey from orders where o_orderkey % 10 = 0")
def _(spark, d):
    base, head = _orders(spark, d)
    return head.select("o_orderkey").exceptAll(base.select("o_orderkey"))


@query("st_intersect_modified", "select o_orderkey from orders where o_orderkey % 10 = 2")
def _(spark, d):
    base, head = _orders(spark, d)
    return versions.diff(base, head, ["o_orderkey"], ["o_totalprice"]).where("status = 'modified'").select("o_orderkey")


@query(
    "st_union_overlay",
    "select o_orderkey, case when o_orderkey % 7 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice from orders where o_orderkey % 7 <> 1",
)
def _(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    dirty = o.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    hidden = versions.suppressed(dirty, o.where("o_orderkey % 7 = 1"), "o_orderkey")
    return versions.overlaid(o, dirty, hidden, "o_orderkey")


@query("st_suppressed", "select distinct l_orderkey from lineitem where l_returnflag = 'R' or l_linestatus = 'O'")
def _(spark, d):
    line = _t(spark, d, "lineitem")
    return versions.suppressed(line.where("l_returnflag = 'R'"), line.where("l_linestatus = 'O'"), "l_orderkey")


@query("st_overlay_edges", f"with {EDGES_SQL} select src as src_id, dst as dst_id from edges where src % 5 <> 0 and dst % 5 <> 0 union all select p_partkey, p_partkey + 1 from part where p_partkey % 5 = 0")
def _(spark, d):
    p = _t(spark, d, "part").where("p_partkey % 5 = 0")
    new = p.select(F.col("p_partkey").alias("src_id"), (F.col("p_partkey") + 1).alias("dst_id"))
    return versions.overlaid_edges(edges(spark, d).select("src_id", "dst_id"), new, p.select(F.col("p_partkey").alias("node")))


@query("sink_upsert", "select c_custkey, case when c_custkey % 3 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer union all select c_custkey + 10000000, 'ADDED' from customer where c_custkey % 100 = 0")
def _(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")).unionByName(c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment")))
    return versions.upsert(c, changes, ["c_custkey"])


@query("sink_add_call", f"with {EDGES_SQL} select distinct src as src_id, dst as dst_id from edges where src in (select p_partkey from part where p_size > 10) and dst in (select p_partkey from part where p_size > 20)")
def _(spark, d):
    e = edges(spark, d).select("src_id", "dst_id")
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return versions.add_edges(e.where("false"), e, p.where("p_size > 10"), p.where("p_size > 20"))


@query("wn_latest_overlay", "select user_id, event_type, max(event_id) as event_id, max_by(value, event_id) as value from events group by all")
def _(spark, d):
    return versions.latest(_t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


PLAN_SQL = """select doc_id as file_id, case when doc_id % 11 = 0 then 'added' when doc_id % 11 = 1 then 'deleted' when doc_id % 11 = 2 then 'changed' when doc_id % 11 = 3 then 'touched' else 'unchanged' end as action from documents"""


@query("ing_incremental_plan", PLAN_SQL)
def _(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit(1).alias("mtime"), F.col("n_chars").alias("size"), F.sha1("text").alias("digest"))
    part = F.col("file_id") % 11
    current = docs.where(part != 1)
    stored = docs.where(part != 0).select(
        "file_id", F.when(part.isin(2, 3), 0).otherwise(1).alias("mtime"), "size", F.when(part == 2, "old").otherwise(F.col("digest")).alias("cached_hash"), F.when(part == 2, "old").otherwise(F.col("digest")).alias("hash")
    )
    return versions.plan(current, stored)


# ingest expressions


@query("ing_body_hash", r"select doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '\s+', ' ', 'g'))) as hash from documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.body_hash(F.col("text")).alias("hash"))


@query("gr_normalize_snippet", r"select page_id, sha1(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(html, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '\s+', ' ', 'g')), '\s*([{}();,])\s*', '\1', 'g')) as hash from pages")
def _(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha1(T.normalised(F.col("html"))).alias("hash"))


@query("ing_arg_count", "select doc_id, cast(sum(case when trim(x) = '' then 0 else len(string_split(x, ',')) end) as bigint) as args from (select doc_id, unnest(string_split(text, chr(10))) as x from documents) group by 1")
def _(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.sum(T.argument_count(F.col("line"))).cast("bigint").alias("args"))


@query("ing_ids", "select doc_id, sha1(source || ':' || doc_id) as file_id, sha1(source || '|' || lang || '::' || doc_id || '#f(' || n_chars || ')') as method_id, sha1('class:' || lang || ':' || doc_id) as symbol_id from documents")
def _(spark, d):
    docs = _t(spark, d, "documents")
    doc, sig = F.col("doc_id").cast("string"), F.concat(F.lit("f("), F.col("n_chars").cast("string"), F.lit(")"))
    return docs.select("doc_id", ids.file_id(F.col("source"), doc).alias("file_id"), ids.method_id(F.col("lang"), doc, sig, F.col("source")).alias("method_id"), ids.symbol_id(F.lit("class"), F.col("lang"), doc).alias("symbol_id"))


@query(
    "ing_scope",
    """select page_id, case when contains(p, '/java/') then split_part(p, '/java/', 1) when contains(p, '/src/') then split_part(p, '/src/', 1)
    when contains(p, '/') then regexp_extract(p, '^(.*)/[^/]*$', 1) else '.' end as scope, contains(p, 'src/test/java') as is_test
    from (select page_id, case page_id % 4 when 0 then 'm' || page_id || '/src/main/java/a/B.java' when 1 then 'm/src/test/java/B.java' when 2 then 'dir/' || page_id || '/B.java' else 'B.java' end as p from pages)""",
)
def _(spark, d):
    n = F.col("page_id")
    p = F.when(n % 4 == 0, F.concat(F.lit("m"), n, F.lit("/src/main/java/a/B.java"))).when(n % 4 == 1, "m/src/test/java/B.java").when(n % 4 == 2, F.concat(F.lit("dir/"), n, F.lit("/B.java"))).otherwise("B.java")
    return _t(spark, d, "pages").select("page_id", ids.scope(p).alias("scope"), ids.is_test_path(p).alias("is_test"))


@query("src_modules", "select page_id, unnest(regexp_extract_all(replace(replace(html, '<h1>', '<module>'), '</h1>', '</module>'), '<module>\\s*([^<]+?)\\s*</module>', 1)) as module from pages")
def _(spark, d):
    text = F.replace(F.replace("html", F.lit("<h1>"), F.lit("<module>")), F.lit("</h1>"), F.lit("</module>"))
    return workspace.module_names(_t(spark, d, "pages"), text).select("page_id", "module")


@query("src_file_to_module", "select page_id, case when count(*) over (partition by h) >= 0 then h end as project_id from (select page_id, url, split_part(split_part(url, '://', 2), '/', 1) as h from pages)")
def _(spark, d):
    pages = _t(spark, d, "pages").select("page_id", F.concat_ws("/", F.substring_index(F.substring_index("url", "://", -1), "/", 1), "page_id").alias("path"))
    modules = pages.select(F.substring_index("path", "/", 1).alias("module_path")).distinct().withColumn("project_id", F.col("module_path"))
    return workspace.to_modules(pages, modules).select("page_id", "project_id")


@query("src_snippet", "select conv_id, turn, array_to_string(l[greatest(turn + 1 - 2, 1):turn + 1 + 2], chr(10)) as snippet from (select conv_id, turn, string_split(text, chr(10)) as l from conversations) where turn + 1 - 2 <= len(l)")
def _(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", T.snippet(F.col("text"), F.col("turn") + 1).alias("snippet"))
    return c.where("snippet is not null")


@query(
    "src_git_log",
    """with n as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id) as c from events)
    select distinct user_id || ':' || c as change, event_type as item from n where event_type <> 'signup' and c > 0""",
)
def _(spark, d):
    line = F.when(F.col("event_type") == "signup", "commit x").otherwise(F.col("event_type"))
    lines = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))
    return coupling.change_sets(lines)


# resolution

CATALOG_SQL = """m as (select p_partkey as id, split_part(p_name, ' ', 2) as name, p_size % 4 as arity, p_brand as class_id, 'p' || (p_size % 6) || '.' || replace(p_brand, '#', '') as fqcn from part),
s as (select event_id as call_id, event_type, ['bolt', 'ring', 'gear', 'widget'][event_id % 4 + 1] as name, cast(user_id % 4 as int) as arity, 'Brand#' || (event_id % 30) as class_id, 'p' || (user_id % 7) as package,
  case event_id % 3 when 0 then 'Brand' || (user_id % 30) end as receiver from events)"""

RESOLVE_SQL = f"""with {CATALOG_SQL},
t1 as (select distinct call_id, m.id, 1 as tier, 0.8 as confidence, 'receiver_method_match' as reason from s join m on m.name = s.name and m.arity = s.arity and (m.fqcn = s.package || '.' || s.receiver or split_part(m.fqcn, '.', 2) = s.receiver)),
t2 as (select call_id, m.id, 2, 1.0, 'intra_class_exact' from s join m on m.name = s.name and m.arity = s.arity and m.class_id = s.class_id),
t3 as (select call_id, m.id, 3, case when count(*) over (partition by call_id) = 1 then 1.0 else 0.5 end, case when count(*) over (partition by call_id) = 1 then 'exact_name_arity_unique' else 'fuzzy_name_arity_ambiguous' end
  from s join m on m.name = s.name and m.arity = s.arity and starts_with(m.fqcn, s.package || '.') qualify count(*) over (partition by call_id) <= 12),
g as (select name, arity from m group by all having count(*) <= 12),
t4 as (select call_id, m.id, 4, case when count(*) over (partition by call_id) = 1 then 1.0 else 0.5 end, case when count(*) over (partition by call_id) = 1 then 'exact_name_arity_unique' else 'fuzzy_name_arity_ambiguous' end
  from s join g using (name, arity) join m using (name, arity)),
u as (select * from t1 union all select * from t2 union all select * from t3 union all select * from t4)
select call_id as src_id, id as dst_id, confidence, reason from u qualify tier = min(tier) over (partition by call_id)"""


@query("res_call_tiers", RESOLVE_SQL)
def _(spark, d):
    p, e = _t(spark, d, "part"), _t(spark, d, "events")
    methods = p.select(
        F.col("p_partkey").alias("id"), F.substring_index("p_name", " ", -1).alias("name"), (F.col("p_size") % 4).alias("param_count"), F.col("p_brand").alias("class_id"),
        F.concat(F.lit("p"), F.col("p_size") % 6, F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("class_fqcn"),
    )
    classes = methods.select(F.col("class_fqcn").alias("fqcn"), F.substring_index("class_fqcn", ".", -1).alias("name")).distinct()
    none = F.lit(None).cast("map<string,string>")
    sites = e.select(
        F.col("event_id").alias("call_id"), F.col("event_id").alias("source_id"), F.element_at(F.array(*map(F.lit, ("bolt", "ring", "gear", "widget"))), (F.col("event_id") % 4 + 1).cast("int")).alias("name"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Brand"), F.col("user_id") % 30)).alias("receiver"), (F.col("user_id") % 4).cast("int").alias("arg_count"), F.concat(F.lit("Brand#"), F.col("event_id") % 30).alias("class_id"),
        F.lit("own.Class").alias("class_fqcn"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("package"), F.array().cast("array<string>").alias("imports"), none.alias("local_types"), none.alias("field_types"),
    )
    return resolve.resolve_calls(sites, methods, classes)


@query("res_noise_filter", "select p_partkey from part where split_part(p_name, ' ', 1) not in (select unnest(['print', 'add', 'size', 'red', 'small'])) or split_part(p_name, ' ', 1) in ('red', 'small')")
def _(spark, d):
    return _t(spark, d, "part").where(~F.substring_index("p_name", " ", 1).isin(resolve.NOISE)).select("p_partkey")


XMOD_SQL = """with c as (select n_nationkey as id, 'Nation' || (n_nationkey % 8) as name, 'r' || n_regionkey as project_id from nation),
m as (select s_suppkey as id, 'f' || (s_suppkey % 5) as name, s_nationkey as class_id, 'r' || n_regionkey as project_id, 'Nation' || (s_suppkey % 8) as type, s_suppkey % 3 = 0 as private, s_suppkey % 7 = 0 as is_constructor from supplier join nation on s_nationkey = n_nationkey),
p as (select a.id as src_id, b.id as dst_id, case when a.name = b.name then 0.7 when not b.is_constructor and not b.private then 0.4 end as confidence
  from m a join c on c.name = a.type and c.project_id <> a.project_id join m b on b.class_id = c.id)
select src_id, dst_id, max(confidence) as confidence, case when max(confidence) > 0.5 then 'cross_module_name_match' else 'cross_module_type_ref' end as reason from p where confidence is not null group by all"""


@query("xmod_link", XMOD_SQL)
def _(spark, d):
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier")
    project = F.concat(F.lit("r"), "n_regionkey").alias("project_id")
    classes = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Nation"), F.col("n_nationkey") % 8).alias("name"), project)
    k = F.col("s_suppkey")
    name = F.concat(F.lit("f"), k % 5)
    methods = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("id"), name.alias("name"), F.concat(name, F.lit("(Nation"), k % 8, F.lit(")")).alias("signature"), F.lit("void").alias("return_type"),
        F.when(k % 3 == 0, F.array(F.lit("private"))).otherwise(F.array(F.lit("public"))).alias("modifiers"), (k % 7 == 0).alias("is_constructor"), F.col("s_nationkey").alias("class_id"), project,
    )
    return resolve.cross_module(methods, classes)


@query(
    "res_overrides",
    """with m as (select p_partkey as id, p_brand as class_id, p_name as signature from part), i as (select distinct a.p_brand as sub, b.p_brand as super from part a join part b on a.p_brand = b.p_brand || '0')
    select distinct a.id as src_id, b.id as dst_id, 1.0 as confidence from i join m a on a.class_id = sub join m b on b.class_id = super and a.signature = b.signature""",
)
def _(spark, d):
    p = _t(spark, d, "part")
    brands = p.select("p_brand").distinct()
    implements = brands.withColumn("dst_id", F.col("p_brand")).withColumn("src_id", F.concat("p_brand", F.lit("0"))).join(brands.select(F.col("p_brand").alias("src_id")), "src_id", "left_semi").select("src_id", "dst_id")
    methods = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("class_id"), F.col("p_name").alias("signature"), F.lit(False).alias("is_constructor"))
    return resolve.resolve_overrides(implements, methods)


# source text: each part is a class that calls the next part's method


def _sources(spark, d):
    k = F.col("p_partkey")
    name = lambda i: F.concat(F.lit("C"), i.cast("string"))
    text = F.concat(
        F.lit("package q"), (F.col("p_size") % 5).cast("string"), F.lit(";\n/* "), "p_name", F.lit(" { */\n@Tag(\"a,b\") public class "), name(k),
        F.lit(" {\n  private int n = 1; // f()\n  public "), name(k), F.lit("() { }\n  @Override protected void go"), k.cast("string"),
        F.lit("(String[] a, java.util.Map<String, Integer> b) { this.size(); }\n  static int run(int x) { "), name(k + 1), F.lit(" y = new "), name(k + 1),
        F.lit("(); y.go"), (k + 1).cast("string"), F.lit("(null, make(1, 2)); return x; }\n}\n"),
    )
    path = F.concat(F.lit("src/main/java/"), name(k), F.lit(".java"))
    return _t(spark, d, "part").select(F.lit("demo").alias("project_id"), path.alias("rel_path"), F.encode(text, "UTF-8").alias("content"))


@query(
    "src_parse_java",
    """select 'q' || (p_size % 5) || '.C' || p_partkey as fqcn, sig as signature, ret as return_type, ctor as is_constructor, mods as modifiers, cast(line as bigint) as line, calls
    from part, unnest([struct_pack(sig := 'C' || p_partkey || '()', ret := 'C' || p_partkey, ctor := true, mods := 'public', line := 5, calls := ''),
      struct_pack(sig := 'go' || p_partkey || '(String,java.util.Map)', ret := 'void', ctor := false, mods := '@Override protected', line := 6, calls := 'this.size/0'),
      struct_pack(sig := 'run(int)', ret := 'int', ctor := false, mods := 'static', line := 7, calls := 'y.go' || (p_partkey + 1) || '/2 make/2')]) as u(x), (select x.sig, x.ret, x.ctor, x.mods, x.line, x.calls)""",
)
def _(spark, d):
    found = java.parsed(_sources(spark, d), ["rel_path"]).select(F.explode("classes").alias("c")).select("c.fqcn", F.explode("c.methods").alias("m"))
    call = lambda c: F.concat(F.coalesce(F.concat(c["receiver"], F.lit(".")), F.lit("")), c["name"], F.lit("/"), c["arg_count"].cast("string"))
    return found.select("fqcn", "m.signature", "m.return_type", "m.is_constructor", F.array_join("m.modifiers", " ").alias("modifiers"), "m.line", F.array_join(F.transform("m.calls", call), " ").alias("calls"))


@query(
    "ing_index",
    """select 'C' || a.p_partkey || '.run' as caller, 'C' || b.p_partkey || '.go' || b.p_partkey as callee, 0.8 as confidence, 'receiver_method_match' as reason
    from part a join part b on b.p_partkey = a.p_partkey + 1""",
)
def _(spark, d):
    tables = ingest.index(_sources(spark, d))
    m = tables["method"].select("id", F.concat_ws(".", F.substring_index("class_fqcn", ".", -1), "name").alias("n"))
    ends = tables["calls"].join(m.select(F.col("id").alias("src_id"), F.col("n").alias("caller")), "src_id").join(m.select(F.col("id").alias("dst_id"), F.col("n").alias("callee")), "dst_id")
    return ends.select("caller", "callee", "confidence", "reason")


@query("ing_symbols", "select kind, count(*) as n from (select unnest(['class', 'method', 'method', 'method']) as kind from part) group by 1")
def _(spark, d):
    return ingest.parse_files(_sources(spark, d)).symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# aggregates and predicates


@query(
    "ag_project_stats",
    """with c as (select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by 1), s as (select n_name, count(*) as suppliers from supplier join nation on s_nationkey = n_nationkey group by 1)
    select n_name, coalesce(customers, 0) as customers, coalesce(suppliers, 0) as suppliers from c full join s using (n_name)
    union all select null, (select count(*) from customer), (select count(*) from supplier)""",
)
def _(spark, d):
    n = _t(spark, d, "nation")
    c = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return stats.with_totals({"customers": c, "suppliers": s}, "n_name")


@query(
    "ag_list_projects",
    """select r_name as project_id, count(distinct n_nationkey) as files, count(c_custkey) as symbols, cast(epoch(timestamp '2024-02-01 00:00:00' - timestamp '2024-01-01 00:00:00') as bigint) as age_s
    from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1""",
)
def _(spark, d):
    r, n, c = _t(spark, d, "region"), _t(spark, d, "nation"), _t(spark, d, "customer")
    projects = r.select(F.col("r_name").alias("id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("indexed_at"))
    files = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("project_id"))
    return stats.list_projects(projects, files, c.select(F.col("c_nationkey").alias("file_id")), F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("ag_group_count", "select p_type as package, p_brand as project_id, count(*) as classes from part group by all order by classes desc, package, project_id limit 50")
def _(spark, d):
    return stats.list_packages(_t(spark, d, "part").select(F.col("p_type").alias("package"), F.col("p_brand").alias("project_id")), 50)


@query("ag_capabilities", "select (select count(*) > 0 from part) as has_part, (select count(*) > 0 from orders where o_orderkey < 0) as has_none, (select count(embedding) from embeddings) as embedded")
def _(spark, d):
    found = stats.capabilities({"part": _t(spark, d, "part"), "none": _t(spark, d, "orders").where("o_orderkey < 0"), "symbol": _t(spark, d, "embeddings")})
    return found.select("has_part", "has_none", "embedded")


@query("ag_set_collect", "select p_brand, count(distinct p_type) as kinds, string_agg(distinct p_type, ',' order by p_type) as types from part group by 1")
def _(spark, d):
    return _t(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t")).select("p_brand", F.size("t").cast("bigint").alias("kinds"), F.array_join("t", ",").alias("types"))


@query("ag_counter", "select lang, token, n from (select *, row_number() over (partition by lang order by n desc, token) as r from (select lang, token, count(*) as n from (select lang, unnest(" + TOKENS_SQL.format("text") + ") as token from documents) group by all)) where r <= 10")
def _(spark, d):
    words = _t(spark, d, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("token"))
    counted = words.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("r <= 10").drop("r")


@query("flt_ci_contains", "select c_custkey, c_mktsegment from customer where contains(lower(c_mktsegment), 'mach')")
def _(spark, d):
    return _t(spark, d, "customer").where(F.lower("c_mktsegment").contains("mach")).select("c_custkey", "c_mktsegment")


@query("flt_suffix_any", "select p_partkey, p_name from part where regexp_matches(p_name, '(ring|bolt)$') and p_brand in ('Brand#1', 'Brand#2') and p_size is not null")
def _(spark, d):
    return _t(spark, d, "part").where(F.col("p_name").rlike("(ring|bolt)$") & F.col("p_brand").isin("Brand#1", "Brand#2") & F.col("p_size").isNotNull()).select("p_partkey", "p_name")


@query("jn_5way", "select r_name, o_orderpriority, count(*) as n, round(sum(l_extendedprice), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def _(spark, d):
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("jn_left_anti", "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 48)")
def _(spark, d):
    hot = _t(spark, d, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, d, "part").join(hot, "p_partkey", "left_anti").select("p_partkey")


@query("jn_left_outer", "select c_custkey, count(o_orderkey) as orders, max(o_orderdate) as last_order from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1")
def _(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'")
    return _t(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("o_orderdate").alias("last_order"))


@query("jn_undirected", f"with {EDGES_SQL} select a, count(*) as degree from (select src as a, dst as b from edges union select dst, src from edges) group by 1")
def _(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).union(e.select("dst_id", "src_id")).distinct()
    return both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))


# streams and status


@query("ss_group_by_module", "select source as project_id, count(*) as changed from documents group by 1")
def _(spark, d):
    batch = _t(spark, d, "documents").select(F.concat_ws("/", F.lit("ws"), "source", F.col("doc_id").cast("string")).alias("path"), "source")
    modules = batch.select("source").distinct().select(F.concat(F.lit("ws/"), "source").alias("module_path"), F.col("source").alias("project_id"))
    return watch.changes_by_module(batch, modules)


@query("ss_overlay_update", "select 'p' || (user_id % 3) as project_id, count(*) as files, count(*) filter (where last = 'error') as deleted from (select user_id, max_by(event_type, ts) as last from events group by 1) group by 1")
def _(spark, d):
    e = _t(spark, d, "events")
    batch = e.select(F.concat(F.lit("p"), F.col("user_id") % 3).alias("project_id"), F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"), F.col("props").alias("content"), F.col("ts").cast("timestamp").alias("ts"))
    state = overlay.state(watch.overlay_events(batch, 0))
    return state.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("op") == "deleted").alias("deleted"))


@query(
    "ss_status",
    """select c_custkey as project_id, coalesce(n, 0) > 0 as present, coalesce(n, 0) as dirty_files, coalesce(n, 0) > 0 and c_mktsegment <> 'BUILDING' as promotion_pending
    from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey""",
)
def _(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    summary = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count(F.lit(1)).alias("dirty_files")).withColumn("deleted_files", F.lit(0))
    projects = c.select(F.col("c_custkey").alias("id"), F.lit("BUILDING").alias("indexed_commit"))
    heads = c.select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("head"))
    return versions.overlay_status(summary, projects, heads).select("project_id", "present", "dirty_files", "promotion_pending")


@query(
    "ss_staleness",
    """select user_id as project_id, a as age_s, case when a > 3600 then (a // 3600) || 'h ' || (a % 3600 // 60) || 'm old' end as warning
    from (select user_id, cast(floor(epoch(timestamp '2024-02-01 00:00:00')) - floor(epoch(max(ts))) as bigint) as a from events group by 1)""",
)
def _(spark, d):
    projects = _t(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("indexed_at"))
    return versions.staleness(projects, F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("ss_promote", "select c_custkey as id, case when c_mktsegment <> 'BUILDING' then c_mktsegment else 'BUILDING' end as indexed_commit, c_mktsegment = 'BUILDING' as overlay_dirty from customer")
def _(spark, d):
    c = _t(spark, d, "customer")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    projects = c.select(F.col("c_custkey").alias("id"), F.lit("BUILDING").alias("indexed_commit"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(True).alias("overlay_dirty"))
    heads = c.select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("head"))
    return watch.promoted(projects, watch.promotable(projects, heads), now).select("id", "indexed_commit", "overlay_dirty")


@query("ext_tumbling_windows", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def _(spark, d):
    return watch.event_windows(_t(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 6))


@query(
    "ext_sessions",
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts) as k from g)
    select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, count(*) as n from s group by user_id, k""",
)
def _(spark, d):
    return watch.sessions(_t(spark, d, "events"), "6 hours")
