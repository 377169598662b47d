"""Near-duplicate detection by a chosen-path set similarity join.

A document's set holds the hashes of its distinct word shingles. Equal sets are one vertex. TREES
independent trees branch on selected minwise tokens: the root of a tree sends each vertex to the
child named by its minwise token under one hash function; a node that is still larger than LEAF
selects BRANCH further functions by its own name, and sends its vertices to a child for each, except
those that all but equal its pivot: all vertices like the pivot are linked with it, and these end, so
a large group of close copies doesn't multiply. Nodes of one vertex end. Small nodes are compared exhaustively on sketches; what is linked there, loosely,
is a spanning forest, so a node yields fewer links than vertices however many pairs it has.

The components of all loose links are candidate clusters. Each member's full set is then sent once,
and a cluster is compared exhaustively and exactly, except that pairs already known to be in one
component are skipped: they can't change the result. Nodes and clusters over BLOCK members go in
blocks, each with the cluster's pivot; members whose component in their block lacks the pivot are
compared with every other block afterwards. So no pair of components is left uncompared.

Recall: two sets at the threshold meet in a tree's first node with probability 0.75 and stay
together per level with 1 - 0.25**BRANCH; at the greatest depth they miss one tree with 0.38 and all
16 with 2e-7. Loose links need a sketch estimate of LOOSE, five standard deviations below 0.75.

Cases: null or empty texts have an empty set and are linked with nothing; shorter texts than a
shingle are one shingle; a component is named by its smallest doc_id, nulls only if there is no
other; rows with equal ids and texts are alike; equal texts with different ids are linked; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rolling
from tessera.llm.common import bounded, documents, scratch, ship, small_batches, stage
from tessera.llm.components import components

SHINGLE = 5
#: Links need 100 * shared >= THRESHOLD * united.
THRESHOLD = 75
TREES, BRANCH, DEPTH = 16, 2, 4
#: Minwise values of a vertex: the first TREES are the roots', the others are for branching. And bytes of its sketch.
PATHS, SKETCH = 32, 128
#: Members of a node that are compared on sketches in one task, and of a cluster that are compared on full sets.
LEAF, BLOCK = 4000, 1500
LOOSE = 0.55
#: Vertices so like a large node's pivot need not branch: a true neighbour of theirs has a distance of at
#: most 0.25 + 0.05 from the pivot and is linked with it itself.
STRONG = 0.95

U = rolling.U
MULTIPLIERS = rolling.mix(np.arange(1, PATHS + SKETCH + 1, dtype=U) * U(rolling.BASE2)) | U(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; a shorter text with words is one shingle."""
    words, bounds = rolling.word_hashes([t.translate(rolling.LOWER) for t in texts])
    grams = rolling.windows(words, size)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(grams[a : z - size + 1]))
        elif z > a:
            out.append(rolling.windows(words[a:z], z - a) ^ U(z - a))
        else:
            out.append(np.zeros(0, U))
    return out


def minwise(values: np.ndarray) -> np.ndarray:
    """PATHS + SKETCH minwise values of a set that isn't empty."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, U)
    for i in range(0, len(values), 4096):
        np.minimum(least, (values[i : i + 4096, None] * MULTIPLIERS).min(axis=0), out=least)
    return rolling.mix(least)


def set_id(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def vertices(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, rid, paths, sketch of every row; rid names the set, null if empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")], size)
            signs = [minwise(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if m is None else m[:PATHS].astype(np.uint32).tobytes() for m in signs], pa.binary()),
                    pa.array([None if m is None else m[PATHS:].astype(np.uint8).tobytes() for m in signs], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "rid", "paths", "sketch"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, rid binary, paths binary, sketch binary"), "near-vertices")


def _children(nodes: DataFrame, depth: int) -> DataFrame:
    """node, v: children of (node, v, paths, sketch, pivot, p_sketch); the root's children at depth 0.

    Vertices like the pivot come back with it, without a node; those that all but equal it end there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if depth:
                sketch, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "p_sketch"))
                like = (sketch == pivot).mean(axis=1)
                linked = batch.filter(pa.array(like >= LOOSE))
                yield pa.RecordBatch.from_arrays([pa.nulls(linked.num_rows, pa.int64()), linked.column("v"), linked.column("pivot")], names=["node", "v", "pivot"])
                batch = batch.filter(pa.array(like < STRONG))
            paths = np.frombuffer(b"".join(batch.column("paths").to_pylist()), np.uint32).reshape(-1, PATHS).astype(U)
            if depth == 0:
                picks = np.tile(np.arange(TREES), (len(paths), 1))
                base = rolling.mix(np.arange(1, TREES + 1, dtype=U))[None, :].repeat(len(paths), axis=0)
            else:
                name = batch.column("node").to_numpy().view(U)
                # BRANCH different functions, selected by the node's name
                spare = U(PATHS - TREES)
                one = rolling.mix(name ^ U(depth)) % spare
                two = (one + U(1) + rolling.mix(name ^ U(depth + 100)) % (spare - U(1))) % spare
                picks = np.stack([one, two][:BRANCH], axis=1).astype(np.int64) + TREES
                base = name[:, None].repeat(BRANCH, axis=1)
            values = np.take_along_axis(paths, picks, axis=1)
            child = rolling.mix(rolling.mix(base + U(depth)) ^ rolling.mix(values + (picks.astype(U) << U(40)))).view(np.int64)
            n = child.shape[1]
            same = batch.column("v").take(pa.array(np.repeat(np.arange(len(paths)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(child.ravel()), same, pa.nulls(len(same), pa.int64())], names=["node", "v", "pivot"])

    return nodes.mapInArrow(run, "node long, v long, pivot long")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i in range(1, len(cells) + 1):
            if i == len(cells) or cells[i] != cells[start]:
                if held and cells[start] != current:
                    yield current, pa.Table.from_batches(held)
                    held = []
                current = cells[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield current, pa.Table.from_batches(held)


def link_all(n: int, near: Callable[[int, np.ndarray], np.ndarray], queries: int = 0) -> np.ndarray:
    """Component labels (least member) when near(i, others) tells which of the others i is linked with.

    Every pair of members is asked unless it is known to lie in one component. With ``queries``,
    only the first so many members ask, and only the others are asked.
    """
    labels = np.arange(n)
    count = n
    for i in range(queries or n):
        if count == 1:
            break
        others = np.arange(max(i + 1, queries), n)
        others = others[labels[others] != labels[i]]
        hit = others[near(i, others)] if len(others) else others
        if len(hit):
            old = np.unique(np.append(labels[hit], labels[i]))
            labels[np.isin(labels, old)] = old[0]
            count -= len(old) - 1
    return labels


def sketch_near(sketches: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda i, others: (sketches[others] == sketches[i]).mean(axis=1) >= LOOSE


def exact_near(sets: list[np.ndarray], sketches: np.ndarray, threshold: int = THRESHOLD) -> Callable[[int, np.ndarray], np.ndarray]:
    """Exact links, asked only of pairs whose sketches and sizes allow one."""
    sizes = np.array([len(s) for s in sets])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fits = (100 * np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i])) & ((sketches[others] == sketches[i]).mean(axis=1) >= LOOSE)
        out = np.zeros(len(others), bool)
        for k in np.flatnonzero(fits).tolist():
            other = sets[others[k]]
            at = np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)
            shared = int((sets[i][at] == other).sum())
            out[k] = 100 * shared >= threshold * (sizes[i] + len(other) - shared)
        return out

    return near


def _forest(rows: DataFrame, exact: bool, threshold: int = THRESHOLD) -> DataFrame:
    """u, v, apart: links of each (grp, block) from its members to the first of their component.

    ``apart`` marks members whose component in the block lacks the pivot, if there are more blocks.
    Rows with role 1 are asked against those with role 0 instead, if there are any.
    """
    kind = rows.schema["member"].dataType.simpleString()
    arrow = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, table in groups(batches, ["grp", "block"]):
            out += solve(table)
            if len(out) > 5000:
                yield pack(out)
                out = []
        yield pack(out)

    def solve(table: pa.Table) -> list[tuple]:
        members, roles, pivots = (table.column(c).to_pylist() for c in ("member", "role", "pivot"))
        seen: dict = {}
        for i in sorted(range(len(members)), key=lambda i: (-roles[i], members[i] != pivots[i], members[i])):
            seen.setdefault(members[i], i)
        order, names = list(seen.values()), list(seen)
        if len(names) < 2:
            return []
        sketches = np.frombuffer(b"".join(table.column("sketch")[i].as_py() for i in order), np.uint8).reshape(len(order), SKETCH)
        asking = sum(roles[i] for i in order)
        near = exact_near([np.frombuffer(table.column("values")[i].as_py(), U) for i in order], sketches, threshold) if exact else sketch_near(sketches)
        labels = link_all(len(order), near, asking)
        lone = pivots[0] is not None and not asking
        return [(names[k], names[i], bool(lone and k != 0)) for i, k in enumerate(labels.tolist()) if k != i or lone and k != 0]

    def pack(out: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, [arrow, arrow, pa.bool_()], strict=True)], names=["u", "v", "apart"])

    dealt = rows.repartition("grp", "block").sortWithinPartitions("grp", "block")
    return dealt.mapInArrow(run, f"u {kind}, v {kind}, apart boolean")


def forest(sized: DataFrame, exact: bool, divided: bool, block: int, threshold: int = THRESHOLD) -> DataFrame:
    """Staged links (u, v) that connect what is linked in each group. sized: grp, n, pivot, member and payload.

    Groups over ``block`` (``divided`` tells whether there are any) go in blocks with the group's
    pivot; what a block doesn't connect to it is asked against all other blocks, in parts of at most
    about a block.
    """
    payload = ["sketch"] + (["values"] if exact else [])
    none = F.lit(None).cast(sized.schema["member"].dataType)
    if not divided:
        rows = sized.select("grp", "member", *payload, F.lit(0).alias("block"), F.lit(0).alias("role"), none.alias("pivot"))
        return stage(_forest(rows, exact, threshold).select("u", "v").distinct(), "near-links", outer=True)
    with scratch():
        sized = stage(sized.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")), "near-blocks")
        places = F.when((F.col("blocks") > 1) & (F.col("member") == F.col("pivot")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
        rows = sized.select("grp", "member", *payload, F.explode(places).alias("block"), F.lit(0).alias("role"), F.when(F.col("blocks") > 1, F.col("pivot")).alias("pivot"))
        links = stage(_forest(rows, exact, threshold), "near-links")
        found = links.select("u", "v")
        apart = links.where("apart").select(F.col("v").alias("member")).distinct()
        if not apart.isEmpty():
            lone = sized.where("blocks > 1").join(apart, "member", "left_semi")
            counts = lone.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
            asked = lone.join(counts, "grp").withColumn("part", F.pmod(F.xxhash64("member", F.lit(1)), F.col("parts")).cast("int"))
            asked = asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("at <> own")
            against = sized.where("blocks > 1").join(counts, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            number = lambda a: (F.col(a).cast("long") * F.lit(1 << 31) + F.col("part")).alias("block")
            both = asked.select("grp", "member", *payload, number("at"), F.lit(1).alias("role"), none.alias("pivot")).unionByName(
                against.select("grp", "member", *payload, number("own"), F.lit(0).alias("role"), none.alias("pivot"))
            )
            found = found.unionByName(_forest(both, exact, threshold).select("u", "v"))
        return stage(found.distinct(), "near-links", outer=True)


def loose_links(reps: DataFrame) -> DataFrame:
    """u, v: links by sketch within the nodes of all trees. reps: v, paths, sketch.

    A vertex is a set's 64-bit number here; should two sets share it, they are compared as one and
    both go on to the exact comparison.
    """
    found = []
    with scratch():
        nodes = stage(_children(reps.select("v", "paths"), 0).select("node", "v"), "near-nodes")
        for depth in range(1, DEPTH + 1):
            sizes = stage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("pivot")).where("n > 1"), "near-sizes")
            last = depth == DEPTH
            large = stage(sizes.where(F.col("n") > LEAF), "near-large")
            more = not large.isEmpty()
            # joins of growing tables never broadcast
            members = nodes.join((sizes if last else sizes.where(F.col("n") <= LEAF)).hint("merge"), "node")
            members = members.join(reps.select("v", "sketch").hint("merge"), "v").select(F.col("node").alias("grp"), "n", "pivot", F.col("v").alias("member"), "sketch")
            found.append(forest(members, False, last and more, LEAF))
            if last or not more:
                break
            pivots = large.join(reps.select(F.col("v").alias("pivot"), F.col("sketch").alias("p_sketch")), "pivot").select("node", "pivot", "p_sketch")
            grown = stage(_children(nodes.join(pivots, "node").join(reps, "v"), depth), "near-nodes")
            found.append(stage(grown.where("node is null").select(F.col("pivot").alias("u"), "v").distinct(), "near-links"))
            nodes = grown.where("node is not null").select("node", "v").distinct()
        return stage(reduce(DataFrame.unionByName, found).distinct(), "near-loose", outer=True)


def with_components(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id of every row, staged."""
    with scratch():
        rows = vertices(docs, size)
        slim = rows.select("doc_id", "text_key", "n_shingles", "rid")
        reps = rows.where("rid is not null").groupBy("rid").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("paths").alias("paths"), F.min("sketch").alias("sketch"))
        reps = stage(reps.withColumn("v", F.xxhash64("rid")), "near-sets")
        clusters = components(loose_links(reps.select("v", "paths", "sketch")))
        members = stage(clusters.join(reps.hint("merge"), "v").select("rid", F.col("label").alias("grp"), "one"), "near-members")
        sizes = stage(members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("pivot")), "near-clusters")
        divided = not sizes.where(F.col("n") > BLOCK).isEmpty()
        known = members.join(sizes, "grp").select(F.col("one.doc_id").alias("m_doc"), F.col("one.text_key").alias("m_key"), "grp", "n", "pivot", F.col("rid").alias("member"))
        known = bounded(stage(known, "near-known"))
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        same = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("text_key") == F.col("m_key"))
        chosen = texts.join(known, same).select("grp", "n", "pivot", "member", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = shingle_sets([t.as_py().encode("utf-8", "surrogatepass") for t in batch.column("text")], size)
                signs = [minwise(s)[PATHS:].astype(np.uint8).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(signs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "sketch", "values"])

        kept = ["grp", "n", "pivot", "member"]
        links = forest(chosen.mapInArrow(run, "grp long, n long, pivot binary, member binary, sketch binary, values binary"), True, divided, BLOCK, threshold)
        # links of an undivided cluster lead to its components' first members, so they name components already
        labels = components(links) if divided else links.select("v", F.col("u").alias("label"))
        named = slim.join(labels.hint("merge"), slim["rid"] == labels["v"], "left").withColumn("label", F.coalesce("label", "rid")).drop("v")
        least = stage(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")), "near-names")
        # most components are one set: only names are joined, and rows of a hot one are the side that Spark splits
        own = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return stage(named.join(least.hint("merge"), "label", "left").select("doc_id", "text_key", "n_shingles", own.alias("component_id")), "near-named", outer=True)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, the one with the smallest id, columns unchanged; those without words stay.

    Of several texts with that id the one with the smallest key stays; rows with equal ids and texts
    are one document.
    """
    named = with_components(docs, **options)
    first = named.where("n_shingles > 0").groupBy(F.col("component_id").alias("c")).agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("doc_id", "text_key"))).alias("one"))
    gone = named.where("n_shingles > 0").join(first, F.col("component_id").eqNullSafe(F.col("c"))).select("doc_id", "text_key", F.struct("doc_id", "text_key").eqNullSafe(F.col("one")).alias("stays"))
    drop = stage(gone.where("not stays").select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct(), "near-dropped")
    same = docs["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    left = docs.join(bounded(drop), same, "left_anti")
    # equal rows of the one that stays: all but one go
    return left.dropDuplicates(["doc_id", "text"]) if docs.select("doc_id").groupBy("doc_id").count().where("count > 1").limit(1).count() else left


def op7_chosen_path(spark, sf_dir: str) -> DataFrame:
    found = with_components(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP7_SQL = r"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), sh as (
  select distinct doc_id, array_to_string(list_slice(w, s, s + least(len(w), 5) - 1), ' ') as g
  from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(s) where len(w) > 0
), n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (g) where a.doc_id < b.doc_id group by all),
links as (
  select x, y from pairs join n as p on p.doc_id = x join n as q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)
), both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as v, doc_id as r from d union select y, r from reach join both_ways on x = v),
least_of as (select v, min(r) as component_id from reach group by 1)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept
from d join least_of on v = doc_id left join n using (doc_id)
"""


ship(__name__)
