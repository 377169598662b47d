"""Merkle fixity audit of WARC replicas.

A replica's records are hashed where they lie; nothing but digests leaves the scan. Within a file
the records are ordered by offset, and every FANOUT neighbouring digests are hashed into a node that
covers their offset range, up to one root per file; file roots are joined in the same way into the
root of the archive. Two replicas compare roots, and only below nodes that differ are children
compared at all, down to the records: an intact replica costs one comparison, a corrupt record one
path.

Layout: files hold FILE_RECORDS ids each, by number; a record without an id goes to a file by its
hash. Files over MOST_RECORDS records are divided by a hash of the record.

Cases: null urls and bodies are empty; rows without an id are records like others; equal rows are
records of their own and lie side by side; a replica that ends early reports the records that it
lacks as missing, one that has more reports them as extra; empty archives are equal to one another;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, scratch, ship, small_batches, stage

FANOUT = 16
FILE_RECORDS, MOST_RECORDS = 1000, 4000
#: Files that records without an id are dealt to, below zero.
NAMELESS_FILES = 1 << 20
KEY = ["file", "part"]

HEADER = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{id}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {n}\r\n\r\n"


def record_bytes(name: Column, url: Column, body: Column) -> Column:
    """A whole record: header, body, and the two line ends after it."""
    body = F.coalesce(body, F.lit(""))
    parts = re.split(r"(\{\w+\})", HEADER)
    values = {"{id}": F.coalesce(name.cast("string"), F.lit("")), "{url}": F.coalesce(url, F.lit("")), "{n}": F.octet_length(body).cast("string")}
    return F.encode(F.concat(*[values.get(p, F.lit(p)) for p in parts if p], body, F.lit("\r\n\r\n")), "UTF-8")


def leaves(pages: DataFrame) -> DataFrame:
    """file, part, pos, first, after, digest, page_id, url: the records of an archive, staged; bodies stay where they are."""
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    slim = pages.select("page_id", "url", F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    base = F.floor(F.col("page_id") / FILE_RECORDS).cast("long")
    slim = stage(slim.withColumn("file", F.coalesce(base, -1 - F.pmod(F.xxhash64("digest"), F.lit(NAMELESS_FILES)))), "warc-records")
    large = stage(slim.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_RECORDS).select("file", F.ceil(F.col("n") / FILE_RECORDS).cast("int").alias("parts")), "warc-large")
    slim = slim.join(bounded(large), "file", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("digest"), F.col("parts")), F.lit(0)).cast("int"))
    order = "over (partition by file, part order by page_id, url, digest"
    placed = slim.withColumn("pos", F.expr(f"row_number() {order}) - 1").cast("long")).withColumn("after", F.expr(f"sum(length) {order} rows unbounded preceding)"))
    return stage(placed.select(*KEY, "pos", (F.col("after") - F.col("length")).alias("first"), "after", "digest", "page_id", "url"), "warc-leaves")


def scan_files(files: DataFrame) -> DataFrame:
    """file, part, pos, first, after, digest, page_id, url of the records in WARC files (file: number, content: bytes)."""
    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(number, 0, *r) for number, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in parse(content or b"")]
            cells = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["file", "part", "pos", "first", "after", "digest", "page_id", "url"])

    return stage(files.select("file", "content").mapInArrow(run, "file long, part int, pos long, first long, after long, digest string, page_id long, url string"), "warc-leaves")


def parse(content: bytes) -> list[tuple]:
    """(pos, first, after, digest, id, url) of the records of a file; what can't be read up to its end is one last record."""
    out, at = [], 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        fields = dict(re.findall(rb"^([\w-]+):[ \t]*([^\r\n]*)", content[at:head], re.M)) if content.startswith(b"WARC/", at) and head >= 0 else {}
        size = fields.get(b"Content-Length", b"")
        end = head + 4 + int(size) + 4 if size.isdigit() else len(content)
        end = min(end, len(content))
        name = re.search(rb"urn:page:(-?\d+)", fields.get(b"WARC-Record-ID", b""))
        out.append((len(out), at, end, hashlib.sha256(content[at:end]).hexdigest(), int(name[1]) if name else None, fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace")))
        at = end
    return out


def _parents(nodes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One level up: every FANOUT neighbours by ``at`` become a node over their range."""
    up = nodes.withColumn("up", F.floor(F.col(at) / FANOUT).cast("long"))
    children = F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), "digest")))  # FANOUT at most
    joined = up.groupBy(*keys, F.col("up").alias(at)).agg(children.alias("c"), F.min("first").alias("first"), F.max("after").alias("after"))
    # places are part of what is hashed, so a gap isn't the same as a shift
    text = F.array_join(F.transform("c", lambda x: F.concat((x["i"] % FANOUT).cast("string"), F.lit(":"), x["digest"])), ",")
    return joined.select(*keys, at, F.sha2(text, 256).alias("digest"), "first", "after")


def levels_of(most: int) -> int:
    """Levels above places 0..most until one is left."""
    n = 0
    while most > 0:
        most //= FANOUT
        n += 1
    return n


def trees(records: DataFrame, inner: int, outer: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node tables of the files, records first, and of the archive, file roots first; all staged.

    ``inner`` and ``outer`` are the numbers of levels, the same for both replicas.
    """
    files = [records.select(*KEY, "pos", "digest", "first", "after")]
    for _ in range(inner):
        files.append(stage(_parents(files[-1], KEY, "pos"), "warc-nodes"))
    roots = files[-1].groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("p"), F.min("first").alias("first"), F.max("after").alias("after"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["digest"])), ",")
    # numbers below zero go above all others, so that places divide evenly
    place = F.when(F.col("file") < 0, F.lit(1 << 40) - F.col("file")).otherwise(F.col("file"))
    archive = [stage(roots.select(place.alias("place"), F.sha2(text, 256).alias("digest"), "first", "after"), "warc-nodes")]
    for _ in range(outer):
        archive.append(stage(_parents(archive[-1], [], "place"), "warc-nodes"))
    return files, archive


def _differ(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values])
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values])
    return left.join(right, keys, "full_outer").where("not a_digest <=> b_digest")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, part, pos, kind (changed, missing, extra), and both sides' ranges of each corrupt record, staged.

    Both sides are staged tables of records. Mismatches are joined by broadcast up to a counted size.
    """
    with scratch():
        top = lambda df: df.agg(F.max("pos"), F.max(F.when(F.col("file") < 0, F.lit(1 << 40) - F.col("file")).otherwise(F.col("file")))).first()
        (p1, f1), (p2, f2) = top(ours), top(theirs)
        inner, outer = levels_of(max(p1 or 0, p2 or 0)), levels_of(max(f1 or 0, f2 or 0))
        mine, others = trees(ours, inner, outer), trees(theirs, inner, outer)
        bad = stage(_differ(mine[1][-1], others[1][-1], ["place"], ["digest"]).select("place"), "warc-differ")
        for level in range(outer - 1, -1, -1):
            if bad.isEmpty():
                break
            below = [_under(t[1][level], bad, ["place"], "place") for t in (mine, others)]
            bad = stage(_differ(*below, ["place"], ["digest"]).select("place"), "warc-differ")
        number = F.when(F.col("place") >= 1 << 40, F.lit(1 << 40) - F.col("place")).otherwise(F.col("place"))
        bad_files = stage(bad.select(number.alias("file")), "warc-differ")
        below = [t[0][inner].join(bounded(bad_files), "file", "left_semi") for t in (mine, others)]
        bad = stage(_differ(*below, [*KEY, "pos"], ["digest"]).select(*KEY, "pos"), "warc-differ")
        for level in range(inner - 1, -1, -1):
            below = [_under(t[0][level], bad, [*KEY, "pos"], "pos") for t in (mine, others)]
            values = ["digest"] if level else ["digest", "first", "after"]
            found = _differ(*below, [*KEY, "pos"], values)
            bad = stage(found if level == 0 else found.select(*KEY, "pos"), "warc-differ")
        if not inner:
            below = [t[0][0].join(bounded(bad), [*KEY, "pos"], "left_semi") for t in (mine, others)]
            bad = stage(_differ(*below, [*KEY, "pos"], ["digest", "first", "after"]), "warc-differ")
        kind = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra").otherwise("changed")
        return stage(bad.select(*KEY, "pos", kind.alias("kind"), "a_first", "a_after", "b_first", "b_after"), "warc-corrupt", outer=True)


def _under(nodes: DataFrame, parents: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Nodes below the given parents."""
    named = nodes.withColumn("__up", F.floor(F.col(at) / FANOUT).cast("long"))
    above = parents.withColumnRenamed(at, "__up")
    return named.join(bounded(above), [k for k in keys if k != at] + ["__up"], "left_semi").drop("__up")


def archive_root(records: DataFrame) -> str | None:
    """Root of an archive; None for an empty one."""
    with scratch():
        p, f = records.agg(F.max("pos"), F.max("file")).first()
        if p is None:
            return None
        found = trees(records, levels_of(p), levels_of(f if f >= 0 else 1 << 41))[1][-1].first()
        return found.digest


#: Faults that the query plants in its replica: a changed byte in the bodies of these ids, and files that end early.
CHANGED, SHORT, CUT = (101, 7), (13, 5), 3


def replica(pages: DataFrame) -> DataFrame:
    """Pages as a damaged replica has them: some bodies with another first character."""
    hit = (F.col("page_id") % CHANGED[0] == CHANGED[1]) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def op2_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """Every record of the archive of all pages, with what the audit of a damaged replica says of it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    ours, theirs = leaves(pages), leaves(replica(pages))
    ends = theirs.groupBy(*KEY).agg((F.max("pos") - CUT).alias("last")).where(F.col("file") % SHORT[0] == SHORT[1])
    theirs = stage(theirs.join(ends, KEY, "left").where("last is null or pos <= last").drop("last"), "warc-leaves")
    found = audit(ours, theirs).select(*KEY, "pos", "kind")
    joined = ours.join(bounded(found), [*KEY, "pos"], "left")
    return joined.select(
        "page_id", "url", F.col("file").alias("warc_file"), F.col("first").alias("record_offset"), (F.col("after") - F.col("first")).alias("record_length"),
        F.col("digest").alias("record_sha256"), F.coalesce("kind", F.lit("intact")).alias("status"),
    )


OP2_SQL = r"""
with r as (
  select page_id, url, html, page_id // 1000 as f, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) as b from pages
), o as (
  select *, strlen(b) as n, sum(strlen(b)) over (partition by f order by page_id) as after, row_number() over (partition by f order by page_id desc) as from_end from r
)
select page_id, url, cast(f as bigint) as warc_file, cast(after - n as bigint) as record_offset, cast(n as bigint) as record_length, sha256(b) as record_sha256,
  case when f % 13 = 5 and from_end <= 3 then 'missing' when page_id % 101 = 7 and left(html, 1) <> '?' then 'changed' else 'intact' end as status from o
"""

ship(__name__)
