"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``size`` words of every text is hashed. Hashes travel in bulk: a task packs those of
a chunk of documents by bucket, 8 bytes each, in text order. A bucket is a second, independent hash,
so that a match means equality of both. Within a chunk the earliest window of each hash alone is
sent (pre-aggregation before the shuffle, so a passage in a third of all rows is sent once a chunk);
the others are known to be repeats at once. Buckets then find, for each hash, the earliest start by
(doc_id, start), and name the windows of all other documents. Those come back to their documents,
where repeated windows merge into maximal removal intervals.

A false match needs two different windows with equal 64-bit hashes in one bucket. With W windows in
2**b buckets about W**2 / 2**(65 + b) are to be expected: 2e-4 for half a gigabyte, and about one for
100 TB, where buckets are as many more.

Cases: null and empty texts have no words; a text of fewer words than a window loses none; null ids
come after all others; rows with equal id and text are one document and lose the same words; rows
with one id and different texts are ordered by the text's CRC; other columns are ignored; an empty
table gives an empty result. Long texts are hashed in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rolling
from tessera.llm.common import documents, ship, small_batches, stage

WINDOW = 20
#: Bytes of text in a task's chunk, in a bucket's share and in a block of documents.
CHUNK, PER_BUCKET, PER_BLOCK = 6 << 20, 8 << 20, 8 << 20
NO_ID = np.iinfo(np.int64).max

MESSAGE = "place long, kind int, doc_ids binary, crcs binary, counts binary, data binary"


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in column]


def _block(ids: np.ndarray, crcs: np.ndarray, blocks: int) -> np.ndarray:
    return (rolling.mix(ids.view(rolling.U) ^ rolling.mix(crcs.astype(rolling.U))) % rolling.U(blocks)).astype(np.int64)


def window_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows that lie within one text, their second hashes, and the first window of each text."""
    lengths = np.maximum(np.diff(bounds) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(lengths)])
    keep = np.repeat(bounds[:-1] - first[:-1], lengths) + np.arange(first[-1])
    return rolling.windows(words, size)[keep], rolling.windows(words, size, rolling.BASE2)[keep], first


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=[n.split()[0] for n in MESSAGE.split(", ")])


def chunk_messages(ids: np.ndarray, crcs: np.ndarray, texts: list[bytes], size: int, buckets: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Of a chunk: for each bucket the documents and hashes of the earliest windows (kind 1), and for
    each block the runs of windows that are repeats within the chunk (kind 2: start and end)."""
    order = np.lexsort((crcs, ids))
    order = order[np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(crcs[order].astype(np.int64)) != 0)])] if len(order) else order
    ids, crcs = ids[order], crcs[order]
    words, bounds = rolling.word_hashes([texts[i] for i in order])
    hashes, second, first = window_hashes(words, bounds, size)
    if not len(hashes):
        return
    bucket = (second % rolling.U(buckets)).astype(np.int64)
    # by bucket and hash; the stable order keeps the earliest first
    by_hash = np.argsort(hashes, kind="stable")
    by_hash = by_hash[np.argsort(bucket[by_hash], kind="stable")]
    fresh = np.concatenate([[True], (np.diff(hashes[by_hash]) != 0) | (np.diff(bucket[by_hash]) != 0)])
    repeat = np.zeros(len(hashes), bool)
    repeat[by_hash[~fresh]] = True
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    rows = []
    if repeat.any():
        at = np.flatnonzero(repeat)
        begins = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0)])
        starts, lasts = at[begins], at[np.concatenate([begins[1:], [True]])]
        who = owner[starts]
        spans = np.stack([starts - first[who], lasts + 1 - first[who]], axis=1).astype(np.int64)
        block = _block(ids, crcs, blocks)[who]
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            docs, counts = np.unique(who[own], return_counts=True)
            rows.append((-1 - int(b), 2, ids[docs].tobytes(), crcs[docs].tobytes(), counts.astype(np.uint32).tobytes(), spans[own].tobytes()))
    sent = np.flatnonzero(~repeat)
    sent = sent[np.argsort(bucket[sent], kind="stable")]  # by bucket, in text order
    cuts = np.searchsorted(bucket[sent], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = sent[cuts[b] : cuts[b + 1]]
        docs, counts = np.unique(owner[own], return_counts=True)
        rows.append((int(b), 1, ids[docs].tobytes(), crcs[docs].tobytes(), counts.astype(np.uint32).tobytes(), hashes[own].tobytes()))
        if len(rows) >= 64:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def repeated_in_bucket(messages: list[tuple[bytes, bytes, bytes, bytes]], blocks: int) -> Iterator[tuple]:
    """For each block the documents and hashes of the bucket's windows that start earlier elsewhere (kind 1)."""
    ids = np.concatenate([np.frombuffer(m[0], np.int64) for m in messages])
    crcs = np.concatenate([np.frombuffer(m[1], np.uint32) for m in messages])
    counts = np.concatenate([np.frombuffer(m[2], np.uint32) for m in messages])
    hashes = np.concatenate([np.frombuffer(m[3], rolling.U) for m in messages])
    order = np.lexsort((crcs, ids))
    rank = np.empty(len(ids), np.int64)
    new = np.concatenate([[0], ((np.diff(ids[order]) != 0) | (np.diff(crcs[order].astype(np.int64)) != 0)).astype(np.int64)])
    rank[order] = np.cumsum(new)
    owner = np.repeat(np.arange(len(ids)), counts)
    by = np.argsort(hashes, kind="stable")
    sorted_hashes, ranks = hashes[by], rank[owner[by]]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(sorted_hashes) != 0]))
    least = np.repeat(np.minimum.reduceat(ranks, begins), np.diff(np.concatenate([begins, [len(by)]])))
    late = np.sort(by[ranks > least])
    if not len(late):
        return
    who = owner[late]
    block = _block(ids, crcs, blocks)[who]
    order = np.argsort(block, kind="stable")
    late, who, block = late[order], who[order], block[order]
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(block) != 0])), [len(block)]])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        docs, counts = np.unique(who[a:z], return_counts=True)
        yield (-1 - int(block[a]), 1, ids[docs].tobytes(), crcs[docs].tobytes(), counts.astype(np.uint32).tobytes(), hashes[late[a:z]].tobytes())


def repeats(docs: DataFrame, size: int, total: int) -> tuple[DataFrame, int]:
    """Messages to blocks of documents about their repeated windows, staged; and the number of blocks."""
    small_batches(docs.sparkSession)
    buckets, blocks = max(1, -(-total // PER_BUCKET)), max(1, -(-total // PER_BLOCK))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, crcs, texts, held = [], [], [], 0
        for batch in batches:
            new, numbers, marks = _texts(batch.column("text")), _ids(batch.column("id")), batch.column("crc").to_numpy().astype(np.uint32)
            for i, text in enumerate(new):
                ids.append(numbers[i])
                crcs.append(marks[i])
                texts.append(text)
                held += len(text)
                if held >= CHUNK:
                    yield from chunk_messages(np.array(ids, np.int64), np.array(crcs, np.uint32), texts, size, buckets, blocks)
                    ids, crcs, texts, held = [], [], [], 0
        if texts:
            yield from chunk_messages(np.array(ids, np.int64), np.array(crcs, np.uint32), texts, size, buckets, blocks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] < 0:
                    yield _rows([row])
                    continue
                if row[0] != place and held:
                    yield _rows(list(repeated_in_bucket(held, blocks)))
                    held = []
                place = row[0]
                held.append(row[2:])
        if held:
            yield _rows(list(repeated_in_bucket(held, blocks)))

    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"), "text")
    sent = source.mapInArrow(send, MESSAGE)
    return stage(sent.repartition("place").sortWithinPartitions("place").mapInArrow(find, MESSAGE), "repeated-windows"), blocks


def removed_words(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Mask of the words that the windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 of every row. The kept text has its words joined by spaces."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    messages, blocks = repeats(docs, size, total)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _block(_ids(batch.column("doc_id")), batch.column("crc").to_numpy().astype(np.uint32), blocks)
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(-1 - block), pa.array(np.zeros(batch.num_rows, np.int32)), none, none, none, none, batch.column("doc_id"), batch.column("crc"), batch.column("text")],
                names=["place", "kind", "doc_ids", "crcs", "counts", "data", "doc_id", "crc", "text"],
            )

    schema = MESSAGE + ", doc_id long, crc long, text string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc.alias("crc"), "text").mapInArrow(place, schema)
    both = rows.unionByName(messages, allowMissingColumns=True)
    # a block's messages come before its documents, which then stream
    dealt = both.repartition("place").sortWithinPartitions("place", F.desc("kind"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, late, runs = None, {}, {}
        for batch in batches:
            out, pending = [], []
            places, kinds = batch.column("place").to_pylist(), batch.column("kind").to_pylist()
            for i in range(batch.num_rows):
                if places[i] != block:
                    out += kept(pending, late, runs)
                    block, late, runs, pending = places[i], {}, {}, []
                if kinds[i] == 0:
                    pending.append((batch.column("doc_id")[i].as_py(), batch.column("crc")[i].as_py(), batch.column("text")[i].as_py() or ""))
                    continue
                ids, crcs, counts, data = (batch.column(c)[i].as_py() for c in ("doc_ids", "crcs", "counts", "data"))
                values = np.frombuffer(data, rolling.U) if kinds[i] == 1 else np.frombuffer(data, np.int64).reshape(-1, 2)
                into, at = (late if kinds[i] == 1 else runs), 0
                for doc, mark, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(crcs, np.uint32).tolist(), np.frombuffer(counts, np.uint32).tolist(), strict=True):
                    into.setdefault((doc, mark), []).append(values[at : at + n])
                    at += n
            out += kept(pending, late, runs)
            cells = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    def kept(pending: list, late: dict, runs: dict) -> list[tuple]:
        out = []
        for doc, mark, text in pending:
            data = text.encode("utf-8", "surrogatepass")
            words = data.split()
            key, gone = (NO_ID if doc is None else doc, mark), 0
            if key in late or key in runs:
                own, bounds = rolling.word_hashes([data])
                starts = [np.arange(a, z) for part in runs.get(key, ()) for a, z in part.tolist()]
                if key in late:
                    starts.append(np.flatnonzero(np.isin(window_hashes(own, bounds, size)[0], np.concatenate(late[key]))))
                mask = removed_words(len(words), np.concatenate(starts), size)
                gone = int(mask.sum())
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            joined = b" ".join(words)
            out.append((doc, len(words) + gone, gone, joined.decode("utf-8", "replace"), hashlib.sha256(joined).hexdigest()))
        return out

    return dealt.mapInArrow(merge, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op4_rabin_karp_windows(spark, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
with doc as (
  select row_number() over (order by doc_id) as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents
), win as (
  select r, s, hash(list_slice(w, s, s + 19)) as h, md5(array_to_string(list_slice(w, s, s + 19), ' ')) as g
  from doc, unnest(range(1, len(w) - 18)) as u(s) where len(w) >= 20
), late as (
  select r, s from (select r, s, row_number() over (partition by h, g order by r, s) as nth from win) where nth > 1
), gone as (
  select r, list(distinct p) as ps from late, unnest(range(s, s + 20)) as u(p) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
       sha256(case when ps is null then array_to_string(w, ' ')
              else coalesce((select string_agg(x, ' ' order by i) from (select unnest(w) as x, unnest(range(1, len(w) + 1)) as i) where not list_contains(ps, i)), '') end) as kept_sha256
from doc left join gone using (r)
"""

ship(__name__)
