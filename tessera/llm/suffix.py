"""Substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Sorting all suffixes of a corpus on one machine doesn't scale, so the transform is taken over a
sparse suffix array, dealt out by content. A text's anchors are the places whose K-byte hash is the
least among the starts of some stretch of ``size`` bytes; every such stretch holds one, and equal
stretches hold the same one at the same offset. Only anchors that occur twice matter: their contexts
go to one task per anchor. There the suffixes that begin at the anchors are sorted, which gives the
intervals of common prefixes. Intervals are extended backward, breadth first: at each level every
suffix shows the byte before it (its symbol in the transform), a stable partition by that byte
divides the intervals, and an interval whose common prefix has reached ``size`` bytes, the extension
included, consists of repeated stretches. Extension ends at the greatest offset that an anchor can
have; intervals of one suffix end at once.

A context that a block of documents has twice is repeated as a whole, so one copy of it is sent.
An anchor with more contexts than fit a task (GROUP) is divided, by the bytes around it, into groups
that share no stretch with one another, until each fits; those are expanded like all others.

Cases: null and empty texts have no bytes; texts under ``size`` bytes lose none; equal rows are
copies of one another and lose all repeated bytes; other columns are ignored; an empty table gives
an empty result. Anchors of long texts are taken from overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import rolling
from tessera.llm.common import bounded, documents, ship, small_batches, stage
from tessera.llm.minhash import groups
from tessera.llm.substring import MESSAGE, NO_ID, _block, _ids, _rows, _texts

SIZE, K = 400, 64
PER_BUCKET, PER_BLOCK, PIECE = 32 << 20, 8 << 20, 1 << 20
#: Contexts of an anchor in one task, and rows that are expanded together.
GROUP, TOGETHER = 4_000, 6_000
U = rolling.U
LOW = U((1 << 24) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, from block-wise running minima of both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _piece_anchors(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = rolling.windows(rolling.BYTES[codes], K)
    width = size - K + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, U)
    least = sliding_least((hashes & ~LOW) | np.arange(len(hashes), dtype=U), width) & LOW
    at = np.unique(least[np.concatenate([[True], np.diff(least) != 0])]).astype(np.int64)
    return at, hashes[at]


def anchors(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of every anchor, by text and position."""
    owners, places, marks = [], [], []
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            ends = np.cumsum([len(texts[i]) for i in group])
            at, hashes = _piece_anchors(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), size)
            who = np.searchsorted(ends, at, side="right")
            inside = at + K <= ends[who] if len(at) else np.zeros(0, bool)
            owners.append(np.array(group)[who[inside]])
            places.append(at[inside] - (ends - [len(texts[i]) for i in group])[who[inside]])
            marks.append(hashes[inside])
            group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) < size:
            continue
        if len(text) > PIECE:
            flush()
            codes, found = np.frombuffer(text, np.uint8), {}
            for a in range(0, len(text) - size + 1, PIECE):
                at, hashes = _piece_anchors(codes[a : a + PIECE + size - 1], size)
                found.update(zip((at + a).tolist(), hashes.tolist(), strict=True))
            at = np.array(sorted(found), np.int64)
            owners.append(np.full(len(at), i))
            places.append(at)
            marks.append(np.array([found[x] for x in at.tolist()], U))
            continue
        if held + len(text) > PIECE:
            flush()
        group.append(i)
        held += len(text)
    flush()
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(owners).astype(np.int64), np.concatenate(places).astype(np.int64), np.concatenate(marks)


def to_blocks(kind: int, ids: np.ndarray, crcs: np.ndarray, values: np.ndarray, blocks: int) -> list[tuple]:
    """Messages with a value (or a row of values) for a document each, one message a block."""
    if not len(ids):
        return []
    block = _block(ids, crcs, blocks)
    order = np.lexsort((crcs, ids, block))
    ids, crcs, values, block = ids[order], crcs[order], values[order], block[order]
    new = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(crcs.astype(np.int64)) != 0) | (np.diff(block) != 0)])
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(ids)]])).astype(np.uint32)
    out = []
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(block) != 0])), [len(block)]])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        i, j = np.searchsorted(first, [a, z])
        out.append((-1 - int(block[a]), kind, ids[first[i:j]].tobytes(), crcs[first[i:j]].tobytes(), counts[i:j].tobytes(), np.ascontiguousarray(values[a:z]).tobytes()))
    return out


def chunk_anchors(ids: np.ndarray, crcs: np.ndarray, texts: list[bytes], size: int, buckets: int, blocks: int) -> list[tuple]:
    """Messages of a chunk: to buckets one occurrence of each anchor, to blocks those that the chunk has twice."""
    owner, _, hashes = anchors(texts, size)
    if not len(hashes):
        return []
    _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    rows = to_blocks(1, ids[owner[twice]], crcs[owner[twice]], hashes[twice], blocks)
    bucket = (rolling.mix(hashes[first]) % U(buckets)).astype(np.int64)
    order = np.lexsort((owner[first], bucket))
    first, bucket = first[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = first[cuts[b] : cuts[b + 1]]
        docs, n = np.unique(owner[own], return_counts=True)
        rows.append((int(b), 1, ids[docs].tobytes(), crcs[docs].tobytes(), n.astype(np.uint32).tobytes(), hashes[own].tobytes()))
    return rows


def bucket_anchors(messages: list[tuple[bytes, bytes, bytes, bytes]], blocks: int) -> list[tuple]:
    """Messages to blocks: the anchors that more than one chunk has."""
    ids, crcs, counts = (np.concatenate([np.frombuffer(m[i], t) for m in messages]) for i, t in enumerate((np.int64, np.uint32, np.uint32)))
    hashes = np.concatenate([np.frombuffer(m[3], U) for m in messages])
    _, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(ids)), counts)
    again = np.flatnonzero(n[inverse] > 1)
    return to_blocks(1, ids[owner[again]], crcs[owner[again]], hashes[again], blocks)


def repeated_anchors(docs: DataFrame, size: int, total: int, blocks: int) -> DataFrame:
    """Staged messages to blocks of documents: their anchors that occur twice."""
    buckets = max(1, -(-total // PER_BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, crcs, texts, held = [], [], [], 0
        for batch in batches:
            numbers, marks = _ids(batch.column("id")), batch.column("crc").to_numpy()
            for i, text in enumerate(_texts(batch.column("text"))):
                ids.append(numbers[i])
                crcs.append(marks[i])
                texts.append(text)
                held += len(text)
                if held >= PER_BLOCK:
                    yield _rows(chunk_anchors(np.array(ids, np.int64), np.array(crcs, np.uint32), texts, size, buckets, blocks))
                    ids, crcs, texts, held = [], [], [], 0
        if texts:
            yield _rows(chunk_anchors(np.array(ids, np.int64), np.array(crcs, np.uint32), texts, size, buckets, blocks))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place,), table in groups(batches, ["place"]):
            rows = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
            yield _rows(rows if place < 0 else bucket_anchors([r[2:] for r in rows], blocks))

    sent = docs.mapInArrow(send, MESSAGE)
    return stage(sent.repartition("place").sortWithinPartitions("place").mapInArrow(find, MESSAGE), "repeated-anchors")


def expand(group: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset of an anchor in a repeated stretch of its row, or -1.

    group: the anchor of each row. left, right: bytes before the anchor, nearest first, and from it
    on. before, after: how many of them there are.
    """
    n = len(group)
    least, most = np.full(n, -1), np.full(n, -1)
    # the sparse suffix array of each group: order by the bytes from the anchor on
    keys = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), right], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel(), kind="stable")
    interval = np.cumsum(np.concatenate([[0], np.diff(group[order]) != 0]))

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of rows a and b, ends included."""
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 20_000):
            differ = right[a[i : i + 20_000]] != right[b[i : i + 20_000]]
            out[i : i + 20_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
        return np.minimum(out, np.minimum(after[a], after[b]))

    together = interval[1:] == interval[:-1]
    prefix = np.where(together, common(order[:-1], order[1:]), -1)
    for level in range(size - K + 1):
        if level:
            have = before[order] >= level
            symbol = np.where(have, left[order, level - 1].astype(np.int64), 256)
            if not have.all() or (together & (symbol[1:] != symbol[:-1])).any():
                by = np.argsort(interval * 257 + symbol, kind="stable")
                order, symbol = order[by], symbol[by]
                old = interval[by]
                interval = np.cumsum(np.concatenate([[0], (np.diff(old) != 0) | (np.diff(symbol) != 0)]))
                # intervals of one suffix and those without a byte before them end here
                alone = np.bincount(interval)[interval] < 2
                stay = ~alone & (symbol < 256)
                moved = by[stay]
                order, interval = order[stay], interval[stay]
                if not len(order):
                    break
                together = interval[1:] == interval[:-1]
                next_to = np.diff(moved) == 1
                fresh = np.full(len(order) - 1, -1)
                kept = together & next_to
                fresh[kept] = prefix[moved[:-1][kept]]
                new = np.flatnonzero(together & ~next_to)
                fresh[new] = common(order[new], order[new + 1])
                prefix = fresh
        long = np.flatnonzero(prefix >= size - level)
        if len(long):
            rows = order[np.union1d(long, long + 1)]
            most[rows] = level
            least[rows] = np.where(least[rows] < 0, level, least[rows])
    return least, most


CONTEXT = "anchor long, id long, crc long, pos long, begins int, context binary, settled boolean"


def contexts(dealt: DataFrame, size: int, blocks: int) -> DataFrame:
    """Staged contexts of repeated anchors (place 0), and messages about those that a block has twice."""
    schema = MESSAGE + ", " + CONTEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flagged, rows in _blocks_of(batches):
            for at in range(0, len(rows), 256):
                part = [r for r in rows[at : at + 256] if (r[0], r[1]) in flagged]
                if part:
                    yield from pick(part, flagged)

    def pick(rows: list[tuple], flagged: dict) -> Iterator[pa.RecordBatch]:
        texts = [r[2] for r in rows]
        owner, pos, hashes = anchors(texts, size)
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        seen: dict[tuple[int, int, bytes], list[tuple[int, int, int, int]]] = {}
        for i, (doc, crc, text) in enumerate(rows):
            a, z = cuts[i], cuts[i + 1]
            hit = np.isin(hashes[a:z], np.concatenate(flagged[doc, crc]))
            for p, h in zip(pos[a:z][hit].tolist(), hashes[a:z][hit].tolist(), strict=True):
                begin = max(0, p - (size - K))
                seen.setdefault((h, p - begin, text[begin : p + size]), []).append((doc, crc, p, begin))
        if not seen:
            return
        whole = [(d, c, b, b + len(k[2])) for k, places in seen.items() if len(places) > 1 and len(k[2]) >= size for d, c, _, b in places]
        if whole:
            x = np.array(whole, np.int64)
            yield both(_rows(to_blocks(2, x[:, 0], x[:, 1].astype(np.uint32), x[:, 2:], blocks)), None)
        cells = [(np.int64(np.uint64(k[0]).view(np.int64)), p[0][0], p[0][1], p[0][2], k[1], k[2], len(p) > 1) for k, p in seen.items()]
        for i in range(0, len(cells), 2000):
            yield both(None, cells[i : i + 2000])

    names, kinds = [x.split()[0] for x in schema.split(", ")], [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]

    def both(messages: pa.RecordBatch | None, cells: list | None) -> pa.RecordBatch:
        if messages is not None:
            return pa.RecordBatch.from_arrays([*messages.columns, *(pa.nulls(messages.num_rows, k) for k in kinds[6:])], names=names)
        columns = [pa.array(c, k) for c, k in zip(zip(*cells, strict=True), kinds[6:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cells), np.int64)), *(pa.nulls(len(cells), k) for k in kinds[1:6]), *columns], names=names)

    return stage(dealt.mapInArrow(run, schema), "anchor-contexts")


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, list[tuple]]]:
    """Sorted rows of blocks: (block, values by document from its messages, some of its documents)."""
    block, values, rows, held = None, {}, [], 0
    for batch in batches:
        places, kinds = batch.column("place").to_pylist(), batch.column("kind").to_pylist()
        for i in range(batch.num_rows):
            if places[i] != block:
                if rows:
                    yield block, values, rows
                block, values, rows, held = places[i], {}, [], 0
            if kinds[i]:
                ids, crcs, counts, data = (batch.column(c)[i].as_py() for c in ("doc_ids", "crcs", "counts", "data"))
                cells = np.frombuffer(data, U) if kinds[i] == 1 else np.frombuffer(data, np.int64).reshape(-1, 2)
                at = 0
                for doc, crc, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(crcs, np.uint32).tolist(), np.frombuffer(counts, np.uint32).tolist(), strict=True):
                    values.setdefault((doc, crc), []).append(cells[at : at + n])
                    at += n
            else:
                doc = batch.column("id")[i].as_py()
                text = (batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")
                rows.append((NO_ID if doc is None else doc, batch.column("crc")[i].as_py(), text))
                held += len(text)
                if held >= PER_BLOCK:
                    yield block, values, rows
                    rows, held = [], 0
    if rows:
        yield block, values, rows


def settle(rows: DataFrame, size: int, blocks: int) -> DataFrame:
    """Messages to blocks with the repeated spans around anchors, by interval expansion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, table in groups(batches, ["anchor"]):
            if table.num_rows < 2:
                continue
            held.append(table)
            n += table.num_rows
            if n >= TOGETHER:
                yield spans(pa.concat_tables(held))
                held, n = [], 0
        if held:
            yield spans(pa.concat_tables(held))

    def spans(table: pa.Table) -> pa.RecordBatch:
        anchor, ids, crcs, pos, begins = (table.column(c).to_numpy() for c in ("anchor", "id", "crc", "pos", "begins"))
        n, reach = len(anchor), size - K
        left, right = np.zeros((n, reach), np.uint8), np.zeros((n, size), np.uint8)
        after = np.empty(n, np.int64)
        for i, context in enumerate(table.column("context").to_pylist()):
            codes, b = np.frombuffer(context, np.uint8), begins[i]
            left[i, :b] = codes[:b][::-1]
            right[i, : len(codes) - b] = codes[b:]
            after[i] = len(codes) - b
        least, most = expand(anchor.view(U), left, right, begins.astype(np.int64), after, size)
        hit = (least >= 0) & ~table.column("settled").to_numpy(zero_copy_only=False)
        x = np.stack([pos - most, pos - least + size], axis=1)[hit]
        return _rows(to_blocks(2, ids[hit], crcs[hit].astype(np.uint32), x, blocks))

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, MESSAGE)


PART = CONTEXT + ", low int, high int, region binary"


def _region(context: bytes, begins: int, low: int, high: int, size: int) -> bytes:
    """Names the bytes of a context that stretches with the anchor at offsets low to high can have, and the anchor's offset in them.

    A text with a short period can have one anchor at several places whose bytes are the same part of it.
    """
    return hashlib.blake2b(min(begins, high).to_bytes(4, "little") + context[max(0, begins - high) : begins + size - low], digest_size=16).digest()


def halves(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Contexts of groups that are too large, dealt to two smaller groups each.

    A group looks for repeated stretches whose anchor lies at offsets low to high. Stretches of the
    lower half share the bytes that follow the anchor up to what the greatest of these offsets leaves
    of ``size``, those of the upper half the bytes before it down to the least of them; so rows with a
    common stretch go on together, by a hash of the shared bytes and the group. Rows too short for a
    half have no stretch there.
    """
    columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
    picked, keys, lows, highs, regions = [], [], [], [], []

    def deal(i: int, key: bytes, low: int, high: int) -> None:
        picked.append(i)
        keys.append(hashlib.blake2b(key, digest_size=8).digest())
        lows.append(low)
        highs.append(high)
        regions.append(_region(columns["context"][i], columns["begins"][i], low, high, size))

    for i, (key, begins, context, low, high) in enumerate(zip(columns["anchor"], columns["begins"], columns["context"], columns["low"], columns["high"], strict=True)):
        middle, own = (low + high) // 2, key.to_bytes(8, "little", signed=True)
        after = context[begins : begins + size - middle]
        if len(after) == size - middle and begins >= low:
            deal(i, b"<" + own + after, low, middle)
        if begins > middle and high > middle:
            deal(i, b">" + own + context[begins - middle - 1 : begins], middle + 1, high)
    rows = batch.take(pa.array(picked, pa.int64()))
    cells = [pa.array(np.frombuffer(b"".join(keys), np.int64), pa.int64()), *rows.columns[1:-3], pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(regions, pa.binary())]
    return pa.RecordBatch.from_arrays(cells, names=batch.schema.names)


def divided(rows: DataFrame, size: int, blocks: int) -> list[DataFrame]:
    """Staged messages for anchors with very many contexts: their groups are halved by offset until each fits a task.

    Rows of a group that agree in all bytes its offsets can reach, and where the anchor is in them, are repeats of one another there:
    they are settled as a whole, and one of them goes on for the others' sake. So what goes on are
    different rows, and a row only as long as a change of its own lies near. Groups that fit are
    settled like all others, by interval expansion.
    """
    out, others = [], [x.split()[0] for x in PART.split(", ") if not x.startswith(("anchor ", "region "))]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            regions = [_region(c, b, 0, size - K, size) for c, b in zip(batch.column("context").to_pylist(), batch.column("begins").to_pylist(), strict=True)]
            more = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, size - K, np.int32)), pa.array(regions, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "low", "high", "region"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield halves(batch, size)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, begins, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("pos", "begins", "low", "high"))
            after = np.array([len(c) for c in batch.column("context").to_pylist()], np.int64) - begins
            most, least = np.minimum(high, begins), np.maximum(low, size - after)
            has = most >= least
            x = np.stack([pos - most, pos - least + size], axis=1)[has]
            yield _rows(to_blocks(2, batch.column("id").to_numpy()[has], batch.column("crc").to_numpy()[has].astype(np.uint32), x, blocks))

    parts = stage(rows.mapInArrow(first, PART), "anchor-parts")
    while True:
        one = F.min(F.struct(*others)).alias("one")
        same = stage(parts.groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("n"), one), "equal-parts")
        equal = stage(same.where("n > 1").select("anchor", "region"), "equal-regions")
        out.append(stage(parts.where("not settled").join(bounded(equal), ["anchor", "region"], "left_semi").mapInArrow(whole, MESSAGE), "repeated-spans"))
        left = same.select("anchor", *[(F.col("one.settled") | (F.col("n") > 1)).alias(c) if c == "settled" else F.col(f"one.{c}").alias(c) for c in others], "region")
        left = stage(left, "different-parts")
        large = stage(left.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("anchor"), "large-parts")
        out.append(stage(settle(left.join(bounded(large), "anchor", "left_anti").drop("low", "high", "region"), size, blocks), "repeated-spans"))
        if large.isEmpty():
            return out
        names = [x.split()[0] for x in PART.split(", ")]
        parts = stage(left.join(bounded(large), "anchor", "left_semi").select(*names).mapInArrow(split, PART), "anchor-parts")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"), "text")


def dealt_to_blocks(source: DataFrame, messages: DataFrame, blocks: int) -> DataFrame:
    """Documents and messages by block, messages first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _block(_ids(batch.column("id")), batch.column("crc").to_numpy().astype(np.uint32), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - block), pa.array(np.zeros(len(block), np.int32)), *batch.columns], names=["place", "kind", "id", "crc", "text"])

    rows = source.mapInArrow(place, "place long, kind int, id long, crc long, text string")
    return rows.unionByName(messages, allowMissingColumns=True).repartition("place").sortWithinPartitions("place", F.desc("kind"))


def union_of(spans: list[np.ndarray]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for a, z in sorted(map(tuple, np.concatenate(spans).tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256 of every row."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // PER_BLOCK))
    source = keyed(docs)
    around = contexts(dealt_to_blocks(source, repeated_anchors(source, size, total, blocks), blocks), size, blocks)
    rows = around.where("place = 0").select(*[x.split()[0] for x in CONTEXT.split(", ")])
    large = stage(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("anchor"), "large-anchors")
    found = around.where("place < 0").select(*[x.split()[0] for x in MESSAGE.split(", ")])
    found = found.unionByName(stage(settle(rows.join(bounded(large), "anchor", "left_anti"), size, blocks), "repeated-spans"))
    if not large.isEmpty():
        for part in divided(rows.join(bounded(large), "anchor", "left_semi").select(*rows.columns), size, blocks):
            found = found.unionByName(part)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, spans, texts in _blocks_of(batches):
            for at in range(0, len(texts), 512):
                yield pack([one(r, spans.get((r[0], r[1]))) for r in texts[at : at + 512]])

    def one(row: tuple, spans: list[np.ndarray] | None) -> tuple:
        doc, _, text = row
        runs = union_of(spans) if spans else []
        kept, at = [], 0
        for a, z in runs:
            kept.append(text[at:a])
            at = z
        left = b"".join([*kept, text[at:]])
        return None if doc == NO_ID else doc, len(text), len(text) - len(left), len(runs), left, hashlib.sha256(left).hexdigest()

    def pack(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return dealt_to_blocks(source, found, blocks).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op6_interval_expansion(spark, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).drop("kept")


#: All 400-byte windows, compared by 64-bit hashes; the bytes that are left are joined as hexadecimal digits.
OP6_SQL = """
with n as materialized (
  select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as materialized (
  select r, s, hash(array_slice(b, s, s + 399)) as h from (select r, b, unnest(range(1, n - 398)) as s from n where n >= 400)),
again as (select h from w group by h having count(*) > 1),
hit as (select r, s, lag(s) over (partition by r order by s) as before from w where h in (select h from again)),
opened as (select r, s, sum(case when before is null or s > before + 400 then 1 else 0 end) over (partition by r order by s) as run from hit),
runs as materialized (select r, run, min(s) as a, max(s) + 400 as z from opened group by r, run),
ends as (select r, count(*) as n_spans, max(z) as z from runs group by r),
gaps as (
  select r, lag(z, 1, 1) over (partition by r order by a) as since, a as upto from runs
  union all select r, coalesce(z, 1), n + 1 from n left join ends using (r)),
kept as (
  select r, string_agg(case when upto > since then hex(array_slice(b, since, upto - 1)) else '' end, '' order by upto) as digits
  from gaps join n using (r) group by r)
select doc_id, n.n as n_bytes, cast(n.n - length(digits) // 2 as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(digits)) as kept_sha256
from n join kept using (r) left join ends using (r)
"""


ship(__name__)
