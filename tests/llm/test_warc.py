"""The fixity audit against a plain comparison of records, for every kind of damage."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.runtime import stage

PAGE = "page_id long, url string, html string, digest string, pos string, file int"


def record(i, url, html):
    body = (html or "").encode()
    head = warc.HEADER.format(id="" if i is None else i, url=url or "", n=len(body))
    return head.encode() + body + b"\r\n\r\n"


def pages_of(rng, n):
    rows = [(i * rng.choice([1, 1, 40]), f"http://h/{i}", rng.choice(["", None, "<p>é</p>", "x" * rng.randint(1, 50)]), None, None, None) for i in range(n)]
    return rows + rows[:2] + [(None, None, None, "d", "p", 1), (None, "u", "b", None, None, None)] * 2 if n else rows


def plain(records):
    return {(r.file, r.part, r.pos): r.digest for r in records.collect()}


def damaged(rng, records):
    """A staged replica with some digests changed, the ends of some files cut, and some files longer."""
    rows = [r.asDict() for r in records.collect()]
    out = []
    last = {}
    for r in rows:
        last[r["file"], r["part"]] = max(last.get((r["file"], r["part"]), 0), r["pos"])
    cut = {k for k in last if rng.random() < 0.2}
    for r in rows:
        if (r["file"], r["part"]) in cut and r["pos"] == last[r["file"], r["part"]]:
            continue
        if rng.random() < 0.1:
            r["digest"] = hashlib.sha256(str(rng.random()).encode()).hexdigest()
        out.append(tuple(r.values()))
    if rows and rng.random() < 0.7:
        out.append((999, 0, 0, 0, 9, "f" * 64, 1, "new"))
    return stage(records.sparkSession.createDataFrame(out, records.schema), "damaged")


@pytest.mark.parametrize("size", [0, 1, 40, 300])
def test_audit(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "FANOUT", 3)
    monkeypatch.setattr(warc, "FILE_RECORDS", 20)
    monkeypatch.setattr(warc, "MOST_RECORDS", 25)
    monkeypatch.setattr(warc, "NAMELESS_FILES", 4)
    rng = random.Random(size)
    rows = pages_of(rng, size)
    ours = warc.leaves(spark.createDataFrame(rows, PAGE))
    got = ours.collect()
    assert sorted(r.digest for r in got) == sorted(hashlib.sha256(record(*r[:3])).hexdigest() for r in rows)
    ends = {}
    for r in sorted(got, key=lambda r: (r.file, r.part, r.pos)):
        assert r["first"] == ends.get((r.file, r.part), 0)
        ends[r.file, r.part] = r.after
    assert warc.audit(ours, ours).count() == 0
    theirs = damaged(rng, ours)
    a, b = plain(ours), plain(theirs)
    want = {k: "missing" if k not in b else "extra" if k not in a else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert {(r.file, r.part, r.pos): r.kind for r in warc.audit(ours, theirs).collect()} == want
    assert (warc.archive_root(ours) == warc.archive_root(theirs)) == (not want)


def test_scanned_files(spark):
    rows = [(7, "http://h/7", "<p>a</p>"), (8, "http://h/8", "é\r\n\r\nWARC/1.1"), (None, "", "")]
    content = b"".join(record(*r) for r in rows)
    parsed = warc.parse(content)
    assert [(p[4], p[5]) for p in parsed] == [(7, "http://h/7"), (8, "http://h/8"), (None, "")] and parsed[-1][2] == len(content)
    assert [p[3] for p in parsed] == [hashlib.sha256(record(*r)).hexdigest() for r in rows]
    assert warc.parse(b"") == [] and len(warc.parse(b"junk without end")) == 1 and len(warc.parse(content[:-20])) == 3
    files = spark.createDataFrame([(0, bytearray(content)), (1, bytearray(b"")), (2, None)], "file long, content binary")
    changed = bytearray(content)
    changed[-8] ^= 1
    other = files.withColumn("content", F.when(F.col("file") == 0, F.lit(bytes(changed))).otherwise(F.col("content")))
    bad = warc.audit(warc.scan_files(files), warc.scan_files(other)).collect()
    assert [(r.file, r.pos, r.kind) for r in bad] == [(0, 2, "changed")] or [(r.file, r.pos) for r in bad] == [(0, 2)]
