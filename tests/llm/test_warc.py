import gzip
import hashlib
import random
import re
import urllib.parse

import pyarrow as pa

from millrace.llm import warc
from millrace.llm.warc import member, read_warc, record, records, write_warc


def test_round_trip(spark, tmp_path):
    big = "é" * 60 + "<p>"
    noise = "".join(random.Random(1).choices("abcdefghij\n", k=300_000))
    rows = [(5, "http://x/ a", big), (3, None, big), (9, "u", big), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u\r\nX-Page-Id: 1", noise), (8, "u", "x" * 100), (8, "u", "x" * 100), (None, "u", "y" * 200), (10, "u", "y" * 200), (None, "u", "z" * 200), (None, "u", "z" * 200), (11, "u", "x" * 99), (12, "u", "x" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS member")
    write_warc(pages, f"{tmp_path}/w")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(spark, f"{tmp_path}/w").collect()), key=str)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        same = to is None or to == i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if same else "revisit", None if same else to))
    assert got == sorted(want, key=str)
    assert all(r.verified for r in read_warc(spark, f"{tmp_path}/w").collect())
    names = []
    for part in (tmp_path / "w").glob("part-*"):  # any gzip reader can take the archives
        plain = gzip.decompress(part.read_bytes())
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        names += re.findall(rb"WARC-Record-ID: (\S+)", plain)
    assert len(names) > len(rows) and len(names) == len(set(names))
    write_warc(pages.limit(0), f"{tmp_path}/e")
    assert read_warc(spark, f"{tmp_path}/e").count() == 0


def test_members_of_any_length():
    payload = b"a" * ((1 << 24) + 5)
    sha = hashlib.sha256(payload).hexdigest()
    archive = b"".join(member(record(str(i), i, "u", p, len(p), hashlib.sha256(p).hexdigest())) + b"\0" for i, p in enumerate((b"x", payload, b"y")))
    got = list(records(archive))
    assert [r["page_id"] for r in got] == [0, 1, 2]
    assert got[1]["payload_bytes"] == len(payload) and got[1]["payload_digest"] == sha and all(r["verified"] for r in got)


def test_a_changed_payload_is_noticed():
    whole = record("0", 1, "u", b"abc" * 50, 150, hashlib.sha256(b"abc" * 50).hexdigest())
    spoilt = whole.replace(b"abcabc", b"abcabd", 1)
    (r,) = records(gzip.compress(spoilt))
    assert not r["verified"]
    assert urllib.parse.quote("a b") in record("0", 1, "a b", b"", 0, "").decode()


def test_archives_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 2000)
    noise = random.Random(2)
    pages = [{"page_id": i, "url": "u", "body": noise.randbytes(700), "size": 700, "digest": "", "refers_to": None, "its_url": None} for i in range(60)]
    chunks = [r.column(0)[0].as_py() for r in warc._archives(iter([pa.RecordBatch.from_pylist(pages[:35]), pa.RecordBatch.from_pylist(pages[35:])]))]
    assert len(chunks) > 2 * warc.CHUNKS_IN_ARCHIVE and max(map(len, chunks)) < 2000 + 1200
    archives = [b"\0".join(chunks[k : k + warc.CHUNKS_IN_ARCHIVE]) + b"\0" for k in range(0, len(chunks), warc.CHUNKS_IN_ARCHIVE)]
    assert all(gzip.decompress(a).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for a in archives)
    assert [r["page_id"] for a in archives for r in records(a)] == list(range(60))


def test_pages_table(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_warc(pages, f"{tmp_path}/w")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.verified) for r in read_warc(spark, f"{tmp_path}/w").collect()}
    assert got == {r.page_id: (len(r.html.encode()), hashlib.sha256(r.html.encode()).hexdigest(), True) for r in pages.collect()}
