import gzip
import random
from hashlib import sha256

import pytest

from stellate.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, tie string, first int"


def brute(rows):
    first = {}
    for i, (page_id, _, html) in enumerate(rows):
        h = (html or "").encode()
        if len(h) >= 100:
            key = (page_id is None, page_id or 0, i)
            first[h] = min(first.get(h, key), key)
    out = []
    for i, (page_id, _, html) in enumerate(rows):
        h = (html or "").encode()
        f = first.get(h)
        again = f is not None and f[2] != i
        out.append((page_id, len(h), sha256(h).hexdigest(), "revisit" if again else "response", (None if f[0] else f[1]) if again else None))
    return out


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "t", 1) for r in rows], SCHEMA)


def archives(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


@pytest.mark.parametrize("small", [warc.SMALL, 0])
def test_round_trip(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(warc, "SMALL", small)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab <é\r\n\0") for _ in range(n)) for n in (0, 50, 99, 100, 101, 5000)] + [None, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 5]
    rows = [(i, rng.choice([None, "http://a/b\r\nX: y", "http://é"]), rng.choice(texts)) for i in range(80)]
    rows += rows[:9] + [(None, None, texts[5]), (None, None, "only" * 40), (None, None, "only" * 40), (3, None, texts[5])]
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w"), payloads=True)
    assert sorted(map(repr, map(tuple, warc.page_digests(read).collect()))) == sorted(map(repr, brute(rows)))
    assert warc.gaps(read).count() == 0
    got = read.filter("type = 'response'").collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted((r[2] or "").encode() for r, b in zip(rows, brute(rows), strict=True) if b[3] == "response")
    for p in (tmp_path / "w").glob("part-*"):
        gzip.decompress(p.read_bytes())  # any reader of gzip takes the files


def test_empty(spark, tmp_path):
    warc.write_archives(pages(spark, []), str(tmp_path / "w"))
    assert warc.page_digests(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0


def test_long_records_take_several_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER", 1 << 20)
    text = "".join(random.Random(2).choices("abcdefgh", k=5 << 20))
    warc.write_archives(pages(spark, [(1, "u", text), (2, "u", text), (3, "u", "x")]), str(tmp_path / "w"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.page_digests(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    d = sha256(text.encode()).hexdigest()
    assert got == {1: (len(text), d, "response", None), 2: (len(text), d, "revisit", 1), 3: (1, sha256(b"x").hexdigest(), "response", None)}


def parts(n, seed=0):
    rng = random.Random(seed)
    return [warc.page_record(i, i, f"http://h/{i}", "".join(rng.choices("abc <>", k=rng.randint(0, 3000))), "0" * 64, None, "d") for i in range(n)]


def read(data, piece):
    s, out = warc.Salvage(), []
    for i in range(0, len(data), piece):
        out += list(s.feed(data[i : i + piece]))
    return out + list(s.feed(b"", True))


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("piece", [1 << 20, 777, 5])
def test_salvage(packed, piece):
    """Records apart from damaged ones are recovered, gaps and records together are all bytes."""
    made = parts(30)
    pieces = [gzip.compress(p, mtime=0) if packed else p for p in made]
    starts = [sum(map(len, pieces[:k])) for k in range(31)]
    whole = b"".join(pieces)
    rng = random.Random(5)
    for hurt in ([3], [0], [29], [4, 5, 6], [10, 20], list(range(0, 30, 2))):
        data = bytearray(whole)
        for k in hurt:
            at = rng.randrange(starts[k] + (30 if packed else made[k].index(b"\r\n\r\n") + 4), starts[k + 1] - 8)  # nothing guards a bare header
            data[at] ^= 0x55
        got = read(bytes(data), piece)
        ids = [r[3]["warc-record-id"] for r in got if not r[2]]
        assert ids == [f"<urn:page:{k}:{k}>" for k in range(30) if k not in hurt]
        at = 0
        for r in got:
            assert r[0] == at
            at += r[1]
        assert at == len(data)


def test_gaps_are_where_bytes_were_put_in_or_lost():
    made = [gzip.compress(p, mtime=0) for p in parts(6, 1)]
    junk = b"WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" + bytes(range(256)) * 20 + b"\x1f\x8b\x08junk"
    got = read(made[0] + junk + made[1] + made[2][5:] + made[3] + made[4][:-20] + made[5][:40], 1000)
    assert [(r[1], r[2] is None) for r in got] == [(len(made[0]), True), (len(junk), False), (len(made[1]), True), (len(made[2]) - 5, False), (len(made[3]), True), (len(made[4]) - 20 + 40, False)]
    assert read(b"", 10) == [] and read(b"\n", 10)[0][:3] == (0, 1, "no record")


def test_archives_of_others(spark, tmp_path):
    """Uncompressed records, other digests and other types, damaged in a file among others."""
    from base64 import b32encode
    from hashlib import sha1

    block = b"some text"
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Block-Digest: sha1:" + b32encode(sha1(block).digest()) + b"\r\nContent-Length: 9\r\n\r\n" + block + b"\r\n\r\n"
    two = one.replace(b"urn:x:1", b"urn:x:2")
    (tmp_path / "a.warc").write_bytes(one + two.replace(b"some", b"sore") + one)
    (tmp_path / "b.warc").write_bytes(two)
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one) + b"\0\0" + gzip.compress(two))
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read_archives(spark, f"{tmp_path}/*", payloads=True)
    rows = sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["length"], r["kind"], r["reason"], r["record_id"], r["payload"] and bytes(r["payload"])) for r in got.collect())
    n, z = len(one), len(gzip.compress(one))
    assert rows == [
        ("a.warc", 0, n, "record", None, "<urn:x:1>", block), ("a.warc", n, n, "gap", "digest", None, None), ("a.warc", 2 * n, n, "record", None, "<urn:x:1>", block),
        ("b.warc", 0, n, "record", None, "<urn:x:2>", block),
        ("c.warc.gz", 0, z, "record", None, "<urn:x:1>", block), ("c.warc.gz", z, 2, "gap", "no record", None, None), ("c.warc.gz", z + 2, len(gzip.compress(two)), "record", None, "<urn:x:2>", block),
    ]


def test_sql_agrees(spark):
    import duckdb

    import __spark_entry__

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["op13_warc"]).fetchall()
    got = __spark_entry__.queries()["op13_warc"](spark, d).collect()
    assert want and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
