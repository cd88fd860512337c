import random

import pytest

from stellate.sources import raw


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "70000", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_chunks_give_all_bytes(spark, tmp_path, small_splits):
    """Random bytes, separators at the ends, a run without any, an empty file, names with pattern characters and one of a codec."""
    r = random.Random(3)
    bodies = {"a.bin": r.randbytes(300_001), "b.bin": r.randbytes(1000) + b"\n", "c [x].bin": b"\n" * 5000, "d.bin": b"x" * 200_000, "e.bin": b"", "f.gz": r.randbytes(150_000), "g.bin": b"\r\n\x00\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = raw.chunks(spark, f"{tmp_path}/*", 10_000).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x["file"], x["offset"])):
        name = x["file"].rsplit("/", 1)[1].replace("%20", " ").replace("%5B", "[").replace("%5D", "]")
        assert x["offset"] == len(got.setdefault(name, b""))
        got[name] += bytes(x["body"])
    assert got == {k: v for k, v in bodies.items() if v}
    assert len({x["split"] for x in rows if x["file"].endswith("a.bin")}) > 2
    assert max(len(x["body"]) for x in rows if x["file"].endswith("a.bin")) < 20_000
    assert raw.chunks(spark, f"{tmp_path}/e.bin").count() == 0
