import random
import pytest
from pyspark.sql import functions as F

from stellate import schema
from stellate.functions import paths, symbols, versions
from stellate.sources import scip


def over(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.withColumn("y", make(F.col("x"))).orderBy("i").collect()]


def test_test_files(spark):
    yes = ["src/a_test.cpp", "src/a_test_helpers.cpp", "a_unittest.cpp", "src/tests/x.cpp", "a/test/b.h", "test_x.c", "A\\TEST\\b.c", "x_tests.cc"]
    no = ["src/a.cpp", "b.h", None, "", "test/x.cpp", "latest.cpp", "contest.cpp"]
    assert over(spark, yes + no, paths.is_test_file) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    ("include", "exclude", "want"),
    [
        (None, None, [True] * 6),
        ([], [], [True] * 6),
        (["src/foo"], None, [True, True, False, False, True, False]),
        (None, ["src/foo/"], [False, False, True, True, False, True]),
        (["/"], None, [False] * 6),
        (None, ["/"], [True] * 6),
        (["src"], ["src/foo"], [False, False, True, True, False, False]),
    ],
)
def test_path_prefixes(spark, include, exclude, want):
    files = ["src/foo/bar.cpp", "src/foo", "src/foobar.cpp", "src/x.cpp", "src\\foo\\b.cpp", None]
    assert over(spark, files, lambda c: paths.path_ok(c, include, exclude)) == want


def test_project_roots(spark):
    assert over(spark, ["file:///repo", "/repo", "", None, "http://file://x"], paths.project_root_path) == ["/repo", "/repo", "", None, "http://file://x"]


def test_labels(spark):
    anonymous = "cxx . . $ `$anonymous_namespace_src/acme/x.cpp`/acme/Odd_Case#~Odd_Case(0a1b2c3d)."
    plain = "cxx . . $ acme/Foo#bar(abc)."
    assert over(spark, [anonymous, plain, "odd"], symbols.short_label) == ["acme/Odd_Case#~Odd_Case.", "acme/Foo#bar(abc).", "odd"]
    assert over(spark, [anonymous, plain], symbols.qualified_name) == ["acme/Odd_Case#~Odd_Case", "acme/Foo#bar"]
    assert over(spark, [anonymous, plain, "cxx . . $ a/b/c()."], symbols.leaf_name) == ["~Odd_Case", "bar", "c"]
    assert over(spark, ["x $ a/tassert(1234567).", "x $ N#operator==(aaaaaa).", "x $ domainWork().", "x $ a/Status#Status(bbbbbb)."], symbols.is_trivial_callee) == [True, True, False, True]
    assert over(spark, ["x $ $anonymous_type_7#", "x $ y()."], symbols.is_noise) == [True, False]
    assert over(spark, ["a().", "T#", "T# ", "local 3", "n/"], symbols.symbol_kind) == ["callable", "type", "other", "local", "other"]
    assert over(spark, ["T# ", "T#", "f()."], symbols.is_type_query) == [True, True, False]
    assert symbols.loosen_to_leaf("A#b().") == "b()" and symbols.loosen_to_leaf("A::b") == "b" and symbols.loosen_to_leaf("plain") is None


def test_versions(spark):
    cases = {"0.2.10": [0, 2, 10], "v1.0": [1, 0], "0.2.0-rc1": [0, 2, 0], None: [], "": [], "x": [], "1.x.3": [1], "1.2rc.9": [1, 2]}
    assert over(spark, list(cases), versions.parse_version) == list(cases.values())
    assert [list(versions.version_tuple(v)) for v in cases] == list(cases.values())
    releases = {"0.2.0": "none", "0.3.0": "store", "0.4.0": "reindex", "0.5.0": "none"}
    df = spark.createDataFrame(list(releases.items()), "version string, level string")
    assert versions.max_rebuild_level(df, "0.2.0", "0.3.0").first()["level"] == "store"
    assert versions.max_rebuild_level(df, "0.2.0", "0.5.0").first()["level"] == "reindex"
    assert versions.max_rebuild_level(df, "0.4.0", "0.5.0").first()["level"] == "none"
    got = versions.update_advice(releases, "0.3.0", "0.5.0", "0.2.0")
    assert got["update_available"] and got["rebuild_now"] == "store" and got["rebuild_after_update"] == "reindex"


@pytest.mark.parametrize("current, latest, built", [("0.3.0", "0.5.0", "0.2.0"), ("0.3.0", "0.3.0", None), ("v0.4.0", "0.5.0", "0.4.0"), (None, "0.4.0", None), ("0.5.0", "0.4.0", "0.2.0"), ("0.2.0", "x", "0.2.0")])
def test_advice_over_a_table(spark, current, latest, built):
    releases = {"0.2.0": "none", "0.3.0": "store", "0.4.0": "reindex", "0.5.0": "none", "x": "reindex", "0.4.5": "odd"}
    df = spark.createDataFrame(list(releases.items()), "version string, level string")
    assert versions.advise(df, current, latest, built).first().asDict() == versions.update_advice(releases, current, latest, built)


def test_advice_without_a_latest_version(spark):
    df = spark.createDataFrame([("0.9.0", "none"), ("0.10.0", "store")], "version string, level string")
    assert tuple(versions.advise(df, "0.9.0").first()) == ("0.9.0", "0.10.0", True, "none", "store")
    assert tuple(versions.advise(df.limit(0), "0.9.0").first()) == ("0.9.0", None, False, "none", "none")


def number(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(n, value):
    if isinstance(value, int):
        return number(n << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(n << 3 | 2) + number(len(value)) + value


def index():
    packed = lambda *v: b"".join(map(number, v))
    one = field(2, "a().") + field(3, 1) + field(1, packed(5, 0, 9)) + field(7, packed(5, 0, 30, 1))
    two = field(2, "b().") + field(1, packed(99, 0, 1)) + field(8, field(1, 7) + field(2, 3)) + field(10, field(1, 6))
    three = field(2, "c#") + field(9, field(1, 300) + field(3, 310)) + field(11, field(1, 2) + field(3, 40))
    symbol = field(1, "a().") + field(6, "a") + field(4, field(1, "base().") + field(3, 1)) + field(4, field(1, "other#"))
    doc = field(1, "src/x.cpp") + b"".join(field(2, o) for o in (one, two, three, field(2, "none"))) + field(3, symbol)
    return field(1, field(2, field(1, "tool") + field(2, "1.2")) + field(3, "file:///repo")) + field(2, doc) + field(2, field(1, "empty.cpp"))


def test_index_reader(spark, tmp_path):
    p = tmp_path / "index.scip"
    p.write_bytes(index())
    got = scip.read_index(spark, str(p))
    rows = [tuple(r) for r in got["occurrences"].select("doc", "occ_ord", "symbol", "symbol_roles", "line", "enc_start", "enc_end").orderBy("occ_ord").collect()]
    assert rows == [("src/x.cpp", 0, "a().", 1, 5, 5, 30), ("src/x.cpp", 1, "b().", 0, 7, 6, 6), ("src/x.cpp", 2, "c#", 0, 300, 2, 40), ("src/x.cpp", 3, "none", 0, None, None, None)]
    assert [tuple(r)[3:] for r in got["relationships"].orderBy("dst").collect()] == [("a().", "base().", True), ("a().", "other#", False)]
    assert [(r["symbol"], r["display_name"]) for r in got["symbol_info"].collect()] == [("a().", "a")]
    assert {r["doc"] for r in got["documents"].collect()} == {"src/x.cpp", "empty.cpp"}
    d = scip.describe(spark, str(p))
    assert d["exists"] and d["documents"] == 2 and d["tool"] == "tool" and d["project_root"] == "file:///repo"
    assert scip.describe(spark, str(tmp_path / "none")) == {"exists": False}
    p.write_bytes(b"\x12\xff\x01abc")
    assert "error" in scip.describe(spark, str(p))


def test_index_as_a_source(spark, tmp_path):
    """Several indexes, in folders too, read by ranges of few bytes: rows and numbers are those of read_index."""
    (tmp_path / "b.scip").mkdir()
    for name in ("a.scip", "b.scip/part-0", "c.scip", "d.txt"):
        (tmp_path / name).write_bytes(index() if name != "d.txt" else b"?")
    scip.register(spark)
    want = sorted(map(tuple, scip.read_index(spark, f"{tmp_path}/*.scip")["occurrences"].collect()))
    for most in (1, 1 << 20):
        got = spark.read.format("scip").option("range", most).load(f"{tmp_path}/*.scip")
        assert sorted(map(tuple, got.select("doc_ord", "doc", "occ_ord", "symbol", "symbol_roles", "line", "enc_start", "enc_end").collect())) == want
    assert len(want) == 12 and got.rdd.getNumPartitions() == 3


def _chunked(whole, cuts):
    """What _chained gives for chunks that end at the cuts."""
    ends = sorted({c for c in cuts if 0 < c < len(whole)} | {len(whole)})
    rows, at = [], 0
    for e in ends:
        begins, outs, counts, docs = (x.tolist() for x in scip.chains(whole[at:e], at, len(whole)))
        rows.append({"offset": at, "length": e - at, "head": whole[at:e][: scip._HEADER], "tail": whole[at:e][-scip._HEADER :], "begins": begins, "ends": outs, "counts": counts, "docs": docs})
        at = e
    return rows


def test_framing_finds_all_messages():
    """Against following the lengths from the first byte, for chunks of any size, down to less than a header."""
    r = random.Random(9)
    for trial in range(150):
        made = [field(r.choice([1, 2, 2, 2, 3]), r.choice([r.randbytes(r.choice([0, 1, 5, 130, 3000])), b"\x0a\x12\x1a" * r.randint(0, 60)])) for _ in range(r.randint(1, 30))]
        whole = b"".join(made)
        starts = [sum(map(len, made[:k])) for k in range(len(made))]
        rows = _chunked(whole, [r.randrange(len(whole)) for _ in range(r.choice([0, 1, 5, 40]))] if trial % 5 else range(0, len(whole), r.choice([3, 40, 500])))
        got, docs = scip._followed(rows, len(whole))
        assert docs == sum(m[0] == 0x12 for m in made)
        assert [o for o, _, _ in got] == [x["offset"] for x in rows]
        for (offset, first, number), x in zip(got, rows, strict=True):
            inside = [k for k, s in enumerate(starts) if offset <= s < offset + x["length"]]
            assert (first, number) == ((starts[inside[0]], inside[0]) if inside else (None, sum(s < offset for s in starts)))
    assert scip._followed(_chunked(field(2, b"a") + field(9, b"b"), []), 6) is None
    assert scip._followed(_chunked(field(2, b"a") + b"\x12\x09a", []), 6) is None


def test_one_index_in_many_tasks(spark, tmp_path):
    """Split small, with documents longer than a chunk, an index that has other fields at its top, an empty one, and rows and
    numbers as from one value."""
    r = random.Random(4)
    for name, extra in (("a", b""), ("b", field(9, b"own") + field(12, 7)), ("c d [1]", b"")):
        docs = [scip.encoded(f"{name}/{k}.cpp", [{"symbol": f"s{r.randrange(99)}().", "symbol_roles": 1, "line": i, "enc_start": None, "enc_end": None} for i in range(r.choice([0, 3, 40, 900]))], []) for k in range(60)]
        (tmp_path / f"{name}.scip").write_bytes(field(1, field(2, field(1, "tool"))) + b"".join(docs[:30]) + extra + b"".join(docs[30:]))
    (tmp_path / "e.scip").write_bytes(b"")
    want = []
    for k, name in enumerate(sorted(p.name for p in tmp_path.glob("*.scip"))):
        for n, (f, wire, v) in enumerate(scip.fields(memoryview((tmp_path / name).read_bytes()))):
            if f == 2:
                d = scip.document(v)
                want.append(((k << 40) + n, d["doc"], len(d["occurrences"])))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        _, plan, slow, _ = scip.frame(spark, f"{tmp_path}/*.scip", 4000)
        assert len(slow) == 1 and plan.count() > 30
        got = scip.read_documents(spark, f"{tmp_path}/*.scip", 4000)
        assert sorted((x["doc_ord"], x["doc"], len(x["occurrences"])) for x in got.collect()) == want
        assert scip.describe(spark, f"{tmp_path}/a.scip")["documents"] == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_written_index_is_read(spark, tmp_path):
    """Documents of over 127 bytes, two files by a pattern, lines beyond a byte."""
    occ = [(d, f"src/{d}.cpp", k, f"sym{k}().", k % 2, 200 * k, 200 * k if k % 2 else None, 200 * k + 150 if k % 2 else None) for d in range(4) for k in range(40)]
    sym = [(d, f"src/{d}.cpp", 0, "sym1().", "é" * 100) for d in range(4)]
    rel = [(d, f"src/{d}.cpp", 0, "sym1().", "base().", True) for d in range(4)]
    every = {"occurrences": spark.createDataFrame(occ, schema.OCCURRENCES), "symbol_info": spark.createDataFrame(sym, schema.SYMBOL_INFO), "relationships": spark.createDataFrame(rel, schema.RELATIONSHIPS)}
    for k in (0, 1):
        scip.write_index({n: t.filter(f"doc_ord % 2 = {k}") for n, t in every.items()}, f"{tmp_path}/{k}.scip")
    got = scip.read_index(spark, f"{tmp_path}/*.scip")
    assert sorted(tuple(r)[1:] for r in got["occurrences"].collect()) == sorted(x[1:] for x in occ)
    order = {r["doc"]: r["doc_ord"] for r in got["documents"].collect()}
    assert sorted(order, key=order.get) == [f"src/{d}.cpp" for d in (0, 2, 1, 3)] and len(set(order.values())) == 4
    assert {r["display_name"] for r in got["symbol_info"].collect()} == {"é" * 100} and got["relationships"].count() == 4
    assert scip.describe(spark, f"{tmp_path}/none.scip") == {"exists": False}
