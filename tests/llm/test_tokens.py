import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellate.llm import counts, token_output
from stellate.llm.common import fresh_path
from stellate.llm.tokens import UnitEncoder, tokenizer_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["a", "B", "é", "ß", "İ", ".", ",", " ", "  ", "\n", " \n", "\t", "\x1c", "\xa0", "'s", "'re", "<|endoftext|>", "<|startoftext|>", "½", "中", "́", "23", "​", "🙂", "don't", "The", "word", "-", "_", "ﬁ", "\r\n", "x" * 60]
ENCODERS = {n: UnitEncoder(tokenizer_path(n)) for n in NAMES}


def expected(name, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in ENCODERS[name].tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.characters(exclude_categories=["Cs"]), max_size=40).map("".join), max_size=5))
def test_units_give_the_library_s_ids(name, texts):
    assert ENCODERS[name].encode(texts) == expected(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_counts_and_table_turnover(name, monkeypatch, words):
    monkeypatch.setattr("stellate.llm.tokens.CACHED_UNITS", 50)
    texts = [words(300, s).title() + "." for s in range(20)]
    enc = UnitEncoder(tokenizer_path(name), counts=True)
    for i in range(0, 20, 4):
        assert enc.encode(texts[i : i + 4]) == [len(x) // 4 for x in expected(name, texts[i : i + 4])]


def test_sliced_and_null_columns():
    column = pa.array(["x", None, "a b", "c  d", ""]).slice(1, 4)
    assert ENCODERS[NAMES[0]].encode(column) == expected(NAMES[0], ["", "a b", "c  d", ""])


def rows(words):
    rng = random.Random(1)
    out = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return [*out, (70, None), (71, ""), (72, words(30_000, 3)), (5, "again"), (72, "second"), (None, "no id"), (3, out[3][1])]


def test_token_files(spark, docs_of, words):
    data = rows(words)
    path = token_output.write_tokens(docs_of(data, clash=True), fresh_path(spark, "t"), end_id=0)
    table = token_output.read_tokens(spark, path)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [x + b"\0\0\0\0" for x in expected(NAMES[0], [t or "" for _, t in order])]
    got = token_output.with_starts(token_output.with_crc(table), table).orderBy("start").collect()
    start = 0
    for (i, _), raw, r in zip(order, ids, got, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    one = token_output.read_tokens(spark, path, ["doc_id", "n_tokens"]).filter("doc_id = 72")
    assert one.count() == 2
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,72)]" in plan and "token_ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_token_counts(spark, docs_of, words):
    data = rows(words)
    got = sorted(map(tuple, counts.count_tokens(docs_of(data, clash=True), limit=20).collect()), key=str)
    n = [len(x) // 4 for x in expected(NAMES[0], [t or "" for _, t in data])]
    assert got == sorted(((i, len((t or "").encode()), k, k > 20) for (i, t), k in zip(data, n, strict=True)), key=str)


def test_empty_tables(spark, docs_of):
    assert counts.count_tokens(docs_of([])).count() == 0
    table = token_output.read_tokens(spark, token_output.write_tokens(docs_of([]), fresh_path(spark, "t")))
    assert token_output.with_starts(token_output.with_crc(table), table).count() == 0


def test_footers_of_token_files(spark, docs_of, words, monkeypatch):
    """Encodings, row groups and page indexes are as the layout says, and the file holds no more than it needs."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(token_output, "ROW_GROUP_BYTES", 1 << 17)
    data = [(i, words(400, i)) for i in range(600)]
    path = token_output.write_tokens(docs_of(data).repartition(1), fresh_path(spark, "t"), end_id=0)
    files = [pq.ParquetFile(p).metadata for p in glob.glob(path.removeprefix("file://") + "/*.parquet")]
    assert sum(f.num_rows for f in files) == 600 and max(f.num_row_groups for f in files) > 1
    for f in files:
        for g in range(f.num_row_groups):
            columns = {f.row_group(g).column(i).path_in_schema.split(".")[0]: f.row_group(g).column(i) for i in range(f.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert "RLE_DICTIONARY" in columns["token_ids"].encodings
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "local_start"))
            assert columns["token_ids"].total_uncompressed_size < 3 * columns["token_ids"].num_values
