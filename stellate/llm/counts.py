"""Token counts: lengths only, from Arrow batches balanced by bytes, long texts cut at safe boundaries."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import bounded_batches, by_bytes
from stellate.llm.tokens import encoder, tokenizer_path


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512, path: str | None = None) -> DataFrame:
    """One row for each row of `docs`: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows; a null id is kept. Columns other
    than the id and the text are not read. Tokens are those of the whole text without added special tokens; a special
    string inside a text is one token, as the library has it by default. Texts of any length are counted whole; an empty table
    gives no rows. `path` names a vocabulary file of one's own.
    """
    path = path or tokenizer_path(tokenizer)

    def run(batches):
        enc = encoder(path, counts=True)
        for b in by_bytes(batches, "text"):
            n = enc.encode(b.column(1))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(size, pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = bounded_batches(src).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
