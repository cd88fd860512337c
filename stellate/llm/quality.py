"""Quality rules: per-document counts and cross-document line frequency, in DataFrame functions only.

Line frequency: lines are normalised (ASCII lower case, runs of white space to one space, trimmed) and hashed; for each
host (the source column) the documents that hold a line are counted; lines above the limit are removed, and a document
that loses more than half of its line characters is depleted and rejected.

Documents that hold a line are told apart by a hash of all their normalised lines. Exact copies of one text, however
many, count once: a line is boilerplate where many different texts hold it, not where one text has many copies. Near
copies are different texts and count each.

Texts are split once: counts, line hashes and the hash of all lines go to a table in the shared folder, from which hosts
are counted and verdicts made. Columns of the documents are carried in a struct, so that their names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import cut, row_key, settled, written

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LINE_MIN_DOCS = 20
LINE_MAX_SHARE = 0.01
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * (len(WHITE) - 1)), " "), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, WHITE, "") != "")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), "[\\x20\\x09-\\x0D]+", " "))


def line_hash(line: Column) -> Column:
    """60 bits of MD5, so that SQL engines agree."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text has no words.

    n_repeat_words: a long for each 3-word window, its hash with the low bits replaced by its position, is sorted;
    windows with the hash of a neighbour are compared by their words. If all neighbours of one hash have the same words,
    these windows are the ones that repeat, and the words that they cover are counted. Else (different windows share the
    bits of the hash that are left, a matter of chance), and in texts of over 65,536 words, the windows themselves are
    sorted. The count is exact either way.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines, keys, found = (F.col(c) for c in ("_words", "_lines", "_keys", "_found"))
    one = docs.withColumns({"_words": words_of(text), "_lines": lines_of(text), "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")})
    n = F.size(words)
    mask = F.when(n <= 1 << 12, F.lit(-(1 << 12))).otherwise(F.lit(-(1 << 16))).cast("long")
    starts = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    word = lambda i: F.get(words, i)
    packed = F.when(n <= 1 << 16, F.sort_array(F.transform(starts, lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)).bitwiseAND(F.col("_mask")).bitwiseOR(i.cast("long")))))
    two = one.withColumns({"_mask": mask, "n_words": n.cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}).withColumn("_keys", packed)
    same = lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.col("_mask")) == 0
    three = two.withColumn("_found", F.filter(keys, lambda x, i: same(x, F.get(keys, i + 1)) | same(x, F.get(keys, i - 1))))
    place = lambda x: x.bitwiseAND(F.bitwise_not("_mask")).cast("int")
    differ = lambda p, q: (word(p) != word(q)) | (word(p + 1) != word(q + 1)) | (word(p + 2) != word(q + 2))
    unlike = F.exists(F.transform(found, lambda x, i: same(x, F.get(found, i + 1)) & differ(place(x), place(F.get(found, i + 1)))), lambda x: F.coalesce(x, F.lit(False)))
    whole = F.sort_array(F.transform(starts, lambda w, i: F.struct(F.concat_ws(" ", w, word(i + 1), word(i + 2)).alias("g"), i.alias("p"))))
    four = three.withColumn("_whole", F.when((n > 1 << 16) | unlike, whole))
    long = F.transform(F.filter("_whole", lambda x, i: (x["g"] == F.get("_whole", i + 1)["g"]) | (x["g"] == F.get("_whole", i - 1)["g"])), lambda x: x["p"])
    five = four.withColumn("_at", F.sort_array(F.when(F.col("_whole").isNull(), F.transform(found, place)).otherwise(long)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    six = five.withColumn("n_repeat_words", F.aggregate("_at", start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return six.withColumn("base_failed", failed)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each row of `docs`, from a table in the shared folder: id, key, host, the base counts, lines (its
    distinct normalised lines: line, chars), total (their chars), content (a hash of all its normalised lines in order,
    repeats included; null without a line)."""
    src = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    each = F.transform(F.transform("_lines", normalised), lambda x: F.struct(line_hash(x).alias("line"), F.length(x).cast("long").alias("chars")))
    one = base_counts(src).withColumn("_every", each)
    two = one.withColumns({"lines": F.array_distinct("_every"), "content": F.when(F.size("_every") > 0, F.xxhash64(F.transform("_every", lambda x: x["line"])))})
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    return written(two.select("id", "key", "host", *COUNTS, "lines", total.alias("total"), "content"), "measured")[0]


def frequent_lines(rows: DataFrame, min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """(host, line, n_docs) of the lines that more than max(min_docs, max_share of the host's different documents)
    different documents hold, from what `measured` gives. Both numbers count documents by their content."""
    different = rows.filter("content is not null").select("host", "content", "lines").dropDuplicates(["host", "content"])
    hosts = cut(different.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")))
    held = different.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    return held.filter(F.col("n_docs") > min_docs).join(hosts, "host").filter(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line", "n_docs")


def removed_lines(rows: DataFrame, min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """(key, lost, total, gone): the chars that each document loses, the chars of all its lines, and the lines that go.
    A common line is dealt over salted keys."""
    frequent = cut(frequent_lines(rows, min_docs, max_share)).select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lines = rows.select("key", "host", "total", F.explode("lines").alias("x")).select("key", "host", "total", F.col("x.line").alias("line"), F.col("x.chars").alias("chars"), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    gone = lines.join(frequent, ["host", "line", "salt"]).select("key", "line", "chars", "total").distinct()
    return gone.groupBy("key").agg(F.sum("chars").alias("lost"), F.max("total").alias("total"), F.collect_set("line").alias("gone"))


def depleted() -> Column:
    return F.coalesce(2 * F.col("lost") > F.col("all_chars"), F.lit(False))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """One row for each row of `docs`: the id, the base counts, base_failed, removed_chars and kept.

    A null text has no words and fails; a null host counts as the host ''; equal rows get equal verdicts; a line that
    exactly as many documents hold as the limit says stays; texts of any length are read whole; an empty table gives no rows;
    other columns are not read.
    """
    rows = measured(docs, id_col, text_col, host_col)
    lost = removed_lines(rows, min_docs, max_share).select("key", "lost", F.col("total").alias("all_chars"))
    both = rows.select("id", "key", *COUNTS).join(lost, "key", "left")
    removed = F.coalesce("lost", F.lit(0).cast("long")).alias("removed_chars")
    return settled(both).select(F.col("id").alias(id_col), *COUNTS, removed, (~F.col("base_failed") & ~depleted()).alias("kept"))


def apply_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """The rows that quality_rules keeps, without the lines above the limit; the columns are those of `docs`, whatever
    their names. A null text is rejected, as it has no words; equal rows share their fate."""
    rows = measured(docs, id_col, text_col, host_col)
    lost = removed_lines(rows, min_docs, max_share).withColumnRenamed("total", "all_chars")
    passed = rows.filter(~F.col("base_failed")).select("key").distinct().join(lost, "key", "left").filter(~depleted()).select("key", "gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("gone", line_hash(normalised(x)))), "\n")
    both = whole.join(passed, "key").select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"))
    new = {text_col: F.col("text"), "n_chars": F.length("text")}
    return both.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])
