"""Raw bytes of files of any size, cut into chunks by as many tasks as Spark has splits for them.

Spark's text source reads a file by byte ranges, on any file system it knows, and with a line separator of one byte it
gives what lies between separators unchanged, whatever it is. Behind each value the separator is put back, and since the
values of a split follow each other, the length of all splits before says at which byte of its file each chunk begins. A
file that ends without the separator gets one too many, which the file's size tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellate.session import cut as cut_lineage
from stellate.session import fresh_path

CHUNK = 1 << 20
SMALL = 100_000  # splits whose offsets are broadcast at most
#: Endings of names for which the text source would decompress.
CODECS = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, split, size, v): bytes up to and with each separator."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), meta["file_size"].alias("size"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("v"))


def _cut(chunk: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["file", "split", "size", "at", "body"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        key, at, held, n = None, 0, [], 0

        def done():
            nonlocal at, held, n
            row = [[*key, at, b"".join(held)]] if n else []
            at, held, n = at + n, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*row, strict=True), kinds, strict=True)], names) if row else None

        for b in batches:
            if not b.num_rows:
                continue
            values = b.column(3)
            ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
            whole = values.buffers()[2]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            start = 0
            for i, k in enumerate(keys):
                if k != key or n + ends[i + 1] - ends[start] > chunk:
                    if start < i:
                        held.append(whole[int(ends[start]) : int(ends[i])].to_pybytes())
                        n += int(ends[i] - ends[start])
                    start = i
                    if (out := done()) is not None:
                        yield out
                    if k != key:
                        key, at = k, 0
            held.append(whole[int(ends[start]) : int(ends[-1])].to_pybytes())
            n += int(ends[-1] - ends[start])
        if (out := done()) is not None:
            yield out

    return run


def _unsplit(spark: SparkSession, paths: list[str], chunk: int) -> DataFrame:
    """(file, split, offset, body) of files whose names ask for decompression, each a value of up to 2 GB first."""
    whole = spark.read.format("binaryFile").load([escaped(p) for p in paths]).select(F.col("_metadata.file_path").alias("file"), "content", F.col("length").alias("size"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk).cast("long"))).alias("offset")
    return whole.select("file", "content", at).select("file", F.lit(0).cast("long").alias("split"), "offset", F.substring("content", (F.col("offset") + 1).cast("int"), F.lit(chunk)).alias("body"))


def files_at(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, size) of the files at a path or pattern, in order, named as in `chunks`; a listing, without their bytes."""
    return [(f, n) for f, n, _ in _listed(spark, path)]


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    found = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "length", "path")
    return sorted(tuple(r) for r in found.collect())


def chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, split, offset, body): all bytes of the files at `path`, about `chunk` of them in a row. Rows of a split lie in one
    partition in order of their offsets, and a split's first row says where the split's bytes begin. An empty file has no rows.

    Files whose names end as those of compressed files do are read whole, as the source would decompress them. Bytes without
    a single separator (0x0A) in them are one value, of 2 GB at most.
    """
    files = [p for _, _, p in _listed(spark, path)]
    packed = [p for p in files if p.endswith(CODECS)]
    plain = [p for p in files if not p.endswith(CODECS)]
    parts = [_split(spark, plain, chunk)] * bool(plain) + [_unsplit(spark, packed, chunk)] * bool(packed)
    if not parts:
        return spark.createDataFrame([], "file string, split long, offset long, body binary")
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _split(spark: SparkSession, paths: list[str], chunk: int) -> DataFrame:
    lines = _lines(spark, [escaped(p) for p in paths])
    lengths = lines.groupBy("file", "split", "size").agg(F.sum(F.octet_length("v")).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(F.col("file").alias("_f"), F.col("split").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = cut_lineage(starts)
    few = starts.count() <= SMALL
    cut = lines.mapInArrow(_cut(chunk), "file string, split long, size long, at long, body binary")
    found = cut.join(F.broadcast(starts) if few else starts, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    offset: Column = F.col("start") + F.col("at")
    body = F.substring("body", F.lit(1), F.least(F.octet_length("body"), F.col("size") - offset).cast("int"))  # without a separator that the file doesn't have
    out = found.select("file", "split", offset.alias("offset"), body.alias("body")).filter(F.octet_length("body") > 0)
    return out if few else out.sortWithinPartitions("file", "split", "offset")


def escaped(path: str) -> str:
    """A path that holds characters of patterns, as a pattern for itself."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def write_parts(rows: DataFrame, path: str, last: str) -> None:
    """The bytes of the column of `rows` one row behind the other in files at `path`, in order of the partitions. `last` is what
    every row ends with, which is left to the sink as its separator: the rows come without it."""
    (name,) = rows.columns
    rows.select(F.col(name).cast("string")).write.mode("overwrite").option("lineSep", last).text(path)


def write_file(rows: DataFrame, path: str, last: str) -> None:
    """As write_parts, one file, written by one task and moved to `path`."""
    spark = rows.sparkSession
    at = fresh_path(spark, "file")
    write_parts(rows, at, last)
    hadoop = spark._jvm.org.apache.hadoop.fs
    to = hadoop.Path(path)
    fs, conf = to.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()
    parts = hadoop.Path(f"{at}/part-*")
    here = parts.getFileSystem(conf)
    found = sorted(x.getPath().toString() for x in here.globStatus(parts))
    if not found:  # no rows in any partition
        fs.create(to, True).close()
    for part in found:
        hadoop.FileUtil.copy(here, hadoop.Path(part), fs, to, True, True, conf)
    here.delete(hadoop.Path(at), True)
