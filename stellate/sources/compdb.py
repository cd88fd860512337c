"""Compilation databases: loading, filtering, summaries and discovery."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.functions.paths import is_test_file
from stellate.session import cut, remove_path
from stellate.sources.raw import write_file, write_parts


class PipelineError(RuntimeError):
    """A step has nothing to work on."""


def load_compdb(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a compile_commands.json, which has to be a list of objects, or of a folder of such lists. A list is read by
    one task."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    if text.filter(~F.col("value").startswith("[")).limit(1).count():
        raise ValueError(f"{path}: not a list")
    return spark.read.option("multiLine", True).schema("directory string, command string, arguments array<string>, file string, output string").json(path)


def find_compdb(start: str) -> str | None:
    """compile_commands.json in the folder, its build folder, or those of the folders above."""
    here = Path(start.removeprefix("file://")).resolve()
    for d in (here, *here.parents):
        for p in (d / "compile_commands.json", d / "build" / "compile_commands.json"):
            if p.is_file() or (p / "_SUCCESS").is_file():
                return str(p)
    return None


def filter_compdb(entries: DataFrame, src_filter: str | None = None, no_tests: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Entries whose file holds the filter, without tests if asked, and how many of how many were kept and dropped as
    tests."""
    named = entries.filter(F.col("file").contains(src_filter)) if src_filter else entries
    kept = named.filter(~is_test_file(F.col("file"))) if no_tests else named
    n, a, b = entries.count(), named.count(), kept.count()
    if not b:
        raise PipelineError("no translation unit is left")
    return kept, {"kept": b, "total": n, "dropped_tests": a - b}


PATTERNS = 500_000  # changed paths in one automaton


def changed_units(entries: DataFrame, changed: list[str] | DataFrame) -> DataFrame:
    """Entries whose file holds one of the changed paths (a list, or a table with the column path), null ones apart; an empty
    path is in every file.

    The paths are looked for all at once, by an automaton that reads each file's path once. Beyond PATTERNS of them they are
    dealt over several automatons, each a pass over the entries, so that none outgrows a task.
    """
    spark = entries.sparkSession
    paths = changed.select("path") if isinstance(changed, DataFrame) else spark.createDataFrame([(p,) for p in changed], "path string")
    paths = cut(paths.filter("path is not null").distinct())
    blocks = max(1, -(-paths.count() // PATTERNS))
    file = F.col("file")
    hit = F.lit(False)
    for k in range(blocks):
        own = [r["path"] for r in paths.filter(F.pmod(F.xxhash64("path"), F.lit(blocks)) == k).collect()]
        hit = hit | _holds_one(spark, own)(file)
    return entries.filter(hit)


def _holds_one(spark: SparkSession, patterns: list[str]):
    """A column function: whether a text holds one of the patterns."""
    sent = spark.sparkContext.broadcast(patterns)
    built = {}

    @F.pandas_udf("boolean")
    def holds(texts):
        import ahocorasick

        if "it" not in built:
            it = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in sent.value:
                if p:
                    it.add_word(p)
            if len(it):
                it.make_automaton()
            built["it"] = it
        it, every = built["it"], "" in sent.value
        return texts.map(lambda t: t is not None and (every or bool(len(it)) and next(it.iter(t), None) is not None)).astype(bool)

    return holds


def common_prefix(files: DataFrame) -> str:
    """The folder that all files (column file) share; the least and the greatest path bound it."""
    lo, hi, n = files.agg(F.min("file"), F.max("file"), F.count("file")).first()
    if n < 2 or lo.startswith("/") != hi.startswith("/"):
        return ""
    a, b = lo.split("/"), hi.split("/")
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    out = "/".join(a[:k])
    return "" if out in ("", ".") else out


def group_key(rel, depth: int = 2):
    """The first `depth` folders of a relative path; a file without folders is a group of its own name."""
    parts = F.filter(F.split(rel, "/"), lambda p: (p != "") & (p != "."))
    dirs = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(F.nullif(F.array_join(F.slice(dirs, 1, depth), "/"), F.lit("")), F.lit("."))


def summarize(entries: DataFrame, src_filter: str | None = None, depth: int = 2, top: int = 20) -> dict:
    """total, tests, common_prefix, groups (key, units, tests; most units first) and what a filter would keep."""
    f = entries.filter(F.coalesce("file", F.lit("")) != "").select("file", is_test_file(F.col("file")).alias("test"))
    prefix = common_prefix(f)
    rel = F.substring(F.col("file"), len(prefix) + 2, 1 << 20) if prefix else F.col("file")
    groups = f.groupBy(group_key(rel, depth).alias("key")).agg(F.count(F.lit(1)).alias("units"), F.count_if("test").alias("tests")).orderBy(F.desc("units"), "key").limit(top)
    total, tests = f.agg(F.count(F.lit(1)), F.count_if("test")).first()
    out = {"total": total, "tests": tests, "common_prefix": prefix, "groups": [tuple(r) for r in groups.collect()]}
    if src_filter:
        m = f.filter(F.col("file").contains(src_filter))
        out["matched"], out["matched_tests"] = m.agg(F.count(F.lit(1)), F.count_if("test")).first()
    return out


ONE_FILE = 128 << 20  # bytes of entries in a file, which one task writes and reads


def write_compdb(entries: DataFrame, path: str, most: int = ONE_FILE) -> None:
    """A compile_commands.json: one list in one file. Entries of more than about `most` bytes become a folder of that name
    with as many lists, which load_compdb and find_compdb take as one; no task holds more than one list, and no rows pass the
    driver. What was at `path` is replaced when all is written, so that it may be what the entries come from."""
    spark = entries.sparkSession
    rows = entries.select(F.to_json(F.struct(*entries.columns)).alias("entry"))
    size = rows.agg(F.sum(F.octet_length("entry") + 2)).first()[0] or 0
    files = max(1, -(-size // most))

    def run(batches):
        import pyarrow as pa

        begun = False
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([("," if begun or i else "[") + e for i, e in enumerate(b.column(0).to_pylist())])], ["line"])
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], ["line"])

    new = f"{path}.{uuid.uuid4().hex}.new"
    lines = rows.repartition(files).mapInArrow(run, "line string") if size else spark.range(0, 1, 1, 1).select(F.lit("[]").alias("line"))
    (write_file if files == 1 else write_parts)(lines, new, "\n")
    remove_path(spark, path)
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not to.getFileSystem(spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(new), to):
        raise OSError(f"{new} could not be moved to {path}")


def format_summary(s: dict) -> str:
    """The summary as text."""
    share = f", {round(100 * s['tests'] / s['total'])}%" if s["total"] else ""
    lines = [f"{s['total']} translation unit(s), {s['tests']} test(s){share}"]
    if s["common_prefix"]:
        lines.append(f"under {s['common_prefix']}/")
    lines += [f"{n:>6} {t:>6}  {key}" for key, n, t in s["groups"]]
    if "matched" in s:
        lines.append(f"the filter keeps {s['matched']} ({s['matched_tests']} test(s))")
    return "\n".join(lines)
