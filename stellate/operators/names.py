"""An index of names: for each three characters of folded symbols and display names the ids that hold them.

A posting row holds the ids of one gram within 65,536 consecutive ids, so that no list has to fit into a task. The table is
sorted by gram: a query reads the row groups of its own grams. What the grams leave is a candidate and still compared; a
row that has since changed or gone only adds a candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellate.functions.symbols import folded, folded_words

GRAM, PART, RAREST = 3, 16, 3
POSTINGS = "gram string, part long, n int, ids array<long>"
FEW = 1000  # ids that reach the scan as literals


def postings(symbols: DataFrame) -> DataFrame:
    """(gram, part, n, ids) of symbols (id, symbol, display_name)."""

    def grams(text):
        places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1)))
        return F.coalesce(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))), F.array().cast("array<string>"))

    texts = symbols.select("id", folded(F.col("symbol")).alias("a"), folded(F.coalesce("display_name", F.lit(""))).alias("b"))
    each = texts.select("id", F.explode(F.array_union(grams(F.col("a")), grams(F.col("b")))).alias("gram"))
    return each.groupBy("gram", F.shiftright("id", PART).alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids")).select("gram", "part", F.size("ids").alias("n"), "ids")


def candidates(index: DataFrame, symbols: DataFrame, query: str, fuzzy: bool = False) -> DataFrame:
    """The rows of `symbols` that hold the rarest grams of every word of the query, a few of each; all of them if no word is
    long enough to have a gram."""
    by_word = [{w[i : i + GRAM] for i in range(len(w) - GRAM + 1)} for w in folded_words(query, fuzzy)]
    every = sorted(set().union(*by_word))
    if not every:
        return symbols
    own = index.filter(F.col("gram").isin(every))
    counts = {r["gram"]: r["n"] for r in own.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each gram of the query
    if len(counts) < len(every):
        return symbols.limit(0)
    chosen = sorted({g for grams in by_word for g in sorted(grams, key=lambda g: (counts[g], g))[:RAREST]})
    hits = index.filter(F.col("gram").isin(chosen)).select("gram", F.explode("ids").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(chosen)).select("id")
    if min(counts[g] for g in chosen) <= FEW:
        return symbols.filter(F.col("id").isin([r["id"] for r in hits.collect()]))
    return symbols.join(hits, "id", "left_semi")
