"""Predicates and labels of symbol strings, as column expressions; the kind lies in the last descriptor's suffix."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Callees that are error handling or plumbing, and marks of generated names.
TRIVIAL_LEAVES = ("tassert", "uassert", "massert", "fassert", "iassert", "invariant", "makeStatus", "makeStatusOK", "Status", "StatusWith")
TRIVIAL_PARTS = ("operator", "source_location", "__builtin_")
ANONYMOUS = "$anonymous_type"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def is_callable(symbol: Column) -> Column:
    return symbol.endswith(").")


def is_type(symbol: Column) -> Column:
    return symbol.endswith("#")


def is_type_query(symbol: Column) -> Column:
    """As is_type for what a user typed: white space at the end doesn't count."""
    return F.rtrim(symbol).endswith("#")


def is_local(symbol: Column) -> Column:
    return symbol.startswith("local ")


#: What a label leaves out, anonymous namespaces and overload hashes.
ANONYMOUS_NAMESPACE, OVERLOAD = r"`\$anonymous_namespace_[^`]*`/", r"\([0-9a-f]{6,}\)"


def short_label(symbol: Column) -> Column:
    """The descriptors without scheme, anonymous namespaces, overload hashes and back-ticks."""
    at = F.instr(symbol, " $ ")
    tail = F.when(at > 0, F.substring(symbol, at + 3, F.length(symbol))).otherwise(symbol)
    plain = F.regexp_replace(F.regexp_replace(tail, ANONYMOUS_NAMESPACE, ""), OVERLOAD, "")
    return F.replace(plain, F.lit("`"), F.lit(""))


def qualified_name(symbol: Column) -> Column:
    return F.regexp_replace(F.substring_index(short_label(symbol), "(", 1), r"\.+$", "")


def leaf_name(symbol: Column) -> Column:
    return F.substring_index(F.substring_index(qualified_name(symbol), "#", -1), "/", -1)


def display_label(symbol: Column, display_name: Column, full: bool = False) -> Column:
    return F.coalesce(F.nullif(display_name, F.lit("")), symbol if full else short_label(symbol))


def is_trivial_callee(symbol: Column) -> Column:
    label, out = short_label(symbol), leaf_name(symbol).isin(*TRIVIAL_LEAVES)
    for part in TRIVIAL_PARTS:
        out = out | label.contains(part)
    return out


def is_noise(symbol: Column) -> Column:
    return symbol.contains(ANONYMOUS) | is_trivial_callee(symbol)


def symbol_kind(symbol: Column) -> Column:
    return F.when(is_local(symbol), "local").when(is_callable(symbol), "callable").when(is_type(symbol), "type").otherwise("other")


def folded(text: Column) -> Column:
    """For fuzzy search: ASCII lower case without underscores."""
    return F.replace(F.translate(text, UPPER, LOWER), F.lit("_"), F.lit(""))


def folded_words(query: str, fuzzy: bool) -> list[str]:
    """The words of a query as `matches` looks for them in folded text, or, if it looks in the plain text, as they are folded."""
    if fuzzy:
        return [w.lower().replace("_", "") for w in query.split()]
    return [w.translate(str.maketrans(UPPER, LOWER)).replace("_", "") for w in query.split()]


def matches(symbol: Column, display_name: Column, query: str, fuzzy: bool = False) -> Column:
    """Each word of the query is in the symbol or in the display name. An empty query matches nothing; a fuzzy word of
    underscores only folds to the empty string, which is in everything."""
    words = query.split()
    if not words:
        return F.lit(False)
    name, out = F.coalesce(display_name, F.lit("")), F.lit(True)
    for w in words:
        if fuzzy:
            w = w.lower().replace("_", "")
            out = out & ((F.instr(folded(symbol), w) > 0) | (F.instr(folded(name), w) > 0))
        else:
            out = out & ((F.instr(symbol, w) > 0) | (F.instr(name, w) > 0))
    return out


def loosen_to_leaf(query: str) -> str | None:
    """The last name in a qualified query, or None where that is nothing new."""
    bare = query.strip().rstrip(".#")
    leaf = re.split(r"#|::|/", bare)[-1]
    return leaf if leaf and leaf != query.strip() else None


def line1(line: Column) -> Column:
    return line + 1


def location(line: Column) -> Column:
    return F.concat(F.lit("L"), (line + 1).cast("string"))
