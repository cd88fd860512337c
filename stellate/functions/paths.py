"""Predicates and projections of file paths, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the sources that a graph is built from.
SOURCE_EXTENSIONS = (".cpp", ".cc", ".cxx", ".c", ".cu", ".h", ".hpp", ".hh", ".hxx", ".ipp", ".inl", ".cuh")


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_node_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def is_test_file(path: Column) -> Column:
    """A path with a /test/ or /tests/ part, or a test-like stem; null and empty paths are not tests."""
    p = F.lower(slashed(path))
    stem = F.regexp_replace(basename(p), r"\.[^.]*$", "")
    named = stem.startswith("test_") | stem.endswith("_test") | stem.endswith("_tests") | stem.endswith("_unittest") | stem.contains("_test_")
    return F.coalesce(p.contains("/test/") | p.contains("/tests/") | named, F.lit(False))


def _prefixes(paths: Iterable[str] | None) -> list[str]:
    return [x for x in (p.replace("\\", "/").rstrip("/") for p in paths or ()) if x]


def under_any(path: Column, prefixes: Iterable[str] | None) -> Column:
    """Whether a path is one of the prefixes or below one; a prefix ends at a path segment."""
    out, p = F.lit(False), slashed(path)
    for x in _prefixes(prefixes):
        out = out | (p == x) | p.startswith(x + "/")
    return out


def path_ok(path: Column, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> Column:
    """Include first, then exclude; an empty list counts as not given; a null path passes unless include is given."""
    out = F.lit(True)
    if include:
        out = out & F.coalesce(under_any(path, include), F.lit(False))
    if exclude:
        out = out & ~F.coalesce(under_any(path, exclude), F.lit(False))
    return out


def is_source_file(path: Column) -> Column:
    out = F.lit(False)
    for x in SOURCE_EXTENSIONS:
        out = out | F.lower(path).endswith(x)
    return out


def project_root_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")
