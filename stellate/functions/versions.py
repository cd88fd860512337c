"""Version strings as arrays of numbers, which compare like their versions, and advice on rebuilding."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("none", "store", "reindex")


def parse_version(text: Column) -> Column:
    """Dotted numbers after an optional v, up to the first part that isn't one; an empty array for null or none."""
    parts = F.split(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^[vV]", ""), r"\.")
    digits = F.transform(parts, lambda p: F.regexp_extract(p, r"^(\d+)", 1))
    whole = F.transform(parts, lambda p: p.rlike(r"^\d+$"))
    stop = F.array_position(whole, False)
    n = F.when(stop == 0, F.size(parts)).otherwise(F.when(F.get(digits, (stop - 1).cast("int")) != "", stop).otherwise(stop - 1)).cast("int")
    return F.transform(F.slice(digits, F.lit(1), n), lambda p: p.cast("int"))


def version_tuple(text: str | None) -> tuple[int, ...]:
    """The same on the driver."""
    out = []
    for part in (text or "").strip().lstrip("vV").split("."):
        m = re.match(r"\d+", part)
        if not m:
            break
        out.append(int(m[0]))
        if m[0] != part:
            break
    return tuple(out)


def read_registry(path: str, max_age: float | None = 86_400) -> dict | None:
    """A version registry that was saved as JSON, or None if it is missing, unreadable or older than max_age seconds."""
    p = Path(path)
    try:
        if max_age is not None and time.time() - p.stat().st_mtime > max_age:
            return None
        found = json.loads(p.read_text())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def level_rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1, F.lit(0)).cast("long")


def max_rebuild_level(releases: DataFrame, current: str, latest: str) -> DataFrame:
    """releases (version, level) -> one row: the highest level over the versions in (current, latest]."""
    v = parse_version(F.col("version"))
    between = releases.filter((v > parse_version(F.lit(current))) & (v <= parse_version(F.lit(latest))))
    return between.agg(F.coalesce(F.max(level_rank(F.col("level"))), F.lit(0).cast("long")).alias("rank")).select("rank", F.get(F.array(*map(F.lit, LEVELS)), F.col("rank").cast("int")).alias("level"))


def update_advice(releases: dict[str, str], current: str | None, latest: str | None, built_with: str | None) -> dict:
    """What to do about a tool of version `current` and a store that `built_with` made: update, rebuild, reindex."""
    have, last, made = version_tuple(current), version_tuple(latest), version_tuple(built_with)

    def level(low, high):
        ranks = [LEVELS.index(x) for v, x in releases.items() if low < version_tuple(v) <= high and x in LEVELS]
        return LEVELS[max(ranks, default=0)]

    return {"current": current, "latest": latest, "update_available": bool(last) and last > have, "rebuild_now": level(made, have) if made else "none", "rebuild_after_update": level(made or have, last) if last else "none"}


def advise(releases: DataFrame, current: str | None, latest: str | None = None, built_with: str | None = None) -> DataFrame:
    """As update_advice over a table of releases (version, level), in one pass and as one row; without `latest` the newest of
    them. A level that isn't known asks for nothing."""
    v, have, made = parse_version(F.col("version")), parse_version(F.lit(current)), parse_version(F.lit(built_with))
    last = F.max(v) if latest is None else parse_version(F.lit(latest))
    reached = F.lit(True) if latest is None else v <= last
    rank = lambda low, high: F.coalesce(F.max(F.when((v > low) & high, level_rank(F.col("level")))), F.lit(0)).cast("int")
    known = version_tuple(built_with) != ()
    got = releases.agg(
        (F.max_by("version", v) if latest is None else F.lit(latest)).alias("latest"),
        last.alias("last"),
        (rank(made, v <= have) if known else F.lit(0)).alias("now"),
        rank(made if known else have, reached).alias("after"),
    )
    some = F.coalesce(F.size("last") > 0, F.lit(False))
    level = lambda n: F.get(F.array(*map(F.lit, LEVELS)), n)
    return got.select(
        F.lit(current).cast("string").alias("current"),
        "latest",
        (some & F.coalesce(F.col("last") > have, F.lit(False))).alias("update_available"),
        level(F.col("now")).alias("rebuild_now"),
        level(F.when(some, F.col("after")).otherwise(0)).alias("rebuild_after_update"),
    )


def indexer_advice(made_by: str | None, installed: str | None, pinned: str | None, rebuild: str = "none") -> dict:
    """Whether the installed indexer is the pinned one, and whether to index again: where the index was made by another
    version than the pinned one and that asks for a rebuild. Without a pin nothing is checked."""
    made, have, pin = ((x or "").strip().lstrip("vV") for x in (made_by, installed, pinned))
    if not pin:
        return {"checked": False}
    status = "unknown" if not have else "ok" if have == pin else "stale"
    return {"checked": True, "index": made_by, "installed": installed, "pinned": pin, "installed_status": status, "reindex": bool(made) and made != pin and rebuild in LEVELS[1:]}
