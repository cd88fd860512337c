"""URL filters: host and path rules, and propagation of trust and distrust over the graph of linked hosts.

Trust starts at hosts in proportion to their pages that an allow rule fits and follows links; distrust starts at hosts
in proportion to their pages that a block rule fits and follows links backwards (who links to bad hosts is suspect).
Both are personalised PageRank over host edges, run together as one table of ranks. A host is blocked where distrust
holds more than `threshold` of its mass; a host that neither reaches is allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellate.llm.common import cut

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
LOOK = 4  # rounds between looks at what moved
SALTS = 8
BROADCAST_HOSTS = 100_000
UNSEEN = "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
LINK = "(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*[\"']?(?:https?:)?//([^/\"'?#\\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and for one without ://"""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def rule_verdict(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; of two equally long ones block wins. Null where none fits."""
    rule = action = F.lit(None).cast("string")
    for what, domain, prefix in sorted(RULES if rules is None else rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule, action = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, from the links of the pages; those in comments, scripts and styles are none."""
    seen = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), UNSEEN, " ")
    links = pages.select(host_and_path(F.col(url_col))[0].alias("src"), F.explode(F.regexp_extract_all(seen, F.lit(LINK), F.lit(1))).alias("dst"))
    return links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """edges (src, dst, links), seeds (host, trust, distrust) -> (host, trust, distrust), where trust and distrust have the
    mass of their seeds.

    Ranks and edges carry a kind: 't' follows links, 'd' follows them backwards. Without edges the seeds are the fixed
    point. Rounds go on until what is still to move is at most `tolerance` of the seeds' mass, in sum over all hosts: a round
    moves at most `damping` of what the one before moved, so that the end is reached by log(tolerance) / log(damping) rounds
    (86), and sooner where a look at the last round says so. Mass at hosts without links goes back to the seeds, which is
    the same as giving each kind its seeds' mass in the end. The edges of a host with many lie under salted keys. Lineage is
    cut at each look.
    """
    both = edges.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), "src", "dst", "links"), F.struct(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))).alias("e")).select("e.*")
    total = both.groupBy("kind", "src").agg(F.sum("links").alias("total"))
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    share = cut(both.select("*", salt).join(total.select("*", salts), ["kind", "src", "salt"]).select("kind", "src", "salt", "dst", (F.col("links") / F.col("total")).alias("w")))
    seed = cut(seeds.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("host"), F.col("trust").cast("double").alias("p")), F.struct(F.lit("d").alias("kind"), F.col("host"), F.col("distrust").cast("double").alias("p")))).alias("s")).select("s.*").filter("p > 0"))
    rank = seed.select("kind", "host", F.col("p").alias("r"))
    linked = not share.isEmpty()
    most = math.ceil(math.log(tolerance) / math.log(damping))
    mass = (seed.agg(F.sum("p")).first()[0] or 0.0) if linked else 0.0
    for k in range(most if linked else 0):
        given = share.join(rank.select("kind", F.col("host").alias("src"), "r", salts), ["kind", "src", "salt"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("w") * F.col("r"))).alias("g"))
        new = seed.join(given, ["kind", "host"], "full").select("kind", "host", ((1 - damping) * F.coalesce("p", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("r"))
        if k % LOOK == LOOK - 1 or k == most - 1:
            before, new = rank.withColumnRenamed("r", "was"), cut(new)
            moved = new.join(before, ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("r", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
            rank = new
            if moved * damping / (1 - damping) <= tolerance * mass:
                break
        else:
            rank = new
    sums = rank.groupBy("kind").agg(F.sum("r").alias("held")).join(seed.groupBy("kind").agg(F.sum("p").alias("given")), "kind")
    rank = rank.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("r") * F.col("given") / F.col("held")).alias("r"))  # sums: a row for each kind
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("r")).otherwise(0.0))
    return rank.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=None, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `pages`: the id, host, path, rule (null where none fits), verdict (allow or block).

    The verdict is the rule's, else the host's by propagation. A null url, or one without ://, has an empty host, fits
    no rule and is allowed. Repeated rows are judged alike, and each counts as a page of its host. A host with as much
    trust as distrust is allowed. Urls and pages of any length are read whole; an empty table gives no rows; columns that
    aren't named are not read. Pages are never dealt out by host: blocked hosts are broadcast up to BROADCAST_HOSTS of
    them (counted first), and joined under salted keys beyond.
    """
    host, path = host_and_path(F.col(url_col))
    rule, action = rule_verdict(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).select("id", "host", "path", rule.alias("rule"), action.alias("action"))
    seeds = judged.filter("host <> '' and action is not null").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("trust"), F.count_if(F.col("action") == "block").alias("distrust"))
    ranks = propagate(host_edges(pages, url_col, html_col), seeds, damping, tolerance)
    bad = cut(ranks.filter(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("spread")))
    if bad.count() <= BROADCAST_HOSTS:
        known = judged.join(F.broadcast(bad), "host", "left")
    else:
        salted = bad.select("host", "spread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        known = judged.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return known.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))
