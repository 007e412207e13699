"""URL filters: longest host-and-path rules, and trust that spreads over the links between hosts.

Only DataFrame functions. Pages that rules judge make their hosts seeds: pages allowed by a rule of trust, pages
blocked by one of distrust; all seeds of a kind add up to one, so a verdict does not depend on how many pages rules of
either kind judge. Trust follows links, as personalised PageRank; distrust follows them backwards, to those who link to
blocked hosts. A host whose distrust exceeds its trust, times a threshold, is blocked.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host, path)
Rule = tuple[str, str, str]
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*([a-z][a-z0-9+.-]*://[^\s\"'>]+)"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    found = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits; null if none does. Of equals the last by name."""
    fits = []
    for verdict, own, prefix in rules:
        fit = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        fits.append(F.when(fit, F.struct(F.lit(len(own + prefix)).alias("size"), F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits)) if fits else none


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another host, counted."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1)).alias("link"))
    ends = links.select("src", host_of(F.col("link")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return ends.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_trust(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) over edges (src, dst, n). Seeds count as parts of their sum.

    Trust of a host is handed to the hosts that it links to, by their share of its links; distrust to the hosts that
    link to it, by their share of the links to it. What reaches a host without such links ends there.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    onward = edges.join(out, "src").select(F.col("src").alias("origin"), F.col("dst").alias("host"), (F.col("n") / F.col("all")).alias("t"), F.lit(0.0).alias("d"))
    behind = edges.join(back, "dst").select(F.col("dst").alias("origin"), F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("n") / F.col("all")).alias("d"))
    shares = checkpointed(onward.unionByName(behind).groupBy("origin", "host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    whole = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))  # one row
    part = lambda c, of: F.coalesce(F.try_divide(F.col(c), F.col(of)), F.lit(0.0)).alias(c)
    seeds = checkpointed(seeds.crossJoin(F.broadcast(whole)).select("host", part("trust", "t"), part("distrust", "d")))
    now = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    if shares.isEmpty():
        return now  # as any number of rounds would leave it
    for _ in range(rounds):
        moved = shares.join(now.withColumnRenamed("host", "origin"), "origin").select("host", (F.col("t") * F.col("trust") * damping).alias("trust"), (F.col("d") * F.col("distrust") * damping).alias("distrust"))
        kept = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
        now = checkpointed(moved.unionByName(kept).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    return now


def url_verdicts(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, rounds: int = 10, threshold: float = 1.0) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule (host and path of the rule that fits, or null), verdict.

    A page that no rule fits is blocked if its host's distrust exceeds its trust times the threshold; a host that neither reaches, a
    tie and an empty host allow. Null urls and those without :// have an empty host and path; null html has no
    links. Repeated rows give a row each and count as often; other columns are ignored.
    """
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    read = parts.withColumn("found", judged(F.col("host"), F.col("path"), rules))
    count = lambda verdict: F.sum(F.when(F.col("found.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = read.where("found is not null and host <> ''").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    bad = host_trust(host_edges(pages, url_col=url_col, html_col=html_col), seeds, damping=damping, rounds=rounds)
    bad = bad.where(F.col("distrust") > F.col("trust") * threshold).select("host", F.lit(True).alias("bad"))
    return read.join(bad, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
    )
