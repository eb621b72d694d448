"""URL filters: host and path rules first, then trust and distrust spread over the link graph.

Personalised PageRank runs from the hosts that rules allow along host links, and from the hosts
that rules block against them; a host is blocked where distrust outweighs trust by a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ascii_lower, written

#: Steps before the first test of convergence; steps go on until the ranks have converged.
ROUNDS = 8
DAMPING = 0.85
#: A host is blocked if distrust - trust, as shares of the mean seed, is over this.
MARGIN = 0.05
#: The ranks have converged if what is left to move, as a multiple of an even share, is under this part of MARGIN.
TOLERANCE = 1e-3


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct<rule,verdict> of the longest rule that fits; null if none does. Equal lengths: the longer host, then a block."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): how many absolute or scheme-relative (``//host``) links of src's pages point to another host."""
    host, _ = host_and_path(F.col(url))
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    target, _ = host_and_path(F.when(F.startswith("__link", F.lit("//")), F.concat(F.lit("relative:"), F.col("__link"))).otherwise(F.col("__link")))
    pairs = pages.select(host.alias("src"), F.explode(links).alias("__link")).select("src", target.alias("dst"))
    return pairs.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _left_to_move(ranks: DataFrame, before: DataFrame, shrink: float) -> float:
    """A bound on the summed distance from ``ranks`` to the converged ones, as a multiple of an even share: changes shrink by ``shrink`` from ``before`` to ``ranks`` and on."""
    change = ranks.unionByName(before.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("change"))
    summed, n = change.agg(F.sum(F.abs("change")), F.count("*")).first()
    return (summed or 0.0) * n * shrink / (1 - shrink)


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE * MARGIN) -> DataFrame:
    """(host, trust, distrust) of the walks from ``seeds`` (kind ``allow`` or ``block``, host, weight), converged.

    Both walks run together: trust along the links, distrust against them. Steps go on, ``rounds``
    at least and without an upper limit, until no rank can be further than ``tolerance`` of an even
    share from where it converges; each step shrinks the change by ``damping``, so that ends. Every
    round is written, so the plan stays short, a lost executor repeats one round at most and a hub's
    links can be split; the driver sees two numbers per test. The ranks are those of the walk that
    ends at a host without links. Divided by their sum they are the PageRank in which that walk
    starts again from the seeds, since both differ by one factor a kind.
    """
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = written(both, "links")  # neither side of the joins below is an aggregate, so Spark can split the links of a hub
    out = written(both.groupBy("kind", "src").agg(F.sum("weight").alias("all")), "link-counts")
    steps = written(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all")).alias("p")), "steps")
    base = written(seeds, "seeds")
    total = base.groupBy("kind").agg(F.sum("weight").alias("all"))
    base = base.join(F.broadcast(total), "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("rank"))
    restart = base.withColumn("rank", F.col("rank") * (1 - damping))
    ranks = base
    if not steps.isEmpty():
        done, before, converged = 0, ranks, False
        while not converged:
            moved = ranks.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("rank"))
            ranks = written(moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
            done += 1
            if done % 2 == 0:
                converged = done >= rounds and _left_to_move(ranks, before, damping**2) <= tolerance
                before = ranks
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(side("allow").alias("trust"), side("block").alias("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html", rounds: int = ROUNDS, margin: float = MARGIN) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust and distrust.

    A rule decides where one fits. Elsewhere the host is blocked if its share of all distrust
    exceeds its share of all trust by more than ``margin`` of an even share (one by the number of
    hosts that either reaches); a host that nothing reaches is allowed. Trust and distrust are
    given as multiples of an even share, before they are divided by their sums.

    * Null url, or one without ``://``: empty host and path, no rule, allowed. Null html: no links.
    * Repeated rows and page_ids, null page_ids: judged one by one. Other columns are not read.
    * No page that a rule allows or blocks: no seeds of that kind and no spread from it.

    Links are counted per pair of hosts before the shuffle; pages meet written scores by host in a
    join whose hot hosts can be split, and html is read once and never shuffled.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(page_id).alias("__id"), host.alias("host"), path.alias("path")).withColumn("__m", matched_rule(F.col("host"), F.col("path"), rules))
    seeds = judged.filter(F.col("__m").isNotNull() & (F.col("host") != "")).groupBy(F.col("__m")["verdict"].alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    scores = propagate(host_edges(pages, url, html), seeds, rounds, tolerance=TOLERANCE * (margin if margin > 0 else MARGIN))
    scores = written(scores, "scores")
    sums = scores.agg(F.count("*").alias("n"), F.sum("trust").alias("t"), F.sum("distrust").alias("d"))  # one row
    share = lambda c, all: F.when(F.col(all) > 0, F.col(c) / F.col(all)).otherwise(F.lit(0.0))
    bad = F.round((share("distrust", "d") - share("trust", "t")) * F.col("n"), 9) > margin
    even = lambda c: F.round(F.col(c) * F.col("n"), 9).alias(c)
    scores = written(scores.crossJoin(F.broadcast(sums)).select(F.col("host").alias("__host"), even("trust"), even("distrust"), bad.alias("__bad")), "host-verdicts")
    spread = F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow"))
    zero = F.lit(0.0)
    rows = judged.join(scores, F.col("host") == F.col("__host"), "left").withColumns({"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)})
    return rows.select(F.col("__id").alias(page_id), "host", "path", F.col("__m")["rule"].alias("rule"), F.coalesce(F.col("__m")["verdict"], spread).alias("verdict"), "trust", "distrust")
