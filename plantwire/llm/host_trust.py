"""URL filtering: rules where they fit, else trust and distrust spread over the graph of hosts.

Hosts are linked by the links on their pages, and a host is linked with the hosts it is part of
by name. Trust starts from hosts with allowed pages and follows links; distrust starts from
hosts with blocked pages and follows links backwards. Both are personalised PageRank, computed
together, one row per host and direction. A host is blocked by the method if its distrust is
more than a given part of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stages

DAMPING = 0.85
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """Verdict for a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` (with host and path) with the text and verdict of the longest rule that fits; else null.

    Rules are tried from the longest to the shortest, equally long ones in the order given.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        under = (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
        fits = under & F.col("path").startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return pages.withColumns({"rule": text, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) between hosts: number of links on the pages of src, relative ones to itself.

    A host also has one edge to and from each host of at least two labels that it is a subdomain of.
    """
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), 1)).alias("link"))
    to = F.regexp_extract("link", r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    named = F.col("link").rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") & (to == "")  # mailto: and the like
    found = links.filter(~named).select(F.col("host").alias("src"), F.when(to == "", F.col("host")).otherwise(_ascii_lower(to)).alias("dst"))
    counted = found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    labels = F.split("host", r"\.")
    parents = F.expr(r"transform(sequence(2, greatest(size(l) - 1, 2)), i -> array_join(slice(l, i, size(l)), '.'))")
    up = (
        pages.select("host").filter("host <> ''").distinct().withColumn("l", labels).filter("size(l) > 2")
        .select(F.col("host").alias("src"), F.explode(parents).alias("dst"))
    )
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return counted.filter("src <> '' AND dst <> ''").unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, stages: Stages, damping: float = DAMPING, tolerance: float = 1e-3, unroll: int = 4) -> DataFrame:
    """Personalised PageRank of each kind of seed: (kind, host, score).

    ``edges``: kind, src, dst, weight; ``seeds``: kind, host, weight. Scores of a kind add up to
    one; a host without out-edges keeps what it sends. Rounds end when no host's score moves by
    more than ``tolerance`` of itself and no new host is reached, so that hosts with a small part
    of all scores are as exact as others. A move shrinks by damping with every round; scores
    under 1e-300 are beyond double precision and not waited for.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = stages.write(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("seed")), "seeds")
    ends = start.select("kind", "host").unionByName(edges.select("kind", F.col("dst").alias("host"))).distinct()
    stuck = ends.join(edges.select("kind", F.col("src").alias("host")).distinct(), ["kind", "host"], "left_anti")
    edges = edges.unionByName(stuck.select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("weight")))
    outs = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    steps = stages.write(
        edges.join(outs, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("part")), "steps"
    )
    now = start.select("kind", "host", F.col("seed").alias("score"))
    turn = 0
    while True:
        before = now
        for _ in range(unroll):
            sent = now.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("part")).alias("score"))
            back = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
            now = sent.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        turn += 1
        now = stages.write(now, f"scores-{turn}")
        moves = now.unionByName(before.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(
            F.abs(F.sum("score")).alias("d"), F.max("score").alias("score")
        )
        change = moves.filter("score > 1e-300").agg(F.max(F.col("d") / F.col("score"))).first()[0]
        if turn > 1:
            stages.drop(f"scores-{turn - 1}")
        if not change or change <= tolerance:
            return now


def judge(pages: DataFrame, rules: list[Rule] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """Host, path, rule, verdict and the host's trust and distrust for every page.

    ``pages``: page_id, url, html; other columns are ignored. Returns page_id, host, path, rule
    (text of the longest rule that fits, else null), trust, distrust and verdict: that of the
    rule, else block if distrust is more than ``threshold`` of the host's trust and distrust
    together, else allow. So hosts that neither reaches, and pages without host, are allowed.
    Null html has no links; a url that is null or has no ``://`` has empty host and path. One
    row for each input row, repeated or not. An empty table gives no rows.
    """
    stages = Stages(pages.sparkSession, "hosts")
    with_host = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = stages.write(judge_by_rules(with_host.drop("html"), rules), "ruled")
    links = stages.write(host_edges(with_host.select("host", "html")), "edges")
    seeds = ruled.filter("rule_verdict IS NOT NULL AND host <> ''").groupBy(
        F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host"
    ).agg(F.count("*").cast("double").alias("weight"))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    scores = spread(edges, seeds, stages, damping)
    by_host = scores.groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    by_host = stages.write(by_host, "by-host")
    # the part is rounded, not the scores: those of all hosts add up to one and shrink with their number
    both = F.col("trust") + F.col("distrust")
    blocked = F.round(F.when(both > 0, F.col("distrust") / both), 9) > threshold
    return ruled.join(by_host, "host", "left").select(
        "page_id", "host", "path", "rule", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"),
        F.coalesce("rule_verdict", F.when(blocked, "block"), F.lit("allow")).alias("verdict"),
    )
