"""URL rules by host and path, and trust over the link graph of hosts for pages without a rule.

Rules fit a host and its subdomains and a path by prefix; the longest wins. They are joined to distinct hosts, not to
pages. Seeds: a host that a block rule fits as a whole is blocked, one that only allow rules reach is trusted. Links between
hosts, counted per pair before any shuffle, carry personalised PageRank forward from the trusted seeds and distrust
backward from the blocked ones (who links to a bad host is worse for it), at any distance. Both are sums to one over all
hosts; a host is blocked if its part of distrust in both is above the threshold.

Null URLs, and those without `://`: empty host and path, no rule, allowed. Null page ids stay null; repeated rows give
repeated results; an empty table gives none. Null html: no links. Only page_id, url and html are read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts up to which their verdicts are broadcast; beyond, they are joined by a shuffle that splits skewed hosts.
BROADCAST_HOSTS = 100_000
#: The smallest score of a host that was reached, however far away: a product of many parts would become 0.
LEAST = 1e-300
Rule = tuple[str, str, str]
HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rules_of(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_host, rule_path, rule, verdict; rules: (verdict, host, path beginning with /)."""
    return spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "rule_host string, rule_path string, rule string, verdict string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules that fit a host, the longest first, for hosts with any."""
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).head()[0] or 0
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, labels)))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    fit = hosts.where(F.col("host") != "").select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    entry = F.struct((-F.length("rule")).alias("order"), "rule", "rule_path", "verdict")
    return fit.groupBy("host").agg(F.array_sort(F.collect_set(entry)).alias("rules"))


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages of one host to another."""
    target = F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1)))
    rows = pages.select(F.col("host").alias("src"), target.alias("href"))
    href = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    rows = rows.where(href.rlike(r"(?i)^https?://")).select("src", host_of(href).alias("dst"))
    return rows.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """way, host, score. edges: src, dst, n. seeds: way (trust or distrust), host; distrust takes the edges backward.

    What hosts without links onward hold goes back to the seeds. Rounds go on until no host is reached for the first time
    and, if both ways reach any, no score moves by more than its own size times tolerance: a score's size depends on the
    number of seeds, and a host's verdict on the ratio of its scores, or on which way reaches it where only one does. A
    round's largest such move is never below a later one's once all hosts are reached. rounds: at most so many."""
    both = edges.select(F.lit("trust").alias("way"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("way", "src").agg(F.sum("n").alias("all"))
    steps = staged(both.join(out, ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("all")).alias("part")), "steps")
    many = seeds.groupBy("way").agg(F.count("*").alias("m"))
    start = staged(seeds.join(F.broadcast(many), "way").select("way", "host", (1 / F.col("m")).alias("seed")), "seeds")  # two counts
    ranks = start.select("way", "host", F.col("seed").alias("score"))
    if steps.isEmpty():
        return ranks
    sources = staged(steps.select("way", F.col("src").alias("host")).distinct(), "sources")
    contested = None
    for _ in count() if rounds is None else range(rounds):
        flow = ranks.join(steps, (ranks["way"] == steps["way"]) & (F.col("host") == F.col("src"))).groupBy(steps["way"], "dst").agg(F.sum(F.col("score") * F.col("part")).alias("flow"))
        held = ranks.join(sources, ["way", "host"], "left_anti").groupBy("way").agg(F.sum("score").alias("held"))
        back = {r["way"]: r["held"] for r in held.collect()}  # two rows
        part = F.when(F.col("way") == "trust", F.lit(back.get("trust", 0.0))).otherwise(F.lit(back.get("distrust", 0.0)))
        new = flow.select("way", F.col("dst").alias("host"), "flow").join(start, ["way", "host"], "full_outer")
        score = damping * F.coalesce("flow", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0)) * (1 - damping + damping * part)
        new = staged(new.select("way", "host", F.greatest(score, F.lit(LEAST)).alias("score")), "ranks")
        change = F.when(F.col("old").isNull(), F.lit(float("inf"))).otherwise(F.abs(F.col("score") - F.col("old")) / F.col("score"))
        moved = new.join(ranks.select("way", "host", F.col("score").alias("old")), ["way", "host"], "left").agg(F.max(change)).head()[0]
        drop_staged(ranks)
        ranks = new
        if moved is None or moved <= tolerance:
            break
        if contested is None and moved < float("inf"):  # all are reached
            contested = not ranks.groupBy("host").count().where("count > 1").isEmpty()
        if contested is False:
            break
    return ranks


def judged(pages: DataFrame, rules: list[Rule], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    spark = pages.sparkSession
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    seen = seen.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    edges = staged(links(seen), "links")
    known = seen.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    fitting = staged(host_rules(known, rules_of(spark, rules)), "host-rules")
    whole = F.exists("rules", lambda r: (r["verdict"] == "block") & r["rule_path"].isin("", "/"))
    allowed = F.exists("rules", lambda r: r["verdict"] == "allow")
    way = F.when(whole, F.lit("distrust")).when(allowed, F.lit("trust"))
    scores = propagated(edges, fitting.select(way.alias("way"), "host").where("way IS NOT NULL"))
    good, bad = (F.coalesce(F.sum(F.when(F.col("way") == w, F.col("score"))), F.lit(0.0)) for w in ("trust", "distrust"))
    shares = scores.groupBy("host").agg((bad / (good + bad)).alias("distrust"))
    hosts = staged(fitting.join(shares, "host", "full_outer").select("host", "rules", (F.coalesce("distrust", F.lit(0.0)) > threshold).alias("blocked")), "hosts")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    found = seen.drop("html").join(hosts, "host", "left").withColumn("first", first)
    method = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise("allow")
    return found.select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.verdict", method).alias("verdict"))
