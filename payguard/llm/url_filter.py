"""URL filters: rules first, then link-graph propagation per host.

Rules (host, path, verdict) fit a host and its subdomains if the url's path
starts with the rule's; the longest wins. Urls without a rule get their host's
verdict from the host graph, whose edges are the absolute links of the pages:

* trust: PageRank personalised to the pages under allow rules,
* distrust: the same over reversed edges from the pages under block rules (who
  links to a blocked host is suspect),
* importance: PageRank with all pages as seeds.

A host is blocked if (distrust - trust) / importance, its lift against an
average host, exceeds the threshold. Mass of hosts without outgoing edges
returns to the seeds. Edges and seeds are aggregated per host before any join, and
pages meet their host's facts in salted joins, so a host with a third of the pages is split;
each round is a join and a sum, stored in the shared folder. Rounds go on until the vectors
move by no more than the tolerance, which damping bounds (97 rounds).

Defined cases: a url that is null or has no ``://`` has an empty host and path
(rules don't fit it; the empty host is a host without links); without seeds
of a kind that vector is 0; null html has no links; repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.llm.common import salted_join, stored

DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, fits: the rules that fit the host, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("suffix"), "path", F.concat("host", "path").alias("rule"), "verdict")
    best = F.reverse(F.sort_array(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "path", "verdict"))))
    return hosts.withColumn("suffix", F.explode(suffixes)).join(r, "suffix").groupBy("host").agg(best.alias("fits"))


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (id, host, path, ...) with rule and ruled (the rule's verdict)."""
    fits = _rules_by_host(pages.select("host").distinct(), rules)
    first = F.try_element_at(F.filter("fits", lambda r: F.col("path").startswith(r["path"])), F.lit(1))
    return (salted_join(pages, fits, "host", "id").withColumn("_r", first)
            .withColumn("rule", F.col("_r.rule")).withColumn("ruled", F.col("_r.verdict")).drop("fits", "_r"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages of one host to another."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    return (links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).filter("src <> dst AND src <> ''")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None,
              tolerance: float = TOLERANCE) -> DataFrame:
    """hosts (host, pages, allowed, blocked: seed weights) and edges (src, dst, n) to host,
    trust, distrust, importance. Each vector sums to 1 or is 0. Iterates until the tolerance
    is met, or for ``rounds`` at most if given."""
    # three vectors move by 2 at most, and by the damping less in each round; one more for rounding
    bound = rounds if rounds is not None else math.ceil(math.log(tolerance / 6) / math.log(damping)) + 1
    edges = stored(edges, "edges")
    ends = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = hosts.join(ends, "host", "full").na.fill(0, ["pages", "allowed", "blocked"])
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("out_n"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("in_n"))
    hosts = stored(hosts.join(out, "host", "left").join(into, "host", "left"), "hosts")
    total = hosts.agg(*[F.sum(c).alias(c) for c in ("pages", "allowed", "blocked")]).first()
    names = {"trust": "allowed", "distrust": "blocked", "importance": "pages"}
    seed = {v: (F.col(s) / F.lit(float(total[s] or 1))) for v, s in names.items()}
    ranks = stored(hosts.select("host", "out_n", "in_n", *[e.alias(f"{v}_seed") for v, e in seed.items()],
                                *[e.alias(v) for v, e in seed.items()]), "ranks")
    for _ in range(bound):
        give = ranks.select("host", *[(F.col(v) / F.col("in_n" if v == "distrust" else "out_n")).alias(v) for v in names])
        zero = F.lit(0.0)
        along = edges.join(give, edges["src"] == give["host"]).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("n")).alias("trust"), zero.alias("distrust"),
            (F.col("importance") * F.col("n")).alias("importance"))
        against = edges.join(give, edges["dst"] == give["host"]).select(
            F.col("src").alias("host"), zero.alias("trust"), (F.col("distrust") * F.col("n")).alias("distrust"),
            zero.alias("importance"))
        got = stored(along.unionByName(against).groupBy("host").agg(*[F.sum(v).alias(f"{v}_in") for v in names]), "flow")
        mass = got.agg(*[F.sum(f"{v}_in").alias(v) for v in names]).first()
        new = {v: damping * F.coalesce(f"{v}_in", F.lit(0.0)) + (1 - damping * (mass[v] or 0.0)) * F.col(f"{v}_seed") for v in names}
        moved = sum((F.abs(new[v] - F.col(v)) for v in names), F.lit(0.0))
        ranks = stored(ranks.join(got, "host", "left").select(
            "host", "out_n", "in_n", *[f"{v}_seed" for v in names], *[e.alias(v) for v, e in new.items()], moved.alias("moved")), "ranks")
        if (ranks.agg(F.sum("moved")).first()[0] or 0.0) <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError("propagation did not settle")
    return ranks.select("host", *names)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, host, path, rule (null: none fits), verdict, lift (of the host)."""
    p = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    ruled = with_rules(p, rules)
    hosts = ruled.groupBy("host").agg(
        F.count("*").alias("pages"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    links = host_edges(pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")))
    lift = propagate(hosts, links).select("host", ((F.col("distrust") - F.col("trust")) / F.greatest("importance", F.lit(1e-300))).alias("lift"))
    method = F.when(F.col("lift") > threshold, "block").otherwise("allow")
    return salted_join(ruled, lift, "host", "id").select(
        "id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "lift")
