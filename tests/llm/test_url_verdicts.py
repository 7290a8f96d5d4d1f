"""Whole verdicts of the URL filter against plain Python: rules, host graph, propagation, threshold."""

from __future__ import annotations

import collections
import functools
import re
import tempfile

import numpy as np
import pytest

from payguard.llm import queries, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PAGES = "page_id long, url string, html string"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def linked_hosts(html):
    """Hosts of the absolute links of a page."""
    out = []
    for tag in re.findall(r"<a\s[^>]*>", html or "", re.I):
        m = re.search(r"href\s*=\s*[\"']?\s*([^\"'\s>]+)", tag, re.I)
        link = m.group(1) if m else ""
        scheme, slashes, rest = link.partition("//")
        if slashes and (not scheme or re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*:", scheme)):
            out.append(re.split("[/?#]", rest, maxsplit=1)[0].translate(LOWER))
    return [h for h in out if h]


def plain_verdicts(rows, tolerance):
    """page_id -> (host, path, rule, verdict), and the lift of each host."""
    facts, seeds, edges = {}, collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for page_id, url, html in rows:
        host, path = split_url(url)
        rule, ruled = rule_of(host, path)
        facts[page_id] = (host, path, rule, ruled)
        for i, hit in enumerate((True, ruled == "allow", ruled == "block")):
            seeds[host][i] += hit
        for to in linked_hosts(html):
            if to != host and host:
                edges[host, to] += 1
                seeds[to]  # a host known by links alone
    names = sorted(seeds)
    at = {h: i for i, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), n in edges.items():
        m[at[a], at[b]] = n
    start = np.array([seeds[h] for h in names], float)
    start = start / np.maximum(start.sum(0), 1)
    steps = [w / np.maximum(w.sum(1, keepdims=True), 1) for w in (m, m, m.T)]  # importance, trust, distrust
    x = start
    for rounds in range(1, 200):
        flow = np.stack([x[:, k] @ steps[k] for k in range(3)], 1) * url_filter.DAMPING
        new = flow + (1 - flow.sum(0)) * start
        moved, x = np.abs(new - x).sum(), new
        if moved <= tolerance:
            break
    lift = dict(zip(names, (x[:, 2] - x[:, 1]) / np.maximum(x[:, 0], 1e-300)))
    out = {p: (h, path, rule, ruled or ("block" if lift[h] > url_filter.THRESHOLD else "allow"))
           for p, (h, path, rule, ruled) in facts.items()}
    return out, lift, rounds


def check(got, rows, tolerance):
    want, lift, rounds = plain_verdicts(rows, tolerance)
    assert min(abs(v - url_filter.THRESHOLD) for v in lift.values()) > 1e-9  # no verdict hangs on rounding
    assert len(got) == len(rows) and got == want
    return lift, rounds


def test_query_equals_plain_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    out = queries.op9_link_graph(spark, "/root/testdata/sf0.001")
    assert out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    check(got, [tuple(p) for p in pages], url_filter.TOLERANCE)
    assert {v[3] for v in got.values()} == {"allow", "block"}


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_on_a_link_graph(spark, monkeypatch, seed):
    """A host with a third of the pages, chains into blocked hosts, hosts known by links alone, every tenth url null
    or without a scheme, links of every form; through a table as the query reads it."""
    rng = np.random.default_rng(seed)
    forms = ['<a href="https://{}/x">', "<A class=b HREF='HTTP://{}?q'>", "<a href=//{}>", '<a href = "ftp://{}#f">']
    hosts = ["hub.com", "bad.net", "worse.net", "good.org", *[f"Chain{i}.com" for i in range(6)], *[f"h{i}.info" for i in range(12)]]
    to = {f"Chain{i}.com": f"Chain{i + 1}.com" for i in range(5)} | {"Chain5.com": "bad.net", "bad.net": "worse.net"}
    rows = []
    for i in range(240):
        host = "hub.com" if i % 3 == 0 else hosts[int(rng.integers(len(hosts)))]
        links = [to[host]] * 3 if host in to else [str(rng.choice([*hosts[3:], "only-linked.com"])) for _ in range(int(rng.integers(0, 4)))]
        html = "x <a name=y><a href='/local'>" + "".join(forms[int(rng.integers(len(forms)))].format(h) + "z</a>" for h in links)
        url = None if i % 20 == 7 else f"no scheme {host}/" if i % 20 == 17 else f"http://{host}{['/', '/fr/a', '/de/?q', ''][i % 4]}"
        rows.append((i, url, html if i % 11 else None))
    rows += [(240 + i, "http://good.org/fr/", '<a href="//trusted.info/">') for i in range(5)]  # allowed seeds
    folder = tempfile.mkdtemp(dir="/tmp", prefix="pg-urls-")
    spark.createDataFrame(rows, PAGES).write.parquet(f"{folder}/pages.parquet")
    monkeypatch.setattr(url_filter, "propagate", functools.partial(url_filter.propagate, tolerance=1e-2))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op9_link_graph(spark, folder).collect()}
    lift, rounds = check(got, rows, 1e-2)
    assert rounds > 10 and lift["chain5.com"] > url_filter.THRESHOLD and lift["trusted.info"] < 0
    assert "block" in {v[3] for v in got.values() if v[0] == "chain5.com"}
