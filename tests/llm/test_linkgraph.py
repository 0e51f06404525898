import re

import pytest

from plywise.llm import linkgraph

SCHEMA = "page_id long, url string, html string, lang string, host string, trust double"


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    best = None
    for rule in ("org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"):
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def slow_ranks(links, seeds):
    """Twenty rounds on plain dictionaries."""
    start = {s: 0.15 for s in seeds}
    now = dict(start)
    for _ in range(20):
        new = dict(start)
        for (a, b), w in links.items():
            if a in now:
                new[b] = new.get(b, 0) + 0.85 * w * now[a]
        change = max((abs(v - now.get(k, 0)) for k, v in new.items()), default=0)
        now = new
        if change <= 1e-4:
            break
    return now


PAGES = [
    ("http://A.Example.ORG/en/1?x", ""), ("https://b.example.org/es/q#t", None), ("http://example.org", ""), ("http://org/", ""),
    ("http://x.com/fr/1", '<a href="http://y.net/">y</a><a href="/own">o</a>'), ("http://x.com/de/1", '<A  class=k HREF=//Z.net/p>z</A>'),
    ("http://x.com/fr/2", "<a href='https://y.net/b'>y</a>"), ("http://y.net/", '<a href="http://w.net">w</a>'), ("http://w.net/a", ""),
    ("http://z.net/", '<a href="https://bad.com/de/">b</a>'), ("http://bad.com/de/x", '<a href="http://z.net">z</a>'), ("http://v.net", '<a href="http://z.net/k">'),
    ("no scheme", '<a href="http://y.net">'), (None, None), ("", ""), ("http://noorg/x", ""), ("ftp://h.com/fr/://x.org/", ""), ("://", ""),
    ("http://é.COM/fr/é?ü", ""), ("http://u:p@h.net:80/p//q", ""), ("http://x.net?a=http://b.org/", ""), ("http://a\nb.org/\nx", ""),
]


@pytest.fixture
def rows():
    found = [(i, u, h, "en", "clash", 1.0) for i, (u, h) in enumerate(PAGES)]
    return found + [(3, *found[3][1:]), (None, *found[4][1:])] + [(100 + i, "http://hot.net/x", '<a href="http://bad.com/de/">' * 3, "en", "", 0.0) for i in range(60)]


def test_query_equals_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = linkgraph.op4_linkgraph(spark, str(tmp_path)).collect()
    verdicts = dict(linkgraph.RULES)
    counts, votes = {}, {}
    for _, url, html, *_ in rows:
        host, path = slow_parts(url)
        rule = slow_rule(host, path)
        if rule:
            votes[host] = votes.get(host, 0) + (1 if verdicts[rule] == "allow" else -1)
        for to in re.findall(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(https?://[^\"'\s>]+|//[^\"'\s>]+)", html or ""):
            b = slow_parts(("http:" if to.startswith("//") else "") + to)[0]
            if host and b and host != b:
                counts[host, b] = counts.get((host, b), 0) + 1
    out, into = {}, {}
    for (a, b), n in counts.items():
        out[a] = out.get(a, 0) + n
    links = {(a, b): n / out[a] for (a, b), n in counts.items()}
    for (a, b), w in links.items():
        into[b] = into.get(b, 0) + w
    trust = slow_ranks(links, [h for h, v in votes.items() if v > 0])
    distrust = slow_ranks({(b, a): w / into[b] for (a, b), w in links.items()}, [h for h, v in votes.items() if v <= 0])
    want = []
    for i, url, *_ in rows:
        host, path = slow_parts(url)
        rule, t, d = slow_rule(host, path), trust.get(host, 0.0), distrust.get(host, 0.0)
        want.append((i, host, path, rule, verdicts[rule] if rule else "block" if d > t and d >= 0.01 else "allow", round(t, 6), round(d, 6)))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust, 6), round(r.distrust, 6))) for r in got)
    by_id = {r.page_id: r.verdict for r in got}
    assert [by_id[i] for i in (7, 9, 11, 100)] == ["allow", "allow", "block", "block"]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert linkgraph.op4_linkgraph(spark, str(tmp_path)).count() == 0
