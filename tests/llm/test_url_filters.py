import math
from collections import Counter, defaultdict

import pytest

from probitas.llm import url_filters as U


@pytest.fixture()
def tables(spark):
    def build(urls, bad, clash=False):
        pages = spark.createDataFrame([(k, u) for k, u in urls], "page_id bigint, url string")
        pages = pages.selectExpr("*", "'x' as host", "'x' as segments", "'x' as template", "'x' as bad", "'x' as labelled") if clash else pages
        return pages, spark.createDataFrame(list(bad), "page_id bigint, bad int")

    return build


def apart(a, n, b, m, limit):
    """1 or -1 where the shares a / n and b / m are more than ``limit`` standard errors apart."""
    if not n or not m or not 0 < a + b < n + m:
        return 0
    p = (a + b) / (n + m)
    z = (a / n - b / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return (z > limit) - (z < -limit)


def brute(paths):
    """Templates of {(host, segments): [urls, labelled, bad]} by a recursive walk of each host's tree."""
    out = {}

    def summed(parts):
        return [sum(x) for x in zip(*parts, strict=True)]

    def walk(host, prefix, depth, members):
        for segs in [s for s in members if len(s) == depth]:
            out[host, segs] = prefix or "/"
        deeper = {s: v for s, v in members.items() if len(s) > depth}
        if not deeper:
            return
        single = defaultdict(list)  # urls, ends, labelled, bad
        for s, v in deeper.items():
            single[s[depth]].append((v[0], v[0] * (len(s) == depth + 1), v[1], v[2]))
        single = {c: summed(v) for c, v in single.items()}
        n = sum(v[0] for v in single.values())
        rare = {c for c, v in single.items() if v[0] < 0.1 * n}
        name = {c: c for c in single}
        if len(rare) >= 8:
            pool = summed([single[c] for c in rare])
            for c in rare:
                v, rest = single[c], [x - y for x, y in zip(pool, single[c], strict=True)]
                bad, ends = apart(v[3], v[2], rest[3], rest[2], 4), apart(v[1], v[0], rest[1], rest[0], 4)
                kinds = [k for k in ({1: "worse", -1: "better"}.get(bad), {1: "leaf", -1: "inner"}.get(ends)) if k]
                name[c] = "*{" + ",".join(kinds) + "}" if kinds else "*"
        children = {x: summed([v for c, v in single.items() if name[c] == x]) for x in set(name.values())}
        branches = []
        for x in sorted(children, key=lambda x: (children[x][3] / (children[x][2] or 1), children[x][1] / children[x][0], x)):
            v = children[x]
            last = branches[-1][1] if branches else None
            if last and not apart(last[3], last[2], v[3], v[2], 1.96) and not apart(last[1], last[0], v[1], v[0], 1.96):
                branches[-1] = (branches[-1][0] | {x}, summed([last, v]))
            else:
                branches.append(({x}, v))
        for members_, _ in branches:
            own = {s: v for s, v in deeper.items() if name[s[depth]] in members_}
            walk(host, f"{prefix}/{'|'.join(sorted(members_))}", depth + 1, own)

    hosts = defaultdict(dict)
    for (host, segs), v in paths.items():
        hosts[host][segs] = v
    for host, members in hosts.items():
        walk(host, "", 0, members)
    return out


def test_agrees_with_a_recursive_walk(tables):
    import random

    rnd = random.Random(7)
    urls, bad = [], []
    for k in range(1500):
        host = rnd.choice(("a.com", "b.org"))
        first = rnd.choice(("blog", "shop", "en", "de", "fr", f"user{rnd.choice('abcdefghijklmnopqrst')}x"))
        path = [first, *(rnd.choice(("list", "item", "deep", "x", "y")) for _ in range(rnd.randint(0, 3)))]
        urls.append((k, f"http://www.{host}/" + "/".join(path) + rnd.choice(("", "?q=1", "#top"))))
        if rnd.random() < 0.6:
            bad.append((k, int(rnd.random() < (0.9 if first == "shop" else 0.1))))
    pages, labels = tables(urls, bad)
    paths = {(r.host, tuple(r.segments)): [r.urls, r.labelled, r.bad] for r in U.url_templates(pages, labels).collect()}
    expected = brute(paths)
    got = {(r.host, tuple(r.segments)): r.template for r in U.url_templates(pages, labels).collect()}
    assert got == expected and len(set(got.values())) > 5
    rows = U.url_filter(pages, labels).collect()
    judged = defaultdict(lambda: [0, 0])
    for key, v in paths.items():
        judged[key[0], expected[key]][0] += v[1]
        judged[key[0], expected[key]][1] += v[2]
    rate = sum(b for _, b in judged.values()) / sum(n for n, _ in judged.values())
    host_rate = {h: (sum(b for (x, _), (_, b) in judged.items() if x == h) + U.STRENGTH * rate) / (sum(n for (x, _), (n, _) in judged.items() if x == h) + U.STRENGTH) for h in ("a.com", "b.org")}
    for r in rows:
        n, b = judged[r.host, r.template]
        purity = (b + U.STRENGTH * host_rate[r.host]) / (n + U.STRENGTH)
        assert math.isclose(r.purity, purity, abs_tol=1e-5) and r.rejected == (r.purity >= U.PURITY)
    assert len(rows) == 1500 and 0 < sum(r.rejected for r in rows) < 900


def test_a_bad_directory_among_many_rare_ones(tables):
    urls = [(k, f"http://hot.com/dir{'abcdefghijklmnopqrst'[k % 20]}/p{'xyz'[k % 3]}") for k in range(4000)]
    bad = [(k, int(k % 20 == 3)) for k in range(0, 4000) if k % 2]
    rows = U.url_filter(*tables(urls, bad)).collect()
    assert {r.page_id for r in rows if r.rejected} == {k for k in range(4000) if k % 20 == 3}
    assert {r.template.split("/")[1] for r in rows} == {"*{worse}", "*|*{better}"}


def test_one_host_with_very_many_directories(tables):
    """As many different children as URLs: all but 9 wildcards go, and nothing is gathered by host."""
    urls = [(k, f"http://hot.com/{'abcdefghij'[k % 10]}{''.join('abcdefghij'[int(c)] for c in str(k))}/{'leaf' if k % 2 else 'a/b'}") for k in range(20_000)]
    templates = {r.template for r in U.url_templates(*tables(urls, [])).collect()}
    assert templates == {"/*/leaf", "/*/a/b"}


def test_depth_is_a_parameter(tables):
    pages, labels = tables([(1, "http://h/a/b/c/d")], [])
    assert [[r.template for r in U.url_filter(pages, labels, depth=d).collect()] for d in (1, 2, 9)] == [["/a/b/c/d"], ["/a/b/c/d"], ["/a/b/c/d"]]
    assert [len(U.url_templates(pages, labels, depth=d).first().segments) for d in (1, 2, 9)] == [1, 2, 4]


def test_typed_segments_and_hosts(spark):
    from pyspark.sql import functions as F

    cases = {
        "HTTPS://user:pw@WWW.Ex.com:8080/a//B/?x=/y": ("ex.com", ["a", "b"]),
        "http://h/2024-01-31/post-123.html": ("h", ["{date}", "post-{num}.html"]),
        "http://h/550e8400-e29b-41d4-a716-446655440000/deadbeef01/facade": ("h", ["{uuid}", "{hex}", "facade"]),
        "http://h": ("h", []),
        "http://[::1]:80/x#y/z": ("[::1]", ["x"]),
        "/no/host": (None, []),
        "http://h/1/2/3/4/5/6/7/8/9/0": ("h", ["{num}"] * 7 + ["{num}/{num}/{num}"]),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", U.host_of(F.col("url")).alias("h"), U.segments_of(F.col("url")).alias("s"))
    assert {r.url: (r.h, r.s) for r in df.collect()} == cases


def test_edge_cases(tables):
    long = "http://h/" + "/".join(["x"] * 20_000)
    urls = [(1, None), (2, ""), (3, "no url"), (None, "http://h/a"), (4, "http://h/a"), (4, "http://h/a"), (5, long), (6, "http://h/b")]
    pages, labels = tables(urls, [(4, 1), (4, 0), (None, 1), (6, None)], clash=True)
    got = U.url_filter(pages, labels).collect()
    assert len(got) == len(urls)
    assert all((r.host, r.template, r.rejected) == (None, None, False) for r in got if r.page_id in (1, 2, 3))
    assert all(r.host == "h" and r.purity is not None for r in got if r.page_id not in (1, 2, 3))
    pages, labels = tables(urls, [])
    assert not any(r.rejected for r in U.url_filter(pages, labels).collect())
    pages, labels = tables([], [(1, 1)])
    assert U.url_filter(pages, labels).collect() == []
