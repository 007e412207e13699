"""op8 against a plain version."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from pairloom.llm import urls as U
from pairloom.llm.queries import ORACLES, RULES, op8_url_verdicts


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def slow(pages, rules, rounds=10, damping=0.85, threshold=1.0):
    read, seeds, edges = [], defaultdict(lambda: [0.0, 0.0]), Counter()
    for i, url, html in pages:
        host, path = slow_parts(url)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        read.append((i, host, path, best))
        if best and host:
            seeds[host][best[2] == "block"] += 1
        for link in re.findall(U.LINK.replace("(?i)", ""), html or "", re.I):
            to = slow_parts(link)[0]
            if host and to and to != host:
                edges[host, to] += 1
    out, back = Counter(), Counter()
    for (a, b), n in edges.items():
        out[a] += n
        back[b] += n
    whole = [sum(v[k] for v in seeds.values()) or 1.0 for k in (0, 1)]
    seeds = {h: [v[0] / whole[0], v[1] / whole[1]] for h, v in seeds.items()}
    now = {h: [t * (1 - damping), d * (1 - damping)] for h, (t, d) in seeds.items()}
    for _ in range(rounds):
        new = defaultdict(lambda: [0.0, 0.0])
        for h, (t, d) in seeds.items():
            new[h][0] += t * (1 - damping)
            new[h][1] += d * (1 - damping)
        for (a, b), n in edges.items():
            new[b][0] += damping * now.get(a, [0, 0])[0] * n / out[a]
            new[a][1] += damping * now.get(b, [0, 0])[1] * n / back[b]
        now = new
    bad = {h for h, (t, d) in now.items() if d > t * threshold}
    return sorted((i, h, p, b and b[1], b[2] if b else "block" if h in bad else "allow") for i, h, p, b in read)


def got(df, **how):
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.url_verdicts(df, RULES, **how).collect())


def test_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op8_url_verdicts(spark, sf).collect())
    assert rows == slow(pages, RULES)


def link(*hosts):
    return "".join(f"<p><a class=x href='http://{h}/x'>y</a>" for h in hosts)


PAGES = [
    (1, "http://A.Org/x", link("b.net", "c.net")), (2, "HTTP://x.COM/de/1?q#f", link("c.net")), (3, "http://b.net", link("x.com")), (4, None, None),
    (5, "no scheme", ""), (6, "://", "x"), (7, "http://c.net?x=/de/", link("c.net", "d.net")), (8, "http://d.net#a", "<a href=http://x.com>"),
    (9, "https://www.Example.org/en/12", ""), (10, "ftp://example.org/es/", ""), (11, "http://badexample.org/es/", ""), (12, "http://e.net/" + "p/" * 20000, link("x.com")),
    (13, "http://com/fr/", ""), (14, "http://org", ""), (8, "http://d.net#a", "<a href=http://x.com>"),
]


def test_small(spark):
    df = spark.createDataFrame([(*p, True, 1.0) for p in PAGES], "page_id long, url string, html string, bad boolean, trust double")
    rows = got(df)
    assert rows == slow(PAGES, RULES) and {r[4] for r in rows if r[3] is None} == {"allow", "block"}
    assert got(df.where("false")) == []
    assert {r[3] for r in got(df.where("page_id > 3 and page_id < 7"))} == {None}


def by_sql(pages, view="select * from rows"):
    with duckdb.connect() as db:
        if not isinstance(pages, str):
            db.register("rows", pa.table({"page_id": [p[0] for p in pages], "url": [p[1] for p in pages], "html": pa.array([p[2] for p in pages], pa.string())}))
        db.sql(f"create view pages as {view if not isinstance(pages, str) else pages}")
        found = db.sql(ORACLES["op8_url_verdicts"])
        assert sorted(found.columns) == ["host", "page_id", "path", "rule", "verdict"]
        return sorted(found.project("page_id, host, path, rule, verdict").fetchall())


def test_sql(spark):
    """The SQL against the plain version, with links and on the table."""
    rng = random.Random(6)
    hosts = [f"h{k}.{rng.choice(['org', 'net', 'com'])}" for k in range(12)]
    pages = [(k, f"http://{rng.choice(hosts)}/{rng.choice(['de/', 'fr/', 'x'])}", link(*rng.choices(hosts, k=rng.randint(0, 4)))) for k in range(150)]
    for rows in (PAGES, pages):
        assert by_sql(rows) == slow(rows, RULES)
    sf = "/root/testdata/sf0.001"
    assert by_sql(f"select * from '{sf}/pages.parquet'") == sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op8_url_verdicts(spark, sf).collect())


def test_native(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    plan = U.url_verdicts(df, RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_seeds_count_as_parts(spark):
    """Many pages of trusted hosts and few blocked ones: who links to the blocked host only is blocked all the same."""
    pages = [(k, f"http://a{k % 4}.org/x{k}", link("b.net")) for k in range(400)] + [(900, "http://bad.com/de/1", ""), (901, "http://c.net/1", link("bad.com")), (902, "http://c.net/2", link("bad.com")), (903, "http://b.net/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdicts = {r[0]: r[4] for r in got(df)}
    assert got(df) == slow(pages, RULES) and verdicts[901] == "block" and verdicts[903] == "allow"
    assert got(df, threshold=1e9) == slow(pages, RULES, threshold=1e9)
