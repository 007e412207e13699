"""op9 on made pages with known articles, on the table, and its template against a plain deduction."""

import html
import random
import re
from collections import defaultdict

import pytest

from pairloom.llm import html as H
from pairloom.llm.queries import op9_main_texts


def text(page):
    return H.main_text(H.parsed(page), set(), None, set())


def test_parse():
    assert text("<nav>menu</nav><article><h1>A&amp;B</h1><p>one <b>t</b>wo<br>three<p>four&nbsp;  five</p></article><footer>x</footer>") == "A&B one two three four five"
    assert text("<body><article><p>a<script>var t='</p>';</script>b<div class='ad-box'>buy<div>now</div></div>c</p><!-- <p>no</p> --></article>") == "ab c"
    assert text("<main><header><h1>T</h1></header><p>x</p><section class='comments'><article>first!</article></section><form><p>q</p></form><aside>s</aside></main>") == "T x"
    assert text("<article><p><b>unclosed<br><p>next</p></article><div>out</div>") == "unclosed next"
    assert text("<div role=navigation>n</div><div style='display: none'>h</div><p hidden>h</p><p>y &lt;tag&gt; &#233; 1 < 2</p>") == "y <tag> é 1 < 2"
    assert text("") == "" and text("<!-- open <p>x") == "" and text("plain   text") == "plain text" and text("<p>" * 3000 + "x") == "x"
    assert text("<article>a<span class='share'>tweet</span>b</article>") == "a b"
    assert text("<article><li>a<li>b</article>") == "a b"


def test_wrappers():
    for wrapper in ("div class='layout with-sidebar'", "div id=page class=has-sidebar", "div class=social-layout", "form id=aspnet"):
        name = wrapper.split()[0]
        assert text(f"<body><{wrapper}><div class=menu>m</div><article><h1>T</h1><p>x</p></article></{name}></body>") == "T x", wrapper
    assert text("<body><article>long enough a text</article><div class=comments><article>first!</article></div></body>") == "long enough a text"
    assert text("<body><div>" + "The body is here. " * 20 + "</div><article>teaser</article></body>").startswith("The body")
    assert text("<form><label>Name</label><p>q</p></form><p>x</p>") == "x" and text("<body><form><h1>T</h1><p>x</p></form></body>") == "T x"


def plain(page):
    """The article of the table's pages: all that is between the tags of its article."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    found = re.sub(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", " ", found)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", found)).split())


def test_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op9_main_texts(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == plain(pages[r.page_id].html)


def slow_template(pages):
    """{host: template tokens} of (host, html), by whole occurrence vectors."""
    hosts = defaultdict(dict)
    for host, page in pages:
        tokens = tuple(H.token_of(i) for i in H.parsed(page))
        if host:
            hosts[host][tokens] = 1
    out = {}
    for host, found in hosts.items():
        seqs = list(found)
        vectors = defaultdict(list)
        for t in {t for s in seqs for t in s}:
            vectors[tuple(s.count(t) for s in seqs)].append(t)
        own = {v: ts for v, ts in vectors.items() if max(v) == 1 and sum(v) >= 3 and sum(v) >= 0.6 * len(seqs) and len(ts) >= 3}
        valid = {}
        for v, ts in own.items():
            places = [[t for t in s if t in ts] for s, n in zip(seqs, v) if n]
            fixed = [t for t in ts if len({p.index(t) for p in places}) == 1]
            if len(fixed) >= 3:
                valid[v] = fixed
        keep = []
        for v, fixed in valid.items():
            for w, other in own.items():
                if sum(w) > sum(v):
                    gaps = set()
                    for s, n, m in zip(seqs, v, w):
                        if n and m:
                            at = [k for k, t in enumerate(s) if t in other]
                            first, last = (f(s.index(t) for t in own[v]) for f in (min, max))
                            gaps |= {sum(a < first for a in at), sum(a < last for a in at)}
                    if len(gaps) > 1:
                        break
            else:
                keep += fixed
        if keep:
            out[host] = set(keep)
    return out


def made(seed):
    """Pages of a few hosts: blocks of a layout, some on part of the pages, some that change places, stories of their own."""
    rng = random.Random(seed)
    pages = []
    for h in range(3):
        for k in range(14):
            top = [f"<div class=top>Top of {h}</div>", f"<div id=lead><p>Lead {h}</p></div>"]
            foot = [f"<div class=a>Write to us {h}</div>", f"<div class=b>All rights {h}</div>", f"<section><h3>Find</h3><em>us {h}</em></section>"]
            if k % 2:
                foot[:2] = foot[1::-1]
            extra = [f"<table class=x><tr><td class=y>Seen {h}</td></tr></table>"] if k % 14 < 10 else []
            story = "".join(f"<p>{' '.join(rng.choices(['a', 'b', 'c', 'd'], k=9))} {k}</p>" for _ in range(rng.randint(1, 4)))
            pages.append((f"h{h}.org", f"<html><body>{''.join(top + extra)}<div>{story}</div>{''.join(foot)}</body></html>"))
    return pages


@pytest.mark.parametrize("repeat", [1, 3])
def test_template_by_vectors(spark, repeat):
    pages = made(3) * 1 + made(3)[:5] * (repeat - 1)
    pages += [("h9.org", "<p>a</p>"), ("h9.org", "<p>b</p>"), ("", "<p>none</p>")]
    df = spark.createDataFrame([(k, f"http://{h}/{k}" if h else None, p) for k, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.host: set(r.own) for r in H.templates(df).collect()}
    want = slow_template(pages)
    assert got == want and set(want) == {"h0.org", "h1.org", "h2.org"}
    swapped = {H.token_of(H.Block(f"{what} {h}", ("html", "body", "div"), 0, 0)) for h in range(3) for what in ("Write to us", "All rights")}
    assert not swapped & set().union(*want.values())


def test_template_of_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(re.sub(r"^.*?://([^/?#]*).*$", r"\1", r.url or "", flags=re.S).lower() if "://" in (r.url or "") else "", r.html or "") for r in pages.collect()]
    got = {r.host: set(r.own) for r in H.templates(pages).collect()}
    assert got == slow_template(rows) and len(got) > 5 and all(len(v) >= 3 for v in got.values())


@pytest.mark.parametrize("times", [1, 2, 5])
def test_repeated_rows(spark, times):
    pages = [(k, f"http://h{k % 2}.org/{k}", f"<html><body><div>Top of h{k % 2}</div><div><p>Story {k} is here.</p><p>{'It goes on. ' * (k % 3)}</p></div><div>Write to us</div><div>All rights</div></body></html>") for k in range(24)]
    pages += [pages[5]] * (times - 1)
    pages += [(30, "http://alone.org/", "<div>Top</div><p>Only page</p>"), (31, None, "<p>no url</p>"), (32, "x", None), (32, "x", None), (None, "http://alone.org/", "<article>in it</article>")]
    df = spark.createDataFrame([(*p, "t", 3) for p in pages], "page_id long, url string, html string, text string, host int")
    rows = {r.page_id: r.text for r in H.main_texts(df).collect()}
    assert all(rows[k] == " ".join(f"Story {k} is here. {'It goes on. ' * (k % 3)}".split()) for k in range(24))
    assert rows[30] == "Top Only page" and rows[31] == "no url" and rows[32] == "" and rows[None] == "in it"
    assert H.main_texts(df).count() == len(pages) and H.main_texts(df.where("false")).count() == 0


def test_same_line_in_articles(spark):
    """A line of the host within all articles goes; a page that is another's copy keeps its text; a menu without a name goes."""
    words = "one two three four five six seven eight".split()
    pages = [(k, f"http://h.org/{k}", f"<body><div class=m{k}><a>Home {k}</a> <a>Away</a></div><article><p class=f>First line</p><h1>Title {k}</h1><p>{' '.join(words[k % 5:])} {k} and much more of it</p><p>more of {k}</p><div class=z>All of h</div></article></body>") for k in range(9)]
    pages += [(20 + k, f"http://g.org/{k}", f"<body><article><h1>Same</h1><p class=x>{'The very same text. ' * 5}</p><p class=y>end {k}</p><div class=z>z</div></article></body>") for k in range(4)]
    pages += [(60 + k, f"http://e.org/{k}", f"<body><div class=a>A</div><article><h1>Title {k}</h1><p>{'Passage of three articles. ' * 4}</p><p>{'own words ' * 30} {k}</p></article><div class=b>B</div></body>") for k in range(3)]
    pages += [(40 + k, f"http://f.org/{k}", f"<body><div class=q><a>Go {k}</a> <a>there</a></div><div class=s><p>Text of {k}</p></div><div class=t>End</div></body>") for k in range(4)]
    rows = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(rows[k] == f"Title {k} {' '.join(words[k % 5:])} {k} and much more of it more of {k}" for k in range(9))
    assert all(rows[20 + k] == "Same " + "The very same text. " * 5 + f"end {k} z" for k in range(4))
    assert all(rows[60 + k] == f"Title {k} " + "Passage of three articles. " * 4 + "own words " * 30 + f"{k}" for k in range(3))
    assert all(rows[40 + k] == f"Text of {k}" for k in range(4))
