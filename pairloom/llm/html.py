"""Main text of web pages by equivalence classes of template tokens.

A token is an opening tag (with its class) or a text block, told apart by the path of tags it stands in. Tokens of one
host with the same occurrence vector (how often each page has them) form a class. Vectors are never gathered: sums of
page hashes times counts stand for one, so they add up map-side and across partitions. A class is template if enough
of the host's pages have it, with enough tokens, each once a page; its tokens must have one place in the class's order
on every page (those that change places leave it), and classes must nest: all of a smaller class lies between the
same two tokens of each larger one, on every page.

What stands between two template tokens is a slot. Template text is dropped from the slots of all pages, and what is
left is ranked over the host: by how much text lies in article or main elements, outside of them, and in links. Slots
of menus, notices, adverts and the like, known by tag, role or class name, rank last and are never extracted.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written
from .urls import host_of

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|</[^>]*>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

_FORM_END, _HEADING = re.compile(r"</form\b", re.I), re.compile(r"<(?:h1|article|main)\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Left out wherever they stand.
NEVER = frozenset("script style noscript template iframe object svg math canvas audio video map head title nav aside footer button select option textarea input dialog menu fieldset".split())
#: Never seen, so they don't part the text around them; and others whose content is not read as tags.
UNSEEN = frozenset("script style noscript template".split())
RAW = frozenset("iframe textarea title svg math".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of a class name or id that mark what is not the article. HEAD only outside of it. An article or main element
#: below one of NAMES (or a form) may still be the article; below one of OTHERS it is someone else's.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social widget widgets pagination pager toolbar skip copyright legal disclaimer paywall".split()
)
OTHERS = frozenset("related recommended recommendations comment comments reply replies respond disqus".split())
#: A class name that begins so tells what the element has, not what it is.
HAS = ("with-", "has-", "no-", "without-")
HEAD = frozenset("header masthead topbar".split())
CONTENT = frozenset(("article", "main"))
#: Opening one of these ends an open one of the same set.
SIBLINGS = (frozenset(("li",)), frozenset(("dt", "dd")), frozenset(("tr",)), frozenset(("td", "th")), frozenset(("option",)))

#: A host's pages that must have a class, at least and as a part of all; tokens that it must have.
PAGES, SHARE, TOKENS = 3, 0.6, 3
#: Ranks of text: in an article or main element; the same below a form or one of NAMES; elsewhere; left out.
INSIDE, BELOW, ELSEWHERE, OUT = range(4)
#: What article and main elements must hold, as a part of the text elsewhere, to be the main text; links of a menu's text.
ENOUGH, MENU = 0.25, 0.5
#: Different pages of a host from which its template may claim text within an article.
SURE = 5
#: Rows of sums that a task holds before it hands them on.
HELD = 200_000


class Block:
    __slots__ = ("linked", "path", "rank", "text")

    def __init__(self, text: str, path: tuple[str, ...], rank: int, linked: int) -> None:
        self.text, self.path, self.rank, self.linked = text, path, rank, linked


def _marks(attributes: str) -> tuple[set[str], bool, bool, str]:
    """Words of class and id and the role; whether it is hidden; whether it is named as the article's body; the class."""
    found = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    own = [n for n in (found.get("class", "") + " " + found.get("id", "")).split() if not n.lower().startswith(HAS)]
    words = {w.lower() for w in _WORD.findall(" ".join(own))}
    role = found.get("role", "").lower()
    if role in ROLES:
        words.add("nav")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return words, hidden, role == "main" or found.get("itemprop", "").lower() == "articlebody", found.get("class", "")


def _page_wide(page: str, at: int) -> bool:
    """Whether the form whose tag ends here has the page's heading or article in it."""
    stop = _FORM_END.search(page, at)
    return bool(_HEADING.search(page, at, stop.start() if stop else len(page)))


def parsed(page: str) -> list[Block | tuple[str, ...]]:
    """Text blocks and opening tags (as paths, the last with its class) in page order."""
    items: list[Block | tuple[str, ...]] = []
    # tag, left out for good, left out by name or form, in content
    stack: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    linked = 0  # characters held that are in links

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            _, out, soft, content = stack[-1] if stack else ("", False, False, False)
            rank = OUT if out else (BELOW if soft else INSIDE) if content else OUT if soft else ELSEWHERE
            items.append(Block(text, tuple(s[0] for s in stack if s[0] not in INLINE), rank, min(linked, len(text))))
        linked = 0

    def close(depth: int) -> None:
        end()
        del stack[depth:]

    at, size = 0, len(page)
    while at < size:
        low = page.find("<", at)
        if low < 0:
            low = size
        if low > at:
            held.append(page[at:low])
            if any(s[0] == "a" for s in stack[-3:]):
                linked += low - at
        if low == size:
            break
        match = _TAG.match(page, low) or _LOOSE.match(page, low)
        if not match:
            held.append("<")
            at = low + 1
            continue
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:  # a closing tag
            if name in INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if (stack[k][1] or stack[k][2]) and not (k and (stack[k - 1][1] or stack[k - 1][2])):
                            close(k)
                        else:
                            del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                end()
            continue
        if name in ("br", "wbr"):
            held.append(" " if name == "br" else "")
            continue
        if name in UNSEEN:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        words, hidden, body, kind = _marks(match[3]) if match[3] else (set(), False, False, "")
        if name not in INLINE:
            end()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or any(name in s and stack[k][0] in s for s in SIBLINGS):
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
            items.append((*(s[0] for s in stack if s[0] not in INLINE), f"{name}.{kind}" if kind else name))
        if name in VOID or match[3].endswith("/"):
            continue
        _, out, soft, content = stack[-1] if stack else ("", False, False, False)
        was = out or soft
        if name in CONTENT or body:
            out = out or hidden or bool(words & OTHERS)
            content = True
        elif name not in ("html", "body"):
            out = out or name in NEVER or hidden or bool(words & OTHERS) or (not content and (name == "header" or bool(words & HEAD)))
            named = bool(words & NAMES) or (name == "form" and not _page_wide(page, at))
            out = out or (named and content)  # within the article nothing below is the article again
            soft = soft or named
        if (out or soft) and held and name in INLINE and not was:
            end()
        stack.append((name, out, soft, content))
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = stop.start() if stop else size
    end()
    return items


def _token(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=100_000)
def _tag_token(path: tuple[str, ...]) -> int:
    return _token("/".join(path))


def token_of(item: Block | tuple[str, ...]) -> int:
    return _token("/".join(item.path), item.text) if isinstance(item, Block) else _tag_token(item)


def tokens_of(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, t, k, c, l) of rows with a host: the page's tokens in order, their ranks (-1 for a tag), and a text's
    characters and those in links. page: a hash of all that, so pages that are alike are one."""
    own = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            keys = []
            for page in texts(batch.column(1)):
                items = parsed(page)
                blocks = [i if isinstance(i, Block) else None for i in items]
                rows = [token_of(i) for i in items], [b.rank if b else -1 for b in blocks], [len(b.text) if b else 0 for b in blocks], [b.linked if b else 0 for b in blocks]
                for column, value in zip(out, rows, strict=True):
                    column.append(value)
                digest = hashlib.blake2b(np.array(rows[0], np.int64).tobytes(), digest_size=8).digest()
                keys.append(int.from_bytes(digest, "little", signed=True))
            kinds = (pa.int64(), pa.int8(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), *(pa.array(v, pa.list_(k)) for v, k in zip(out, kinds, strict=True))], names=["host", "page", "t", "k", "c", "l"])

    return own.mapInArrow(run, "host string, page long, t array<long>, k array<tinyint>, c array<int>, l array<int>")


def _summed(rows: DataFrame, each: Callable[[dict, tuple], None], fields: str) -> DataFrame:
    """What each(sums, row) adds up for the rows of a task in sums[key][position], as rows (of key and sums) of `fields`."""
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in fields.split(", ")]

    def emitted(sums: dict) -> pa.RecordBatch:
        columns = zip(*((*k, *v) for k, v in sums.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                each(sums, row)
            if len(sums) >= HELD:
                yield emitted(sums)
                sums = {}
        if sums:
            yield emitted(sums)

    return rows.mapInArrow(run, fields)


def _count(sums: dict, row: tuple) -> None:
    host, page, tokens = row
    parts = [(page >> s) & 0xFFFFFF for s in (0, 20, 40)]
    counts: dict[int, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    for t, n in counts.items():
        had = sums.get((host, t))
        if had is None:
            sums[host, t] = [1, n, *(p * n for p in parts)]
        else:
            had[0] += 1
            had[1] = max(had[1], n)
            for k, p in enumerate(parts):
                had[2 + k] += p * n


def classes(tokens: DataFrame, *, pages: int = PAGES, share: float = SHARE, least: int = TOKENS) -> DataFrame:
    """(host, class, on, t): classes of tokens that stand once on the same `on` pages, of enough pages and tokens.

    tokens: (host, page, t), distinct pages.
    """
    counted = tokens.groupBy("host").agg(F.count("*").alias("of"))
    sums = _summed(tokens.select("host", "page", "t"), _count, "host string, t long, on long, most long, v0 long, v1 long, v2 long")
    vectors = sums.groupBy("host", "t").agg(F.sum("on").alias("on"), F.max("most").alias("most"), *[F.sum(v).alias(v) for v in ("v0", "v1", "v2")])
    once = vectors.where(F.col("most") == 1).where(F.col("on") >= pages).join(counted, "host").where(F.col("on") >= F.col("of") * share)
    each = once.groupBy("host", "on", "v0", "v1", "v2").agg(F.collect_list("t").alias("own")).where(F.size("own") >= least)  # as many as one page has at most
    return each.select("host", F.xxhash64("host", "on", "v0", "v1", "v2").alias("class"), "on", F.explode("own").alias("t"))


def _places(sums: dict, row: tuple) -> None:
    """Places of tokens in their classes, as (host, 0, class, token), and of classes between the tokens of larger ones, as
    (host, 1, class, larger class): least and most."""
    host, tokens, known = row
    of = {x["t"]: (x["class"], x["on"]) for x in known}
    found: dict[int, list[int]] = {}
    on = {}
    for at, t in enumerate(tokens):
        if t in of:
            c, on[c] = of[t]
            found.setdefault(c, []).append(at)
    for c, ats in found.items():
        for k, at in enumerate(ats):
            _between(sums, (host, 0, c, tokens[at]), k, k)
        for larger, others in found.items():
            if (on[larger], larger) > (on[c], c):
                lo, hi = np.searchsorted(others, (ats[0], ats[-1])).tolist()
                _between(sums, (host, 1, c, larger), lo, hi)


def _between(sums: dict, key: tuple, lo: int, hi: int) -> None:
    had = sums.get(key)
    sums[key] = [lo, hi] if had is None else [min(had[0], lo), max(had[1], hi)]


def template(tokens: DataFrame, found: DataFrame, *, least: int = TOKENS) -> DataFrame:
    """(host, t): tokens of `found` classes that keep one place in their class, of classes that nest in all larger ones."""
    of_host = found.groupBy("host").agg(F.collect_list(F.struct("class", "on", "t")).alias("known"))
    rows = tokens.select("host", "t").join(of_host, "host").select("host", "t", "known")
    sums = _summed(rows, _places, "host string, kind long, class long, other long, lo long, hi long")
    spans = sums.groupBy("host", "kind", "class", "other").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    crossing = spans.where("kind = 1 and lo <> hi").select("host", "class").distinct()
    fixed = spans.where("kind = 0 and lo = hi").select("host", "class", F.col("other").alias("t")).join(crossing, ["host", "class"], "left_anti")
    whole = fixed.groupBy("host", "class").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return fixed.join(whole, ["host", "class"], "left_semi").select("host", "t")


def slots_of(tokens: list[int], own: set[int]) -> list[int]:
    """For each token the template token that its slot follows; 0 before the first."""
    out, last = [], 0
    for t in tokens:
        if t in own:
            last = t
        out.append(last)
    return out


def _ranks(sums: dict, row: tuple) -> None:
    """Characters of a slot's text that is not template, by rank, and those of rank ELSEWHERE that are in links."""
    host, tokens, ranks, sizes, linked, known = row
    own = set(known)
    for t, k, c, n, slot in zip(tokens, ranks, sizes, linked, slots_of(tokens, own), strict=True):
        if k >= 0 and k != OUT and t not in own:
            had = sums.setdefault((host, slot), [0, 0, 0, 0])
            had[k] += c
            if k == ELSEWHERE:
                had[3] += n


def chosen(inside: int, below: int, elsewhere: int) -> int:
    """The ranks up to which text is main text."""
    if inside and inside >= ENOUGH * elsewhere:
        return INSIDE
    if below and below >= ENOUGH * elsewhere:
        return BELOW
    return ELSEWHERE


def main_text(items: list[Block | tuple[str, ...]], own: set[int], most: int | None, menus: set[int], pages: int = 0) -> str:
    """The text of a page: what its host's template and ranks leave, or those of the page by itself (most: None). pages: of
    the host, different ones."""
    blocks = [i for i in items if isinstance(i, Block)]
    if most is None:
        most = chosen(*(sum(len(b.text) for b in blocks if b.rank == k) for k in (INSIDE, BELOW, ELSEWHERE)))
    if not own and not menus:
        return " ".join(b.text for b in blocks if b.rank <= most)
    tokens = [token_of(i) for i in items]
    main = [(i, t) for i, t, slot in zip(items, tokens, slots_of(tokens, own), strict=True) if isinstance(i, Block) and i.rank <= most and not (i.rank == ELSEWHERE and slot in menus)]
    left = [(i, t) for i, t in main if t not in own]
    # articles of a few pages may share a passage, and more than half of the text in common is a copy's, not a template's
    if most < ELSEWHERE and (pages < SURE or sum(len(i.text) for i, _ in left) * 2 < sum(len(i.text) for i, _ in main)):
        left = main
    return " ".join(i.text for i, _ in left)


def templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, own, most, menus, pages): the template tokens of each host that has any, the ranks that are its main text, its
    slots of links, and the number of its different pages."""
    tokens = tokens_of(pages, url_col=url_col, html_col=html_col)
    once = tokens.groupBy("host", "page").agg(F.first(F.struct("t", "k", "c", "l")).alias("x")).select("host", "page", "x.*")
    tokens = written(once)
    own = template(tokens, classes(tokens)).groupBy("host").agg(F.collect_list("t").alias("own"))  # as many as one page has at most, nearly
    own = written(own)
    rows = tokens.join(own, "host").select("host", "t", "k", "c", "l", "own")
    sums = _summed(rows, _ranks, "host string, slot long, inside long, below long, elsewhere long, linked long")
    slots = sums.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("inside", "below", "elsewhere", "linked")])
    menu = F.col("linked") > MENU * F.col("elsewhere")
    ranked = slots.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("inside", "below", "elsewhere")], F.collect_list(F.when(menu, F.col("slot"))).alias("menus"))
    enough = lambda c: (F.col(c) > 0) & (F.col(c) >= ENOUGH * F.col("elsewhere"))  # noqa: E731  as chosen()
    most = F.when(enough("inside"), INSIDE).when(enough("below"), BELOW).otherwise(ELSEWHERE)
    counted = tokens.groupBy("host").agg(F.count("*").alias("pages"))
    found = own.join(counted, "host").join(ranked.select("host", most.alias("most"), "menus"), "host", "left")
    return found.select("host", "own", F.coalesce("most", F.lit(ELSEWHERE)).alias("most"), F.coalesce("menus", F.array().cast("array<long>")).alias("menus"), "pages")


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url, text (empty if none), n_chars (its code points).

    Null html is empty. Repeated rows and null ids or urls give a row each, but pages that are alike count once for the
    template; a page without a host, or of a host without a template, is ranked by itself. Pages of any length are read
    whole, once for the template and once for their text; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = own.join(written(templates(pages, url_col=url_col, html_col=html_col)), "host", "left").select("id", "url", "html", "own", "most", "menus", "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, known, most, menus, n in zip(texts(batch.column(2)), *(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True):
                found.append(main_text(parsed(page), set(known or ()), most, set(menus or ()), n or 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
