"""Removal of repeated 100-byte strings by suffix arrays.

Of a repeated string every copy holds the same anchor at the same place: the least hash among its 32-byte runs.
So anchors that occur once anywhere rule their surroundings out, and the rest meet in groups of one anchor. There,
contexts (the bytes that strings around the anchor can reach) that are alike to the last byte fold into their first;
what differs goes, group by group, into shards. A shard is sorted by Larsson-Sadakane refinement, Kasai's scan
gives common prefixes, and suffixes that share 100 bytes form a class of which all but the earliest are removed. A
group too large for one shard is sorted in several, whose classes are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of an anchor. Bytes of text hashed together, of a part of the texts, of a shard of contexts; of a partition, which
#: holds several parts one after another.
ANCHOR, CHUNK, PART, SHARD, PARTITION = 32, 256 << 10, 24 << 20, 1 << 20, 192 << 20
#: Different contexts of one anchor beyond which they meet by what stands before or behind it too. Either way gives the
#: same result, as a string around an anchor has half of its further bytes on one side; it only bounds the work of a group.
CROWD = 2000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MOST = np.uint64(2**64 - 1)


def _run_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the width bytes from each place; width is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    h ^= h >> np.uint64(29)
    step = 1
    while step < width:
        h = h[:-step] * _MIX + h[step:]
        h ^= h >> np.uint64(32)
        step *= 2
    h *= _ODD
    return h ^ (h >> np.uint64(29))


def _slid(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (minimum or maximum) of each width values in a row."""
    step = 1
    while step * 2 <= width:
        x = least(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return least(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, and their hashes, of all strings of this length that lie in one text."""
    strings = len(data) - length + 1
    if strings <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _run_hashes(data, ANCHOR)
    width = length - ANCHOR + 1
    low = _slid(h, width, np.minimum)  # of the string that starts here
    for end in starts[1:-1].tolist():
        low[max(0, end - length + 1) : end] = 0  # reaches into the next text
    padded = np.zeros(strings + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + strings] = low
    high = _slid(padded, width, np.maximum)  # the largest least hash of the strings that hold the run here
    at = np.flatnonzero(h == high)
    return at, h[at]


def contexts(data: np.ndarray, starts: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For anchors: their text's number, first and last + 1 byte of the context, and the context's hash."""
    text = np.searchsorted(starts, at, side="right") - 1
    left = np.maximum(starts[text], at - (length - ANCHOR))
    right = np.minimum(starts[text + 1], at + length)
    reach = length - ANCHOR
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length + 8, np.uint8)])
    wide = -(-(2 * length - ANCHOR) // 8) * 8
    out = np.empty(len(at), np.uint64)
    for k in range(0, len(at), 20_000):
        a, lo, hi = (v[k : k + 20_000] for v in (at, left, right))
        rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[a].copy()
        cut = np.flatnonzero((lo > a - reach) | (hi < a + length))
        if len(cut):
            place = np.arange(wide)[None, :] + (a[cut] - reach)[:, None]
            rows[cut] *= (place >= lo[cut, None]) & (place < hi[cut, None])
        rows[:, 2 * length - ANCHOR :] = 0
        words = rows.view("<u8")
        h = (a - lo).astype(np.uint64) * np.uint64(1000) + (hi - a).astype(np.uint64)
        for j in range(words.shape[1]):
            h = (h ^ words[:, j]) * _ODD
            h ^= h >> np.uint64(32)
            h *= _MIX
        out[k : k + 20_000] = h ^ (h >> np.uint64(29))
    return text, left, right, out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, the bytes of some texts in a row, and where each starts (and the last ends)."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK or k == len(texts) - 1:
            held = texts[first : k + 1]
            yield first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            first, size = k + 1, 0


# -- suffix arrays --------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each place's rank.

    data: bytes; the end counts as 0. Larsson-Sadakane: sort by the first symbols, as many as fit into a word with as few
    bits each as the data's own symbols need, then sort only groups not yet told apart, by the ranks that many, twice as
    many, ... places on, until none is left. (Kasai's scan needs the whole order; equal prefixes of some depth would not do.)
    """
    n = len(data)
    own = np.bincount(data, minlength=256) > 0
    own[0] = False
    code = np.where(own, np.cumsum(own), 0).astype(np.uint8)
    bits = max(1, int(own.sum()).bit_length())
    h = min(16, 64 // bits)
    padded = np.concatenate([code[data], np.zeros(h, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(bits)) | padded[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    del key, sorted_key
    rank = np.empty(n + 1, np.int32)  # a shard is far below 2**31 bytes
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    while h < n:
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = np.flatnonzero(~alone)  # places in the order that groups of more than one take up
        if not len(at):
            break
        who = order[at]
        both = rank[who].astype(np.int64) * (n + 2) + rank[np.minimum(who + h, n)] + 1
        by = np.argsort(both)
        who, both = who[by], both[by]
        order[at] = who
        split = np.ones(len(at), bool)
        split[1:] = both[1:] != both[:-1]
        rank[who] = np.maximum.accumulate(np.where(split, at, 0))
        new[at] = split
        h *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """For each place, the common prefix (at most so long) of its suffix and the one sorted before it.

    Kasai: from one place to the next a common prefix shrinks by one at most. Stretches of the data, from one of
    `begins` to the next, are scanned side by side.
    """
    n = len(data)
    before = np.where(rank > 0, order[np.maximum(rank, 1) - 1], n)
    padded = np.concatenate([data, np.zeros(most + 1, np.uint8)])  # what lies beyond the end is never part of a whole string
    out = np.zeros(n, np.int32)
    ends = np.append(begins[1:], n)
    lanes = np.argsort(begins - ends, kind="stable")  # longest first, so that those still open are a prefix
    first, spans = begins[lanes], (ends - begins)[lanes]
    length = np.zeros(len(begins), np.int64)
    for k in range(int(spans.max(initial=0))):
        live = int(np.searchsorted(-spans, -k, side="left"))
        here = first[:live] + k
        other = before[here]
        got = np.maximum(length[:live] - 1, 0)
        got *= other < n
        grow = np.flatnonzero((padded[here + got] == padded[other + got]) & (got < most))
        while len(grow):
            now = got[grow] + 1
            got[grow] = now
            more = (padded[here[grow] + now] == padded[other[grow] + now]) & (now < most)
            grow = grow[more]
        out[here] = got
        length[:live] = got
    return out


def repeats(rows: list[bytes], doc: np.ndarray, start: np.ndarray, length: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each context (bytes without zero bytes of a document's from a place on), which of the strings of this
    length in it also start earlier, in any of the contexts: a Boolean for each place they can start at."""
    found, begins = repeats_in_a_row(rows, doc, start, length, shard)
    return [found[b : b + max(0, len(r) - length + 1)] for r, b in zip(rows, begins.tolist(), strict=True)]


def repeats_in_a_row(rows: list[bytes], doc: np.ndarray, start: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """repeats() in one array, each row's followed by a False, and where each row's begin."""
    places = np.array([max(0, len(r) - length + 1) for r in rows], np.int64) + 1
    begins = np.cumsum(places) - places
    found = np.zeros(int(places.sum()), bool)
    history: list[tuple] = []
    cuts, size = [0], 0
    for k, r in enumerate(rows):
        size += len(r) + 1
        if size >= shard or k == len(rows) - 1:
            cuts.append(k + 1)
            size = 0
    merged: tuple | None = None
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        text, d, s, who, place = _classes(rows[lo:hi], doc[lo:hi], start[lo:hi], length, len(cuts) == 2)
        who = who + lo
        first = np.ones(len(d), bool)
        first[1:] = text[1:] != text[:-1] if len(text) else first[1:]
        group = np.cumsum(first) - 1
        late = (d != d[first][group]) | (s != s[first][group])
        found[begins[who[late]] + place[late]] = True
        if len(cuts) == 2:
            break
        strings, fd, fs = text[first], d[first], s[first]
        if merged is None:
            merged = (strings, fd, fs)
            history.append((text, d, s, who, place))
            continue
        history.append((text, d, s, who, place))
        # merge by binary search: strings of this shard among those of the shards before
        at = np.searchsorted(merged[0], strings)
        hit = at < len(merged[0])
        hit[hit] = merged[0][at[hit]] == strings[hit]
        ms, md, mp = merged
        earlier = hit.copy()
        earlier[hit] = (fd[hit] < md[at[hit]]) | ((fd[hit] == md[at[hit]]) & (fs[hit] < mp[at[hit]]))
        md[at[earlier]], mp[at[earlier]] = fd[earlier], fs[earlier]
        new = ~hit
        place_in = at[new] + np.arange(new.sum())
        total = len(ms) + int(new.sum())
        old = np.ones(total, bool)
        old[place_in] = False
        parts = []
        for had, got in ((ms, strings), (md, fd), (mp, fs)):
            whole = np.empty(total, had.dtype)
            whole[old], whole[place_in] = had, got[new]
            parts.append(whole)
        merged = tuple(parts)
    if merged is not None:
        for text, d, s, who, place in history:
            at = np.searchsorted(merged[0], text)
            late = (merged[1][at] != d) | (merged[2][at] != s)
            found[begins[who[late]] + place[late]] = True
    return found, begins


def _classes(rows: list[bytes], doc: np.ndarray, start: np.ndarray, length: int, alone: bool) -> tuple:
    """Strings of one shard, sorted, those alike by (doc, start): string, doc, start, row, place. For a shard that is alone,
    only those of classes of two and more, by their class's number."""
    joined = np.frombuffer(b"\0".join(rows) + b"\0", np.uint8)
    sizes = np.array([len(r) + 1 for r in rows])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order, rank = suffix_array(joined)
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(joined)) - begins[row]
    whole = place <= sizes[row] - 1 - length
    prefix = common_prefixes(joined, order, rank, begins, length)
    fresh = prefix[order] < length
    label = np.empty(len(joined), np.int64)
    label[order] = np.cumsum(fresh)
    at = order[whole[order]]
    if alone:
        at = at[np.bincount(label[at], minlength=label[order[-1]] + 1)[label[at]] > 1]
    d, s = doc[row[at]], start[row[at]] + place[at]
    by = np.lexsort((s, d, label[at]))
    at, d, s = at[by], d[by], s[by]
    return label[at] if alone else _strings(joined, at, length), d, s, row[at], place[at]


def _strings(joined: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    if not len(at):
        return np.zeros(0, f"S{length}")
    wide = np.concatenate([joined, np.zeros(length, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, length)[at]).view(f"S{length}").ravel()


# -- the operator ---------------------------------------------------------------------------------------------

_LEAST = -(1 << 63)
_GROUP = "part int, a long, c long, doc long, at long, n long"
_SAID = "part int, kind int, a long, c long, lo long, hi long"


def _part_anchors(ids: np.ndarray, texts: list[bytes], length: int, only: np.ndarray | None = None) -> Iterator[tuple]:
    """Anchors of the texts, chunk by chunk, with their contexts; only those of these hashes (ascending), if given."""
    for first, data, starts in _chunks(texts):
        at, h = anchors(data, starts, length)
        if only is not None:
            known = h.view(np.int64)
            place = np.minimum(np.searchsorted(only, known), max(len(only) - 1, 0))
            keep = only[place] == known if len(only) else np.zeros(len(known), bool)
            at, h = at[keep], h[keep]
        text, left, right, c = contexts(data, starts, at, length)
        yield first, data, starts, at, h.view(np.int64), text, left, right, c.view(np.int64)


def _folded(length: int):
    """Anchors of a partition of texts; those of one context become one row with the first place and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, _, texts in _whole(batches):
            held = []
            for first, _, starts, at, a, text, _, _, c in _part_anchors(ids, texts, length):
                held.append((a, c, ids[first + text], at - starts[text]))
            if not held:
                continue
            a, c, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((place, doc, c, a))
            a, c, doc, place = a[by], c[by], doc[by], place[by]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), part, np.int32)), *(pa.array(v[heads]) for v in (a, c, doc, place)), pa.array(n)], names=["part", "a", "c", "doc", "at", "n"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """Partitions of texts: their number, ids, keys and texts. Rows of a partition come together."""
    held: list = []
    now = None
    for batch in batches:
        parts = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if now is not None and parts[lo] != now:
                yield now, *_columns(held)
                held = []
            now = int(parts[lo])
            held.append(batch.slice(lo, hi - lo))
    if now is not None:
        yield now, *_columns(held)


def _columns(held: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
    keys = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in held])
    return ids, keys, [t for b in held for t in b.column(3).cast(pa.binary()).to_pylist()]


#: What a group of one anchor says of a partition's folded context: all its places hold earlier strings only; all
#: but the first do; the same, and the first is to be compared with other contexts (with very many: CROWDED). SPAN:
#: strings lo to hi start so.
ALL, LATER, COMPARE, SPAN, CROWDED = 0, 1, 2, 3, 4


def _judged(batches: Iterator[pa.RecordBatch], crowd: int = CROWD) -> Iterator[pa.RecordBatch]:
    """Rows of _GROUP sorted by a, c, doc, at, in; verdicts of groups that occur more than once out."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if held is None or not len(held[0]):
            continue
        end = len(held[1]) if batch is None else int(np.searchsorted(held[1], held[1][-1]))
        part, a, c, doc, at, n = (x[:end] for x in held)
        held = [x[end:] for x in held]
        if not end:
            continue
        new_a = np.ones(end, bool)
        new_a[1:] = a[1:] != a[:-1]
        new_c = new_a.copy()
        new_c[1:] |= c[1:] != c[:-1]
        group = np.cumsum(new_a) - 1
        differ = np.bincount(group, new_c)[group]
        many = differ > 1
        # rows of one id may lie in several partitions: those that start where the first one does are as early as it
        head = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
        first = (doc == doc[head]) & (at == at[head])
        kind = np.where(first, np.where(differ > crowd, CROWDED, np.where(many, COMPARE, LATER)), ALL)
        keep = many | ~new_c | (n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(part[keep]), pa.array(kind[keep].astype(np.int32)), pa.array(a[keep]), pa.array(c[keep]), pa.array(doc[keep]), pa.array(at[keep])], names=["part", "kind", "a", "c", "lo", "hi"])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _matched(a: np.ndarray, c: np.ndarray, said: tuple) -> np.ndarray:
    """The verdict on each anchor: its row in said (kind, a, c, lo, hi; sorted by a, c), or -1."""
    sa, sc = said[1], said[2]
    if not len(sa):
        return np.full(len(a), -1)
    pair = np.empty(len(sa), [("a", "<i8"), ("c", "<i8")])
    pair["a"], pair["c"] = sa, sc
    lo = np.searchsorted(sa, a, side="left")
    hi = np.searchsorted(sa, a, side="right")
    out = np.full(len(a), -1)
    one = np.flatnonzero(hi > lo)
    # binary search for c inside the run of a
    low, high = lo[one].copy(), hi[one].copy()
    want = c[one]
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = open_ & (sc[np.minimum(mid, len(sc) - 1)] < want)
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    ok = (low < hi[one]) & (sc[np.minimum(low, len(sc) - 1)] == want)
    out[one[ok]] = low[ok]
    return out


def _said(table: pa.Table) -> tuple:
    kind, a, c, lo, hi = (table[name].to_numpy() for name in ("kind", "a", "c", "lo", "hi"))
    by = np.lexsort((c, a))
    return kind[by], a[by], c[by], lo[by], hi[by]


def _sides(left: pa.Table) -> tuple[int, np.ndarray, np.ndarray, list[bytes]]:
    return next(_whole(iter(left.combine_chunks().to_batches())))


def _halves(a: int, context: bytes, at: int, length: int) -> list[int]:
    """Where a crowd's context meets others: a string around the anchor holds half of its further bytes on one side."""
    half = (length - ANCHOR) // 2
    sides = []
    if at >= half:
        sides.append(b"<" + context[at - half : at])
    if len(context) - at - ANCHOR >= half:
        sides.append(b">" + context[at + ANCHOR : at + ANCHOR + half])
    return [int.from_bytes(hashlib.blake2b(b"%d" % a + s, digest_size=8).digest(), "little", signed=True) for s in sides]


def _wanted(length: int):
    """Contexts to compare, of a partition of texts and the verdicts on it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if left.num_rows and right.num_rows:
            part, ids, keys, texts = _sides(left)
            said = _said(right)
            for first, data, starts, at, a, text, lo, hi, c in _part_anchors(ids, texts, length, said[1]):
                row = _matched(a, c, said)
                place = at - starts[text]
                ok = (row >= 0) & (said[0][row] >= COMPARE) & (said[3][row] == ids[first + text]) & (said[4][row] == place)
                for k in np.flatnonzero(ok).tolist():
                    t = first + int(text[k])
                    context = data[lo[k] : hi[k]].tobytes()
                    for meets in [int(a[k])] if said[0][row[k]] == COMPARE else _halves(int(a[k]), context, int(at[k] - lo[k]), length):
                        for column, value in zip(out, (part, meets, int(ids[t]), int(keys[t]), int(lo[k] - starts[text[k]]), context), strict=True):
                            column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["part", "a", "doc", "key", "start", "bytes"])

    return run


def _compared(length: int):
    """Contexts sorted by a, doc, start, in; spans of strings that start earlier elsewhere, out."""

    def judge(rows: list) -> Iterator[pa.RecordBatch]:
        part, _, doc, key, start, data = (np.array(v) if k < 5 else v for k, v in enumerate(zip(*rows, strict=True)))
        found, begins = repeats_in_a_row([_free(d) for d in data], doc, start, length, 2 * SHARD)
        edge = np.diff(np.concatenate([[0], found.view(np.int8)]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(lo):
            row = np.searchsorted(begins, lo, side="right") - 1
            base = start[row] - begins[row]
            columns = (part[row].astype(np.int32), np.full(len(row), SPAN, np.int32), doc[row], key[row], base + lo, base + hi)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["part", "kind", "a", "c", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []  # whole groups
        group: list = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if group and row[1] != group[-1][1]:
                    if len(group) > 1:  # who is alone has no one to compare with
                        rows += group
                        size += sum(len(r[5]) for r in group)
                    group = []
                    if size >= SHARD:
                        yield from judge(rows)
                        rows, size = [], 0
                group.append(row)
        if len(group) > 1:
            rows += group
        if rows:
            yield from judge(rows)

    return run


def _free(data: bytes) -> bytes:
    """Without zero bytes, in a way that keeps places and equality: UTF-8 never holds the byte 255."""
    return data.replace(b"\0", b"\xff")


def _kept_text(data: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes are gone."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(begins):
        return ""
    whole = np.minimum.reduceat(gone.view(np.uint8), begins).astype(bool)
    return data[~np.repeat(whole, np.diff(np.append(begins, len(data))))].tobytes().decode()


def _cleaned(length: int, keep_text: bool, carried: list[str]):
    """Texts without what the verdicts on their anchors and the spans cover."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if left.num_rows:
            _, ids, keys, texts = _sides(left)
            span = right["kind"].to_numpy() == SPAN if right.num_rows else np.zeros(0, bool)
            said = _said(right.filter(pa.array(~span)))
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            extra = right.filter(pa.array(span))
            for doc, key, lo, hi in zip(*(extra[n].to_pylist() for n in ("a", "c", "lo", "hi")), strict=True):
                spans.setdefault((doc, key), []).append((lo, hi))
            for first, data, starts, at, a, text, lo, hi, c in _part_anchors(ids, texts, length, said[1]):
                row = _matched(a, c, said)
                place = at - starts[text]
                mine = (said[3][row] == ids[first + text]) & (said[4][row] == place) if len(said[0]) else np.zeros(len(at), bool)
                hit = (row >= 0) & (hi - lo >= length)
                if len(said[0]):
                    hit &= (said[0][row] == ALL) | ~mine
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, lo[hit], 1)
                np.add.at(change, hi[hit], -1)
                for t in range(len(starts) - 1):
                    for s, e in spans.get((int(ids[first + t]), int(keys[first + t])), ()):
                        change[starts[t] + s] += 1
                        change[starts[t] + e - 1 + length] -= 1
                covered = np.cumsum(change[:-1]) > 0
                for t, (s, e) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                    gone = covered[s:e]
                    removed = int(gone.sum())
                    rest = data[s:e][~gone].tobytes() if removed else texts[first + t]
                    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)) if removed else 0
                    for column, value in zip(out, (int(ids[first + t]), e - s, removed, runs, hashlib.sha256(rest).hexdigest(), _kept_text(data[s:e], gone) if keep_text else None), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        n = 6 if keep_text else 5
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:n]
        rest_of = left.select(carried)
        return pa.Table.from_arrays([*(pa.array(v, k) for v, k in zip(out[:n], kinds, strict=False)), *rest_of.columns], names=[*names, *carried])

    return run


def without_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_text: bool = False, carry: tuple[str, ...] = (), crowd: int = CROWD) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text kept, the text left.

    (kept holds whole characters: one of which some bytes are removed and others not stays.) The columns in carry
    come along.

    Removed is each byte that a string of `length` bytes covers which also starts earlier: in a row of a smaller
    id, or in a row of the same id at an earlier byte. Null texts are empty; shorter texts lose nothing; texts
    are read whole. Rows of one id that are alike do not remove each other; a null id counts as the least and comes
    back null. Columns not named are ignored; an empty table gives no rows.

    Texts are dealt once, by a hash of their id and content, and that exchange serves all three passes over them.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"), *[F.col(c).alias(f"__{c}") for c in carry])
    carried = [f"__{c}" for c in carry]
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PARTITION))
    parts = max(partitions, -(-int(total) // PART))
    dealt = own.select(F.pmod(F.xxhash64("doc", "key"), F.lit(parts)).cast("int").alias("part"), "doc", "key", "text", *carried).repartition(partitions, F.col("part"))
    folded = dealt.sortWithinPartitions("part").mapInArrow(_folded(length), _GROUP)
    said = folded.repartition(partitions, F.col("a")).sortWithinPartitions("a", "c", "doc", "at").mapInArrow(lambda batches: _judged(batches, crowd), _SAID)
    wanted = dealt.groupBy("part").cogroup(said.where(F.col("kind").isin(COMPARE, CROWDED)).groupBy("part")).applyInArrow(_wanted(length), "part int, a long, doc long, key long, start long, bytes binary")
    spans = wanted.repartition(partitions, F.col("a")).sortWithinPartitions("a", "doc", "start").mapInArrow(_compared(length), _SAID)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    schema += "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in carried)
    out = dealt.groupBy("part").cogroup(said.unionByName(spans).groupBy("part")).applyInArrow(_cleaned(length, keep_text, carried), schema)
    return out.select(F.nullif(F.col("doc_id"), F.lit(_LEAST)).alias(id_col), *[F.col(f"`{c}`").alias(c.removeprefix("__")) for c in out.columns[1:]])


def cleaned(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """The rows of df in its columns, each text without its repeated strings; a column n_chars is counted anew.

    A text of which nothing is left stays, empty. Of a character removed in part all stays. A null text comes back
    empty.
    """
    carry = tuple(c for c in df.columns if c not in (id_col, text_col))
    plain = {c: f"own_{k}" for k, c in enumerate(carry)}  # no clash with the columns that are added
    out = without_repeats(df.withColumnsRenamed(plain), id_col=id_col, text_col=text_col, length=length, keep_text=True, carry=tuple(plain.values()))
    found = {c: F.col(plain.get(c, c)).alias(c) for c in df.columns if c != text_col}
    found[text_col] = F.col("kept").alias(text_col)
    if "n_chars" in carry:
        found["n_chars"] = F.char_length("kept").cast(df.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[found[c] for c in df.columns])
