"""Document fingerprints from improbable features.

Every 16-byte window of a text gets the entropy of its bytes; classes of entropy are ranked by how rare they
are over the whole corpus, rarest first. A window that is the rarest of enough runs of neighbouring windows is a
feature (runs reach over the text's ends, so a short text has features too). Features go, in text order, into a chain
of Bloom filters, and two chains are alike as far as their filters share more bits than chance would have them share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: Bytes of a window; windows of a run, of which the rarest is noted; how often noted makes a feature.
WINDOW, RUN, NOTED = 16, 32, 8
#: Bits of a filter, bits set for a feature, features of a filter.
FILTER, HASHES, HELD = 2048, 5, 128
#: Classes of entropy; windows of the lowest come last: blanks and rules tell nothing.
CLASSES, PLAIN = 1025, 102
#: Bytes taken together, and lanes that walk over them side by side; bytes of a partition.
CHUNK, LANES, PART = 4 << 20, 8192, 128 << 20

_STEP = np.zeros(WINDOW + 1, np.int32)  # growth of sum(c log2 c), in 1/16 bits, from c to c + 1
_C = np.arange(1, WINDOW + 2)
_STEP[1:] = np.diff(np.rint(_C * np.log2(_C) * 16).astype(np.int32))
_MOST = 16 * WINDOW * (WINDOW.bit_length() - 1)  # of a window of one byte value
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 for k in range(max(2, WINDOW // 8))], np.uint64)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class of the window that starts at each byte, for all that fit in.

    Lanes of equal length walk along the data together; each keeps its window's byte counts and updates
    sum(c log c) by the byte that enters and the byte that leaves.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    lanes = min(LANES, max(1, n // 256))
    span = -(-n // lanes)
    padded = np.zeros(lanes * span + WINDOW, np.uint8)
    padded[: len(data)] = data
    steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (span + WINDOW - 1, lanes), (1, span)))
    counts = np.zeros(lanes * 256, np.uint8)
    base = np.arange(lanes, dtype=np.int64) * 256
    total = np.zeros(lanes, np.int32)
    out = np.empty((span, lanes), np.int16)
    for t in range(span + WINDOW - 1):
        at = base + steps[t]
        c = counts[at]
        total += _STEP[c]
        counts[at] = c + 1
        if t >= WINDOW - 1:
            k = t - WINDOW + 1
            out[k] = CLASSES - 1 - total * (CLASSES - 1) // _MOST
            at = base + steps[k]
            c = counts[at] - 1
            total -= _STEP[c]
            counts[at] = c
    return np.ascontiguousarray(out.T).ravel()[:n]


def class_counts(df: DataFrame, text_col: str = "text") -> list[int]:
    """How many windows of each class all texts have; partitions add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for data, starts, lengths in _chunks([t.encode() for t in texts(batch.column(0))]):
                ok = _inside(len(data), starts, lengths)
                total += np.bincount(np.maximum(entropy_classes(data), 0)[ok], minlength=CLASSES)[:CLASSES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(total)], names=["class", "n"])

    out = [0] * CLASSES
    for row in df.select(text_col).mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[row["class"]] = row["n"]
    return out


def ranked(counts: list[int]) -> np.ndarray:
    """Rank of each class: rarest first, plain ones after all others."""
    order = sorted(range(CLASSES), key=lambda c: (c < PLAIN, counts[c], c))
    rank = np.empty(CLASSES, np.int64)
    rank[order] = np.arange(CLASSES)
    return rank


def _chunks(rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts, about CHUNK bytes at once, so far apart that no run sees two: the bytes, where each text starts, and
    its length."""
    held: list[bytes] = []
    size = 0
    gap = bytes(RUN)
    for k, row in enumerate(rows):
        held.append(row)
        size += len(row) + RUN
        if size >= CHUNK or k == len(rows) - 1:
            lengths = np.array(list(map(len, held)), np.int64)
            starts = RUN + np.concatenate([[0], np.cumsum(lengths[:-1] + RUN)])
            yield np.frombuffer(gap + gap.join(held) + gap, np.uint8), starts, lengths
            held, size = [], 0


def _inside(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the window from each place lies in a text, for the n - WINDOW + 1 places of the data."""
    change = np.zeros(n + 2, np.int32)
    whole = lengths >= WINDOW
    change[starts[whole]] += 1
    change[(starts + lengths)[whole] - WINDOW + 1] -= 1
    return np.cumsum(change)[: max(0, n - WINDOW + 1)] > 0


class Digest:
    """Features of one text in a chain of filters."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.n = len(hashes)
        chain = -(-self.n // HELD)
        bits = np.zeros((chain, FILTER), np.uint8)
        which = np.arange(self.n) // HELD
        for k in range(HASHES):
            bits[which, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER - 1)] = 1
        self.filters = np.packbits(bits, axis=1)

    def __str__(self) -> str:
        return f"{self.n:x}:{self.filters.tobytes().hex()}"

    def likeness(self, other: Digest) -> float:
        """Shared part of both texts' features, 0 to 1; 1 for two texts without features, 0 if one has some."""
        if not self.n or not other.n:
            return float(self.n == other.n)
        if self.n == other.n and np.array_equal(self.filters, other.filters):
            return 1.0
        a, b = self.filters.view(np.uint64), other.filters.view(np.uint64)
        ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
        shared = np.array([np.bitwise_count(row & b).sum(axis=1, dtype=np.int64) for row in a])
        chance = np.outer(ones_a, ones_b) / FILTER
        least = np.minimum.outer(ones_a, ones_b)
        score = np.clip((shared - chance) / np.maximum(least - chance, 1e-9), 0, 1)
        held_a, held_b = (np.minimum(HELD, x.n - HELD * np.arange(len(x.filters))) for x in (self, other))
        return float((held_a @ score.max(axis=1) + held_b @ score.max(axis=0)) / (self.n + other.n))


def _hashed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view("<u8")
    h = np.zeros(len(at), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _MIX[k]
        h ^= h >> np.uint64(29)
    return (h * _MIX[1]) ^ (h >> np.uint64(32))


def digests_of(rows: list[str], rank: np.ndarray) -> list[Digest]:
    """Of a text shorter than a window the whole is the one feature."""
    out = []
    for data, starts, lengths in _chunks([r.encode() for r in rows]):
        ok = _inside(len(data), starts, lengths)
        key = np.where(ok, rank[np.maximum(entropy_classes(data), 0)], CLASSES) << 32 | np.arange(len(ok))
        low, step = key, 1
        while step < RUN:  # the least key of RUN places, doubled
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            step *= 2
        low = low[low >> 32 < CLASSES]
        chosen = np.bincount(low & 0xFFFFFFFF, minlength=len(ok)) >= NOTED
        at = np.flatnonzero(chosen)
        hashes = _hashed(data, at)
        cuts = np.searchsorted(at, np.append(starts, len(data)))
        for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            if 0 < n < WINDOW:
                whole = hashlib.blake2b(data[s : s + n].tobytes(), digest_size=8).digest()
                out.append(Digest(np.frombuffer(whole, "<u8")))
            else:
                out.append(Digest(hashes[cuts[k] : cuts[k + 1]]))
    return out


def _edited(text: str, following: str) -> str:
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """One row per row of df: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next id (after the last the first; of repeated ids, which are in order of
    their texts, the next row; null ids come first; a lone row is its own next). Its first quarter-length
    replaces a text's last quarter in the edited text. Null texts are empty; an empty text has the fingerprint
    "0:". Texts are read whole; other columns are ignored; an empty table gives no rows. rank: places of
    entropy classes, to compare with digests made elsewhere; else those of this corpus.

    Rows are dealt by ranges of ids whose bounds are ids of the table, so the first row of a range is known
    beforehand and also goes to the range before it: texts are shuffled once.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if rank is None:
        rank = ranked(class_counts(own))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART))
    marks = own.agg(
        F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("first"),
        F.percentile_approx("id", [(k + 1) / parts for k in range(parts - 1)] or [0.5], max(10_000, 50 * parts)).alias("bounds"),
    ).first()
    first = marks["first"]
    bounds = np.array(sorted({b for b in (marks["bounds"] or []) if b != first}) if parts > 1 else [], np.int64)
    last = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, ids, side="right")
            heads = np.concatenate([np.flatnonzero(np.isin(ids, bounds)), np.flatnonzero(ids == first)])
            to = np.concatenate([part[heads[: len(heads) - int((ids == first).sum())]] - 1, np.full(int((ids == first).sum()), last)])
            rows = pa.array(np.concatenate([np.arange(len(ids)), heads]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([part, to]).astype(np.int32)), pa.array(np.repeat([0, 1], [len(ids), len(heads)]).astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)],
                names=["part", "halo", "id", "text"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (part, halo, id, text, digest) of the row whose next row is still to come
        for batch in batches:
            new = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts(batch.column(3)), strict=True))
            found = digests_of([r[3] for r in new], rank)
            rows = ([held] if held else []) + [(*r, d) for r, d in zip(new, found, strict=True)]
            for start in range(0, len(rows) - 1, 256):
                block = rows[start : start + 257]
                pairs = [(a, b) for a, b in zip(block, block[1:], strict=False) if not a[1]]
                if pairs:
                    yield emitted(pairs)
            held = rows[-1]

    def emitted(pairs: list[tuple]) -> pa.RecordBatch:
        edited = [_edited(a[3], b[3]) for a, b in pairs]
        changed = digests_of(edited, rank)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([str(a[4]) for a, _ in pairs], pa.string()),
                pa.array([str(d) for d in changed], pa.string()),
                pa.array([a[4].likeness(d) for (a, _), d in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([a[4].likeness(b[4]) for a, b in pairs], pa.float64()),
            ],
            names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    dealt = own.mapInArrow(deal, "part int, halo int, id long, text string").repartitionById(last + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "halo", F.col("id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
