"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Each partition of pieces packs its own by best-fit decreasing and keeps its full bins. Bins with room stay open, and what
lies in them over all partitions is bounded from below: how many bins does any packing of it need? If that is as many as
are open, they are certified and stay. Else there is a gap: the partitions exchange what lies in open bins, dealt anew by
another hash and over fewer partitions, and pack it again, for as long as that saves bins.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checkpointed, small_batches, texts

#: Words, and parts of words, that a worker remembers in each of two generations.
REMEMBERED = 250_000
#: Pieces of a partition; room that keeps a bin open, as a part of the capacity; part of the open bins that a turn must save
#: for another.
SHARE, ROOM, SAVED = 60_000, 0.03, 0.001
#: Consecutive rows that packed_in_order() packs together.
STRETCH = 2048


def _byte_symbols() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters as they are, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Identifiers as the tokenizer gives them, word by word, each word asked for once.

    Its normaliser and splitter look at no more than what stands between two blanks, so a text's identifiers
    are those of its blank-separated words in a row. A word of characters below U+0250 is split here as the
    tokenizer splits it and its parts go to the tokenizer's model; any other word goes to the tokenizer whole.
    That holds for SPLITTER and NORMALISERS; a file with others has its texts encoded as a whole.
    """

    #: The file's own splitter and normalisers.
    SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALISERS = ("NFC", "Replace", "Lowercase")

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.known_kind = self._known_kind(path)
        self.model = self.whole.model
        self.symbols = _byte_symbols()
        self.parts = regex.compile(self.SPLITTER)
        self.ascii_parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall  # the same for visible ASCII in lower case
        self.plain = re.compile("[!-~¡-ɏ]*")
        self.words: dict[bytes, bytes] = _Known(self.of_word)
        self.known: dict[str, bytes] = _Known(self.of_part)

    def _known_kind(self, path: str) -> bool:
        with open(path, "rb") as file:
            own = json.load(file)
        normal = (own["normalizer"] or {}).get("normalizers", [])
        steps = (own["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            tuple(n["type"] for n in normal) == self.NORMALISERS and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
            and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": self.SPLITTER} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and own["post_processor"] is None and own["model"]["type"] == "BPE"
            and all(t["content"].startswith("<|") and " " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in own["added_tokens"])
        )

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit identifiers."""
        if not self.known_kind:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.encode().split()))

    def of_word(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():  # of bytes: A-Z and a-z only
            return self.known[text.lower()]
        if "<|" in text or not self.plain.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii():
            return b"".join(map(self.known.__getitem__, self.ascii_parts(text.lower())))
        return b"".join(map(self.known.__getitem__, self.parts.findall(unicodedata.normalize("NFC", text).lower())))

    def of_part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(self.symbols[b] for b in part.encode())
        ids = [t.id for t in self.model.tokenize(shown)]
        return pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """What was made before, of the newer generation; of the older one what is asked for again comes over."""

    def __init__(self, make) -> None:
        self.make = make
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older[key] if key in self.older else self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if len(key) <= 60:
            self[key] = value
        return value


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 (and ids, with_ids).

    A document is its tokens and then end_id; one of more than capacity tokens is cut into pieces of capacity.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(texts(batch.column(1))):
                ids = memoryview(tokenizer.ids(text) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part), bytes(part) if with_ids else None), strict=True):
                        column.append(value)
            arrays = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in (2, 3, 4))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(rows[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lengths in descending order: the bin and the offset of each, and the room left in each bin.

    Bins wait by their room; one integer's bits tell which amounts of room some bin has, so the tightest fit is
    its lowest bit from the length on.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    where, offset, room = [], [], []
    for n in lengths.tolist():
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = waiting[left].pop()
            if not waiting[left]:
                mask &= ~(1 << left)
        else:
            b, left, bins = bins, capacity, bins + 1
            room.append(capacity)
        where.append(b)
        offset.append(capacity - left)
        left -= n
        room[b] = left
        if left:
            waiting[left].append(b)
            mask |= 1 << left
    return np.array(where, np.int64), np.array(offset, np.int64), np.array(room, np.int64)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins of any packing: the best of three families of dual-feasible functions.

    The identity; for each e up to half the capacity, "above capacity - e counts as a bin, below e as nothing";
    for each k, "x counts as floor((k + 1) x) / k unless (k + 1) x is whole, then as x" (x in bins).
    """
    return bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound(count: np.ndarray, capacity: int) -> int:
    """least_bins() of so many pieces of each length."""
    size = np.arange(capacity + 1)
    items, mass = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(mass[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    kept = capacity * (items[-1] - items[capacity - e]) + mass[capacity - e] - mass[e - 1]
    best = max(best, -(-int(kept.max(initial=0)) // capacity))
    for k in range(1, 33):
        grown = (k + 1) * size
        # in units of 1 / (k capacity), so that nothing is rounded
        value = np.where(grown % capacity == 0, size * k, grown // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def packed(rows: DataFrame, *, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), capacity: int = 4096, share: int = SHARE) -> DataFrame:
    """rows with sequence_id and offset: each bin's rows lie in it without gaps, at most capacity in all.

    rows: settled, so that reading them again gives the same partitions (a table's, or a checkpoint's). Lengths are 1 to
    capacity. Repeated rows are packed each by itself, and dealt like others. order: columns that settle the order of
    rows of one length.
    """
    names = rows.columns
    spread = [F.col(c) for c in order]

    def packer(turn: int, parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            lengths = table[length_col].to_numpy()
            by = np.argsort(-lengths, kind="stable")
            where, offset, room = best_fit_decreasing(lengths[by], capacity)
            again = (room > ROOM * capacity) if parts > 1 else np.zeros(len(room), bool)
            part = table["__part"][0].as_py()
            ids = (turn << 56) | (part << 28) | where
            out = table.take(pa.array(by)).drop_columns(["__part"])
            for name, values in (("sequence_id", pa.array(ids)), ("offset", pa.array(offset)), ("again", pa.array(again[where]))):
                out = out.append_column(name, values)
            yield from out.to_batches()

        return run

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    pool, old, bins, done, turn = rows, None, 0, [], 0
    n = rows.count()
    while True:
        parts = max(1, -(-n // share))
        salted = pool.select(*names, F.monotonically_increasing_id().alias("__salt"))  # else repeated rows go to one partition
        dealt = salted.select(*names, F.pmod(F.xxhash64(F.lit(turn), "__salt", *spread), F.lit(parts)).cast("int").alias("__part"))
        dealt = dealt.repartitionById(parts, F.col("__part")).sortWithinPartitions(*spread)
        out = checkpointed(dealt.mapInArrow(packer(turn, parts), f"{fields}, sequence_id long, offset long, again boolean"))
        # a bin is its row at offset 0
        all_bins, open_bins, n = out.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("again")), F.count_if("again")).first()
        if old is not None and all_bins > bins * (1 - SAVED):
            done.append(old if all_bins >= bins else out)
            break
        counts = np.zeros(capacity + 1, np.int64)
        for r in out.where("again").groupBy(length_col).agg(F.count("*").alias("k")).collect() if open_bins else []:  # one a length
            counts[r[0]] = r["k"]
        if open_bins <= bound(counts, capacity):
            done.append(out)  # no packing of what lies in open bins needs fewer
            break
        done.append(out.where("not again"))
        old = out.where("again")
        pool, bins, turn = old.select(*names), open_bins, turn + 1
    found = [d.select(*names, "sequence_id", "offset") for d in done]
    return reduce(DataFrame.unionByName, found)


def packed_documents(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, share: int = SHARE) -> DataFrame:
    """One row per piece of df's documents: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    vocabulary: path of a tokenizer's .json file, there on every executor. Null and empty texts are one piece of
    one token, the end mark. Texts of any length are tokenised whole and cut at capacity tokens. Repeated rows
    and null ids are packed each by itself; other columns are ignored; an empty table gives no rows.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return packed(checkpointed(pieces(own, vocabulary, capacity=capacity)), capacity=capacity, share=share).withColumnRenamed("doc_id", id_col)


def certified_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """best_fit_decreasing() of lengths in descending order, and the least bins of any packing by dual-feasible functions.

    While more bins are used than that, what lies in bins with over ROOM is packed again, best fit in another order, for as
    long as that saves bins; a packing of as many bins as the bound is certified and stays.
    """
    where, offset, room = best_fit_decreasing(lengths, capacity)
    least, turn = least_bins(lengths, capacity), 0
    while len(room) > least:
        again = (room > ROOM * capacity)[where]
        own = np.flatnonzero(again)
        count = len(np.unique(where[own]))
        if not len(own) or count <= least_bins(lengths[own], capacity):
            break  # no packing of what lies in open bins needs fewer
        draw = np.random.RandomState(turn)
        best = None
        for _ in range(8):
            order = np.argsort(-lengths[own] * draw.uniform(0.7, 1.0, len(own)), kind="stable")
            found = best_fit_decreasing(lengths[own][order], capacity)
            if best is None or len(found[2]) < len(best[1][2]):
                best = (order, found)
        order, (place, at, left) = best
        if len(left) >= count:
            break
        stay = np.unique(where[~again])
        number = np.full(len(room), -1, np.int64)
        number[stay] = np.arange(len(stay))
        kept = np.where(again, -1, number[where])
        kept[own[order]] = len(stay) + place
        offset = offset.copy()
        offset[own[order]] = at
        where, room, turn = kept, np.r_[room[stay], left], turn + 1
    return where, offset, room, least


def in_stretches(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """df with __stretch and __at: its rows, in the order in which they stand, in runs of so many, and their places there.

    Rows of files stand in the order of the files' names and then of the rows; others in that of the partitions.
    """
    try:
        place = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not read from files
        row = F.monotonically_increasing_id()
        place = df.withColumn("__row", row).withColumn("__file", F.lpad(F.shiftright("__row", 33).cast("string"), 10, "0"))
        place = place.withColumn("__row", F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)))
    before, rows = 0, []
    for r in place.groupBy("__file").agg(F.count("*").alias("n")).orderBy("__file").collect():  # one a file or partition
        rows.append((r["__file"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(rows, "__file string, __before long")
    at = place.join(F.broadcast(starts), "__file").withColumn("__at", F.col("__before") + F.col("__row"))
    return at.select(*df.columns, F.expr(f"__at div {stretch}").alias("__stretch"), F.expr(f"cast(__at % {stretch} as int)").alias("__at"))


def packed_in_order(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, stretch: int = STRETCH) -> DataFrame:
    """packed_documents() whose sequences, read by ascending sequence_id, follow the order of df's rows.

    Each run of `stretch` rows is packed by itself, by best fit certified by dual-feasible bounds (certified_fit), so sequences
    never mix runs; those of a run are numbered by the mean place of their tokens. Costs at most the bins' room at the end of each run.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    own = in_stretches(df, stretch).select(F.struct(F.col(id_col).alias("id"), "__stretch", "__at").alias("doc"), F.col(text_col).alias("text"))
    rows = pieces(own, vocabulary, id_col="doc", capacity=capacity).select("doc.*", "piece", "start", "length", "ids_crc32")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("__at", "ascending"), ("piece", "ascending")])
        lengths, at = group["length"].to_numpy(), group["__at"].to_numpy()
        by = np.argsort(-lengths, kind="stable")
        where, offset, room, _ = certified_fit(lengths[by], capacity)
        mean = np.bincount(where, lengths[by] * at[by]) / np.bincount(where, lengths[by])
        number = np.empty(len(room), np.int64)
        number[np.argsort(mean, kind="stable")] = np.arange(len(room))
        ids = (group["__stretch"].to_numpy()[by] << 32) | number[where]
        out = group.take(pa.array(by)).select(["id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    out = rows.groupBy("__stretch").applyInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
