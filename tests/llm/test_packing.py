"""op7: identifiers by the library, gapless bins, bounds against exhaustive packing."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pairloom.llm import packing as P
from pairloom.llm.queries import op7_packed_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "  ", "Don't THEY'LL we'd İstanbul Straße ΑΣ ﬁ é \x1c a\x1db \x85x\xa0y <|endoftext|>ab '''s 12³½ ªº ÿŸ ǅ x\xady \x7f 日本語", "a" * 3000, "word, " * 9000, "'S 'T I'M"]


def check(rows, docs):
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert all(a + n == b for (a, n), b in zip(held, [*[a for a, _ in held[1:]], sum(n for _, n in held)], strict=True)) and held[0][0] == 0
        assert sum(n for _, n in held) <= 4096
    return len(bins), P.least_bins(np.array([r.length for r in rows]), 4096)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bins, least = check(op7_packed_documents(spark, sf).collect(), docs)
    assert least <= bins <= least + 1


def test_rounds(spark):
    df = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L ids_crc32", "1 + pmod(xxhash64(id), 4096) length")
    rows = P.packed(df, share=200).collect()
    bins = defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    assert len(rows) == 3000 and max(bins.values()) <= 4096
    assert len(bins) <= 1.02 * P.least_bins(np.array([r.length for r in rows]), 4096) + 1


def turns(rows):
    return 1 + max(r.sequence_id >> 56 for r in rows)


def test_certified_partitions_keep_their_bins(spark):
    df = spark.range(600).selectExpr("id doc_id", "0 piece", "0L ids_crc32", "2500L length")
    rows = P.packed(df, share=200).collect()
    assert len({r.sequence_id for r in rows}) == 600 and turns(rows) == 1
    # bins that cannot be filled: no turn without gain but one
    df = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L ids_crc32", "1300 + pmod(xxhash64(id), 1200) length")
    assert turns(P.packed(df, share=200).collect()) <= 4


def test_repeated_rows_are_dealt(spark):
    df = spark.range(4000).selectExpr("7L doc_id", "0 piece", "5L ids_crc32", "1000L length").checkpoint()
    rows = P.packed(df, share=500).collect()
    assert len(rows) == 4000 and len({r.sequence_id for r in rows}) <= 1000 + 8
    parts = {}
    for r in rows:
        parts.setdefault((r.sequence_id >> 28) & 0xFFFFFFF, []).append(r)
    assert len(parts) == 8 and max(map(len, parts.values())) < 700


def test_other_tokenizer(spark, tmp_path):
    import json

    other = json.load(open(PATH))
    other["normalizer"]["normalizers"] = other["normalizer"]["normalizers"][:2]  # keeps case
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    path = str(tmp_path / "other.json")
    json.dump(other, open(path, "w"))
    mine, lib = P.WordTokenizer(path), Tokenizer.from_file(path)
    for t in TEXTS:
        assert mine.ids(t or "") == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_corners(spark):
    docs = [(None if k == 3 else k % 5, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, length int, piece int")
    check(P.packed_documents(df, PATH).collect(), docs)
    assert P.packed_documents(df.where("false"), PATH).count() == 0


def fewest(lengths, capacity):
    for bins in itertools.count(1):
        def place(k, room):
            if k == len(lengths):
                return True
            return any(place(k + 1, room[:b] + [room[b] - lengths[k]] + room[b + 1 :]) for b in range(bins) if room[b] >= lengths[k])
        if place(0, [capacity] * bins):
            return bins


def test_bound():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 31, 7))[::-1]
        best = fewest(lengths.tolist(), 30)
        where, offset, room = P.best_fit_decreasing(lengths, 30)
        assert P.least_bins(lengths, 30) <= best <= len(room)
        assert (np.bincount(where, lengths) <= 30).all()


def test_certified_fit():
    """Whole packings, never more bins than best fit's, and fewer where the bound shows a gap that another order closes."""
    rng, closed = np.random.default_rng(1), 0
    for k in range(300):
        lengths = np.sort(rng.integers(3, [40, 60, 100][k % 3], rng.integers(5, 60)))[::-1]
        plain = len(P.best_fit_decreasing(lengths, 100)[2])
        where, offset, room, least = P.certified_fit(lengths, 100)
        assert least == P.least_bins(lengths, 100) <= len(room) <= plain
        assert (np.bincount(where, lengths, len(room)) + room == 100).all()
        for b in range(len(room)):
            own = np.flatnonzero(where == b)
            own = own[np.argsort(offset[own])]
            assert len(own) and (offset[own] == np.r_[0, np.cumsum(lengths[own])[:-1]]).all()
        closed += least == len(room) < plain
    assert closed


def test_packing_in_order_is_certified(spark):
    """The stage asks the bound of each run; best fit alone takes a bin more here."""
    rng = np.random.default_rng(1)
    for k in range(300):
        lengths = np.sort(rng.integers(3, [40, 60, 100][k % 3], rng.integers(5, 60)))[::-1]
        if len(P.certified_fit(lengths, 100)[2]) < len(P.best_fit_decreasing(lengths, 100)[2]):
            break
    docs = spark.createDataFrame([(i, "a " * (int(n) - 1)) for i, n in enumerate(lengths)], "doc_id long, text string").coalesce(1)
    rows = P.packed_in_order(docs, PATH, capacity=100).collect()
    assert sorted(r.length for r in rows) == sorted(lengths) and len({r.sequence_id for r in rows}) == P.least_bins(lengths, 100)
