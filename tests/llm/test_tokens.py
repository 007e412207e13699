"""op5 against the library."""

import public_tokenizers
import pytest
import sentencepiece

from pairloom.llm.queries import op5_token_counts
from pairloom.llm.tokens import PieceModel, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", "a", " a  b ", "ﬁ x\n\ty  ", "a <s> </s><unk> b<0x0A>", "▁a\xa0b　c\r\n\x00d", "日本𝔘é é", "\x1f", "\n\n a\n  b",
         "hello,world;it's 12.5%off!!  U.S.A. naïve", "a" * 3000, " " * 300 + "x", "word " * 9000, "é" * 50 + "²½Ⅷ"]


def test_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in token_counts(df, PATH).collect()}
    for k, t in enumerate(TEXTS):
        n = len(lib.encode(t or ""))
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((t or "").encode()), n, n > 4096), t


def test_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = {r.doc_id: r.n_tokens for r in op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert rows == {d.doc_id: len(lib.encode(d.text or "")) for d in docs}


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_corners(spark):
    rows = [(None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (3, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())
    assert [g[:2] for g in got] == [("3", 0), ("3", 1), ("3", 1), ("None", 3), ("None", 3)] and got[1] == got[2] and got[3] == got[4]


def test_other_models(tmp_path):
    """A model of another kind is refused, not counted wrongly."""
    data = open(PATH, "rb").read()
    for number in (b"\x18\x02", b"\x98\x02\x01"):  # fields 3 and 35 of the trainer's settings: kind, byte fallback
        at = data.rindex(number)
        (tmp_path / "other.model").write_bytes(data[: at + len(number) - 1] + (b"\x01" if len(number) == 2 else b"\x00") + data[at + len(number) :])
        with pytest.raises(ValueError):
            PieceModel(str(tmp_path / "other.model"))
