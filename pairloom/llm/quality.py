"""A quality classifier on document statistics.

Random Fourier features stand for a Gaussian kernel over the statistics of a whole text; each partition sums its
share of the normal equations, one small system gives the ridge scores, and isotonic regression on labelled rows
kept out of the fit turns scores into chances.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import checkpointed, small_batches, texts, written

#: Random features; ridge penalty for a row; bins of raw scores for the calibration.
FEATURES, RIDGE, BINS = 384, 1e-4, 2000

_CLASS = np.zeros((256, 9), np.float64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(97, 123)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-?", b"!", b"#$%&*|<>{}[]\\/=+_^~@`", bytes(range(128, 256)))):
    _CLASS[list(_bytes), _k] = 1


def statistics(text: str) -> list[float]:
    """Figures of a text, all finite: sizes, kinds of bytes, words, and how much of it repeats."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    share = counts / n
    seen = share[share > 0]
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = text.split("\n")
    pairs = len(set(zip(words, words[1:], strict=False)))
    distinct = len(set(words))
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)),
        *np.sqrt(share @ _CLASS).tolist(),
        -float((seen * np.log2(seen)).sum()),
        float(share.max()),
        float(lengths.mean()), float(lengths.std()), np.log1p(float(lengths.max())),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        distinct / m, np.log1p(distinct), (pairs + 1) / m,
        len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)),
        sum(map(str.isupper, words)) / m, sum(map(str.isalpha, words)) / m, sum(map(str.istitle, words)) / m,
        data.count(b". ") / m, data.count(b"!!") / m, data.count(b",") / m,
    ]


def features(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each row's whole text; null counts as empty."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, x array<double>")


def _summed(df: DataFrame, make: Callable[[np.ndarray, np.ndarray | None], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what make gives for blocks of them; each partition sums first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), np.float64)
                total += make(x, batch.column(1).to_numpy(zero_copy_only=False) if batch.num_columns > 1 else None)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "v"])

    out = np.zeros(size)
    for row in df.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[row["at"]] = row["v"]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ways: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # raw scores, ascending
    chance: np.ndarray  # their calibrated values, ascending

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.ways + self.phase)
        return np.hstack([waves, z * 0.1, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.chance), 0, 1) if len(x) else np.zeros(0)


def isotonic(n: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (n rows, y of them ones, mean raw score x): places and values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(n.tolist(), y.tolist(), x.tolist(), strict=True):
        blocks.append([a, b, a * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([s / a for a, _, s in blocks]), np.array([b / a for a, b, _ in blocks])


def held_out(id_column: Column) -> Column:
    """Whether crc32(id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(known: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", seed: int = 7) -> Model:
    """A model from all labelled rows that are not held out; a fifth of them, by their id's hash, only calibrate.

    known: (id, x) of all rows. Several labels of one id count by their mean, null labels not at all. Without
    any label every score is 0.5; with one kind of label only, that kind's value.
    """
    dims = len(statistics(""))
    sums = _summed(known.select("x"), lambda x, _: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * dims)
    n = max(sums[0], 1)
    mean = sums[1 : dims + 1] / n
    scale = np.sqrt(np.maximum(sums[dims + 1 :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(dims), (dims, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + dims + 1), np.array([0.0]), np.array([0.5]))
    truth = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).cast("double").alias("y"))
    rows = checkpointed(known.join(truth, "id").where(~held_out(F.col("id"))).select("x", "y", (F.crc32(F.col("id").cast("string").cast("binary")) % 20 >= 16).alias("late")))
    size = FEATURES + dims + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.lifted(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows.where("not late").select("x", "y"), equations, size * size + size)
    a, b = sums[: size * size].reshape(size, size), sums[size * size :]
    if a[-1, -1] == 0:
        return model
    penalty = RIDGE * a[-1, -1] * np.eye(size)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(a + penalty + 1e-9 * np.eye(size), b)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        at = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(at, w, BINS) for w in (None, y, raw)])

    for part in (rows.where("late"), rows):
        count, ones, raws = _summed(part.select("x", "y"), binned, 3 * BINS).reshape(3, BINS)
        has = count > 0
        if has.any():
            model.at, model.chance = isotonic(count[has], ones[has], raws[has] / count[has])
            break
    return model


def quality_scores(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row per row of df: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold).

    A score depends on the text alone: null counts as empty, and an empty text has a score like any other.
    Texts are read whole. Repeated rows and null ids give a row each; other columns are ignored.
    """
    known = checkpointed(features(df, id_col=id_col, text_col=text_col))
    model = fit(known, labels, id_col=id_col, label_col=label_col)
    id_type = known.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.array(batch.column(1).to_pylist(), np.float64))
            ids = batch.column(0).to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return known.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")


def accepted(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of df, whole, whose text scores at least the threshold; no row is moved for it.

    Rows are written once with their texts' statistics (a column __x), which the fit reads by themselves.
    """
    small_batches(df.sparkSession)
    at, names = df.columns.index(text_col), df.columns
    with_x = StructType([*df.schema.fields, StructField("__x", ArrayType(DoubleType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in texts(batch.column(at))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, x], names=[*names, "__x"])

    rows = written(df.mapInArrow(read, with_x))
    model = fit(rows.select(F.col(id_col).alias("id"), F.col("__x").alias("x")), labels, id_col=id_col, label_col=label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array(batch.column(len(names)).to_pylist(), np.float64))
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(score >= threshold))

    return rows.mapInArrow(run, df.schema)
