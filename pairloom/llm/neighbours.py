"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts, a small classifier learns from a vector alone
which part it belongs to, and every vector is filed under its most likely part. A part that holds more than a bound
is parted again in the same way, by a router learned from a sample of its own. A query goes to its several most likely
parts and is compared with all vectors there, exactly. How many parts is measured on sampled vectors that the router
has not learned from, whose true neighbours among each other are known.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, small_batches

#: Vectors that a router is learned from; of a part in the sample, at least; parts of one router at most; vectors of a part
#: beyond which it is parted again.
SAMPLE, HELD, PARTS, SPLIT = 6000, 60, 64, 20_000
#: Neighbours of a vector in the graph; hidden units; passes over the sample.
DEGREE, HIDDEN, PASSES = 10, 96, 60
#: Recall to reach on sampled queries; vectors of an index block.
AIM, BLOCK = 0.93, 4096


def exact_neighbours(queries: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest vectors of each query."""
    d = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None, :] - 2 * queries @ vectors.T
    k = min(k, len(vectors))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node of a neighbour graph, few edges cut, no part over 5 % larger than the mean.

    Parts grow from spread seeds along edges, one node a turn for the smallest part; then nodes move to the part that
    most of their neighbours are in, as far as sizes allow.
    """
    n = len(graph)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    around = [np.array(sorted({*row, *back[i]} - {i}), np.int64) for i, row in enumerate(graph.tolist())]
    part = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    fronts: list[list[int]] = [[int(s)] for s in rng.permutation(n)[:parts]]
    loose = iter(rng.permutation(n).tolist())
    most = int(np.ceil(n / parts * 1.05))
    for _ in range(n):
        p = int(size.argmin())
        node = None
        while fronts[p] and node is None:
            k = fronts[p].pop(0)
            node = k if part[k] < 0 else None
        while node is None:
            k = next(loose)
            node = k if part[k] < 0 else None
        part[node] = p
        size[p] += 1
        fronts[p] += around[node][part[around[node]] < 0].tolist()
    for _ in range(12):
        moved = 0
        for k in rng.permutation(n).tolist():
            votes = np.bincount(part[around[k]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != part[k])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[k]]:
                size[part[k]] -= 1
                size[best] += 1
                part[k] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer that gives each part's chance."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def learned(x: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> Router:
    """targets: for each vector the parts' shares among itself and its neighbours."""
    n, dims = x.shape
    parts = targets.shape[1]
    mean, scale = x.mean(0), float(x.std()) or 1.0
    z = (x - mean) / scale
    weights = [rng.normal(0, np.sqrt(2 / dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for turn in range(PASSES):
        rate = 3e-3 * (1 - turn / PASSES) + 1e-4
        order = rng.permutation(n)
        for at in range(0, n, 128):
            rows = order[at : at + 128]
            hidden = np.maximum(z[rows] @ weights[0] + weights[1], 0)
            out = hidden @ weights[2] + weights[3]
            chance = np.exp(out - out.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            d = (chance - targets[rows]) / len(rows)
            dh = d @ weights[2].T * (hidden > 0)
            step += 1
            for k, g in enumerate((z[rows].T @ dh, dh.sum(0), hidden.T @ d, d.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) + 1e-4 * weights[k])
    return Router(mean, scale, *weights)


@dataclass
class Parting:
    """A router, its number of parts, and how many of them a query is to visit."""

    router: Router | None
    parts: int
    visited: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """The parts by their chance, for each vector; only one part without a router."""
        return self.router.parts(x, self.parts) if self.router and len(x) else np.zeros((len(x), 1), np.int64)


def fitted(sample: np.ndarray, k: int, aim: float = AIM, seed: int = 5) -> Parting:
    """Parts learned from a sample; one part if it is too small for two."""
    rng = np.random.default_rng(seed)
    n = len(sample)
    parts = min(PARTS, n // HELD)
    if parts < 2:
        return Parting(None, 1, 1)
    degree = min(DEGREE, n - 1)
    near = np.vstack([exact_neighbours(sample[at : at + 1024], sample, degree + 1) for at in range(0, n, 1024)])
    graph = np.array([[j for j in row.tolist() if j != i][:degree] for i, row in enumerate(near)])
    part = balanced_parts(graph, parts, rng)
    targets = np.zeros((n, parts))
    np.add.at(targets, (np.arange(n)[:, None], part[graph]), 1 / (degree + 1))
    targets[np.arange(n), part] += 1 / (degree + 1)
    # how well unseen vectors find each other: learn without a third, half of which ask
    order = rng.permutation(n)
    unseen, seen = order[: n // 3], order[n // 3 :]
    trial = learned(sample[seen], targets[seen], rng)
    asked = np.arange(max(1, len(unseen) // 2))
    filed = trial.parts(sample[unseen], 1)[:, 0]
    found = exact_neighbours(sample[unseen[asked]], sample[unseen], min(k + 1, len(unseen)))
    visits = trial.parts(sample[unseen[asked]], parts)
    place = np.empty_like(visits)
    np.put_along_axis(place, visits, np.arange(parts)[None, :].repeat(len(asked), 0), 1)
    needed = np.take_along_axis(place, filed[found], 1)[found != asked[:, None]]
    recall = [(needed < v).mean() if len(needed) else 1.0 for v in range(1, parts + 1)]
    visited = next((v for v, r in enumerate(recall, 1) if r >= aim), parts)
    return Parting(learned(sample, targets, rng), parts, visited)


@dataclass
class Index:
    """The first parting, and those of its parts that are parted again; leaves are numbered through."""

    first: Parting
    again: dict[int, Parting]

    def __post_init__(self) -> None:
        sizes = [self.again[p].parts if p in self.again else 1 for p in range(self.first.parts)]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @property
    def leaves(self) -> int:
        return int(self.start[-1])

    def filed(self, x: np.ndarray) -> np.ndarray:
        """The most likely leaf of each vector."""
        part = self.first.order(x)[:, 0]
        out = self.start[part]
        for p, parting in self.again.items():
            own = np.flatnonzero(part == p)
            if len(own):
                out[own] += parting.order(x[own])[:, 0]
        return out

    def routes(self, x: np.ndarray, counts: np.ndarray, least: int) -> list[list[int]]:
        """The leaves that each vector visits: the likely ones of its likely parts, and more until they hold `least`."""
        first = self.first.order(x)
        inner = {p: parting.order(x) for p, parting in self.again.items()}
        out = []
        for r in range(len(x)):
            likely, later = [], []
            for at, p in enumerate(first[r].tolist()):
                leaves = (self.start[p] + inner[p][r]).tolist() if p in inner else [int(self.start[p])]
                own = self.again[p].visited if p in inner else 1
                likely += leaves[:own] if at < self.first.visited else []
                later += leaves[own:] if at < self.first.visited else leaves
            held = int(counts[likely].sum())
            for leaf in later:
                if held >= least:
                    break
                likely.append(leaf)
                held += int(counts[leaf])
            out.append(likely)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def taking_part(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers and one not zero, of the length most vectors have."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = df.where(v.isNotNull() & (F.size(v) > 0)).where(~bad).where(F.exists(v, lambda x: x != 0))
    most = ok.groupBy(F.size(v).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return ok.where(F.size(v) == (most[0]["n"] if most else 0))


def indexed(index: DataFrame, k: int, *, sample: int = SAMPLE, split: int = SPLIT) -> tuple[DataFrame, Index]:
    """(id, v, leaf) of all vectors of index (id, v), and what filed them.

    Each router is learned from at most `sample` vectors, those of the least hashes: the first on the driver, the others,
    for parts of more than `split` vectors, each in a task. A router is a few hundred kilobytes, and there are at most
    PARTS of the second kind.
    """
    drawn = index.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    first = fitted(np.array([list(v) for v in drawn], np.float64), k) if len(drawn) else Parting(None, 1, 1)
    kind = index.schema["v"].dataType.simpleString()

    def file(found: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = found.filed(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], names=["id", "v", "leaf"])

        return checkpointed(index.mapInArrow(run, f"id long, v {kind}, leaf int"))

    found = Index(first, {})
    filed = file(found)
    large = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect() if r["n"] > split}
    if not large or first.router is None:
        return filed, found
    # of each large part about `sample` vectors, by their hash
    part = F.create_map(*[F.lit(x) for p, n in large.items() for x in (p, int(min(1.0, 0.9 * sample / n) * (1 << 30)))])
    some = filed.where(F.col("leaf").isin(list(large))).where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < part[F.col("leaf")])

    def learn(group: pa.Table) -> pa.Table:
        x = _matrix(group["v"].combine_chunks())
        parting = fitted(x[:sample], k, aim=AIM**0.5)
        return pa.table({"leaf": group["leaf"][:1], "model": pa.array([pickle.dumps(parting)], pa.binary())})

    again = {r["leaf"]: pickle.loads(r["model"]) for r in some.groupBy("leaf").applyInArrow(learn, "leaf int, model binary").collect()}
    found = Index(first, again)
    return file(found), found


def nearest(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, sample: int = SAMPLE, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest found for each row whose id is a
    multiple of `every`, ties to the smaller id; all others, if fewer than k.

    Vectors that are null, empty, zero, hold a null or non-finite component or are not of the usual length take no
    part, nor do rows without an id. Rows of one id are one candidate each but never of that id's own query, and one
    query (by the least vector, compared component by component). Other columns are ignored.

    Of equal vectors only rows of the k + 1 smallest ids, and k rows of each, can be among any k nearest, so no more are
    compared; repeated rows are counted map-side, before Spark shuffles. A part of the index is searched in blocks;
    queries meet each block of the parts they visit, and blocks are of bounded size.
    """
    spark = df.sparkSession
    small_batches(spark)
    own = taking_part(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col(id_col).isNotNull()), "v")
    # zeros of either sign are one vector
    own = own.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float") if "float" in own.schema["v"].dataType.simpleString() else x + F.lit(0)))
    rows = own.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    by_vector = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    index = index.select("id", "v", F.explode(F.sequence(F.lit(1), "copies")).alias("n")).select("id", "v")
    by_id = Window.partitionBy("id").orderBy("v")
    queries = own.where(F.col("id") % every == 0).withColumn("n", F.row_number().over(by_id)).where("n = 1").drop("n")
    index, queries = checkpointed(index), checkpointed(queries)
    filed, found = indexed(index, k, sample=sample, split=split)
    counts, others = np.zeros(found.leaves, np.int64), np.zeros(found.leaves, np.int64)
    for row in filed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect():
        counts[row["leaf"]], others[row["leaf"]] = row["n"], row["ids"]
    blocks = np.maximum(1, -(-counts // block))
    kind = own.schema["v"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, to, where = [], [], []
            for r, leaves in enumerate(found.routes(_matrix(batch.column(1)), others, k + 1)):
                for leaf in leaves:
                    n = int(blocks[leaf])
                    rows += [r] * n
                    to += [leaf] * n
                    where += range(n)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(to, pa.int32()), pa.array(where, pa.int32())], names=["id", "v", "leaf", "block"])

    several = {int(p): int(n) for p, n in enumerate(blocks) if n > 1}
    per_leaf = F.coalesce(F.create_map(*[F.lit(x) for pair in several.items() for x in pair])[F.col("leaf")], F.lit(1)) if several else F.lit(1)
    placed = filed.withColumn("block", F.pmod(F.xxhash64("id", "v"), per_leaf).cast("int"))
    asked = queries.mapInArrow(route, f"id long, v {kind}, leaf int, block int")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["v"].combine_chunks()), _matrix(right["v"].combine_chunks())
            q_ids, ids = left["id"].to_numpy(), right["id"].to_numpy()
            square = (x**2).sum(1)
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                d = (some**2).sum(1)[:, None] + square[None, :] - 2 * some @ x.T
                own_id = q_ids[at : at + 256, None] == ids[None, :]
                d[own_id] = np.inf
                kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                slack = 1e-9 * ((some**2).sum(1) + square.max())
                for r in range(len(some)):
                    near = np.flatnonzero((d[r] <= kth[r] + slack[r]) & ~own_id[r])
                    exact = np.sqrt(((x[near] - some[r]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], exact))[:k]
                    out[0] += [int(q_ids[at + r])] * len(best)
                    out[1] += ids[near][best].tolist()
                    out[2] += exact[best].tolist()
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    near = asked.groupBy("leaf", "block").cogroup(placed.select("id", "v", "leaf", "block").groupBy("leaf", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
