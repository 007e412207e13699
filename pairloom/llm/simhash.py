"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Bits that vary together share a partition. If thresholds t of m partitions satisfy sum(t + 1) > distance, two
fingerprints within the distance are within t of each other in one partition at least. Dynamic programming gives the
thresholds their least estimated cost; each fingerprint is then filed under its partition's value (and, for t > 0, under
those at up to t / 2 bits from it, so that both meet half way), and whoever meets in a group is verified.

Exact copies fold into one fingerprint before that. A group that holds too many fingerprints is parted anew by
further bits, and what is still too large in tiles, so that any two of its members meet in some task. Of a
group's links a spanning forest leaves the task, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import files
from .common import checkpointed, small_batches, texts, written

BITS = 64
#: Members of a group that one task links by itself.
GROUP = 4096
#: Sets of a component whose similarity one task takes, and what they hold; a larger one is compared in tiles of so much.
TILE, SHINGLES = 4096, 2 << 20
#: Fingerprints of a set of shingles, by differently mixed hashes: a similar pair is near in one of them at least.
MIXES = 3
#: What an entry costs, in verified candidates; distances from which large groups go to tiles at once, as finer parts of so
#: few bits would hardly part them.
FILING, FINER = 300, 8
#: Rows compared with so many others at most go step by step; entries that a task looks at together, about.
STEPS, TOGETHER = 48, 200_000
#: Sizes of one class differ by this factor at most.
CLASS = 4.0


def shingle_hashes(text: str, words: int, seed: int) -> list[int]:
    """XXH64 of each run of so many words; of the whole sequence if there are fewer; none without words."""
    found = text.encode().lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return [digest(b" ".join(found), seed)] if found else []
    form = b" ".join([b"%b"] * words)
    return [digest(form % run, seed) for run in zip(*(found[k:] for k in range(words)), strict=False)]


def fingerprints_of(rows: list[str], words: int, seed: int) -> np.ndarray:
    """A 64-bit fingerprint for each text: the bits that over half of its shingles' hashes have."""
    hashes = [shingle_hashes(t, words, seed) for t in rows]
    out = np.zeros(len(rows), np.uint64)
    for k, each in enumerate(hashes):
        if each:
            bits = np.unpackbits(np.array(each, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[k] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(each), bitorder="little").view("<u8")[0]
    return out


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """id_col and fp (the fingerprint's bits as a signed long) for each row; null text counts as empty: fp 0."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(texts(batch.column(1)), words, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def _bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints, and how many have both bits i and j, over all of them; each partition sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            values = np.append(total.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "n"])

    sums = distinct.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    values = np.zeros(BITS * BITS + 1)
    for row in sums:
        values[row["at"]] = row["n"]
    return int(values[-1]), values[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many groups of like size; each group gathers what is most correlated with it."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    alike = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        group = [max(left, key=lambda b: (alike[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (alike[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _apart(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Chances that two fingerprints differ in 0, 1, ... most of these bits.

    Mean and variance of the number of differing bits follow exactly from how many fingerprints have each pair of bits;
    a beta-binomial of both stands for its distribution, so bits that vary together raise the chance of few differences.
    """
    joint = both / max(n, 1)
    mean = np.diag(joint)
    m, q = len(bits), 2 * mean * (1 - mean)
    p11 = joint[np.ix_(bits, bits)]
    p10 = mean[bits][:, None] - p11
    p01 = mean[bits][None, :] - p11
    cov = 2 * (p11 * (1 - p11 - p10 - p01) + p10 * p01) - np.outer(q[bits], q[bits])
    np.fill_diagonal(cov, q[bits] * (1 - q[bits]))
    rate = float(np.clip(q[bits].mean(), 1e-6, 1 - 1e-6))
    spread = max(float(cov.sum()), 0.0) / (m * rate * (1 - rate))  # 1 for independent bits, m for equal ones
    rho = min(max((spread - 1) / max(m - 1, 1), 1e-6), 1 - 1e-6)
    alpha, beta = rate * (1 / rho - 1), (1 - rate) * (1 / rho - 1)
    d = np.arange(most + 1)
    chance = [comb(m, int(k)) * np.exp(lgamma(k + alpha) + lgamma(m - k + beta) - lgamma(m + alpha + beta) + lgamma(alpha + beta) - lgamma(alpha) - lgamma(beta)) if k <= m else 0.0 for k in d]
    return np.array(chance)


def _meetings(m: int, radius: int, d: int) -> int:
    """Values of m bits within the radius of both of two values that differ in d bits."""
    return sum(comb(d, i) * comb(m - d, j) for i in range(d + 1) for j in range(m - d + 1) if i + j <= radius and d - i + j <= radius)


def plan(n: int, both: np.ndarray, distance: int, pairs: float | None = None, filing: float = FILING) -> list[tuple[list[int], int]]:
    """Partitions (bits, radius) of least estimated cost: entries filed, and candidates to verify, of which one entry
    is as dear as `filing`.

    Two values that differ in up to t bits are both within t / 2 (rounded up) of some value, so a radius r serves the
    threshold 2 r. pairs: how many pairs may be candidates at all; by default all.
    """
    pairs = n * n / 2 if pairs is None else pairs
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, distance + 2):
        groups = grouped_bits(n, both, parts)
        costs = []  # of each group, by radius
        for bits in groups:
            m, cost = len(bits), []
            apart = _apart(n, both, bits, min(distance + 1, m))
            for r in range(min(-(-distance // 2), m, 2) + 1):
                filed = sum(comb(m, d) for d in range(r + 1))
                met = sum(apart[d] * _meetings(m, r, d) for d in range(min(2 * r, len(apart) - 1) + 1))
                cost.append(filing * n * filed + pairs * met)
            costs.append(cost)
        # least[s]: the cheapest radii of the groups so far whose thresholds 2 r give sum(2 r + 1) = s, or more than the distance
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in least.items():
                for r in range(-1, len(cost)):
                    to, price = min(s + 2 * r + 1, distance + 1) if r >= 0 else s, c + (cost[r] if r >= 0 else 0.0)
                    if to not in new or price < new[to][0]:
                        new[to] = (price, [*chosen, r])
            least = new
        cost, chosen = least.get(distance + 1, (float("inf"), []))
        if cost < best[0]:
            best = (cost, [(b, r) for b, r in zip(groups, chosen, strict=True) if r >= 0])
    return best[1]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _filed(distinct: DataFrame, parts: list[tuple[list[int], int]], by: tuple[str, ...] = ()) -> DataFrame:
    """(key, part, ..., fp): each fingerprint under the values within the partition's radius of its own.

    key: a hash of `by`, the partition and the value; should two keys be alike, more is compared, and nothing else.
    """
    keys = []
    for k, (bits, r) in enumerate(parts):
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        flips = [list(f) for d in range(r + 1) for f in combinations(bits, d)]
        keys += [F.struct(F.lit(k).alias("part"), value.bitwiseXOR(F.lit(_mask(f))).alias("value")) for f in flips]
    rest = [c for c in distinct.columns if c not in (*by, "fp")]
    filed = distinct.select(*by, *rest, "fp", F.explode(F.array(*keys)).alias("x"))
    return filed.select(F.xxhash64(*by, "x.part", "x.value").alias("key"), F.col("x.part").cast("tinyint").alias("part"), *rest, "fp")


def forest(x: np.ndarray, distance: int, size: np.ndarray | None = None, ratio: float = 0.0) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links within the distance (and of sizes of this ratio at least);
    visits each member once."""
    edges, left = [], np.arange(len(x))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            k = front.pop()
            near = np.bitwise_count(x[left] ^ x[k]) <= distance
            if size is not None:
                near &= np.minimum(size[left], size[k]) >= ratio * np.maximum(size[left], size[k])
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(k, int(j)) for j in found]
                front += found.tolist()
    return edges


def linked_rows(heads: np.ndarray, x: np.ndarray, distance: int, size: np.ndarray | None = None, ratio: float = 0.0) -> np.ndarray:
    """Whether each row has a link within its group. heads: the number of a row's group, ascending; sizes ascend in
    a group. Rows with few others to compare with go step by step, all groups at once; the rest by blocks."""
    n = len(x)
    if size is None:
        ends = np.searchsorted(heads, heads, side="right")
    else:
        place = heads.astype(np.int64) << 40
        ends = np.searchsorted(place | size, place | np.minimum(size / ratio, 2.0**39).astype(np.int64), side="right")
    span = ends - np.arange(n) - 1
    linked = np.zeros(n, bool)
    at = np.flatnonzero((span > 0) & (span <= STEPS))
    step = 1
    while len(at):
        hit = at[np.bitwise_count(x[at] ^ x[at + step]) <= distance]
        linked[hit] = linked[hit + step] = True
        step += 1
        at = at[span[at] >= step]
    wide = np.flatnonzero(span > STEPS)
    for k in range(0, len(wide), 256):
        rows = wide[k : k + 256]
        # one block a group: the rows of a chunk may be of several
        cuts = [0, *(np.flatnonzero(heads[rows[1:]] != heads[rows[:-1]]) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = rows[lo:hi]
            first, last = int(own[0]) + 1, int(ends[own].max())
            hit = np.bitwise_count(x[own, None] ^ x[None, first:last]) <= distance
            other = np.arange(first, last)
            near = np.flatnonzero(hit.any(axis=1))
            for r in near.tolist():
                mates = other[hit[r]]
                mates = mates[(mates > own[r]) & (mates < ends[own[r]])]
                if len(mates):
                    linked[own[r]] = True
                    linked[mates] = True
    return linked


def _linked(filed: DataFrame, key: list[str], distance: int, ratio: float = 0.0) -> DataFrame:
    """Forest edges (a, b) of each group, with a column size only between sizes of this ratio at least; the rows come
    sorted by key and size, so a group is a run of them."""
    sized = "size" in filed.columns
    names = [*key, *["size"] * sized, "fp"]
    ran = filed.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*names).select(*names)

    def of(columns: list[np.ndarray], heads: np.ndarray) -> tuple[list[int], list[int]]:
        x, size = columns[-1].view(np.uint64), columns[-2] if sized else None
        at = np.flatnonzero(linked_rows(heads, x, distance, size, ratio))
        a, b = [], []
        cuts = [0, *(np.flatnonzero(heads[at[1:]] != heads[at[:-1]]) + 1).tolist(), len(at)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            own = x[at[s:e]]
            for i, j in forest(own, distance, size[at[s:e]] if sized else None, ratio):
                a.append(int(own[i]))
                b.append(int(own[j]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in _ended(batches):
            if batch is not None:
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))])
                rows += batch.num_rows
                if rows < TOGETHER:
                    continue
            if not rows:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            change = np.zeros(rows, bool)
            for c in columns[: len(key)]:
                change[1:] |= c[1:] != c[:-1]
            heads = np.cumsum(change)
            end = rows if batch is None else int(np.searchsorted(heads, heads[-1]))
            a, b = of([c[:end] for c in columns], heads[:end])
            held, rows = [[c[end:] for c in columns]], rows - end
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return ran.mapInArrow(run, "a long, b long").distinct()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _parted(filed: DataFrame, key: list[str], group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of groups of at most so many members (and two at least), those of larger ones with their number (members),
    and the keys of these."""
    sizes = filed.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")
    crowded = checkpointed(sizes.where(F.col("members") > group), 0)  # a file for a hundred thousand groups would do
    met = filed.join(sizes.where(F.col("members") <= group), key)
    return met.drop("members"), filed.join(crowded, key), crowded


def links(distinct: DataFrame, distance: int = 3, group: int = GROUP, by: tuple[str, ...] = (), ratio: float = 0.0, pairs: float | None = None) -> DataFrame:
    """(a, b): links between fingerprints within the distance that connect whatever all such links connect.

    distinct: fp, without repeats; with `by`, links are sought among rows of equal `by` only, and with a column size
    only between sizes of this ratio at least. The links found are true ones, at most one fewer than a group's members.
    pairs: how many pairs may be candidates, by the caller's own count.
    """
    n, both = _bit_counts(distinct)
    if n < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    parts = plan(n, both, distance, pairs)
    key = ["key"]
    few, many, crowded = _parted(_filed(distinct, parts, by), key, group)
    out = _linked(few, key, distance, ratio)
    if crowded.isEmpty():
        return out
    sized = [c for c in distinct.columns if c == "size"]
    if distance < FINER:
        # Any two within the distance agree on one of distance + 1 further partitions of the bits that they need not share.
        finer = None
        for k, (bits, r) in enumerate(parts):
            rest = [b for b in range(BITS) if r or b not in bits]
            cuts = [rest[len(rest) * j // (distance + 1) : len(rest) * (j + 1) // (distance + 1)] for j in range(distance + 1)]
            own = [F.struct(F.lit(j).alias("sub"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("rest")) for j, c in enumerate(cuts)]
            rows = many.where(F.col("part") == k).select("key", *sized, F.explode(F.array(*own)).alias("x"), "fp")
            rows = rows.select(F.xxhash64("key", "x.sub", "x.rest").alias("key"), *sized, "fp")
            finer = rows if finer is None else finer.unionByName(rows)
        few, many, _ = _parted(finer, key, group)
        out = out.unionByName(_linked(few, key, distance, ratio))
    # Tiles: chunks of half a group's bound, every two of them together.
    chunks = F.ceil(F.col("members") / F.lit(group // 2)).cast("int")
    tiled = many.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.withColumn("low", F.least("c", "o")).withColumn("high", F.greatest("c", "o")).select(F.xxhash64("key", "low", "high").alias("key"), *sized, "fp")
    return out.unionByName(_linked(tiled, key, distance, ratio))


def simhash_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, distance: int = 3, group: int = GROUP) -> DataFrame:
    """One row per row of df: id_col, fingerprint (16 hexadecimal digits), component_id.

    component_id: the smallest id reachable over links between fingerprints that differ in at most `distance`
    bits, the row's own included. Null and empty texts, and texts of white space only, have the fingerprint
    zero, which is linked like any other. Repeated rows give a row each. A null id is never a component_id
    unless a component has no other. Texts are hashed whole; other columns are ignored.
    """
    own = checkpointed(fingerprints(df, id_col=id_col, text_col=text_col, words=words, seed=seed))
    rows = own.count()
    distinct = checkpointed(own.groupBy("fp").agg(F.min(id_col).alias("least_id")), rows)
    labels = connected_components(links(distinct.select("fp"), distance, group), "a", "b", rows)
    named = distinct.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = named.join(lowest, "component").select("fp", "component_id")
    return own.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of df whose id is their component's smallest, one row for each component; all columns stay.

    Of repeated rows with that id one stays. Rows without an id stay, as nothing tells them apart.
    """
    return _lowest_rows(df, simhash_components(df, id_col=id_col, text_col=text_col, **how), id_col)


def _lowest_rows(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Ids are written as tables, whose size Spark knows, so it broadcasts small ones and leaves the rows where they are.
    Only rows of repeated ids are grouped."""
    stay = written(found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__stay")).distinct())
    repeated = written(found.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("n")).where("n > 1 and __id is not null").select("__id"))
    kept = df.where(F.col(id_col).isNotNull()).join(stay, F.col(id_col) == F.col("__stay"), "left_semi")
    once = kept.join(repeated, F.col(id_col) == F.col("__id"), "left_anti")
    first = kept.join(repeated, F.col(id_col) == F.col("__id"), "left_semi").dropDuplicates([id_col])
    return once.unionByName(first).unionByName(df.where(F.col(id_col).isNull()))


def shingle_sets(rows: list[str], words: int, seed: int) -> list[np.ndarray]:
    """The distinct shingles' hashes of each text, ascending."""
    return [np.unique(np.array(shingle_hashes(t, words, seed), np.uint64)) for t in rows]


def set_fingerprints(own: np.ndarray) -> list[int]:
    """MIXES fingerprints of a set of hashes, as signed longs; 0 without shingles."""
    out = []
    for k in range(MIXES):
        x = own + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own), bitorder="little").view("<i8")[0]))
    return out


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the pairs of sets (of distinct hashes) with this Jaccard similarity; two
    empty sets have it. Each set is compared once, with all that are not yet linked."""
    size = np.array([len(s) for s in sets], np.int64)
    universe, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(universe), bool)
    edges, left, own = [], np.arange(len(sets)), flat  # own: what the sets left hold, in a row
    front: list[int] = []
    while len(left):
        if front:
            k = front.pop()
        else:
            k, left, own = int(left[0]), left[1:], own[size[left[0]] :]
            if not len(left):
                break
        mine = flat[begins[k] : begins[k + 1]]
        mark[mine] = True
        hits = np.concatenate([[0], np.cumsum(mark[own])])
        mark[mine] = False
        ends = np.cumsum(size[left])
        both = hits[ends] - hits[ends - size[left]]
        # whole numbers times the similarity, with the least of slack against rounding
        near = both >= similarity * (size[left] + size[k] - both) * (1 - 1e-12)
        if near.any():
            found = left[near]
            own = own[np.repeat(~near, size[left])]
            left = left[~near]
            edges += [(k, int(j)) for j in found]
            front += found.tolist()
    return edges


def near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, distance: int = 12, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """id_col and component_id (the smallest id of its component) for each row of df with an id.

    Links are pairs whose sets of shingles have this Jaccard similarity, exactly taken. Equal sets fold into one.
    Candidates are within the distance in one of MIXES fingerprints of the sets; a similar pair that is further
    apart in all of them, and not connected otherwise, is missed (at 12 bits and a similarity of just 0.8 about one
    in 200 by the angle between the sets). As similar sets are of similar size, only fingerprints of like sizes are
    compared. Whatever candidates connect is then compared by its sets, read again
    from the texts; more than `tile` sets in tiles. Texts without words are alike.
    """
    small_batches(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def made(with_sets: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = shingle_sets(texts(batch.column(1)), words, seed)
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
                if with_sets:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])
                    continue
                fps = pa.array([set_fingerprints(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), fps, pa.array([len(s) for s in sets], pa.int64())], names=["id", "key", "fps", "size"])

        return run

    own = checkpointed(rows.mapInArrow(made(False), f"id {id_type}, key long, fps array<long>, size long"))
    n = own.count()
    distinct = checkpointed(own.groupBy("key").agg(F.min("id").alias("least_id"), F.first("fps").alias("fps"), F.first("size").alias("size")), n)
    # Filed in the class of its own size, and in the next if a similar set may be there; in a class sorted by size.
    class_ = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(float(np.log(CLASS)))).cast("int")
    each = distinct.select("key", class_.alias("class"), F.greatest("size", F.lit(1)).cast("long").alias("size"), F.posexplode("fps").alias("mix", "fp"))
    beyond = F.col("size") * (1.01 / similarity) >= F.pow(F.lit(CLASS), F.col("class") + 1)
    classes = F.when(beyond, F.array("class", F.col("class") + 1)).otherwise(F.array("class"))
    classed = checkpointed(each.select("mix", F.explode(classes).alias("class"), "size", "fp").groupBy("mix", "class", "fp", "size").agg(F.lit(1).alias("one")).drop("one"), MIXES * n)
    # Pairs of sizes within the ratio, from the numbers of rows by steps of that ratio.
    step = F.floor(F.log("size") / F.lit(float(np.log(1 / similarity)))).cast("int")
    counts = {(r["mix"], r["step"]): r["n"] for r in each.groupBy("mix", step.alias("step")).agg(F.count("*").alias("n")).collect()}
    pairs = sum(n * n / 2 + n * counts.get((mix, k + 1), 0) / 2 for (mix, k), n in counts.items())
    near = links(classed, distance, by=("mix", "class"), ratio=similarity * (1 - 1e-9), pairs=pairs).distinct()
    of_fp = each.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    edges = near.join(of_fp.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b").select("u", "v")
    edges = edges.unionByName(each.join(of_fp.where("n > 1"), "fp").select(F.col("key").alias("u"), F.col("first").alias("v")))
    labels = connected_components(edges, "u", "v", n)
    named = distinct.select("key", "least_id", "size").join(labels.select(F.col("node").alias("key"), "component"), "key")
    half = F.greatest(F.ceil(F.count("*") / F.lit(tile // 2)), F.ceil(F.sum("size") / F.lit(SHINGLES // 2)))
    one = (F.count("*") <= tile) & (F.sum("size") <= SHINGLES)
    members = named.groupBy("component").agg(F.when(one, 1).otherwise(half).cast("int").alias("chunks"))
    met = written(named.join(members, "component").select("component", "chunks", "key", "least_id").coalesce(files(n)))
    # texts are read where they lie, if Spark finds the table of ids small enough to broadcast
    ids = written(met.select(F.col("least_id").alias("id")).distinct().coalesce(files(n)))
    read = rows.join(ids, "id", "left_semi").mapInArrow(made(True), "key long, shingles binary")
    tiled = met.withColumn("c", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    tiled = tiled.join(read.dropDuplicates(["key"]), "key").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = tiled.select("component", F.least("c", "o").alias("low"), F.greatest("c", "o").alias("high"), "key", "shingles")

    def verified(group: pa.Table) -> pa.Table:
        keys = group["key"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        edges = np.array(similar_forest(sets, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(keys[edges[:, 0]]), "b": pa.array(keys[edges[:, 1]])})

    similar = connected_components(tiled.groupBy("component", "low", "high").applyInArrow(verified, "a long, b long"), "a", "b", n)
    joined = distinct.select("key", "least_id").join(similar.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return own.select("id", "key").join(joined.join(lowest, "component").select("key", "component_id"), "key").select(F.col("id").alias(id_col), "component_id")


def one_of_near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """one_of_each() by near_copies()."""
    return _lowest_rows(df, near_copies(df, id_col=id_col, text_col=text_col, **how), id_col)
