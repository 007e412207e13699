"""Pairs of products that share a block, judged as matrices.

Each product is filed under what a pair must share: its brand, or whole gaps of its sizes. A block's products are dealt into
parts, and each two parts of a block are one unit of work, so a large block is many tasks. In a unit products of one shop,
brand and sizes are one class: whether two may pair is asked once for two classes, and each pair comes up in one unit
only, so nothing is sorted or made distinct afterwards. Products that are alike in all that counts may come as one row (ids). Sums over the words of both sides are bilinear: they are
looked up in a matrix of words by words, once for products alike in what is compared. Pairs leave Python as lists: products that
are compared alike, those that they all meet, and what measures give of these; Spark's generated code makes the rows of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from ..workers import tell_home
from .components import connected_components
from .measures import Measure

#: Products of a part; pairs that are compared at once; numbers of a batch at least; products of a row at most.
PART, CELLS, ROWS, ALIKE = 8192, 1 << 17, 1 << 16, 256
#: Products of a list of those that are compared alike, and of a list of those that they meet, at most.
HIGH, WIDE = 16, 1024
#: Products of a part where few pairs stay, as those must share a band of their signatures; pairs that are looked at there at once.
GATED, NEAR = 65536, 1 << 20
#: Products that one task takes as a whole, at most; tasks at most for such groups.
GROUP, TASKS = 65536, 512


@dataclass(frozen=True)
class Rule:
    """Which pairs stay. shop: True, one shop's name holds the other's; False, neither does or one is unknown. brand: "same" (and
    known), "like" (not known to differ), "other". size: "like", two sizes within the gap; "other", none. None: any.
    bands: so many, of so many numbers each, of which a pair's signatures (bytes, by blocking.packed) must share one; numbers: of a signature."""

    shop: bool | None = None
    brand: str | None = None
    size: str | None = None
    gap: float = 1.0
    bands: tuple[int, int] | None = None
    numbers: int = 0

    @property
    def part(self) -> int:
        return GATED if self.bands else PART


def _rows(own: DataFrame, rule: Rule, measure: Measure | None, *more: str) -> DataFrame:
    """own as far as pairs need it: rows of ids, some at most, named by the first (product_id)."""
    ids = F.col("ids") if "ids" in own.columns else F.array("product_id")
    few = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / ALIKE).cast("int")), lambda k: F.slice("ids", k * ALIKE + 1, ALIKE))
    found = own.select(ids.alias("ids"), "shop", "brand", "sizes", *(["signature"] if rule.bands else []), *(measure.columns() if measure else []), *more).where("size(ids) > 0").withColumn("ids", F.explode(few))
    return found.withColumn("product_id", F.col("ids")[0])


def _parts(filed: DataFrame, size: int) -> DataFrame:
    """filed (block, ids, ...) in units: block, i, j, and the part that a row is of."""
    big = filed.groupBy("block").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > size)  # few: at most one for as many rows as a part has
    m = F.coalesce(F.ceil(F.col("n") / size), F.lit(1))
    dealt = filed.join(F.broadcast(big), "block", "left").withColumn("m", m).withColumn("part", F.pmod(F.xxhash64("product_id"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)))
    return dealt.withColumn("i", F.least("part", "q")).withColumn("j", F.greatest("part", "q")).drop("n", "m", "q").withColumn("side", F.lit(0))


def _one_size(own: DataFrame, gap: float) -> DataFrame:
    """own filed by whole gaps: each in those of its sizes, and in the gap before where that has a size near enough."""
    cells = F.array_distinct(F.transform("sizes", lambda s: F.floor(s / gap)))
    tops = own.select(F.explode("sizes").alias("s")).groupBy(F.floor(F.col("s") / gap).alias("k")).agg(F.max("s").alias("top"))
    near = tops.alias("x").join(own.select(F.explode("sizes").alias("s")).distinct().alias("y"), F.col("x.k") == F.floor(F.col("y.s") / gap) - 1)
    near = near.where("abs(y.s - x.top) < %r" % float(gap)).select(F.col("y.s").alias("s"), F.col("x.k").alias("k")).distinct()
    low = own.select(F.explode(cells).alias("k"), "*")
    high = own.select("product_id", F.explode(F.array_distinct("sizes")).alias("s")).join(near, "s").select("product_id", "k").distinct()
    high = own.join(high, "product_id").where(~F.array_contains(cells, F.col("k"))).select("k", *own.columns)
    return low.unionByName(high).withColumn("block", F.col("k").cast("string")).drop("k")


def _one_brand(own: DataFrame, loose: bool, size: int) -> DataFrame:
    """Units of one known brand; loose: and those of products without brand (side 1) with all (side 2)."""
    known = _parts(own.where("brand is not null").withColumn("block", F.concat(F.lit("b"), "brand")), size)
    if not loose:
        return known
    none = own.where("brand is null")
    ml, mr = (max(1, -(-(d.agg(F.sum(F.size("ids"))).first()[0] or 0) // size)) for d in (none, own))
    part = lambda m: F.pmod(F.xxhash64("product_id"), F.lit(m)).cast("int")
    left = none.withColumn("part", part(ml)).withColumn("i", F.col("part")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(mr - 1)))).withColumn("side", F.lit(1))
    right = own.withColumn("part", part(mr)).withColumn("j", F.col("part")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(ml - 1)))).withColumn("side", F.lit(2))
    return known.unionByName(left.unionByName(right).withColumn("block", F.lit("any")))


def by_size(own: DataFrame, rule: Rule, measure: Measure | None = None) -> DataFrame:
    """(id_a, id_b, and what measure gives) of products that have sizes within the gap and pass the rule. id_a < id_b, each pair once."""
    own = _rows(own, rule, measure)
    return _compared(_parts(_one_size(own, rule.gap), rule.part), rule, measure, True)


def by_brand(own: DataFrame, rule: Rule, measure: Measure | None = None) -> DataFrame:
    """The same of products of one brand, and unless the rule says "same" of those that have none with all."""
    own = _rows(own, rule, measure)
    return _compared(_one_brand(own, rule.brand != "same", rule.part), rule, measure, False)


def by_group(own: DataFrame, rule: Rule, measure: Measure, run: Callable[[Whole], Iterator[pa.RecordBatch]], schema: str) -> tuple[DataFrame, DataFrame | None]:
    """What run gives of each group of products that share sizes with no other, as far as groups are no larger than GROUP; and the
    rows of own that are in larger ones, if any."""
    spark = own.sparkSession
    tell_home(spark)
    filed = _one_size(own.select("product_id", "sizes"), rule.gap).select("product_id", F.col("block").cast("long").alias("k"))
    cells = written(filed.groupBy("product_id").agg(F.min("k").alias("k"), F.collect_set("k").alias("others")))
    known = connected_components(cells.select(F.col("k").alias("id_a"), F.explode("others").alias("id_b")).where("id_a <> id_b"))
    grouped = cells.select("product_id", "k").join(known.hint("merge"), F.col("k") == F.col("node"), "left").select("product_id", F.coalesce("component", "k").alias("group"))
    grouped = own.join(grouped.hint("merge"), "product_id")  # small as a file only: products with all their words would be broadcast
    rows = written(_rows(grouped, rule, measure, "group"))
    sizes = rows.groupBy("group").agg(F.sum(F.size("ids")).alias("n"))
    n, big = sizes.agg(F.count("*"), F.count(F.when(F.col("n") > GROUP, 1))).first()
    over = F.broadcast(sizes.where(F.col("n") > GROUP).select("group"))  # few: at most one for as many rows as a group has
    small = rows.join(over, "group", "left_anti") if big else rows
    dealt = small.withColumn("unit", F.col("group").cast("string")).withColumns({c: F.lit(0) for c in ("i", "j", "part", "side")})
    dealt = dealt.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * n, TASKS)), "unit").sortWithinPartitions("unit")
    like = replace(rule, size="like")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            yield from run(Whole(table, like, measure, False))

    return dealt.mapInArrow(each, schema), grouped.join(over, "group").drop("group") if big else None


def _compared(units: DataFrame, rule: Rule, measure: Measure | None, sized: bool) -> DataFrame:
    """Units are few bytes and much work, so they are dealt out by number, which Spark does not undo for their size."""
    spark = units.sparkSession
    tell_home(spark)
    dealt = units.withColumn("unit", F.concat_ws("/", "block", "i", "j"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for table in _units(batches):
            for lists in _Unit(table, rule, measure, sized).pairs():
                held.append(lists)
                n += len(lists.b)
                if n >= ROWS:
                    yield _batch(held, names)
                    held, n = [], 0
        if held:
            yield _batch(held, names)

    names = measure.names() if measure else []
    values = [c.split() for c in measure.schema().split(", ")] if measure else []
    lists = dealt.mapInArrow(run, "a array<bigint>, b array<bigint>, ordered boolean" + "".join(f", {c} array<{kind}>" for c, kind in values))
    one = lists.select(F.explode("a").alias("x"), "b", "ordered", *names)
    met = one.select("x", "ordered", *names, F.posexplode("b").alias("at", "y")).where("not ordered or x < y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), *[F.get(c, F.col("at")).alias(c) for c in names])


@dataclass(frozen=True)
class _Lists:
    """Lists a (ids and lengths), lists b that each of an a's meets, and values of each of b; ordered: of pairs only those that begin with the smaller id."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    values: list[np.ndarray]
    ordered: bool


def _batch(held: list[_Lists], names: list[str]) -> pa.RecordBatch:
    def lists(flat: list[np.ndarray], n: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(n))], pa.int32()), pa.array(np.concatenate(flat)))

    n_b = [h.n_b for h in held]
    columns = [lists([h.a for h in held], [h.n_a for h in held]), lists([h.b for h in held], n_b), pa.array(np.repeat([h.ordered for h in held], list(map(len, n_b))))]
    columns += [lists([h.values[k] for h in held], n_b) for k in range(len(names))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "ordered", *names])


def _cut(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths n cut into pieces of `most` at most: of each piece which it is of, and its length."""
    pieces = -(-n // most)
    of = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return of, np.minimum(n[of] - k * most, most)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit; rows come sorted by unit."""
    key, held = None, []
    for batch in batches:
        unit = batch.column(batch.schema.get_field_index("unit")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for at, end in zip(cuts, cuts[1:]):
            if at == end:
                continue
            if held and unit[at] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = unit[at]
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def _codes(values: list) -> tuple[np.ndarray, list]:
    known: dict = {}
    codes = np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64, len(values))
    return codes, list(known)


class _Unit:
    """Two parts of a block (or one with itself), and the pairs of their products."""

    def __init__(self, table: pa.Table, rule: Rule, measure: Measure | None, sized: bool) -> None:
        self.rule, self.sized = rule, sized
        self.block = int(table["block"][0].as_py()) if sized else None
        lists = table["ids"].combine_chunks()
        self.ids = lists.flatten().to_numpy()
        each = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
        shop, self.shops = _codes(table["shop"].to_pylist())
        brand, brands = _codes(table["brand"].to_pylist())
        size, sizes = _codes([tuple(s or ()) for s in table["sizes"].to_pylist()])
        brand = np.where(brand == (brands.index(None) if None in brands else -1), -1, brand)
        width = max([1, *map(len, sizes)])
        self.sizes = np.array([[np.nan if x is None else x for x in s] + [np.nan] * (width - len(s)) for s in sizes], float).reshape(len(sizes), width)
        shop, brand, size = shop[each], brand[each], size[each]
        order = np.lexsort((each, size, brand, shop))
        keys = np.stack([shop, brand, size], 1)[order]
        new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
        self.classes = keys[new]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.order = order
        self.measured = measure.of(table, each) if measure else None
        self.each, self.n = each, lists.value_lengths().to_numpy().astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.n)[:-1]]
        if rule.bands:
            self._signatures(table)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        side, part = table["side"].to_numpy()[each], table["part"].to_numpy()[each]
        self.across = bool(side[0])
        self.within = not self.across and i == j
        if self.across:
            self.left, self.right = order[side[order] == 1], order[side[order] == 2]
        elif self.within:
            self.left = self.right = order
        else:
            self.left, self.right = order[part[order] == i], order[part[order] == j]
        self.holds: dict[int, np.ndarray] = {}

    def may(self, c: int) -> np.ndarray:
        """Of each class whether its products may pair with those of class c."""
        shop, brand, size = self.classes[c]
        shops, brands, sizes = self.classes.T
        rule, ok = self.rule, np.ones(len(self.classes), bool)
        if rule.shop is not None:
            if shop not in self.holds:
                own = self.shops[shop]
                self.holds[shop] = np.array([own is not None and s is not None and (own in s or s in own) for s in self.shops])
            ok &= self.holds[shop][shops] == rule.shop
        if rule.brand:
            known = (brands >= 0) & (brand >= 0)
            ok &= known & (brands == brand) if rule.brand == "same" else known & (brands != brand) if rule.brand == "other" else ~known | (brands == brand)
        if rule.size or self.sized:
            like, home = self.like(size)
            if self.sized:
                ok &= (home == self.block)[sizes]
            if rule.size:
                ok &= like[sizes] == (rule.size == "like")
        return ok

    def like(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each size whether it is within the gap, and the first block in which the two then meet."""
        gap = self.rule.gap
        home = np.full(len(self.sizes), np.inf)
        for x in self.sizes[size]:
            for y in self.sizes.T:
                home = np.where(np.abs(x - y) < gap, np.fmin(home, np.floor(np.fmin(x, y) / gap)), home)
        return home < np.inf, home

    def pairs(self) -> Iterator[_Lists]:
        of_left, of_right = self.of[self.left], self.of[self.right]
        known = self.classes[:, 1] >= 0
        starts = np.flatnonzero(np.r_[True, of_left[1:] != of_left[:-1]]) if len(of_left) else np.zeros(0, np.int64)
        for at, end in zip(starts, [*starts[1:], len(of_left)]):
            c, own = of_left[at], self.left[at:end]
            ok = self.may(c)
            if self.within:
                if ok[c]:
                    yield from self.met(own, own, True)
                yield from self.met(own, self.right[ok[of_right] & (of_right > c)], False)
            elif self.across:
                yield from self.met(own, self.right[(ok & known)[of_right]], False)
                yield from self.met(own, self.right[(ok & ~known)[of_right]], True)
            else:
                yield from self.met(own, self.right[ok[of_right]], False)

    def met(self, a: np.ndarray, b: np.ndarray, ordered: bool) -> Iterator[_Lists]:
        """All pairs of a and b; ordered: of each only that which begins with the smaller id."""
        if not len(a) or not len(b):
            return
        if self.rule.bands:
            yield from self.gated(np.unique(self.each[a]), np.unique(self.each[b]), ordered)
            return
        if self.measured:
            a = a[np.argsort(self.measured.of[a], kind="stable")]
            own = self.measured.of[a]
            n = np.diff(np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(a)])
        else:
            n = np.array([len(a)])
        n = _cut(n, HIGH)[1]
        end = np.cumsum(n)
        start = end - n
        for k in range(0, len(b), CELLS):
            y = b[k : k + CELLS]
            wide = _cut(np.array([len(y)]), WIDE)[1]
            high = max(1, CELLS // len(y))
            for h in range(0, len(n), high):
                few, at = n[h : h + high], start[h : h + high]
                x = self.ids[a[at[0] : end[h : h + high][-1]]]
                if len(wide) > 1:
                    of = np.repeat(np.arange(len(few)), len(wide))
                    x = x[_spans(at[of] - at[0], few[of])]
                values = [v.ravel() for v in self.measured.values(a[at], y)] if self.measured else []
                yield _Lists(x, np.repeat(few, len(wide)), np.tile(self.ids[y], len(few)), np.tile(wide, len(few)), values, ordered)

    def _signatures(self, table: pa.Table) -> None:
        """Distinct signatures, which of them each row has, and the rows of each; by band, those that share it with others, by their code."""
        b, r = self.rule.bands
        self.signature, made = _codes(table["signature"].to_pylist())
        width = len(made[0]) // max(self.rule.numbers, 1)
        flat = np.frombuffer(b"".join(made), np.uint8).reshape(len(made), -1)
        self.bands = []
        for k in range(b):
            part = np.ascontiguousarray(flat[:, k * r * width : (k + 1) * r * width])
            code = np.unique(part.view(f"V{part.shape[1]}").ravel(), return_inverse=True)[1] if part.shape[1] else np.zeros(len(made), np.int64)
            n = np.bincount(code)
            self.bands.append((np.where(n[code] > 1, code, -1), np.argsort(code, kind="stable"), np.cumsum(n) - n, n))
        self.by_signature = np.argsort(self.signature, kind="stable")
        self.n_of = np.bincount(self.signature)
        self.first_of = np.cumsum(self.n_of) - self.n_of

    def _near(self, some: np.ndarray) -> np.ndarray:
        """Of some signatures which others share a band with them, and themselves."""
        near = np.zeros((len(some), len(self.n_of)), bool)
        near[np.arange(len(some)), some] = True
        for number, members, start, n in self.bands:
            code = number[some]
            own = np.flatnonzero(code >= 0)
            if len(own):
                size = n[code[own]]
                near[np.repeat(own, size), members[_spans(start[code[own]], size)]] = True
        return near

    def gated(self, rows: np.ndarray, others: np.ndarray, ordered: bool) -> Iterator[_Lists]:
        """The same of rows of products alike: of those that share a band, which is asked once for two signatures."""
        may = np.zeros(len(self.n), bool)
        may[others] = True
        meant = np.zeros(len(self.n_of), bool)
        meant[self.signature[others]] = True
        rows = rows[np.argsort(self.signature[rows], kind="stable")]
        known, of = np.unique(self.signature[rows], return_inverse=True)
        step = max(1, NEAR // len(meant))
        for at in range(0, len(known), step):
            few = known[at : at + step]
            i, near = np.nonzero(self._near(few) & meant)
            n = np.bincount(i, minlength=len(few))
            start, reach = np.cumsum(n) - n, np.bincount(i, self.n_of[near], len(few)).astype(np.int64)
            low, high = np.searchsorted(of, [at, at + step])
            yield from self._gated(rows[low:high], of[low:high] - at, near, start, n, reach, may, ordered)

    def _gated(self, rows: np.ndarray, of: np.ndarray, near: np.ndarray, start: np.ndarray, n: np.ndarray, reach: np.ndarray, may: np.ndarray, ordered: bool) -> Iterator[_Lists]:
        """Pairs of rows, each of a signature (of) that is near to some."""
        cuts = np.flatnonzero(np.diff(np.cumsum(reach[of]) // NEAR, prepend=-1))
        for at, end in zip(cuts, [*cuts[1:], len(rows)]):
            own = of[at:end]
            met = near[_spans(start[own], n[own])]
            x = np.repeat(np.repeat(rows[at:end], n[own]), self.n_of[met])
            y = self.by_signature[_spans(self.first_of[met], self.n_of[met])]
            i, j = x[may[y]], y[may[y]]
            if not len(i):
                continue
            values = self.measured.paired(self.start[i], self.start[j]) if self.measured else []
            #: Pairs of rows follow each other by i; a list ends with its i, or where it would make too many rows.
            made = np.cumsum(self.n[i] * self.n[j])
            piece = (made - 1) // (HIGH * WIDE)
            first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (piece[1:] != piece[:-1])])
            own = i[first]
            yield _Lists(
                self.ids[_spans(self.start[own], self.n[own])], self.n[own], self.ids[_spans(self.start[j], self.n[j])], np.add.reduceat(self.n[j], first),
                [np.repeat(v, self.n[j]) for v in values], ordered,
            )


class Whole(_Unit):
    """All products of a group, each row once."""

    cells = CELLS


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start, n of each."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
