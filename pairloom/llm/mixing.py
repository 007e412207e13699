"""Mixing sources to target weights by Pfair scheduling.

Only DataFrame functions. Documents of a source stand in the order of a hash, in blocks of equal count; a block is
due in the mix by its source's weight: block i (from 0) of weight w is released at slot floor(i / w) and due before
slot ceil((i + 1) / w). Earliest deadline first among the released keeps every source within one block of its share.

With whole shares q of D slots the schedule repeats every D slots, so one period of each phase is planned, from
one count a source, and any block finds its slot by arithmetic. A phase ends when a source runs out; the others go
on by the same weights among themselves. Nothing is dropped or repeated.

The driver plans for the sources of the largest weights, of which there is a bounded number. All others, however many,
are one group in that plan, with the sum of their weights; Spark sorts the group's blocks by their deadlines within it.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import checkpointed

#: Documents of a block; slots of the first period; sources that the driver plans for one by one.
BLOCK, PERIOD, SOURCES = 8, 1000, 512
#: Rows ranked in one window, about; with more rows in all their square root, so that windows are no more than that.
RANKED = 2000
#: Times that many rows of one bucket that part it by what they hold.
CROWD = 8


def whole_shares(weights: list[float], period: int) -> list[int]:
    """Positive whole numbers that add up to the period (or to the number of weights, if larger), by largest remainder."""
    period = max(period, len(weights))
    total = sum(weights)
    exact = [w / total * period for w in weights]
    out = [max(1, int(x)) for x in exact]
    while sum(out) < period:
        k = max(range(len(out)), key=lambda k: (exact[k] - out[k], -k))
        out[k] += 1
    while sum(out) > period:
        k = max((k for k in range(len(out)) if out[k] > 1), key=lambda k: (out[k] - exact[k], -k))
        out[k] -= 1
    return out


def edf_period(shares: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one period of sum(shares) slots, earliest deadline first."""
    period = sum(shares)
    waiting = [(0, k) for k in range(len(shares))]  # by release
    heapify(waiting)
    ready: list[tuple[int, int]] = []
    out: list[list[int]] = [[] for _ in shares]
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k = heappop(waiting)
            heappush(ready, (-(-(len(out[k]) + 1) * period // shares[k]), k))
        _, k = heappop(ready)
        out[k].append(slot)
        if len(out[k]) < shares[k]:
            heappush(waiting, (len(out[k]) * period // shares[k], k))
    return out


def phases(blocks: list[int], shares: list[int]) -> list[list[dict]]:
    """For each source its phases: from block `first` on, block j of the phase lies at base + j div q * period + slots[j mod q]."""
    left, out, base = list(blocks), [[] for _ in blocks], 0
    while any(left):
        active = [k for k in range(len(left)) if left[k]]
        slots = edf_period([shares[k] for k in active])
        period = sum(shares[k] for k in active)
        ends = [(left[k] - 1) // shares[k] * period + slots[a][(left[k] - 1) % shares[k]] for a, k in enumerate(active)]
        length = min(ends) + 1
        for a, k in enumerate(active):
            out[k].append({"first": blocks[k] - left[k], "base": base, "period": period, "slots": slots[a]})
            left[k] -= length // period * shares[k] + sum(s < length % period for s in slots[a])
        base += length
    return out


def mixed(df: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int = PERIOD, seed: int = 11, smoothing: float = 0.5, planned: int = SOURCES) -> DataFrame:
    """df with block (of its source, from 0), slot (of that block in the mix, from 0) and place (in the block).

    weights: positive numbers by source, for every source of df; by default a source's count to the power
    `smoothing`. They count as multiples of 1/period. Up to each slot a source has its share of the slots since its
    phase began, less than one block more or less. Of more than `planned` sources those beyond the largest `planned` - 1
    weights are one group, which keeps its share like a source; within it, up to each of the group's blocks, a source has
    its share of them within one block and its weight's part of as many blocks as the group has sources.

    A null source is a source, named "" in weights. Ids and the other columns only settle the order, so nulls and
    repeated rows are as good as any. All columns of df stay; those named __* and block, slot and place are this
    function's. An empty table gives no rows.
    """
    spark = df.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = df.groupBy(source.alias("__source")).agg(F.count("*").alias("__n"))
    if weights is None:
        counts = counts.withColumn("__weight", F.pow("__n", F.lit(smoothing)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0] or [("", 0.0)], "__source string, __weight double").where("__weight > 0")
        counts = counts.join(given, "__source", "left")
    counts = checkpointed(counts.withColumn("__blocks", F.ceil(F.col("__n") / block)))
    if missing := counts.where("__weight is null").limit(10).collect():
        raise ValueError(f"no positive weight for {sorted(r['__source'] for r in missing)}")
    total, of = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count("*")).first()
    largest = counts.orderBy(F.desc("__weight"), "__source").limit(planned if of <= planned else planned - 1)
    heads = sorted((r["__source"], r["__blocks"], r["__weight"]) for r in largest.collect())
    tail = counts.join(spark.createDataFrame([(h[0],) for h in heads], "__source string"), "__source", "left_anti") if of > planned else None
    if tail is not None:
        heads.append((None, *tail.agg(F.sum("__blocks"), F.sum("__weight")).first()))
    plan = phases([h[1] for h in heads], whole_shares([h[2] for h in heads], period) if heads else [])
    kind = "array<struct<s:string,phases:array<struct<first:bigint,base:bigint,period:bigint,slots:array<int>>>>>"
    rows = F.from_json(F.lit(json.dumps([{"s": h[0], "phases": p} for h, p in zip(heads, plan, strict=True)])), kind)
    # at most `planned` rows of at most `planned` * period slots in all
    schedule = spark.range(1).select(F.explode(rows).alias("x")).select(F.col("x.s").alias("__plan"), F.col("x.phases").alias("__phases"))
    bits = max(1, (total // max(RANKED, isqrt(total))).bit_length())
    kept = [c for c in df.columns if c not in ("block", "slot", "place")]
    own = df.select(*kept).withColumn("__source", source).withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_col)))
    own = own.withColumn("__bucket", F.shiftrightunsigned("__hash", 64 - bits))
    # A source's rows are ranked bucket by bucket, so a large source is many windows. A bucket that a repeated or missing id
    # has filled is parted by what its rows hold.
    keys = ["__source", "__bucket", "__part"]
    tie = F.xxhash64(*[F.col(c) for c in kept if "map<" not in df.schema[c].dataType.simpleString()])
    sizes = checkpointed(own.groupBy("__source", "__bucket").agg(F.count("*").alias("__n")))
    crowded = sizes.where(F.col("__n") > CROWD * RANKED)
    if crowded.isEmpty():
        own, sizes = own.withColumn("__part", F.lit(0)), sizes.withColumn("__part", F.lit(0))
    else:
        parts = crowded.select("__source", "__bucket", F.expr(f"__n div {RANKED}").alias("__parts"))
        own = own.join(parts, ["__source", "__bucket"], "left").withColumn("__part", F.coalesce(F.pmod(tie, F.col("__parts")), F.lit(0))).drop("__parts")
        sizes = own.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = sizes.selectExpr(*keys, "sum(__n) over (partition by __source order by __bucket, __part) - __n as __before")
    ranked = own.withColumn("__tie", tie).join(before, keys)
    ranked = ranked.selectExpr("*", "__before + row_number() over (partition by __source, __bucket, __part order by __hash, __tie) - 1 as __rank")
    placed = ranked.withColumn("block", F.expr(f"__rank div {block}")).withColumn("place", F.expr(f"cast(__rank % {block} as int)"))
    placed = placed.select(*kept, "__source", "block", "place")
    if tail is None:
        placed = placed.withColumn("__plan", F.col("__source")).withColumn("__at", F.col("block"))
    else:
        # by deadline, the smaller weight first of equal ones, as it is due less often
        of_group = tail.select("__source", "__weight", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("block"))
        due = of_group.withColumn("__due", (F.col("block") + 1) / F.col("__weight"))
        at = numbered(due, "__due", "__weight", "__source", name="__ordinal").select("__source", "block", "__ordinal", F.lit(True).alias("__grouped"))
        placed = placed.join(at, ["__source", "block"], "left")
        placed = placed.withColumn("__plan", F.when(F.col("__grouped"), F.lit(None)).otherwise(F.col("__source"))).withColumn("__at", F.coalesce("__ordinal", "block"))
    placed = placed.join(F.broadcast(schedule.withColumnRenamed("__plan", "__planned")), F.expr("__plan <=> __planned"))
    placed = placed.withColumn("__phase", F.expr("element_at(filter(__phases, p -> p.first <= __at), -1)"))
    slot = "__phase.base + (__at - __phase.first) div size(__phase.slots) * __phase.period + element_at(__phase.slots, cast((__at - __phase.first) % size(__phase.slots) as int) + 1)"
    return placed.withColumn("slot", F.expr(slot)).select(*kept, "block", "slot", "place")


def in_mix_order(df: DataFrame, weights: dict[str, float] | None = None, **how) -> DataFrame:
    """All rows of df in the order of the mix, in df's columns: sorted over all partitions, so files read in order are the mix."""
    light = ["block", "slot", "place"]
    back = {c: f"__own_{c}" for c in light if c in df.columns}
    out = mixed(df.withColumnsRenamed(back), weights, **how).sort("slot", "place").drop(*light)
    return out.withColumnsRenamed({v: k for k, v in back.items()}).select(*df.columns)
