"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a shuffled order, are cut into blocks of ``block`` documents.  Weights are taken as the
fractions they are written as, and become whole units without rounding; their sum is a period A.  The j-th block
of a source of ``a`` units is released at floor((j - 1) A / a) and due at ceil(j A / a); earliest deadline first
takes one released block a slot, and no block is late, so at each slot every source is less than one block from its
target.  The schedule repeats with the period, so one period at most is simulated; when a source runs out, the rest
go on under their renormalised weights.

The driver holds one row per source and the simulated slots, which are bounded by ``MOST_SLOTS``: weights that need
more (by a period of their own, longer than the sources last) are refused, as are weights that are not above zero.
Documents are numbered by hash ranges within their source, so a source with a third of all rows spreads over all
tasks, and find their slot in their source's row of the schedule.  Every row is placed once.  Null sources are a
source of their own; sources without a weight have ``default``; weights of sources that are not there are ignored;
an empty table gives an empty result; equal rows are placed one after the other; null and empty texts count like
others.  Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_buckets, staged

#: Sources and simulated slots beyond which the schedule would not fit the driver and a broadcast (an error).
MOST_SOURCES, MOST_SLOTS = 1000, 2_000_000


def units_of(weights: dict[str, float]) -> dict[str, int]:
    """The least whole numbers in the weights' proportions; a weight is the fraction it is written as."""
    shares = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if any(w <= 0 for w in shares.values()):
        raise ValueError("weights must be above zero")
    scale = math.lcm(*(w.denominator for w in shares.values()))
    whole = {s: int(w * scale) for s, w in shares.items()}
    part = math.gcd(*whole.values()) or 1
    return {s: w // part for s, w in whole.items()}


def stretch(units: dict[str, int], left: dict[str, int], most: int) -> tuple[dict[str, list[int]], bool]:
    """Slots of each source's blocks by earliest deadline first, until a source is out or (True) for a whole period."""
    total = sum(units.values())
    waiting = [(0, s, 1) for s in sorted(units)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in units}
    now = 0
    while now < total:
        while waiting and waiting[0][0] <= now:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // units[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if now >= due:
            raise AssertionError("a block is late")
        if now >= most:
            raise ValueError(f"the schedule needs more than {MOST_SLOTS} slots; take weights with a shorter period")
        slots[s].append(now)
        now += 1
        if j == left[s]:
            return slots, now == total
        if j < units[s]:
            heapq.heappush(waiting, (j * total // units[s], s, j + 1))
    return slots, True


def schedule(blocks: dict[str, int], weights: dict[str, float], default: float = 1) -> list[tuple]:
    """(source, first block, past the last, units, period, first slot, slots in a period) of each stretch between exhaustions."""
    share = {s: weights.get(s, default) for s, n in blocks.items() if n}
    left, done, start, used, out = dict(blocks), dict.fromkeys(blocks, 0), 0, 0, []
    while share:
        units = units_of(share)
        slots, whole = stretch(units, left, MOST_SLOTS - used)
        used, total = used + sum(map(len, slots.values())), sum(units.values())
        if whole:
            end = min((left[s] - 1) // a * total + slots[s][(left[s] - 1) % a] for s, a in units.items()) + 1
            taken = {s: end // total * a + bisect.bisect_left(slots[s], end % total) for s, a in units.items()}
        else:
            end, taken = sum(map(len, slots.values())), {s: len(x) for s, x in slots.items()}
        for s, n in taken.items():
            if n:
                out.append((s, done[s], done[s] + n, units[s], total, start, slots[s]))
            done[s], left[s] = done[s] + n, left[s] - n
            if not left[s]:
                del share[s]
        start += end
    return out


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = 64, *keep: str, default: float = 1) -> DataFrame:
    """Per row: the columns ``keep``, source, block, slot, position.  Without weights all sources weigh the same."""
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    order = F.xxhash64(F.lit(42), "doc_id")
    n = n_buckets(docs.select(F.lit(1000).alias("weight")), "weight")
    # Hash ranges: the higher half of the hash, scaled to n.
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col("doc_id").alias("_id"), name.alias("_s"), order.alias("_h"))
    rows = rows.withColumn("_b", F.shiftright((F.shiftright("_h", 32) + F.lit(1 << 31)) * F.lit(n), 32))
    counts = staged(rows.groupBy("_s", "_b").agg(F.count("*").alias("n")))
    sizes = {r["_s"]: r["n"] for r in counts.groupBy("_s").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    named = {f"={s}" if s is not None else "": w for s, w in (weights or {}).items()}
    plan = schedule({s: -(-m // block) for s, m in sizes.items()}, named, default)
    # One row a source: its stretches in order.  What isn't repeated needs no period.
    listed: dict[str, list] = {s: [] for s in sizes}
    for s, a, b, u, p, at, slots in plan:
        listed[s].append((a, len(slots), 0 if b - a <= len(slots) else p, at, slots))
    table = spark.createDataFrame([(s, x) for s, x in listed.items()] or [("", [])], "_s string, _plan array<struct<first:bigint,units:bigint,period:bigint,start:bigint,slots:array<bigint>>>")
    # The last block of a source may be short: rows missing before a slot.
    short = []
    for s, m in sizes.items():
        if m % block:
            _, a, b, u, p, at, slots = next(x for x in plan if x[0] == s and x[2] == -(-m // block))
            short.append((at + (b - 1 - a) // u * p + slots[(b - 1 - a) % u], block - m % block))
    before = counts.select("_s", "_b", F.coalesce(F.sum("n").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", "_id")))
    placed = ranked.join(before, ["_s", "_b"]).withColumn("_at", F.col("_before") + F.col("_r") - 1).withColumn("_block", F.expr(f"_at div {block}"))
    # Blocks to slots: the last stretch of the source that starts at or before the block.
    told = placed.join(F.broadcast(table), "_s").withColumn("_n", F.size(F.filter("_plan", lambda x: x["first"] <= F.col("_block"))))
    told = told.withColumn("_step", F.get("_plan", F.col("_n") - 1)).withColumn("_j", F.col("_block") - F.col("_step.first"))
    found = told.withColumn("slot", F.expr("_step.start + (_j div _step.units) * _step.period + get(_step.slots, int(_j % _step.units))")).drop("_plan", "_step")
    missing = F.expr("cast(array() as array<struct<at:bigint,n:bigint>>)") if not short else F.array(*(F.struct(F.lit(a).cast("long").alias("at"), F.lit(m).cast("long").alias("n")) for a, m in short))
    gap = F.aggregate(F.filter(missing, lambda x: x["at"] < F.col("slot")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    source = F.when(F.col("_s") != "", F.substring("_s", 2, 1 << 30)).alias("source")
    return found.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), source, F.col("_block").alias("block"), "slot", (F.col("slot") * block + F.expr(f"_at % {block}") - gap).alias("position"))


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = 64, default: float = 1) -> DataFrame:
    """All rows of ``docs``, dealt out and sorted by their place in the mix: written as files, they are read in that order."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "source")
    placed = mix_sources(whole, weights, block, "row", default=default)
    n = n_buckets(docs.select(F.octet_length(F.coalesce("text", F.lit(""))).alias("size")), "size")
    return placed.repartitionByRange(n, "position").sortWithinPartitions("position").select("row.*")
