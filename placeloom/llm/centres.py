"""Links within dense groups of near copies, exactly and without comparing all with all.

A large node of near copies gets a centre: the shingles that most of a sample's densest part hold.  A set that
lacks r of the centre's c shingles and has a more is u = den r + num a off (for a similarity of num / den).  Two
sets that share s of what sets them off are a link if u + v <= (den - num) c + (den + num) s.  So

* pairs with u + v <= (den - num) c are links without a test: they are counted from the group's histogram of u,
  and a spanning forest runs over the heads of its classes;
* pairs too far apart for any s are none;
* what lies between is compared by the differences alone, in blocks of ordered u, dealt pair by pair of blocks.

By the triangle inequality a set within the distance 1 - num / den of a centre has links only with sets within
twice that, so it may leave the centre's node, or all nodes if the centre has been held against all sets.  A pair with several common centres belongs to the least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, release
from .common import staged

#: Members of a large node whose sets make its centre (half as many at least, about).
SAMPLE = 64
#: What a block of members holds: at most so many differences, a member counting for ``LEAST`` of them at least.
BLOCK, LEAST = 1 << 16, 64
#: Rows and bytes up to which a table of centres or classes is broadcast.
FEW, LIGHT = 5_000, 16 << 20


def small(df: DataFrame) -> DataFrame:
    """The staged table, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _agreement(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sketches == one).mean(axis=-1)


def _densest(coordinates: int, close: float):
    """(sid, node) of the densest part of a node's sample, by the sketches; no row if no two of it are close."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("sid").to_numpy(), kind="stable")))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, coordinates)
        near = np.stack([_agreement(sketches, s) >= close for s in sketches])
        members = np.flatnonzero(near[int(near.sum(axis=1).argmax())])
        return table.select(["sid", "node"]).take(pa.array(members if len(members) > 1 else members[:0]))

    return run


def _centre(sketch_of):
    """(node, centre, size, sketch, set) of what most of a node's sets hold; no row if that is nothing."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        blobs = table.column("set").to_pylist()
        grams, held = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]), return_counts=True)
        grams = grams[2 * held > len(blobs)]
        if len(grams):
            sid, sketch = sketch_of(grams)
            out.append((table.column("node")[0].as_py(), sid, len(grams), sketch.tobytes(), grams.tobytes()))
        columns = list(zip(*out)) or [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("node", "centre", "c", "centre_sketch", "centre_set"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    return run


def _alike(coordinates: int, least: float):
    """(sid, node, centre) of the rows whose sketch agrees with the centre's often enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, coordinates) for i in (3, 4))
                yield batch.select([0, 1, 2]).filter(pa.array(_agreement(a, b) >= least))

    return run


def _differences(num: int, den: int):
    """(sid, centre, c, u, inner, differences) of the sets within twice the link distance of the centre."""

    def run(batches):
        for batch in batches:
            sids, centres, kept = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                lacks, more = len(y) - both, len(x) - both
                every = both + lacks + more
                if den * both >= (2 * num - den) * every:
                    kept.append((sids[i], centres[i], len(y), den * lacks + num * more, den * both >= num * every, np.setxor1d(x, y, assume_unique=True).tobytes()))
            columns = list(zip(*kept)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["sid", "centre", "c", "u", "inner", "differences"])
        release()

    return run


def _near_any(centres: np.ndarray, sketches: np.ndarray, least: float):
    """(sid, centre) of rows (sid, sketch) whose sketch agrees with a centre's often enough (once at least)."""
    coordinates = sketches.shape[1]
    place = np.arange(coordinates, dtype=np.uint64) << np.uint64(32)
    held = (place | sketches).ravel()
    order = np.argsort(held, kind="stable")
    held, owner = held[order], order // coordinates

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sids = batch.column(0).to_numpy(zero_copy_only=False)
            every = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
            for s in range(0, len(sids), 512):
                keys = (place | every[s : s + 512]).ravel()
                low = np.searchsorted(held, keys, "left")
                count = np.searchsorted(held, keys, "right") - low
                row = np.repeat(np.arange(len(keys)) // coordinates, count)
                hit = np.arange(len(row)) + np.repeat(low - (np.cumsum(count) - count), count)
                pairs, agree = np.unique(row * len(centres) + owner[hit], return_counts=True)
                pairs = pairs[agree >= least * coordinates]
                yield pa.RecordBatch.from_arrays([pa.array(sids[s + pairs // len(centres)]), pa.array(centres[pairs % len(centres)])], ["sid", "centre"])

    return run


def _least_near(num: int, den: int, coordinates: int) -> float:
    """The share of places in which sketches of sets within twice the link distance agree, five standard deviations off at most."""
    least = 2 * num / den - 1
    return max(0.0, least - 5 * np.sqrt(least * (1 - least) / coordinates)) if least > 0 else 0.0


def _centres(wide: DataFrame, sets_of, sketch_of, coordinates: int, close: float) -> DataFrame:
    """Staged (node, centre, c, centre_sketch, centre_set) of large nodes (sid, node, members, sketch)."""
    sample = wide.where(F.pmod(F.xxhash64("sid", "node"), F.ceil(F.col("members") / SAMPLE)) == 0)
    # By the sketches first: texts are read only for nodes that have a dense part, and of it.
    dense = staged(sample.select("sid", "node", "sketch").groupBy("node").applyInArrow(_densest(coordinates, close), "sid long, node long"))
    sets = sets_of(dense.withColumnRenamed("node", "to")).select(F.col("to").alias("node"), "set")
    return staged(sets.groupBy("node").applyInArrow(_centre(sketch_of), "node long, centre long, c long, centre_sketch binary, centre_set binary"))


def _measured(each: DataFrame, sets_of, centres: DataFrame, num: int, den: int) -> DataFrame:
    """Staged members of the groups, of (sid, centre) that may be within twice the link distance."""
    once = centres.groupBy(F.col("centre").alias("to")).agg(F.first("centre_set").alias("centre_set"))
    if (once.agg(F.sum(F.length("centre_set"))).first()[0] or 0) <= LIGHT:
        once = F.broadcast(once)
    # In the workers that make the sets: two workers a task would hold twice the memory.
    return staged(sets_of(each.withColumnRenamed("centre", "to"), once, _differences(num, den), "sid long, centre long, c long, u long, inner boolean, differences binary"))


def gather_all(reps: DataFrame, wide: DataFrame, sets_of, sketch_of, coordinates: int, num: int, den: int) -> DataFrame | None:
    """Members, among all ``reps``, of the groups around centres of large nodes; None if there are no centres.

    A member marked ``inner`` has no links but with members of its centre, so it need not be looked for elsewhere.
    """
    least = _least_near(num, den, coordinates)
    if not least:  # sketches tell nothing of sets so far apart
        return None
    centres = _centres(wide, sets_of, sketch_of, coordinates, 2 * num / den - 1)
    # At most two a run and ``LEAF`` sets: a few hundred bytes each.
    found = centres.select("centre", "centre_sketch").dropDuplicates(["centre"]).collect()
    if not found:
        return None
    numbers, sketches = np.array([r.centre for r in found], np.int64), np.stack([np.frombuffer(r.centre_sketch, np.uint32) for r in found])
    near = staged(reps.select("sid", "sketch").mapInArrow(_near_any(numbers, sketches, least), "sid long, centre long"))
    return _measured(near, sets_of, centres, num, den)


def gather(wide: DataFrame, sets_of, sketch_of, coordinates: int, num: int, den: int) -> tuple[DataFrame, DataFrame] | None:
    """Of large nodes, staged (sid, node, members, sketch): members of the groups, and rows (sid, node) that may leave.

    None if no node has a centre.
    """
    centres = _centres(wide, sets_of, sketch_of, coordinates, 2 * num / den - 1)
    if not centres.limit(1).count():
        return None
    near = wide.join(small(centres.select("node", "centre", "centre_sketch")), "node").select("sid", "node", "centre", "sketch", "centre_sketch")
    near = staged(near.mapInArrow(_alike(coordinates, _least_near(num, den, coordinates)), "sid long, node long, centre long"))
    each = near.select("sid", "centre").distinct()
    members = _measured(each, sets_of, centres, num, den)
    leave = near.join(members.where("inner").select("sid", "centre"), ["sid", "centre"]).select("sid", "node").distinct()
    return members, leave


def _plan(num: int, den: int):
    """Of a group's classes: links counted from the histogram, heads, blocks, and which blocks must meet."""

    def run(table: pa.Table) -> pa.Table:
        centre, c = table.column("centre")[0].as_py(), table.column("c")[0].as_py()
        limit = (den - num) * c
        order = np.argsort(table.column("u").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        u, n, weight = (table.column(x).to_numpy() for x in ("u", "n", "weight"))
        heads, lists = table.column("head").to_pylist(), [tuple(x) for x in table.column("centres").to_pylist()]
        names = {x: i for i, x in enumerate(dict.fromkeys(lists))}
        of = np.array([names[x] for x in lists])
        owned = np.array([[min(set(a) & set(b)) == centre for b in names] for a in names])
        links, to = np.zeros(len(u), np.int64), [[] for _ in range(len(u))]
        for b in range(len(names)):
            mine = np.flatnonzero(of == b)
            total = np.concatenate(([0], np.cumsum(weight[mine])))
            reach = np.where(owned[of, b], np.searchsorted(u[mine], limit - u, "right"), 0)
            links += total[reach]
            for i in np.flatnonzero(reach).tolist():
                to[i].append(heads[mine[0]])
        # Classes that have pairs to compare, in blocks by u.
        far = lambda i, j: (u[i] + u[j] > limit) & (u[i] + u[j] - (den + num) * (np.minimum(u[i], u[j]) // num) <= limit) & owned[of[i], of[j]]
        every = np.arange(len(u))
        open_ = np.array([bool(far(i, every).any()) for i in every])
        cost = n * np.maximum(LEAST, u // num)
        first, count, at, used = np.full(len(u), -1), np.zeros(len(u), np.int64), -1, BLOCK
        for i in np.flatnonzero(open_).tolist():
            if used + cost[i] > BLOCK:
                first[i], count[i] = at + 1, -(-cost[i] // BLOCK)
                at += int(count[i])
                used = cost[i] if count[i] == 1 else BLOCK
            else:
                first[i], count[i], used = at, 1, used + cost[i]
        meets: set[tuple[int, int]] = set()
        for i in np.flatnonzero(open_).tolist():
            others = np.flatnonzero(far(i, every))
            for p, k in set(zip(first[others].tolist(), count[others].tolist())):
                meets |= {(min(x, y), max(x, y)) for x in range(first[i], first[i] + count[i]) for y in range(p, p + k)}
        one, two = [x for x, _ in sorted(meets)], [y for _, y in sorted(meets)]
        k, m = len(u), len(one)
        return pa.table({
            "centre": pa.array([centre] * (k + m), pa.int64()), "c": pa.array([c] * (k + m), pa.int64()), "key": pa.array([*table.column("key").to_pylist(), *[None] * m], pa.int64()), "u": pa.array([*u.tolist(), *[None] * m], pa.int64()),
            "links": pa.array([*links.tolist(), *[None] * m], pa.int64()), "heads": pa.array([*to, *[None] * m], pa.list_(pa.int64())), "first": pa.array([*first.tolist(), *one], pa.int32()), "count": pa.array([*count.tolist(), *[None] * m], pa.int32()), "other": pa.array([*[None] * k, *two], pa.int32()),
        })

    return run


_PLAN = "centre long, c long, key long, u long, links long, heads array<long>, first int, count int, other int"


def _pack(table: pa.Table) -> pa.Table:
    """A block of members as one row."""
    differences = table.column("differences").to_pylist()
    lists = table.column("centres").to_pylist()
    parts = [table.column(x).to_numpy().astype(np.int64) for x in ("sid", "mult", "u")]
    parts += [np.array([len(x) // 8 for x in differences], np.int64), np.array([len(x) for x in lists], np.int64), np.array([y for x in lists for y in x], np.int64)]
    head = np.array([len(x) for x in parts], np.int64).tobytes()
    blob = b"".join([head, *(x.tobytes() for x in parts), *differences])
    return pa.table({"centre": table.column("centre").slice(0, 1), "c": table.column("c").slice(0, 1), "block": table.column("block").slice(0, 1), "blob": pa.array([blob], pa.binary())})


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """(sid, mult, u, owner of each difference, differences, lists of centres)."""
    sizes, at, parts = np.frombuffer(blob, np.int64, 6), 48, []
    for n in sizes.tolist():
        parts.append(np.frombuffer(blob, np.int64, n, at))
        at += 8 * n
    sid, mult, u, many, lengths, flat = parts
    cuts = np.cumsum(lengths)[:-1]
    return sid, mult, u, np.repeat(np.arange(len(sid)), many), np.frombuffer(blob, np.uint64, offset=at), [tuple(x.tolist()) for x in np.split(flat, cuts)]


def _overlaps(x: tuple, y: tuple, width: int = 2048) -> np.ndarray:
    """How many differences each member of the one block shares with each of the other."""
    both = np.intersect1d(x[4], y[4])
    out = np.zeros((len(x[0]), len(y[0])), np.float32)
    sides = []
    for side in (x, y):
        at = np.searchsorted(both, side[4])
        hit = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == side[4]) if len(both) else np.zeros(0, np.int64)
        hit = hit[np.argsort(at[hit], kind="stable")]
        sides.append((side[3][hit], at[hit]))
    for s in range(0, len(both), width):
        dense = []
        for (owner, at), side in zip(sides, (x, y)):
            a, b = np.searchsorted(at, [s, s + width])
            m = np.zeros((len(side[0]), min(width, len(both) - s)), np.float32)
            m[owner[a:b], at[a:b] - s] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _meet(num: int, den: int):
    """(sid, links, root) of the pairs of two blocks that only their differences can decide."""

    def run(table: pa.Table) -> pa.Table:
        centre, c = table.column("centre")[0].as_py(), table.column("c")[0].as_py()
        same = table.column("block")[0].as_py() == table.column("other")[0].as_py()
        x, y = _unpack(table.column("blob")[0].as_py()), _unpack(table.column("other_blob")[0].as_py())
        limit = (den - num) * c
        off = x[2][:, None] + y[2][None, :]
        links = off > limit
        off -= limit
        links &= off <= (den + num) * _overlaps(x, y)
        del off
        names: dict[tuple, int] = {}
        of = [np.array([names.setdefault(g, len(names)) for g in side[5]]) for side in (x, y)]
        owned = np.array([[min(set(a) & set(b)) == centre for b in names] for a in names])
        links &= owned[of[0][:, None], of[1][None, :]]
        if same:
            np.fill_diagonal(links, False)
            sids, counts = x[0], links @ x[1]
        else:
            sids, counts = np.concatenate((x[0], y[0])), np.concatenate((links @ y[1], x[1] @ links))
        # Components: each takes the least label around it until none changes.
        m = len(x[0])
        a, b = sids[:m].copy(), (sids[:m] if same else sids[m:]).copy()
        most = np.iinfo(np.int64).max
        while True:
            low = np.minimum(a, np.where(links, b[None, :], most).min(axis=1, initial=most))
            high = np.minimum(b, np.where(links, low[:, None], most).min(axis=0, initial=most))
            if same:
                low = high = np.minimum(low, high)
            if (low == a).all() and (high == b).all():
                break
            a, b = low, high
        roots = a if same else np.concatenate((a, b))
        has = counts > 0
        del links, low, high
        release()
        return pa.table({"sid": pa.array(sids[has], pa.int64()), "links": pa.array(counts[has].astype(np.int64)), "root": pa.array(roots[has], pa.int64())})

    return run


def group_links(members: DataFrame, reps: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """((sid, links, root) of all links within groups, (sid, centres) of their members)."""
    lists = staged(members.groupBy("sid").agg(F.array_sort(F.collect_set("centre")).alias("centres")))
    each = members.dropDuplicates(["sid", "centre"]).join(lists, "sid").join(reps.select("sid", "mult"), "sid")
    each = staged(each.withColumn("key", F.xxhash64("centres")))
    classes = each.groupBy("centre", "c", "key", "u").agg(F.first("centres").alias("centres"), F.count("*").alias("n"), F.sum("mult").alias("weight"), F.min("sid").alias("head"))
    plan = staged(classes.groupBy("centre").applyInArrow(_plan(num, den), _PLAN))
    judged = each.drop("c").join(small(plan.where("key is not null").drop("other")), ["centre", "key", "u"])
    own = (F.element_at("centres", 1) == F.col("centre")) & (2 * F.col("u") <= (den - num) * F.col("c"))  # then the count holds the set itself
    base = F.col("links") - F.when(own, F.col("mult")).otherwise(0)
    # The forest may have several rows a member, the count stands in the first.
    counted = judged.select("sid", base.alias("base"), F.posexplode_outer("heads").alias("place", "root"))
    counted = counted.select("sid", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("base")).otherwise(0).alias("links"), F.coalesce("root", "sid").alias("root"))
    packed = judged.where("first >= 0").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("sid"), "count")).cast("int"))
    packed = staged(packed.select("centre", "c", "block", "sid", "mult", "u", "differences", "centres").groupBy("centre", "block").applyInArrow(_pack, "centre long, c long, block int, blob binary"))
    pairs = plan.where("key is null").select("centre", F.col("first").alias("block"), "other")
    pairs = pairs.join(packed, ["centre", "block"]).join(packed.select("centre", F.col("block").alias("other"), F.col("blob").alias("other_blob")), ["centre", "other"])
    met = pairs.groupBy("centre", "block", "other").applyInArrow(_meet(num, den), "sid long, links long, root long")
    return staged(counted.unionByName(met)), lists
