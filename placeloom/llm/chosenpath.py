"""N-gram Jaccard self-join by chosen paths, and the classes of near-duplicates it links.

A text's set is its shingles of ``SHINGLE`` words (words between white space, unchanged); one with fewer words,
but not none, has all its words as one shingle.  Equal sets are one class representative.  Each run starts one
node for all sets; a node chooses ``BRANCHES`` coordinates of the sets' MinHash sketches by its own number and
splits its sets by the token sampled there.  Nodes of at most ``LEAF`` sets are brute-forced, larger ones split
on, up to ``DEPTH`` times; near copies would never part, so dense groups are looked for first: sets around a centre
of one run's large nodes are linked exactly, from their differences (``centres``), and those near it take part in no
run.  A node that is large still looks for such a group among its own sets, and those near its centre leave it.
What is still large after the last split is brute-forced in tiles.  A pair of similarity s lives through one split
with 1 - (1 - s q)**BRANCHES, so ``runs_for`` repeats the runs until the target recall.  A pair belongs to its
least common centre, else to the least leaf that holds both, so it is counted once.  Sketches drop pairs that are
five standard deviations off; the rest are verified on the sets.

Only members and a spanning forest leave a tile, never its pairs.  Null and empty texts have no set: each is a
class of its own without links.  Equal texts and repeated rows are links of each other; a null doc_id comes after
all others in a class.  A text of any length is one set, held whole by one task.  An empty table gives an empty
result; extra columns are ignored, whatever their names.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import AS_IS, SPACED, gram_hashes, mix, prefix_hashes, range_hashes, release, split_words, text_chunks, within_rows
from .centres import gather, gather_all, group_links
from .common import asked, components, discard, give_back, n_buckets, small_batches, staged

SHINGLE, LEAF, DEPTH, BRANCHES, COORDINATES = 5, 256, 3, 2, 64
_NO_CENTRE = np.uint64(2**64 - 1)
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _least_agreement(s: float) -> float:
    """Coordinates in which the sketches of a pair of the similarity agree, five standard deviations off at most."""
    return COORDINATES * (s - 5 * math.sqrt(s * (1 - s) / COORDINATES))


def runs_for(similarity: float, recall: float) -> int:
    """Runs after which a pair of the similarity has met in a leaf with at least the recall, at full depth.

    All runs read the same sketches, so what they miss is averaged over the numbers of coordinates in which the
    two may agree; pairs that agree too seldom for the sketches' filter count as missed.
    """
    agree = np.arange(COORDINATES + 1)
    chance = np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in agree.tolist()])
    passes = agree >= _least_agreement(similarity)
    alive = np.ones(len(agree))
    for _ in range(DEPTH + 1):
        alive = 1 - (1 - agree / COORDINATES * alive) ** BRANCHES
    dropped = float(chance[~passes].sum())
    if dropped >= 1 - recall:
        raise ValueError("the sketches are too short for this recall")
    runs = 1
    while dropped + float((chance * (1 - alive) ** runs)[passes].sum()) > 1 - recall:
        runs += 1
    return runs


def shingle_sets(buf, offsets, n: int):
    """(row, shingle) of the rows' distinct shingles, by row."""
    _, _, first, words = split_words(buf, offsets, SPACED, AS_IS)
    ok = within_rows(len(words), first, n)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams, rows = gram_hashes(words, n)[ok], row[: len(ok)][ok]
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        c = prefix_hashes(words)
        grams = np.concatenate((grams, mix(range_hashes(c, first[short], first[short + 1]) + size[short].astype(np.uint64))))
        rows = np.concatenate((rows, short))
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], grams[new]


def sketch_of(grams: np.ndarray) -> tuple[int, np.ndarray]:
    """(number, sketch) of one set."""
    number = mix(grams + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(number.view(np.int64)), np.array([(grams * a).min() >> np.uint64(32) for a in _FACTORS], np.uint32)


def _sketches(n: int):
    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            sids, sizes, sketches = [], [], []
            for _, buf, offsets in text_chunks(batch.column(2)):
                rows, grams = shingle_sets(buf, offsets, n)
                have, start = np.unique(rows, return_index=True)
                count = np.zeros(len(offsets) - 1, np.int64)
                count[have] = np.diff(np.append(start, len(rows)))
                sid, sketch = np.zeros(len(count), np.uint64), np.zeros((len(count), COORDINATES), np.uint32)
                if len(have):
                    sid[have] = np.add.reduceat(mix(grams + np.uint64(0x5851F42D4C957F2D)), start)
                    for j, a in enumerate(_FACTORS):
                        sketch[have, j] = np.minimum.reduceat(grams * a, start) >> np.uint64(32)
                sids += [s if c else None for s, c in zip(sid.view(np.int64).tolist(), count.tolist())]
                sizes += count.tolist()
                sketches += [x.tobytes() if c else None for x, c in zip(sketch, count.tolist())]
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "row_key", "sid", "size", "sketch"])
        release()

    return run


def _split(runs: int = 0):
    """Batches of (sid, node, sketch) to (sid, node): with runs, from each run's root, else from the node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sids = batch.column(0).to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            at = np.arange(len(sids))
            if runs:
                parents = [np.full(len(sids), mix(np.array([r + 1], np.uint64))[0]) for r in range(runs)]
            else:
                parents = [batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            for parent in parents:
                chosen = mix(parent + np.uint64(0x2545F4914F6CDD1D))
                first = (chosen % np.uint64(COORDINATES)).astype(np.int64)
                for b in range(BRANCHES):
                    # Distinct coordinates: odd steps around the sketch.
                    step = ((chosen >> np.uint64(20)) % np.uint64(COORDINATES // 2)).astype(np.int64) * 2 + 1
                    place = (first + b * step) % COORDINATES
                    child = mix(parent ^ mix((place.astype(np.uint64) << np.uint64(32)) | sketch[at, place].astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(child.view(np.int64))], ["sid", "node"])

    return run


def _sized(nodes: DataFrame) -> DataFrame:
    """(sid, node, members) of nodes with two members or more."""
    sizes = staged(nodes.groupBy("node").agg(F.count("*").alias("members")).where("members > 1"))  # apart, so that the join can split a large node
    return staged(nodes.join(sizes, "node").select("sid", "node", "members"))


def _with_sketches(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (sid, node, ...) and the sketches of their sets."""
    return some.join(asked(reps.select("sid", "sketch"), some.select("sid")), "sid")


def leaves(reps: DataFrame, sets_of, runs: int, num: int, den: int) -> tuple[DataFrame, DataFrame | None]:
    """((sid, leaf, members) of leaves with two members or more, members of dense groups or None)."""
    started = lambda some, n: staged(some.select("sid", F.lit(0).cast("long").alias("node"), "sketch").mapInArrow(_split(n), "sid long, node long"))
    found, groups = [], []
    # Dense groups are first looked for in one run and gathered from all sets; who is near a centre takes part in no run.
    big = _sized(started(reps, 1)).where(F.col("members") > LEAF)
    if big.limit(1).count():
        wide = staged(_with_sketches(big, reps).select("sid", "node", "members", "sketch"))
        members = gather_all(reps, wide, sets_of, sketch_of, COORDINATES, num, den)
        discard(wide)
        if members is not None:
            groups.append(members)
            reps = staged(reps.select("sid", "sketch").join(members.where("inner").select("sid").distinct(), "sid", "left_anti"))
        give_back(reps.sparkSession)  # the texts that were shuffled for the groups
    nodes = started(reps, runs)
    for depth in range(DEPTH + 1):
        now = _sized(nodes)
        found.append(now.where(F.col("members") <= LEAF))
        big = now.where(F.col("members") > LEAF)
        if not big.limit(1).count():
            break
        wide = staged(_with_sketches(big, reps).select("sid", "node", "members", "sketch"))
        gathered = gather(wide, sets_of, sketch_of, COORDINATES, num, den)
        give_back(reps.sparkSession)
        rest = big
        if gathered is not None:
            groups.append(gathered[0])
            # Only nodes that some leave are counted anew.
            leave = staged(gathered[1])
            touched = leave.select("node").distinct()
            rest = staged(big.join(touched, "node", "left_anti").unionByName(_sized(big.join(touched, "node", "left_semi").join(leave, ["sid", "node"], "left_anti").select("sid", "node")).select(big.columns)))
        found.append(rest if depth == DEPTH else rest.where(F.col("members") <= LEAF))
        big = rest.where(F.col("members") > LEAF)
        last = depth == DEPTH or not big.limit(1).count()
        if not last:
            parts = wide if gathered is None else _with_sketches(big, reps)
            nodes = staged(parts.select("sid", "node", "sketch").mapInArrow(_split(), "sid long, node long"))
        discard(wide)
        if last:
            break
    united = found[0]
    for part in found[1:]:
        united = united.unionByName(part)
    every = None
    for part in groups:
        every = part if every is None else every.unionByName(part)
    return united.withColumnRenamed("node", "leaf"), every


def _tile_pairs(t: dict, s_num: int, s_den: int):
    """Candidate pairs (i, j) of rows of a bucket, each in the first leaf that its two sets share."""
    tile, block, low = t["tile"], t["block"], t["low"]
    order = np.argsort(tile, kind="stable")
    cuts = np.append(np.flatnonzero(np.concatenate(([True], np.diff(tile[order]) != 0))), len(order))
    sizes = np.diff(cuts)
    # Small tiles of one size together, large ones one by one.
    for m in np.unique(sizes):
        if m < 2:
            continue
        of = cuts[:-1][sizes == m]
        a, b = np.triu_indices(int(m), 1)
        step = max(1, (1 << 16) // len(a))
        for s in range(0, len(of), step):
            base = of[s : s + step][:, None]
            i, j = order[(base + a).ravel()], order[(base + b).ravel()]
            # Of two different blocks only pairs across; of one, all.
            go = (t["high"][i] == low[i]) | (block[i] != block[j])
            x, y = t["size"][i], t["size"][j]
            go &= s_den * np.minimum(x, y) >= s_num * np.maximum(x, y)
            i, j = i[go], j[go]
            if len(i):
                go = (t["sketch"][i] == t["sketch"][j]).sum(axis=1) >= _least_agreement(s_num / s_den)
                i, j = i[go], j[go]
            for p in range(0, len(i), 4096):
                x, y = i[p : p + 4096], j[p : p + 4096]
                u, v = t["leaves"][x], t["leaves"][y]
                shared = np.where((u[:, :, None] == v[:, None, :]).any(axis=2), u, np.uint64(2**64 - 1)).min(axis=1)
                own = shared == t["leaf"][x]
                if t["centres"].shape[1]:
                    u, v = t["centres"][x], t["centres"][y]
                    own &= ~((u[:, :, None] == v[:, None, :]) & (u[:, :, None] != _NO_CENTRE)).any(axis=(1, 2))
                if own.any():
                    yield x[own], y[own]


def _wide(column: pa.ChunkedArray, fill) -> np.ndarray:
    """The rows' lists as a matrix, filled up."""
    lists = column.combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    flat, size = flat[offsets[0] : offsets[-1]], np.diff(offsets)
    wide = np.full((len(size), int(size.max(initial=0))), fill)
    wide[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return wide


def _read(table: pa.Table) -> dict:
    t = {c: table.column(c).to_numpy() for c in ("sid", "tile", "block", "low", "high", "size")}
    t["leaf"] = table.column("leaf").to_numpy().view(np.uint64)
    t["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    t["leaves"], t["centres"] = _wide(table.column("leaves"), np.uint64(2**64 - 1)), _wide(table.column("centres"), _NO_CENTRE)
    return t


_ROW = "bucket int, sid long, leaf long, tile long, block long, low long, high long, size long, mult long, sketch binary, leaves array<long>, centres array<long>"


def _needed(s_num: int, s_den: int):
    """Rows of a bucket that some candidate pair needs."""

    def run(table: pa.Table) -> pa.Table:
        t = _read(table)
        keep = np.zeros(table.num_rows, bool)
        for i, j in _tile_pairs(t, s_num, s_den):
            keep[i] = keep[j] = True
        kept = table.select([c.split()[0] for c in _ROW.split(", ")]).filter(pa.array(keep))
        for name in ("leaves", "centres"):
            kept = kept.set_column(kept.column_names.index(name), name, kept.column(name).cast(pa.list_(pa.int64())))
        del t
        release()
        return kept

    return run


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets."""
    rows = np.unique(np.concatenate((i, j)))
    if len(i) <= 4 * len(rows):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    # Many pairs of few sets: a product of 0/1 matrices, over the shingles that two sets or more hold.
    every = np.concatenate([sets[r] for r in rows.tolist()])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows.tolist()])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    go = count[column] > 1
    owner, column = owner[go], rank[column[go]]
    total = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, [s, s + 8192])
        m = np.zeros((len(rows), 8192), np.float32)
        m[owner[a:b], column[a:b] - s] = 1
        total += m @ m.T
    return total[np.searchsorted(rows, i), np.searchsorted(rows, j)].astype(np.int64)


def _link(s_num: int, s_den: int):
    """(sid, links, root): verified links of the bucket's tiles, and a spanning forest of them."""

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("sid", "links", "root")})
        t = _read(table)
        mult = table.column("mult").to_numpy()
        held = dict(zip(given.column("own").to_pylist(), (np.frombuffer(b, np.uint64) for b in given.column("set").to_pylist())))
        sets = [held[x] for x in t["sid"].tolist()]
        links = np.zeros(table.num_rows, np.int64)
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in _tile_pairs(t, s_num, s_den):
            shared = _shared(sets, i, j)
            go = s_den * shared >= s_num * (t["size"][i] + t["size"][j] - shared)
            i, j = i[go], j[go]
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            for a, b in zip(t["sid"][i].tolist(), t["sid"][j].tolist()):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        has = links > 0
        sids = t["sid"][has]
        del sets, held
        release()
        return pa.table({"sid": pa.array(sids), "links": pa.array(links[has]), "root": pa.array([find(x) for x in sids.tolist()], pa.int64())})

    return run


def _sets(n: int):
    """Batches of (sid, text, to, more) to (sid, to, set, more); rows of one sid that follow each other share its set."""

    def run(batches):
        for batch in batches:
            sids, blobs = batch.column(0).to_numpy(zero_copy_only=False), []
            new = np.ones(len(sids), bool)
            new[1:] = sids[1:] != sids[:-1]
            for _, buf, offsets in text_chunks(batch.column(1).filter(pa.array(new))):
                rows, grams = shingle_sets(buf, offsets, n)
                cuts = np.searchsorted(rows, np.arange(len(offsets)))
                blobs += [grams[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            blobs = [blobs[i] for i in (np.cumsum(new) - 1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary()), *batch.columns[3:]], ["sid", "to", "set", *batch.schema.names[3:]])
        release()

    return run


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (4, 5), shingle: int = SHINGLE, recall: float = 0.9999) -> DataFrame:
    """Per row: doc_id, row_key, class_id (the class's least doc_id) and n_links (rows at least that similar)."""
    num, den = similarity
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    sketched = staged(rows.mapInArrow(_sketches(shingle), "doc_id long, row_key long, sid long, size long, sketch binary"))
    equal = sketched.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("rep"), F.count("*").alias("mult"), F.max("size").alias("size"))
    # Equal sets have equal sketches: that of one row goes on.
    one = sketched.select("sid", "sketch", F.col("row_key").alias("rep"))
    reps = staged(equal.join(one.dropDuplicates(["sid", "rep"]), ["sid", "rep"]))

    def sets_of(wanted: DataFrame, beside: DataFrame | None = None, then=None, schema: str = "") -> DataFrame:
        """(sid, to, set) of the given (sid, to); each text that is asked for is shuffled once, no other is.

        With ``beside``, joined on ``to``, what ``then`` makes of the batches in the same Python worker.
        """
        each = wanted.groupBy("sid").agg(F.collect_set("to").alias("to"))
        keyed = staged(each.join(reps.select("sid", "rep"), "sid").select("rep", "sid", "to"))
        texts = asked(rows.select(F.col("row_key").alias("rep"), "text"), keyed.select("rep")).join(keyed, "rep").dropDuplicates(["rep", "sid"])
        sets = _sets(shingle)
        if beside is None:
            made = texts.select("sid", "text", "to").mapInArrow(sets, "sid long, to array<long>, set binary")
            return made.select("sid", F.explode("to").alias("to"), "set")
        more = [c for c in beside.columns if c != "to"]
        each = texts.select("sid", "text", F.explode("to").alias("to")).join(beside, "to").select("sid", "text", "to", *more)
        return each.mapInArrow(lambda batches: then(sets(batches)), schema)

    found, members = leaves(reps, sets_of, runs_for(num / den, recall), num, den)
    found = staged(found)
    lists = found.groupBy("sid").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    rows_of = found.join(lists, "sid").join(reps.select("sid", "rep", "size", "mult", "sketch"), "sid")
    none = F.expr("cast(array() as array<bigint>)")
    if members is None:
        grouped, rows_of = None, rows_of.withColumn("centres", none)
    else:
        grouped, centres = group_links(members, reps, num, den)
        rows_of = rows_of.join(centres, "sid", "left").withColumn("centres", F.coalesce("centres", none))
    blocks = F.ceil(F.col("members") / LEAF)
    tiled = rows_of.withColumn("block", F.pmod(F.xxhash64("sid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiled = tiled.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumn("tile", F.xxhash64("leaf", "low", "high"))
    n = n_buckets(found.select(F.lit(2000).alias("weight")), "weight")
    tiled = tiled.withColumn("bucket", F.pmod("tile", F.lit(n)).cast("int"))
    columns = [c.split()[0] for c in _ROW.split(", ")]
    needed = staged(tiled.select(*columns).groupBy("bucket").applyInArrow(_needed(num, den), _ROW))
    # Sets go once to each bucket that needs them.
    sent = sets_of(needed.select("sid", F.col("bucket").cast("long").alias("to"))).select(F.col("to").cast("int").alias("to"), F.col("sid").alias("own"), "set")
    linked = staged(needed.groupBy("bucket").cogroup(sent.groupBy("to")).applyInArrow(_link(num, den), "sid long, links long, root long"))
    linked = linked if grouped is None else linked.unionByName(grouped)
    classes = components(linked.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("sid").agg(F.sum("links").alias("links"))
    placed = reps.select("sid", "least", "mult").join(classes, reps.sid == classes.node, "left").select("sid", "least", "mult", F.coalesce("root", "sid").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    final = placed.join(heads, "root").join(counts, "sid", "left").select("sid", "class_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = sketched.where("sid is null").select("doc_id", "row_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sketched.where("sid is not null").join(final, "sid").select("doc_id", "row_key", "class_id", "n_links").unionByName(alone)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of each class, one row a class (of equal ids, the least row key)."""
    judged = staged(near_duplicates(docs, **how))
    # Texts without words are classes of their own, row by row.
    first = judged.where("n_links > 0").groupBy("class_id").agg(F.min(F.struct("doc_id", "row_key")).alias("w")).select("w.row_key")
    alone = judged.where("n_links = 0").select("row_key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("row_key"))
    kept = keyed.join(first.union(alone).distinct(), "row_key", "left_semi")
    again = judged.where("n_links > 0").groupBy("row_key").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["row_key"]) if again else kept).select("row.*")
