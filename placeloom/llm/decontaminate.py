"""Benchmark decontamination: a broadcast hash set of normalised test windows, scanned over document words.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased.  A window
is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window.  The set is built
once, on the driver, from a block of the benchmark of bounded size, as sorted arrays: hashes of windows, where
they stand, and the words themselves, on which every hit is verified.  Workers search the arrays as they come.  A
benchmark of several blocks is scanned block by block, each one's hits staged and its arrays dropped.

Nulls and empty texts have no words.  Equal items, equal rows and repeated ids are judged row by row.  Very long
texts are scanned whole.  An empty benchmark hits nothing, an empty table gives an empty result.  Extra columns are
ignored, or carried along by ``remove_leaks``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, prefix_hashes, range_hashes, release, split_words, text_chunks
from .common import small_batches, staged

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits binary, items array<string>"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.string()))
_BITS = 20


def window_set(items: list[tuple], n: int) -> dict:
    """The windows of (name, text) items: per size sorted hashes, first words and owners; and all words' bytes."""
    names = sorted({str(i) for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    if not items:
        return {"names": [], "sizes": []}
    _, buf, offsets = next(text_chunks(pa.array([t or "" for _, t in items], pa.large_string()), 1 << 62))
    starts, ends, first, hashes = split_words(buf, offsets, ALNUM, LOWER)
    words = np.diff(first)
    size = np.minimum(n, words)
    many = np.where(words > 0, words - size + 1, 0)
    row = np.repeat(np.arange(len(items)), many)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    owner = np.array([number[str(i)] for i, _ in items], np.int32)[row]
    h = range_hashes(prefix_hashes(hashes), at, at + size[row])
    out = {"names": names, "raw": LOWER[buf].tobytes(), "starts": starts.astype(np.int32), "ends": ends.astype(np.int32), "sizes": []}
    for k in np.unique(size[row]).tolist():
        mine = np.flatnonzero(size[row] == k)
        mine = mine[np.lexsort((owner[mine], h[mine]))]
        # One entry for each owner of a window; entries of one hash but other words all stay.
        same = (h[mine][1:] == h[mine][:-1]) & (owner[mine][1:] == owner[mine][:-1])
        for j in range(k):
            word = hashes[at[mine] + j]
            same &= word[1:] == word[:-1]
        mine = mine[np.concatenate(([True], ~same))]
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[h[mine] >> np.uint64(64 - _BITS)] = True
        out["sizes"].append((k, h[mine], at[mine].astype(np.int32), owner[mine], np.packbits(bitmap)))
    return out


def _scanner(found: dict):
    """Per row of (buffer, offsets): words, hit ranges of words, names of items; and where words stand."""
    sizes = [(k, h, at, owner, np.unpackbits(bits).view(bool)) for k, h, at, owner, bits in found["sizes"]]

    def scan(buf, offsets):
        starts, ends, first, hashes = split_words(buf, offsets, ALNUM, LOWER)
        rows = len(offsets) - 1
        ranges, names = [[] for _ in range(rows)], [set() for _ in range(rows)]
        c = prefix_hashes(hashes)
        raw = None
        for size, known, places, owner, bitmap in sizes:
            if len(hashes) < size:
                continue
            at = np.arange(len(hashes) - size + 1)
            h = range_hashes(c, at, at + size)
            maybe = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
            row = np.searchsorted(first, maybe, "right") - 1
            hit = (high > low) & (maybe + size <= first[row + 1])
            for i, r, a, b in zip(maybe[hit].tolist(), row[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
                raw = LOWER[buf].tobytes() if raw is None else raw
                words = [raw[x:y] for x, y in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())]
                for j in range(a, b):
                    p = int(places[j])
                    if words == [found["raw"][x:y] for x, y in zip(found["starts"][p : p + size].tolist(), found["ends"][p : p + size].tolist())]:
                        ranges[r].append((i - int(first[r]), i - int(first[r]) + size))
                        names[r].add(found["names"][owner[j]])
        return np.diff(first), ranges, names, starts, ends, first

    return scan


def union_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, most_bytes: int):
    """The benchmark in blocks of at most about most_bytes of text (an item is never cut): their number, and a function of i."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most_bytes) or 1

    def block(i: int) -> list[tuple]:
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        return [(r.item_id, r.text) for r in mine.collect()]

    return n, block


def _judged(doc_id, n_words: int, ranges, names) -> tuple:
    merged, items = union_ranges(ranges), sorted(names)
    hit = sum(b - a for a, b in merged)
    return doc_id, n_words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, np.array(merged, np.int64).tobytes(), items


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], [f.split()[0] for f in SCHEMA.split(", ")])


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, most_bytes: int = 8 << 20) -> DataFrame:
    """One row a document: SCHEMA, ``hits`` being int64 pairs of word ranges."""
    small_batches(docs.sparkSession)
    many, block = _blocks(benchmark, most_bytes)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if many > 1:
        return _united(rows, many, block, n)
    kept = docs.sparkSession.sparkContext.broadcast(window_set(block(0), n))

    def run(batches):
        scan = _scanner(kept.value)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for at, buf, offsets in text_chunks(batch.column(1)):
                counts, ranges, names, *_ = scan(buf, offsets)
                out += [_judged(ids[at + j], int(count), ranges[j], names[j]) for j, count in enumerate(counts)]
            yield _batch(out)
        release()

    return rows.mapInArrow(run, SCHEMA)


def _by_block(keyed: DataFrame, many: int, block, n: int) -> DataFrame:
    """(doc_id, row_key, n_words, hits, items, copy) of (doc_id, text, row_key): all rows for the first block, those hit for the others."""
    parts = None
    for i in range(many):
        kept = keyed.sparkSession.sparkContext.broadcast(window_set(block(i), n))

        def run(batches, kept=kept, i=i):
            scan = _scanner(kept.value)
            for batch in batches:
                keys, hits, names_of, counts_of = [], [], [], []
                for at, buf, offsets in text_chunks(batch.column(1)):
                    counts, ranges, names, *_ = scan(buf, offsets)
                    for j, count in enumerate(counts):
                        keys.append(batch.column(2)[at + j].as_py())
                        hits.append(np.array(union_ranges(ranges[j]), np.int64).tobytes())
                        names_of.append(sorted(names[j]))
                        counts_of.append(int(count))
                found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(counts_of, pa.int64()), pa.array(hits, pa.binary()), pa.array(names_of, pa.list_(pa.string()))], ["doc_id", "row_key", "n_words", "hits", "items"])
                # After the first block, which has all rows, only what is hit.
                yield found.filter(pa.array([i == 0 or bool(x) for x in hits], pa.bool_()))

        part = staged(keyed.mapInArrow(run, "doc_id long, row_key long, n_words long, hits binary, items array<string>")).withColumn("copy", F.lit(int(i == 0)))
        kept.destroy()
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _united(rows: DataFrame, many: int, block, n: int) -> DataFrame:
    """``find_leaks`` for a benchmark of many blocks."""
    parts = _by_block(rows.withColumn("row_key", F.xxhash64("doc_id", "text")), many, block, n)
    grouped = parts.groupBy("doc_id", "row_key", "n_words").agg(F.collect_set("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.sum("copy").alias("copies"))

    def finish(batches):
        for batch in batches:
            out = []
            for doc, n_words, hits, items, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ranges = [tuple(r) for h in hits for r in np.frombuffer(h, np.int64).reshape(-1, 2).tolist()]
                out += [_judged(doc, n_words, ranges, items)] * copies
            yield _batch(out)

    return grouped.select("doc_id", "n_words", "hits", "items", "copies").mapInArrow(finish, SCHEMA)


def _without(body: bytes, ranges: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the ranges of words; starts and ends: where its words stand."""
    at, pieces = 0, []
    for a, b in union_ranges(ranges):
        pieces.append(body[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*pieces, body[at:]]).decode()


def remove_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "documents", most_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without leaked documents, or (``action="spans"``) without the leaked words and what parts them.

    Rows are judged one by one, so ids may repeat; only the rows' text decides.
    """
    small_batches(docs.sparkSession)
    many, block = _blocks(benchmark, most_bytes)
    if action == "spans" and many > 1:
        return _without_spans(docs, many, block, n)
    out, place = docs, docs.columns.index("text")
    for i in range(many):
        kept = docs.sparkSession.sparkContext.broadcast(window_set(block(i), n))

        def run(batches, kept=kept):
            scan = _scanner(kept.value)
            for batch in batches:
                texts, clean = [], []
                for _, buf, offsets in text_chunks(batch.column(place)):
                    _, ranges, _, starts, ends, first = scan(buf, offsets)
                    clean += [not x for x in ranges]
                    if action == "spans":
                        texts += [_without(buf[a:b].tobytes(), x, starts[f:g] - a, ends[f:g] - a) for a, b, f, g, x in zip(offsets, offsets[1:], first, first[1:], ranges)]
                if action == "spans":
                    had = batch.column(place)
                    new = pa.array([None if v else t for t, v in zip(texts, had.is_null().to_pylist())], pa.string()).cast(had.type)
                    yield pa.RecordBatch.from_arrays([new if i == place else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)
                else:
                    yield batch.filter(pa.array(clean, pa.bool_()))
            release()

        out = out.mapInArrow(run, docs.schema)
        if many > 1:
            out = staged(out)
            kept.destroy()
    return out


def _without_spans(docs: DataFrame, many: int, block, n: int) -> DataFrame:
    """Of a benchmark of many blocks: the hits of all of them are united before any is removed."""
    keyed = docs.select(F.struct("*").alias("row"), "text", F.xxhash64("text").alias("row_key"))
    parts = _by_block(keyed.select(F.lit(0).cast("long").alias("doc_id"), "text", "row_key"), many, block, n)
    hits = parts.where("length(hits) > 0").groupBy("row_key").agg(F.collect_set("hits").alias("hits"))

    def cut(batches):
        for batch in batches:
            out = []
            for key, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                _, buf, offsets = next(text_chunks(pa.array([text])))
                starts, ends, _, _ = split_words(buf, offsets, ALNUM, LOWER)
                out.append((key, _without(text.encode(), [tuple(r) for h in found for r in np.frombuffer(h, np.int64).reshape(-1, 2).tolist()], starts, ends)))
            columns = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["row_key", "clean"])

    clean = keyed.select("row_key", "text").dropDuplicates(["row_key"]).join(hits, "row_key").mapInArrow(cut, "row_key long, clean string")
    return keyed.join(clean, "row_key", "left").select(F.col("row").withField("text", F.coalesce("clean", "row.text")).alias("row")).select("row.*")
