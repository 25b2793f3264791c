"""Exact repeats of L consecutive items (bytes or words) over a corpus, without comparing all with all.

1. Every text is cut into k-grams; the least hash of each L-window's k-grams is an anchor.  Equal windows have
   equal anchors, and equal items around these: a window leaves half of what is no anchor on one side at least.
   Anchors travel in packed blobs, in buckets by hash, with 16 bits of what stands half so far to either side;
   those that no other one equals on some side are dropped, so grams that recur by chance go no further.
2. Texts with repeated anchors give, for each one, the stretch of windows it is the least of.  Stretches equal
   within a task are settled there and only the first travels on; anchors with very many holders are cut into
   single windows, dealt by the window, so that no bucket gathers a hot passage.
3. A bucket settles equal stretches, and hands the rest to an index (a suffix automaton or a run-compressed
   Burrows-Wheeler transform), which tells the classes of equal windows.  All but the first of a class repeat.
4. Marked ranges go back to their texts, which are read again: nothing but stretches and marks is kept in between.

An anchor that one task meets more than ``LOCAL`` times in a chunk of text is known to be hot: from then on the
task tells its holders' buckets at once, and sends the anchor's own bucket one entry only.  So that bucket gathers
a few entries a task of an anchor that all texts hold, not one a text.

"First" is by doc_id; of one row, by place, where repeats within a row count (bytes).  Rows of equal doc_id are not earlier than each other.  Null texts
are empty; a null doc_id comes before all; equal rows are judged alike; an empty table gives an empty result.
Anchors, words and rows are told apart by 64-bit hashes; windows by the items themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import AS_IS, BYTE_VALUE, SPACED, grams_of, mix, prefix_hashes, range_hashes, release, sliding, split_words, text_chunks, within_rows
from ..runtime import discard
from .common import give_back, n_buckets, small_batches, staged

#: Holders beyond which an anchor's windows are dealt singly.
HOT = 512
#: Holders in one chunk of text beyond which an anchor is known to be hot.
LOCAL = 32
#: Bytes of text that one bucket is meant to hold, and that are hashed at once (each takes some 80 bytes).
BUCKET_BYTES, CHUNK = 8 << 20, 1 << 20
_NULL = np.iinfo(np.int64).min
SCHEMA = "kind int, bucket int, row_key long, doc_id long, n long, n_removed long, n_spans long, sha string, payload binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
DONE, STRETCHES, MARKS = range(3)
#: Entries of anchors: for the anchor's bucket, for the holder's bucket as it is hot, and that it is hot.
ONCE, TOLD, NEW = range(3)


def _table(rows: list[tuple]) -> pa.Table:
    release()
    columns = list(zip(*rows)) or [[]] * len(_TYPES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 4 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<u4", len(kinds)), kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def values_of(table: pa.Table, name: str) -> list[bytes]:
    """The column's values; a side of a cogroup without rows has no columns."""
    return table.column(name).to_pylist() if table.num_rows else []


def concat(parts: list[list[np.ndarray]], kinds) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


class Bytes:
    """Items are the bytes of the UTF-8 text."""

    name, inner = np.uint8, True

    @staticmethod
    def items(buf, offsets):
        """(values to hash, items before each row, item starts, item ends, items as stored)."""
        return BYTE_VALUE[buf], offsets, None, None, buf

    @staticmethod
    def finish(body: bytes, marks: list[tuple[int, int]]):
        at, kept = 0, hashlib.sha256()
        for a, b in marks:
            kept.update(body[at:a])
            at = b
        kept.update(body[at:])
        return len(body), sum(b - a for a, b in marks), len(marks), kept.hexdigest()

    @staticmethod
    def remaining(body: bytes, marks) -> bytes:
        edges = [0, *(x for m in marks for x in m), len(body)]
        return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


class Words:
    """Items are words between white space, unchanged; repeats within one document are left."""

    name, inner = np.uint64, False

    @staticmethod
    def items(buf, offsets):
        starts, ends, first, hashes = split_words(buf, offsets, SPACED, AS_IS)
        return hashes, first, starts, ends, hashes

    @staticmethod
    def remaining(body: bytes, marks) -> bytes:
        words = body.split()
        edges = [0, *(x for m in marks for x in m), len(words)]
        return b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b])

    @staticmethod
    def finish(body: bytes, marks):
        kept = Words.remaining(body, marks)
        return len(body.split()), sum(b - a for a, b in marks), len(marks), hashlib.sha256(kept).hexdigest()


def anchors(grams: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Places of the least of any w consecutive grams in one row; ok: which runs of w grams lie in one row."""
    least = sliding(grams, w, np.minimum)
    ok = ok[: len(least)]
    # A gram is an anchor if it is the least of some run that holds it: the greatest of those runs' minima.
    low = np.where(ok, least, np.uint64(0))
    padded = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
    return np.flatnonzero((sliding(padded, w, np.maximum) == grams) & (sliding(np.concatenate((np.zeros(w - 1, bool), ok, np.zeros(w - 1, bool))), w, np.logical_or)))


def parts_by(bucket: np.ndarray):
    """(bucket, places of its entries) of the buckets that have any."""
    order = np.argsort(bucket, kind="stable")
    s = bucket[order]
    heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(s)]):
        yield int(s[a]), order[a:z]


def later(classes: np.ndarray, docs: np.ndarray, keys: np.ndarray, places: np.ndarray, inner: bool) -> np.ndarray:
    """Which occurrences have an earlier one in their class: in a smaller document, or (inner) before in the row."""
    order = np.lexsort((places, keys, docs, classes))
    c, d, k = classes[order], docs[order], keys[order]
    head = np.ones(len(c), bool)
    head[1:] = c[1:] != c[:-1]
    first = d[np.flatnonzero(head)][np.cumsum(head) - 1] if len(c) else d
    same = np.zeros(len(c), bool)
    same[1:] = ~head[1:] & (k[1:] == k[:-1]) & (places[order][1:] != places[order][:-1])
    out = np.zeros(len(c), bool)
    out[order] = (d > first) | (same & inner)
    return out


def places_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def content_ids(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Equal ids for equal stretches of items: hashes propose them, the items decide."""
    if not len(starts):
        return np.zeros(0, np.int64)
    total, slabs, low = np.cumsum(sizes), [], 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + step, "right")))
        slabs.append((low, high))
        low = high
    hashes = np.empty(len(starts), np.uint64)
    for low, high in slabs:
        size = sizes[low:high]
        c = prefix_hashes(mix(items[places_of(starts[low:high], size)].astype(np.uint64) + np.uint64(1)))
        ends = np.cumsum(size)
        hashes[low:high] = range_hashes(c, ends - size, ends) ^ mix(size.astype(np.uint64))
    ids, _ = pd.factorize(hashes)
    heads = np.flatnonzero(np.diff(np.maximum.accumulate(ids), prepend=-1))[ids]
    for low, high in slabs:
        part = low + np.flatnonzero(heads[low:high] != np.arange(low, high))
        if (sizes[part] != sizes[heads[part]]).any() or (items[places_of(starts[part], sizes[part])] != items[places_of(starts[heads[part]], sizes[part])]).any():
            told: dict[bytes, int] = {}  # two contents of one hash
            raw, w = items.tobytes(), items.itemsize
            return np.fromiter((told.setdefault(raw[a * w : (a + n) * w], len(told)) for a, n in zip(starts.tolist(), sizes.tolist())), np.int64, len(starts))
    return ids.astype(np.int64)


class Repeats:
    """The passes for one kind of items; ``index(items, starts, sizes, L)`` gives a class per window."""

    def __init__(self, kind, length: int, gram: int, index):
        self.kind, self.length, self.gram, self.index = kind, length, gram, index

    # -- pass 1
    def _anchors(self, buf, offsets):
        """(grams, which windows lie in one row, items before each row, prefix hashes)."""
        values, first, *_ = self.kind.items(buf, offsets)
        c = prefix_hashes(values)
        return grams_of(c, self.gram), within_rows(len(values), first, self.length), first, c

    def _around(self, c, first, place, row):
        """16 bits of what anchors and the items before (after) them are, 0 where the row has too few."""
        most, reach = self.length - self.gram, (self.length - self.gram + 1) // 2
        out = []
        for a, z in ((place - reach, place + self.gram), (place, place + self.gram + reach)):
            inside = (a >= first[row]) & (z <= first[row + 1]) if most else np.ones(len(place), bool)
            bits = np.zeros(len(place), np.uint16)
            bits[inside] = np.maximum(range_hashes(c, a[inside], z[inside]) >> np.uint64(48), np.uint64(1))
            out.append(bits)
        return out

    def repeated_anchors(self, rows: DataFrame, n: int) -> DataFrame:
        """(bucket of the row, blob of (row key, anchor hash, hot)) of anchors found more than once."""

        def send(batches):
            hot = np.zeros(0, np.uint64)
            for batch in batches:
                keys = batch.column(1).to_numpy(zero_copy_only=False)
                packs: dict[tuple[int, int], list] = {}
                for at, buf, offsets in text_chunks(batch.column(0), CHUNK):
                    grams, ok, first, c = self._anchors(buf, offsets)
                    place = anchors(grams, ok, self.length - self.gram + 1) if ok.any() else np.zeros(0, np.int64)
                    row = np.searchsorted(first, place, "right") - 1
                    h, own = grams[place], keys[at + row]
                    before, after = self._around(c, first, place, row)
                    values, count = np.unique(h, return_counts=True)
                    new = np.setdiff1d(values[count > LOCAL], hot, assume_unique=True)
                    hot = np.union1d(hot, new)
                    known = np.isin(h, hot)
                    none = np.zeros(max(len(h), len(new)), np.uint16)
                    for kind, some_h, some_keys, some_before, some_after, to in (
                        (ONCE, h[~known], own[~known], before[~known], after[~known], (h[~known] >> np.uint64(32)) % np.uint64(n)),
                        (TOLD, h[known], own[known], none, none, np.mod(own[known], n)),
                        (NEW, new, np.zeros(len(new), np.int64), none, none, (new >> np.uint64(32)) % np.uint64(n)),
                    ):
                        for b, mine in parts_by(to):
                            packs.setdefault((kind, b), []).append((some_h[mine], some_keys[mine], some_before[mine], some_after[mine]))
                if packs:
                    blobs = [pack(*self._by_row(p)) for p in packs.values()]
                    kinds, buckets = zip(*packs)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])
            release()

        def find(table: pa.Table) -> pa.Table:
            parts: tuple[list, list, list] = ([], [], [])
            for kind, blob in zip(table.column("kind").to_pylist(), values_of(table, "blob")):
                h, before, after, keys, counts = unpack(blob, np.uint64, np.uint16, np.uint16, np.int64, np.uint32)
                parts[kind].append([h, np.repeat(keys, counts), before, after])
            kinds = (np.uint64, np.int64, np.uint16, np.uint16)
            h, keys, before, after = concat(parts[ONCE], kinds)
            told = np.unique(concat(parts[NEW], kinds)[0])
            order = np.argsort(h)
            s = h[order]
            head = np.ones(len(s), bool)
            head[1:] = s[1:] != s[:-1]
            number = np.cumsum(head) - 1
            size = np.bincount(number) if len(s) else np.zeros(0, np.int64)
            size = size + (HOT + 1) * np.isin(s[head], told)
            again = size[number] > 1
            order, size, number = order[again], size[number][again], number[again]
            # Equal windows are equal on one side of their anchors; holders of anchors told elsewhere are not all here.
            alike = np.isin(h[order], told)
            for bits in (before[order], after[order]):
                same = number << 16 | bits
                by = np.argsort(same)
                twin = np.zeros(len(by), bool)
                twin[1:] = same[by][1:] == same[by][:-1]
                twin[:-1] |= twin[1:]
                alike[by] |= twin & (bits[by] > 0)
            order, size = order[alike], size[alike]
            direct_h, direct_keys, *_ = concat(parts[TOLD], kinds)
            h, keys = np.concatenate((h[order], direct_h)), np.concatenate((keys[order], direct_keys))
            hot = np.concatenate(((size > HOT).astype(np.uint8), np.ones(len(direct_h), np.uint8)))
            found = [(b, pack(keys[mine], h[mine], hot[mine])) for b, mine in parts_by(np.mod(keys, n))]
            return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})

        sent = rows.select("text", "row_key").mapInArrow(send, "bucket int, kind int, blob binary")
        return sent.groupBy("bucket").applyInArrow(find, "bucket int, blob binary")

    @staticmethod
    def _by_row(parts):
        h, keys, before, after = (np.concatenate(x) for x in zip(*parts))
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return h, before, after, keys[heads], np.diff(np.append(heads, len(keys))).astype(np.uint32)

    # -- pass 2
    def stretches(self, rows: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
        """SCHEMA rows: stretches of the texts with repeated anchors, and marks settled here."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _table([])
            parts = [unpack(b, np.int64, np.uint64, np.uint8) for b in values_of(right, "blob")]
            keys, hashes, hot = concat(parts, (np.int64, np.uint64, np.uint8))
            order = np.lexsort((hashes, keys))
            keys, hashes, hot = keys[order], hashes[order], hot[order]
            row_keys, docs = left.column("row_key").to_numpy(), left.column("doc_id").fill_null(_NULL).to_numpy()
            own, once = np.unique(row_keys, return_index=True)
            once = np.sort(once[np.isin(own, keys)])
            if not len(once):
                return _table([])
            texts = left.column("text").combine_chunks().cast(pa.large_string()).take(pa.array(once))
            return _table(self._stretches(texts, row_keys[once], docs[once], keys, hashes, hot, n))

        right = repeated.select("bucket", "blob")
        return rows.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(run, SCHEMA)

    def _stretches(self, texts, row_keys, docs, keys, hashes, hot, n) -> list[tuple]:
        """The texts' stretches around their repeated anchors (row key, hash, hot), settled here or sent."""
        L, w = self.length, self.length - self.gram + 1
        known = mix(hashes ^ mix(keys.view(np.uint64)))
        sort = np.argsort(known)
        known, hot = known[sort], hot[sort] > 0
        got: list[tuple] = []
        used = 0
        for at, buf, offsets in text_chunks(texts, CHUNK):
            values, first, _, _, items = self.kind.items(buf, offsets)
            c = prefix_hashes(values)
            grams, window = grams_of(c, self.gram), np.flatnonzero(within_rows(len(values), first, L))
            if not len(window):
                continue
            # The first least gram moves on where the least changes, or where the window before began with it.
            least = sliding(grams, w, np.minimum)[window]
            row = np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - L + 1, 0))
            heads = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (grams[window[:-1]] == least[:-1]) | (row[1:] != row[:-1]))))
            size = np.diff(np.append(heads, len(window)))
            start, h, r = window[heads], least[heads], row[heads]
            own = mix(h ^ mix(row_keys[at + r].view(np.uint64)))
            found = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[found] == own
            start, h, r, size, burst = start[hit], h[hit], r[hit], size[hit], hot[found[hit]]
            # Hot anchors: one stretch per window, dealt by the window.
            step = np.arange(int(size[burst].sum())) - np.repeat(np.cumsum(size[burst]) - size[burst], size[burst])
            single = np.repeat(start[burst], size[burst]) + step
            deal = np.concatenate((h[~burst], range_hashes(c, single, single + L)))
            start, r = np.concatenate((start[~burst], single)), np.concatenate((r[~burst], np.repeat(r[burst], size[burst])))
            got.append((deal, start + used, np.concatenate((size[~burst], np.ones(len(single), np.int64))), row_keys[at + r], docs[at + r], start - first[r], items))
            used += len(items)
        if not got:
            return []
        deal, start, size, key, doc, place, pool = (np.concatenate(x) for x in zip(*got))
        return self._settle_and_send(pool, deal, start, size, key, doc, place, n)

    def _settle_and_send(self, pool, deal, start, size, keys, docs, place, n):
        """Marks of stretches equal to an earlier one here, and blobs of the others by bucket."""
        L = self.length
        drop = later(content_ids(pool, start, size + L - 1), docs, keys, place, self.kind.inner)
        out = self._marks(keys[drop], place[drop], size[drop], n)
        keep = np.flatnonzero(~drop)
        for b, part in parts_by((deal[keep] >> np.uint64(32)) % np.uint64(n)):
            mine = keep[part]
            long = size[mine] + L - 1
            out.append((STRETCHES, b, None, None, None, None, None, None, pack(pool[places_of(start[mine], long)], long.astype(np.uint32), deal[mine], keys[mine], docs[mine], place[mine].astype(np.uint32))))
        return out

    def _marks(self, keys, place, windows, n):
        return [(MARKS, b, None, None, None, None, None, None, pack(keys[m], place[m].astype(np.uint32), (place[m] + windows[m] + self.length - 1).astype(np.uint32))) for b, m in parts_by(np.mod(keys, n))]

    # -- pass 3
    def settle(self, sent: DataFrame, n: int) -> DataFrame:
        """Marks (SCHEMA rows) from the stretches of each bucket."""
        L, kinds = self.length, (self.kind.name, np.uint32, np.uint64, np.int64, np.int64, np.uint32)

        def run(table: pa.Table) -> pa.Table:
            items, long, deal, keys, docs, place = concat([unpack(b, *kinds) for b in values_of(table, "payload")], kinds)
            long, place = long.astype(np.int64), place.astype(np.int64)
            start = np.cumsum(long) - long
            ids = content_ids(items, start, long)
            drop = later(ids, docs, keys, place, self.kind.inner)
            out = self._marks(keys[drop], place[drop], long[drop] - L + 1, n)
            # Anchors that still have more than one stretch go to the index.
            rest = np.flatnonzero(~drop)
            _, group, count = np.unique(deal[rest], return_inverse=True, return_counts=True)
            rest = rest[count[group] > 1]
            if len(rest):
                rest = rest[np.argsort(deal[rest], kind="stable")]
                windows = long[rest] - L + 1
                classes = self.index(items, start[rest], long[rest], L, deal[rest])
                owner = np.repeat(np.arange(len(rest)), windows)
                at = place[rest][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                hit = later(classes, docs[rest][owner], keys[rest][owner], at, self.kind.inner)
                hit_keys, hit_at = keys[rest][owner][hit], at[hit]
                order = np.lexsort((hit_at, hit_keys))
                hit_keys, hit_at = hit_keys[order], hit_at[order]
                head = np.ones(len(hit_at), bool)
                head[1:] = (hit_keys[1:] != hit_keys[:-1]) | (hit_at[1:] > hit_at[:-1] + 1)
                heads = np.flatnonzero(head)
                last = np.append(heads[1:], len(hit_at)) - 1
                if len(heads):
                    out += self._marks(hit_keys[heads], hit_at[heads], hit_at[last] - hit_at[heads] + 1, n)
            return _table(out)

        return sent.where(F.col("kind") == STRETCHES).groupBy("bucket").applyInArrow(run, SCHEMA)

    # -- pass 4
    def results(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """Per row: doc_id, n, n_removed, n_spans, sha of what remains, and with keep_text ``payload``, its bytes."""
        kind = self.kind
        small_batches(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        n = n_buckets(rows.select(F.octet_length("text").alias("size")), "size", BUCKET_BYTES)
        rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("bucket", F.pmod("row_key", F.lit(n)).cast("int"))
        repeated = staged(self.repeated_anchors(rows, n))
        give_back(docs.sparkSession)
        sent = staged(self.stretches(rows, repeated, n))
        discard(repeated)
        give_back(docs.sparkSession)
        marks = staged(sent.where(F.col("kind") == MARKS).unionByName(self.settle(sent, n)).select(F.col("bucket").alias("to"), F.col("payload").alias("marks")))
        discard(sent)
        give_back(docs.sparkSession)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _table([])
            parts = [unpack(b, np.int64, np.uint32, np.uint32) for b in values_of(right, "marks")]
            keys, a, b = concat(parts, (np.int64, np.uint32, np.uint32))
            order = np.lexsort((a, keys))
            keys, a, b = keys[order], a[order].astype(np.int64), b[order].astype(np.int64)
            row_keys, given = left.column("row_key").to_numpy(), left.column("doc_id").to_pylist()
            raw, offsets = _buffers(left.column("text").combine_chunks().cast(pa.large_string()))
            lows, highs = np.searchsorted(keys, row_keys, "left").tolist(), np.searchsorted(keys, row_keys, "right").tolist()
            out = []
            for doc, start, end, low, high in zip(given, offsets[:-1].tolist(), offsets[1:].tolist(), lows, highs):
                ranges: list[tuple[int, int]] = []
                for x, y in zip(a[low:high].tolist(), b[low:high].tolist()):
                    if ranges and x <= ranges[-1][1]:
                        ranges[-1] = (ranges[-1][0], max(y, ranges[-1][1]))
                    else:
                        ranges.append((x, y))
                body = raw[start:end].tobytes()
                out.append((DONE, 0, None, doc, *kind.finish(body, ranges), kind.remaining(body, ranges) if keep_text else None))
            return _table(out)

        finished = rows.groupBy("bucket").cogroup(marks.groupBy("to")).applyInArrow(run, SCHEMA)
        return finished.select("doc_id", "n", "n_removed", "n_spans", "sha", *(["payload"] if keep_text else []))
