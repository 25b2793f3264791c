"""Deduplication by bytes with a run-length index over the stretches that may repeat.

A bucket's stretches are joined into one text, each with its own terminator.  Of its Burrows-Wheeler transform only
the runs stay: per run the text place at its head, the place at the end of the run before (the sampled run ends),
and how long the suffixes at the two match, which is compared byte by byte.  The suffix order goes once the runs
are known.  Texts are streamed against the runs: within a run the neighbour above a place is one after that of the
place before and matches one byte less, so the sample at or before a place gives its matching statistics, how many
bytes match and where.  Places whose neighbour matches ``L`` bytes or more follow it to the first of their class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Bytes, Repeats

WINDOW_BYTES = 100


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in order of their suffixes up to their end (ends: per place); ties by place."""
    bits = len(text).bit_length()
    return _order_in_keys(text, ends, bits) if 3 * bits <= 64 else order_of_many(text, ends)


def order_of_many(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``suffix_order`` of any number of places."""
    n = len(text)
    place = np.arange(n, dtype=np.int64)
    padded = np.concatenate((text.astype(np.uint64) + 1, np.zeros(7, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | np.where(place + j < ends, padded[j : j + n], np.uint64(0))
    depth, longest = 7, int((ends - place).max())
    while True:
        order = np.argsort(key)
        s = key[order]
        head = np.ones(n, bool)
        head[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(head).astype(np.uint64)
        if depth >= longest or head.all():
            break
        ahead = np.minimum(place + depth, n - 1)
        key = rank << np.uint64(32) | np.where(place + depth < ends, rank[ahead], np.uint64(0))
        depth *= 2
    return np.argsort(rank << np.uint64(32) | place.view(np.uint64))


def _order_in_keys(text: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """``suffix_order`` with places of few bits: keys carry them, so plain sorting tells the order."""
    n, shift = len(text), np.uint64(bits)
    place = np.arange(n, dtype=np.uint64)
    left = (ends - np.arange(n)).astype(np.uint64)
    letter = np.zeros(256, np.uint64)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    letter[used] = np.arange(1, len(used) + 1)
    wide = len(used).bit_length()
    depth, longest = (64 - bits) // wide, int(left.max())
    padded = np.concatenate((letter[text], np.zeros(depth, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = key << np.uint64(wide) | np.where(left > np.uint64(j), padded[j : j + n], np.uint64(0))
    while True:
        s = np.sort(key << shift | place)
        order = (s & np.uint64((1 << bits) - 1)).astype(np.int64)
        s >>= shift
        head = np.ones(n, bool)
        head[1:] = s[1:] != s[:-1]
        if depth >= longest or head.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(head).astype(np.uint64)
        ahead = np.zeros(n, np.uint64)
        ahead[: max(n - depth, 0)] = rank[depth:]
        key = rank << shift | np.where(left > np.uint64(depth), ahead, np.uint64(0))
        depth *= 2


class RunIndex:
    """Per run, in order of the text: the place at its head, the place above it and their common bytes."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        order = suffix_order(text, ends)
        starts = np.ones(len(text), bool)
        starts[1:] = ends[1:] != ends[:-1]
        before = np.where(starts[order], 256 + order, text[np.maximum(order - 1, 0)])  # each terminator is a character of its own
        heads = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.places, self.above = np.concatenate((order[:1], order[heads])), np.concatenate(([-1], order[heads - 1]))
        self.common = np.concatenate(([0], _common(text, ends, order[heads - 1], order[heads])))
        by_place = np.argsort(self.places)
        self.places, self.above, self.common = self.places[by_place], self.above[by_place], self.common[by_place]
        self.nbytes = self.places.nbytes + self.above.nbytes + self.common.nbytes

    def matching(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(neighbour above, bytes in common) of places of the text; place 0 starts a run."""
        run = np.searchsorted(self.places, places, "right") - 1
        past = places - self.places[run]
        return self.above[run] + past, np.maximum(self.common[run] - past, 0)

    def classes(self, n: int, length: int, step: int = 1 << 18) -> np.ndarray:
        """Per place of a text of n: a number shared by the places whose next ``length`` items match."""
        first = np.arange(n)
        for s in range(0, n, step):
            above, common = self.matching(first[s : s + step])
            first[s : s + step] = np.where(common >= length, above, first[s : s + step])
        while True:
            ahead = first[first]
            if (ahead == first).all():
                return first
            first = ahead


def _common(text, ends, a, b, step: int = 1 << 15) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    most = np.minimum(ends[a] - a, ends[b] - b)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    live, at = np.arange(len(a)), 0
    while len(live):
        go = []
        for s in range(0, len(live), step):
            part = live[s : s + step]
            width = np.arange(at, at + 16)
            x, y = padded[np.minimum(a[part][:, None] + width, len(text))], padded[np.minimum(b[part][:, None] + width, len(text))]
            same = np.logical_and.accumulate((x == y) & (width < most[part][:, None]), axis=1).sum(axis=1)
            out[part] += same
            go.append(part[same == 16])
        live, at = np.concatenate(go), at + 16
    return out


def classes(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, shard: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """A class per window of the stretches; anchors are indexed together, some ``most`` bytes at a time, never one apart."""
    out, base = [], 0
    head = np.concatenate(([True], shard[1:] != shard[:-1]))
    total = np.cumsum(sizes)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right"))
        high = max(high, low + 1)
        while high < len(starts) and not head[high]:
            high += 1
        size = sizes[low:high]
        own = np.cumsum(size) - size
        text = items[np.repeat(starts[low:high] - own, size) + np.arange(int(size.sum()))]
        ends = np.repeat(own + size, size)
        number = RunIndex(text, ends).classes(len(text), length)
        out.append(base + number[ends - np.arange(len(text)) >= length])
        base += len(text) + 1
        low = high
    return np.concatenate(out)


def byte_dedup(docs: DataFrame, window: int = WINDOW_BYTES, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes): bytes of windows that start earlier too are removed.

    Null and empty texts and those shorter than a window keep all they have; rows of one doc_id are not earlier than
    each other, so repeated rows are judged alike, and a null doc_id is earlier than all; a text of any length is
    hashed megabyte by megabyte, between whole rows; an empty table gives an empty result; extra columns are ignored.
    """
    engine = Repeats(Bytes, window, max(1, min(32, window)), classes)
    found = engine.results(docs, keep_text)
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), *([F.col("payload").alias("kept_bytes")] if keep_text else []))
