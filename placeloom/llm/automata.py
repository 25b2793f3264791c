"""Substring deduplication by words: suffix automata give, per window, the class of its equals.

The reference of a shard is what all its streams may share: the stretches around one anchor.  Its automaton
goes only to the streams that hold the anchor (a broadcast of every shard to every task would grow with the
corpus).  A stream is run through the automaton for its matching statistics; where at least ``L`` words match,
the state whose strings include the window's last ``L`` words names its class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Repeats, Words

WINDOW_WORDS = 13


class SuffixAutomaton:
    """Of several sequences, extended one after another."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            if c in nxt[last]:
                q = nxt[last][c]
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def matches(self, sequence, least: int):
        """For each place from least - 1: the state of the last ``least`` items if they match, else -1."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            while state and length[link[state]] >= least:
                state = link[state]
                size = min(size, length[state])
            if i >= least - 1:
                out.append(state if size >= least else -1)
        return out


def classes(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, shard: np.ndarray) -> np.ndarray:
    """A class per window of the stretches (in order of shard): equal windows of a shard have one state."""
    out: list[int] = []
    base = 0
    cuts = np.append(np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), len(shard)).tolist()
    for low, high in zip(cuts, cuts[1:]):
        streams = [items[s : s + n].tolist() for s, n in zip(starts[low:high].tolist(), sizes[low:high].tolist())]
        automaton = SuffixAutomaton()
        for stream in streams:
            automaton.add(stream)
        for stream in streams:
            out += [base + s for s in automaton.matches(stream, length)]
        base += len(automaton.next)
    return np.array(out, np.int64)


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, n_spans, kept_sha256 (and kept_text): words of windows that an earlier document holds are removed.

    Null and empty texts and those of fewer words than a window keep all they have; rows of one doc_id are one
    document, so repeated rows are judged alike, and a null doc_id is earlier than all; texts of any length are kept
    whole; an empty table gives an empty result; extra columns are ignored.
    """
    engine = Repeats(Words, window, max(1, min(5, window)), classes)
    found = engine.results(docs, keep_text)
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), *([F.decode("payload", "UTF-8").alias("kept_text")] if keep_text else []))
