"""Token-ID output: shards that hold a wavelet matrix over token ids, and the document bounds.

A shard is one row of a Parquet file in the given folder: ``shard``, ``n_tokens``, ``doc_ids`` and ``blob``;
a file holds the shards of one range of documents, in order.  The blob is ``PLWM``, then little-endian
uint32 bit count, uint64 tokens, uint64 documents, the documents' end offsets (uint64), and for each
bit-plane from the highest: uint64 zeros, the ranks before each 4096th bit (uint32), the packed bits.
Spark's commit protocol writes the files, so lost tasks leave none behind.

Nulls and empty texts hold just the end id.  Equal ids are ordered by text; null ids come first.  An empty
table makes no shard.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import AS_IS, SPACED, release, split_words, text_chunks
from .common import n_buckets, small_batches

_MAGIC, _STEP = b"PLWM", 4096
SHARD_TOKENS = 4 << 20
#: Encoded words in a worker's younger generation of words.
CACHED_WORDS = 250_000


class WaveletMatrix:
    """Bit-planes of a sequence of ids.  Access, rank and select take a step a plane, each within one block of bits (select finds the block by a binary search of the ranks)."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now, n = [], ids, len(ids)
        spare = [np.empty_like(ids), np.empty_like(ids)]
        for b in range(bits - 1, -1, -1):
            ones = (now & np.asarray(1 << b, now.dtype)) != 0
            packed = np.packbits(ones, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), _STEP // 8), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
            ranks = np.concatenate(([0], np.cumsum(counts, dtype=np.uint32)[:-1])).astype(np.uint32) if len(counts) else counts
            zeros = n - int(np.count_nonzero(ones))
            np.compress(~ones, now, out=spare[0][:zeros])
            np.compress(ones, now, out=spare[0][zeros:])
            planes.append((zeros, ranks, packed))
            now = spare[0]
            spare.reverse()
        return cls(len(ids), planes)

    def ids(self) -> np.ndarray:
        """The whole sequence, unwound from the lowest plane upwards."""
        bits = len(self.planes)
        now = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for b, (zeros, _, packed) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            now[zeros:] |= np.asarray(1 << b, now.dtype)
            up = np.empty_like(now)
            up[np.flatnonzero(~ones)] = now[:zeros]
            up[np.flatnonzero(ones)] = now[zeros:]
            now = up
        return now

    def _ones(self, plane: int, i: int) -> int:
        _, ranks, packed = self.planes[plane]
        if i <= 0:
            return 0
        block = min(i // _STEP, len(ranks) - 1)
        whole = packed[block * _STEP // 8 : i // 8]
        rest = int(packed[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(ranks[block]) + int(np.bitwise_count(whole).sum()) + rest.bit_count()

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][2][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        value = 0
        for p, (zeros, _, _) in enumerate(self.planes):
            bit, ones = self._bit(p, i), self._ones(p, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for p, (zeros, _, _) in enumerate(self.planes):
            ones_a, ones_b = self._ones(p, a), self._ones(p, b)
            a, b = (zeros + ones_a, zeros + ones_b) if token >> (len(self.planes) - 1 - p) & 1 else (a - ones_a, b - ones_b)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of the kind: a block by its rank, then a byte, then the bit."""
        _, ranks, packed = self.planes[plane]
        before = ranks.astype(np.int64) if bit else np.arange(len(ranks)) * _STEP - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        part = packed[block * _STEP // 8 : (block + 1) * _STEP // 8]
        counts = np.cumsum(np.bitwise_count(part if bit else ~part), dtype=np.int64)
        rest = k - int(before[block])
        byte = int(np.searchsorted(counts, rest, "right"))
        rest -= int(counts[byte - 1]) if byte else 0
        value = int(part[byte]) if bit else ~int(part[byte]) & 255
        at = [i for i in range(8) if value >> i & 1][rest]
        return block * _STEP + 8 * byte + at

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0; -1 if there are fewer.  Up the planes, a step of ``_find`` each."""
        if k < 0 or k >= self.count(token):
            return -1
        bits = len(self.planes)
        at = self._range(token, 0)[0] + k
        for p in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - p) & 1
            at = self._find(p, bit, at - self.planes[p][0] if bit else at)
        return at

    def to_bytes(self, ends: np.ndarray) -> bytes:
        out = [_MAGIC, struct.pack("<IQQ", len(self.planes), self.n, len(ends)), ends.astype("<u8").tobytes()]
        for zeros, ranks, packed in self.planes:
            out += [struct.pack("<Q", zeros), ranks.astype("<u4").tobytes(), packed.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[WaveletMatrix, np.ndarray]:
        if blob[:4] != _MAGIC:
            raise ValueError("not a token shard")
        bits, n, docs = struct.unpack_from("<IQQ", blob, 4)
        at = 24
        ends = np.frombuffer(blob, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        planes = []
        for _ in range(bits):
            (zeros,) = struct.unpack_from("<Q", blob, at)
            blocks, size = -(-n // _STEP), -(-n // 8)
            ranks = np.frombuffer(blob, "<u4", blocks, at + 8)
            planes.append((zeros, ranks, np.frombuffer(blob, np.uint8, size, at + 8 + 4 * blocks)))
            at += 8 + 4 * blocks + size
        return cls(n, planes), ends


class _Words:
    """Ids of words by hash, in one pool."""

    def __init__(self):
        self.hashes, self.table = np.zeros(0, np.uint64), pd.Index(np.zeros(0, np.uint64))
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for those not held."""
        return self.table.get_indexer(hashes)

    def add(self, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.pool = np.concatenate((self.pool, flat))
        self.hashes = np.concatenate((self.hashes, hashes))
        self.table = pd.Index(self.hashes)

    def ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, how many of each)."""
        lengths = self.lengths[index]
        before = np.cumsum(lengths) - lengths
        return self.pool[np.repeat(self.starts[index] - before, lengths) + np.arange(int(lengths.sum()))], lengths


_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STOP[[ord(c) for c in ".,;:!?"]] = True


def _pieces(words: list[str], buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for words of letters, 2 for such with one stop behind, 0 for all others.

    Tokenizers that part runs of letters from what follows make so many pieces of them.
    """
    other = np.concatenate(([0], np.cumsum(~_LETTER[buf], dtype=np.int64)))
    odd, stop = other[ends] - other[starts], _STOP[buf[ends - 1]]
    out = np.where(odd == 0, 1, np.where((odd == 1) & stop & (ends - starts > 1), 2, 0))
    high = np.concatenate(([0], np.cumsum(buf >= 0x80, dtype=np.int64)))
    for i in np.flatnonzero((out == 0) & (high[ends] > high[starts])).tolist():
        core = words[i][:-1] if stop[i] else words[i]
        if core.isalpha() and core.lower().isalpha():
            out[i] = 1 + int(stop[i])
    return out


class WordEncoder:
    """Encodes texts word by word, and a word again only when it has not been met for long.

    The tokenizer must drop white space and never join what white space parts, as this vocabulary does.
    Words are told apart by 64-bit hashes.  Two generations of words are kept: when the younger is full, the
    older goes, so memory is bounded and common words stay.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.uint16 if self.size <= 1 << 16 else np.uint32
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:
            self.last = np.zeros(self.size, bool)
            self.last[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.young, self.old = _Words(), _Words()

    def _learn(self, words: list[str], parts: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each) of words; ``parts``: how many pieces each is parted into before it is encoded, 0 for unknown."""
        known = np.flatnonzero(parts > 0) if self.last is not None else np.zeros(0, np.int64)
        flat, lengths = np.zeros(0, self.type), np.zeros(len(words), np.int64)
        plain = None
        if len(known):
            # The last token of each piece tells where it ends, so no offsets are needed.
            joined = [" ".join([words[j] for j in known[i : i + step].tolist()]) for i in range(0, len(known), step)]
            plain = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)), self.type)
            ends = np.flatnonzero(self.last[plain]) + 1
            pieces = np.cumsum(parts[known])
            if len(ends) == pieces[-1]:
                lengths[known] = np.diff(ends[pieces - 1], prepend=0)
            else:
                known = known[:0]
        rest = np.setdiff1d(np.arange(len(words)), known, assume_unique=True)
        odd, sizes = self._learn_by_offsets([words[i] for i in rest.tolist()], step)
        lengths[rest] = sizes
        # In the order of the words.
        begin = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), self.type)
        for mine, ids in ((known, plain), (rest, odd)):
            if len(mine):
                n = lengths[mine]
                flat[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, lengths

    def _learn_by_offsets(self, words: list[str], step: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a line break apart are encoded together; offsets tell whose an id is."""
        joined = ["\n".join(words[i : i + step]) for i in range(0, len(words), step)]
        flat, lengths = [np.zeros(0, self.type)], [np.zeros(0, np.int64)]
        for i, e in enumerate(self.tokenizer.encode_batch(joined, add_special_tokens=False)):
            mine = words[i * step : (i + 1) * step]
            sizes = np.fromiter(map(len, mine), np.int64, len(mine)) + 1
            ids = e.ids
            at = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(ids))[::2]
            flat.append(np.array(ids, self.type))
            lengths.append(np.bincount(np.searchsorted(np.cumsum(sizes), at, "right"), minlength=len(mine)))
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each followed by end_id; ends of the rows)."""
        starts, ends, first, hashes = split_words(buf, offsets, SPACED, AS_IS)
        number, unique = pd.factorize(hashes)
        if len(self.young.hashes) > CACHED_WORDS:
            self.old, self.young = self.young, _Words()
        known = self.young.find(unique)
        new = np.flatnonzero(known < 0)
        before = self.old.find(unique[new])
        again, new = new[before >= 0], new[before < 0]
        added = [(unique[again], *self.old.ids(before[before >= 0]))]
        if len(new):
            place = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))[new]
            raw, from_, to = buf.tobytes(), starts[place], ends[place]
            words = [raw[a:b].decode() for a, b in zip(from_.tolist(), to.tolist())]
            added.append((unique[new], *self._learn(words, _pieces(words, buf, from_, to))))
        known[np.concatenate((again, new))] = len(self.young.hashes) + np.arange(len(again) + len(new))
        if len(again) + len(new):
            self.young.add(*(np.concatenate(x) for x in zip(*added)))
        body, lengths = self.young.ids(known[number])
        at = np.concatenate(([0], np.cumsum(lengths)))
        rows = len(offsets) - 1
        row_ends = at[first[1:]] + np.arange(1, rows + 1)
        out = np.empty(len(body) + rows, self.type if end_id <= np.iinfo(self.type).max else np.uint32)
        inside = np.ones(len(out), bool)
        inside[row_ends - 1] = False
        out[row_ends - 1] = end_id
        out[inside] = body
        return out, row_ends


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; it outlives the task."""
    kept = sys.modules.setdefault("_placeloom_encoders", types.ModuleType("_placeloom_encoders")).__dict__
    return kept.get(path) or kept.setdefault(path, WordEncoder(path))


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, order: tuple = ("doc_id", "text"), shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes every text and writes the shards, documents in ascending ``order``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c) for c in order if c not in ("doc_id", "text")))
    n = n_buckets(rows.select(F.octet_length("text").alias("size")), "size")
    dealt = rows.repartitionByRange(n, *[c for c in order if c != "text"]).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        words, at = None, TaskContext.get().partitionId() << 24
        ids, ends, doc_ids, total = [], [], [], 0

        def shard():
            sequence = np.concatenate(ids)
            bits = max(1, int(max(words.size - 1, end_id)).bit_length())
            blob = WaveletMatrix.build(sequence.astype(np.uint16) if bits <= 16 else sequence, bits).to_bytes(np.concatenate(ends))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["shard", "n_tokens", "doc_ids", "blob"])

        for batch in batches:
            words = words or encoder(vocabulary)
            docs_of = batch.column(0).to_pylist()
            for row, buf, offsets in text_chunks(batch.column(1), min(2 << 20, 2 * shard_tokens)):
                got, row_ends = words.encode(buf, offsets, end_id)
                ids.append(got)
                ends.append(row_ends + total)
                doc_ids += docs_of[row : row + len(row_ends)]
                total += len(got)
                if total >= shard_tokens:
                    yield shard()
                    ids, ends, doc_ids, total, at = [], [], [], 0, at + 1
        if doc_ids:
            yield shard()
        ids, ends, doc_ids = [], [], []
        release()

    dealt.mapInArrow(run, "shard long, n_tokens long, doc_ids array<long>, blob binary").write.option("compression", "zstd").parquet(folder)


def occurrences(spark, folder: str, token: int) -> DataFrame:
    """(shard, doc_id, place): where the token stands in the documents, found in each shard by select, without decoding it."""
    files = spark.read.schema("shard long, n_tokens long, doc_ids array<long>, blob binary").parquet(folder)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                matrix, ends = WaveletMatrix.from_bytes(batch.column(2)[i].as_py())
                n = matrix.count(token)
                for s in range(0, n, 1 << 16):
                    at = np.fromiter((matrix.select(token, k) for k in range(s, min(n, s + (1 << 16)))), np.int64)
                    doc = np.searchsorted(ends, at, "right")
                    begins = np.concatenate(([0], ends[:-1]))[doc]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(at), pa.int64()), batch.column(1)[i].values.take(pa.array(doc)), pa.array(at - begins)], ["shard", "doc_id", "place"])

    return files.select("shard", "doc_ids", "blob").mapInArrow(run, "shard long, doc_id long, place long")


def read_shards(spark, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema("shard long, n_tokens long, doc_ids array<long>, blob binary").parquet(folder)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                matrix, ends = WaveletMatrix.from_bytes(batch.column(3)[i].as_py())
                ids = matrix.ids().astype("<u4")
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(ends), pa.int64()), batch.column(2)[i].values, pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])
        release()

    decoded = files.select("shard", "n_tokens", "doc_ids", "blob").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Tokens before each shard: sums of groups of shards first, so no task orders more than a group or all groups.
    shards = files.select("shard", "n_tokens").withColumn("part", F.shiftright("shard", 34))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    before = shards.join(parts, "part").select("shard", (F.col("parts_before") + F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    return decoded.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
