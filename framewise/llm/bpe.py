"""Byte-level BPE by a table of ranks: a minimal perfect hash, then a heap.

A text is cut by the vocabulary's pattern; each cut is encoded by itself. Tier one finds the cuts that are tokens as they
stand: a minimal perfect hash over the vocabulary, looked up for all different cuts of a block of texts at once and held
against the token's own bytes. Tier two merges the bytes of the cuts that are left: the bytes are a linked list, a heap
gives the neighbours of least rank, the leftmost first.

Vocabulary and hash are built once by the driver and sent to the executors; they are as large as the rank file, whatever
the corpus. Texts never leave their task. Memory of a task is a block of cuts and, for one cut that is no token, a few
numbers a byte of it.

Null and empty texts have no ids, and no ids decode to nothing. All columns of the input stay; a column called like an
output column is an error.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing

#: Letters and numbers assigned after Unicode 16. To the library, whose tables end there, they are signs, as
#: all that is not assigned; the pattern's own tables here know them.
LATE = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
#: Any character from the first of them on; texts without one, as most in Latin letters, are not searched for each.
HIGH = re.compile("[\u0558-\U0010ffff]")
#: Cuts that are looked up together.
BLOCK = 1 << 18
#: Merged cuts of at most so many bytes are kept for later blocks, at most twice so many of them.
KEPT_BYTES, KEPT = 64, 1 << 18
#: Keys a bucket of the perfect hash has on average, and seeds that are tried before a larger first seed is taken.
LOAD, TRIES = 4, 1 << 16


def _place(hashed: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (hashing.mix(hashed ^ hashing.mix(seed.astype(np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """A place below ``n`` of its own for each of ``n`` different 64-bit numbers; other numbers get some place, too."""

    n: int
    seeds: np.ndarray

    @classmethod
    def of(cls, hashed: np.ndarray) -> PerfectHash:
        """Keys are dealt to buckets; from the largest bucket on, each gets the first seed that sends all its keys to
        places that are still free."""
        n = len(hashed)
        n_buckets = max(1, -(-n // LOAD))
        bucket = (hashed % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
        free, seeds = np.ones(n, bool), np.zeros(n_buckets, np.uint32)
        step = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-np.diff(ends, prepend=0), kind="stable").tolist():
            keys = hashed[order[(ends[b - 1] if b else 0) : ends[b]]]
            if not len(keys):
                break
            for first in range(0, TRIES * 256, 256):
                places = _place(keys[None, :], (step + np.uint64(first))[:, None], n)
                fits = free[places].all(1)
                if len(keys) > 1:
                    ordered = np.sort(places, axis=1)
                    fits &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if fits.any():
                    at = int(fits.argmax())
                    seeds[b] = first + at
                    free[places[at]] = False
                    break
            else:
                raise ValueError("no seed parts the keys of a bucket; are two keys equal?")
        return cls(n, seeds)

    def places(self, hashed: np.ndarray) -> np.ndarray:
        return _place(hashed, self.seeds[(hashed % np.uint64(len(self.seeds))).astype(np.int64)], self.n)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ``sizes[i]`` places from ``starts[i]`` on, for all i in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by the place that the perfect hash gives them, and by rank."""

    pattern: str
    tokens: tuple[bytes, ...]
    hash: PerfectHash
    rank_at: np.ndarray

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: a line a token, its bytes in base 64 and its rank, from 0 on without gaps."""
        ranks = {}
        with open(path, "rb") as lines:
            for token, rank in (line.split() for line in lines if line.strip()):
                ranks[int(rank)] = base64.b64decode(token)
        return cls.of([ranks[i] for i in range(len(ranks))], pattern)

    @classmethod
    def of(cls, tokens: list[bytes], pattern: str) -> Vocabulary:
        if any(len(t) == 1 for t in tokens) and len({t for t in tokens if len(t) == 1}) < 256 or len({*tokens}) < len(tokens):
            raise ValueError("a byte-level vocabulary has each of the 256 bytes and no token twice")
        hashed = _hashes(b"".join(tokens), np.cumsum([len(t) for t in tokens]))
        found = PerfectHash.of(hashed)
        rank_at = np.zeros(len(tokens), np.int64)
        rank_at[found.places(hashed)] = np.arange(len(tokens))
        return cls(pattern, tuple(tokens), found, rank_at)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def cut(self):
        import regex

        return regex.compile(self.pattern)

    @cached_property
    def late(self) -> re.Pattern:
        return re.compile(f"[{''.join('-'.join(chr(int(c, 16)) for c in r.split('-')) for r in LATE.split())}]")

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    @cached_property
    def kept(self) -> dict[bytes, bytes]:
        return {}

    @cached_property
    def older(self) -> dict[bytes, bytes]:
        return {}

    @cached_property
    def single(self) -> list[int]:
        return [self.ranks[bytes([b])] for b in range(256)]

    @cached_property
    def flat(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.tokens), np.uint8)

    def whole(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Tier one: the ranks of cuts that are tokens, -1 of others; cuts lie in a row in ``data``, each up to its end."""
        rank = self.rank_at[self.hash.places(_hashes(data, ends))]
        sizes = np.diff(ends, prepend=0)
        same = np.flatnonzero(self.sizes[rank] == sizes)
        raw = np.frombuffer(data, np.uint8)
        equal = raw[_ragged((ends - sizes)[same], sizes[same])] == self.flat[_ragged(self.starts[rank[same]], sizes[same])]
        first = np.cumsum(sizes[same]) - sizes[same]
        out = np.full(len(ends), -1, np.int64)
        if len(same):
            out[same] = np.where(np.logical_and.reduceat(equal, first), rank[same], -1)
        return out

    def merged(self, cut: bytes) -> list[int]:
        """Tier two: the ids of a cut that is no token. Of neighbours whose joint bytes are a token, those of least rank are
        joined first, and of equal ones the leftmost."""
        n, ranks, shift = len(cut), self.ranks, len(cut).bit_length()
        most = (1 << shift) - 1
        ids = [self.single[b] for b in cut]  # of the part that begins here
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # where the part that begins here ends; where the one before it begins
        heap = [(r << shift | i) << shift | i + 2 for i in range(n - 1) if (r := ranks.get(cut[i : i + 2])) is not None]  # rank, begin, end
        heapq.heapify(heap)
        while heap:
            first = heapq.heappop(heap)
            end = first & most
            first >>= shift
            i = first & most
            middle = after[i]
            if middle < 0 or middle >= end or after[middle] != end:
                continue  # one of the two has been joined with another since
            ids[i] = first >> shift
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(cut[i : after[end]])) is not None:
                    heapq.heappush(heap, (r << shift | i) << shift | after[end])
            j = before[i]
            if j >= 0 and (r := ranks.get(cut[j:end])) is not None:
                heapq.heappush(heap, (r << shift | j) << shift | end)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merged_once(self, cut: bytes) -> bytes:
        """``merged``, remembered for short cuts: those since the last time that so many were kept, and those before."""
        ids = self.kept.get(cut)
        if ids is None:
            ids = self.older.pop(cut, None) or array("I", self.merged(cut)).tobytes()  # four bytes, little-endian, on these machines
            if len(cut) <= KEPT_BYTES:
                if len(self.kept) >= KEPT:
                    self.older.clear()
                    self.older.update(self.kept)
                    self.kept.clear()
                self.kept[cut] = ids
        return ids

    def cuts_of(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(number of the text, some of its cuts), in order; a long text comes in several pieces."""
        for at, text in enumerate(texts):
            late = HIGH.search(text) and self.late.search(text)
            if len(text) < 1 << 20 and not late:
                yield at, self.cut.findall(text)
            else:
                shown = self.late.sub("\ue000", text) if late else text  # a sign, as long as what it stands for
                found = (text[m.start() : m.end()] for m in self.cut.finditer(shown))
                while some := [*islice(found, BLOCK)]:
                    yield at, some

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out, held, of, counts = [[] for _ in texts], [], [], []

        def flush() -> None:
            if not held:
                return
            ids, n_ids = self._encode_cuts(held)
            first = np.concatenate([[0], np.cumsum(n_ids)])
            at = 0
            for text, n in zip(of, counts, strict=True):
                out[text].append(ids[first[at] : first[at + n]].tobytes())
                at += n
            held.clear(), of.clear(), counts.clear()

        for text, cuts in self.cuts_of(texts):
            held += cuts
            of.append(text)
            counts.append(len(cuts))
            if len(held) >= BLOCK:
                flush()
        flush()
        return [b"".join(parts) for parts in out]

    def _encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all cuts in a row, and how many each has; every different cut is looked up once."""
        coded = pa.array(cuts, pa.string()).dictionary_encode()
        which = coded.indices.to_numpy()
        _, offsets, data = coded.dictionary.buffers()
        ends = np.frombuffer(offsets, np.int32, len(coded.dictionary) + 1).astype(np.int64)[1:]
        data = data.to_pybytes()[: ends[-1]]
        rank = self.whole(data, ends)
        missing = np.flatnonzero(rank < 0)
        more = [self.merged_once(data[a:b]) for a, b in zip(np.where(missing, ends[missing - 1], 0).tolist(), ends[missing].tolist(), strict=True)]
        sizes = np.ones(len(ends), np.int64)
        sizes[missing] = np.fromiter(map(len, more), np.int64, len(more)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), "<u4")
        found = np.flatnonzero(rank >= 0)
        flat[starts[found]] = rank[found]
        if more:
            flat[_ragged(starts[missing], sizes[missing])] = np.frombuffer(b"".join(more), "<u4")
        n_ids = sizes[which]
        return flat[_ragged(starts[which], n_ids)], n_ids

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id that is no token is an error."""
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(found) and found.max() >= len(self.tokens):
            raise ValueError(f"id {found.max()} is not below {len(self.tokens)}")
        return b"".join(self.flat[_ragged(self.starts[part], self.sizes[part])].tobytes() for part in np.split(found, range(BLOCK, len(found), BLOCK)))


def _hashes(data: bytes, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the strings that lie in a row in ``data``."""
    return hashing._stretch(np.frombuffer(data + bytes(8), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def _mapped(frame: DataFrame, source: str, made: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """``frame`` with the columns ``made`` that ``make`` gives for the values of ``source``."""
    clash = {name.lower() for name, _, _ in made} & {c.lower() for c in frame.columns}
    if clash:
        raise ValueError(f"{sorted(clash)} are columns already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, (name, _, kind) in zip(make(batch.column(source).to_pylist()), made, strict=True):
                batch = batch.append_column(name, pa.array(column, kind))
            yield batch

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *[T.StructField(name, kind) for name, kind, _ in made]]))


class Codec:
    """A vocabulary on the executors of ``spark``."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.sent = spark.sparkContext.broadcast(Vocabulary.read(path, pattern))

    def encode(self, documents: DataFrame, text: str = "text") -> DataFrame:
        """``documents`` with ``ids``, little-endian unsigned 32-bit numbers in a row, and ``n_tokens``."""
        sent = self.sent

        def make(texts: list[str | None]) -> list[list]:
            ids = sent.value.encode([t or "" for t in texts])
            return [ids, [len(i) // 4 for i in ids]]

        return _mapped(documents.withColumn(text, F.col(text).cast("string")), text, [("ids", T.BinaryType(), pa.binary()), ("n_tokens", T.LongType(), pa.int64())], make)

    def decode(self, encoded: DataFrame, ids: str = "ids") -> DataFrame:
        """``encoded`` with ``decoded``, the bytes of its ids; null ids are none."""
        sent = self.sent
        return _mapped(encoded, ids, [("decoded", T.BinaryType(), pa.binary())], lambda many: [[sent.value.decode(i or b"") for i in many]])
