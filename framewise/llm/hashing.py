"""Word and shingle hashes of many texts at once, in numpy (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts in a row in lower case with eight zeros behind, where their words begin and end, and where
    each text begins."""
    joined = b" ".join(texts).lower()
    n = len(joined)
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    text_starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), text_starts
    edge = np.empty(n + 1, np.int8)
    solid = (~_SPACE[raw[:n]]).view(np.int8)
    edge[1:n] = solid[1:] - solid[:-1]
    edge[0], edge[n] = solid[0], -solid[-1]
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), text_starts


def _stretch(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of stretches of bytes: eight bytes at a time are added in and scattered, so the sum is no polynomial whose
    roots could be written as words; stretches of over ``LONG`` bytes go through xxHash."""
    size = ends - starts
    eights = np.ndarray(max(len(raw) - 7, 0), "<u8", raw, strides=(1,)) if len(raw) >= 8 else np.zeros(0, np.uint64)
    h = mix(size.astype(np.uint64) + mix(np.array([seed * 2 + 1], np.uint64)))
    at = np.flatnonzero(size <= LONG)
    begin, left, done = starts[at], size[at], 0
    while len(at):
        part = eights[begin + done]
        short = np.minimum(left - done, 8).astype(np.uint64)
        part = part & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
        h[at] = mix(mix(part + h[at]) + (h[at] << np.uint64(1)))
        done += 8
        more = left > done
        at, begin, left = at[more], begin[more], left[more]
    long = np.flatnonzero(size > LONG).tolist()
    if long:
        from xxhash import xxh3_64_intdigest

        h[long] = [xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed) for i in long]
    return h


def words(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin (one more entry at the end). Words
    are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased."""
    raw, starts, ends, text_starts = _split(texts)
    return _stretch(raw, starts, ends, seed), np.searchsorted(starts, text_starts)


def word_features(texts: list[bytes], prefixes: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word of the texts and of its first bytes where it is longer, and the text that each is from."""
    raw, starts, ends, text_starts = _split(texts)
    text = np.searchsorted(text_starts, starts, "right") - 1
    hashed, of = [_stretch(raw, starts, ends)], [text]
    for k in prefixes:
        longer = ends - starts > k
        hashed.append(mix(_stretch(raw, starts[longer], starts[longer] + k) + np.uint64(k)))
        of.append(text[longer])
    return np.concatenate(hashed), np.concatenate(of)


def shingles(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` words in a row at every position that has so many after it."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = (x + hashed[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
    return mix(x + np.uint64(k))


def shingle_sets(texts: list[bytes], k: int, seed: int = 0) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of fewer words has one shingle, all of it; none has none."""
    for block in blocks(texts):
        hashed, at = words(block, seed)
        rolled = shingles(hashed, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            else:
                yield shingles(hashed[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def blocks(texts: list[bytes], limit: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts in lists of about ``limit`` bytes, so that the arrays stay small."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > limit:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) + 1
    if block:
        yield block


def encoded(series) -> list[bytes]:
    """UTF-8 bytes of a column of texts, null as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in series]
