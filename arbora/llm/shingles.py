"""Sets of 5-word shingles as 64-bit hashes, minwise hashes of them, and exact comparison on words.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A text of fewer words than a shingle, but not none, is one shingle.
Words are told apart by their bytes (a dictionary) and then hashed whole, so words of any structure don't collide.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from arbora.llm.bytework import spread, string_chunks

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses the border of two texts."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] & ~edge[:-1]
    after = np.r_[inside[1:], False] & ~edge[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of each word, the words by code, index of each text's first word)."""
    low = _LOWER[data]
    start, end = word_spans(low, offsets)
    if not len(start):
        return np.zeros(0, np.int64), [], np.zeros(len(offsets), np.int64)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    packed = np.ascontiguousarray(low[~_SPACE[low]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist(), np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    mul = [np.uint64(pow(0x9E6C63D0876A9A47, j, 1 << 64)) for j in range(k)]
    for _, data, offsets in string_chunks(column):
        code, words, at = _coded(data, offsets)
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[code] if words else np.zeros(0, np.uint64)
        n = max(len(word) - k + 1, 0)
        joined = np.zeros(n, np.uint64)
        for j in range(k):
            joined += word[j : j + n] * mul[j]
        joined = spread(joined)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= k:
                yield np.unique(joined[a : b - k + 1])
            elif b > a:
                yield spread(np.atleast_1d((word[a:b] * np.array(mul[: b - a])).sum() + np.uint64(b - a)))
            else:
                yield np.zeros(0, np.uint64)


def exact_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """Sorted numbers of the distinct shingles of each text, equal numbers for equal words: nothing is hashed."""
    (_, data, offsets), = string_chunks(pa.array(texts, pa.large_string()), 1 << 62)
    code, words, at = _coded(data, offsets)
    n = max(len(code) - k + 1, 0)
    number = code[:n]
    for j in range(1, k):
        number = np.unique(number * max(len(words), 1) + code[j : j + n], return_inverse=True)[1].astype(np.int64)
    short: dict[tuple, int] = {}
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            out.append(np.unique(number[a : b - k + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(code[a:b]), len(short))] if b > a else [], np.int64))
    return out


class Minwise:
    """`n` minwise hashes of a set, each as the hash of the selected token."""

    def __init__(self, n: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        out = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(tokens), 256):  # in cache, bounded memory for very long texts
            part = (tokens[i : i + 256, None] ^ self.xor) * self.mul
            np.minimum(out, part.min(axis=0), out=out)
        return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
