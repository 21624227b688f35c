"""Byte-level numpy work on Arrow string columns: hashing windows and words without a Python loop over characters."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
_powers: dict[str, np.ndarray] = {}


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes close ones differ in all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """P with (P[e] - P[s]) * BASE^-s a hash of data[s:e], whatever s is."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = powers(len(sums))[1]
    return spread((sums[end] - sums[start]) * down[start])


def string_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of first row, bytes, offsets) runs of about `limit` bytes; a null is empty, a long text a run of its own."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
