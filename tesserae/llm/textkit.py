"""Word hashes of many texts at once, on their UTF-8 bytes.

Separators and upper-case letters that matter here are ASCII, so bytes can be
treated alone.  A word's hash is a polynomial in random byte values modulo
2**64, mixed; two different words share one with a chance near 2**-64.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
#: Bytes handled at once; a longer text is a chunk of its own.
CHUNK = 1 << 21
#: As for CHUNK, where a task makes shingle sets of whole batches: what it takes for a byte is some 60 bytes.
SET_CHUNK = 1 << 19

_random = np.random.default_rng(20240607)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {}


def mix(x):
    """Spreads every bit of 64-bit integers over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int):
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, min(CHUNK, 2 * n) + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, U(base))
            steps[0] = U(1)
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"]


def chunks(column, limit: int = CHUNK):
    """An Arrow string column in runs of rows: (first row, end row, bytes, offsets of the rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data, at, fold=LOWER):
    """Starts, ends and hashes of all words, and the index of each row's first word (one more at the end)."""
    n = len(data)
    apart = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = apart[:-1]
    starts = np.flatnonzero(~apart & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = apart[1:]
    ends = np.flatnonzero(~apart & (after | edge[1:])) + 1
    return starts, ends, span_hashes(data, starts, ends, fold), np.searchsorted(starts, at)


def span_hashes(data, starts, ends, fold=LOWER):
    """Hashes of the byte spans [start, end)."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[fold[data]] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes, first, k: int = 5):
    """Hashes of every k words of each row, in order, and each row's first index.

    A row of fewer than k words has its whole sequence as one; a row without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), np.uint64)
    scale = [U(pow(STEP, j, 1 << 64)) for j in range(k)]
    if len(hashes) >= k:
        total = len(hashes) - k + 1
        whole = np.zeros(total, np.uint64)
        for j in range(k):
            whole += hashes[j : j + total] * scale[j]
        row = np.repeat(np.arange(len(n)), n)[:total]
        place = np.arange(total)
        ok = place + k <= first[row + 1]
        out[at[row[ok]] + place[ok] - first[row[ok]]] = mix(whole[ok])
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        own = n[few].astype(np.uint64)
        for j in range(k - 1):
            has = n[few] > j
            own[has] += hashes[first[few[has]] + j] * scale[j]
        out[at[few]] = mix(own ^ U(0x5851F42D4C957F2D))
    return out, at


def distinct(values):
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(column, k: int = 5):
    """Sorted distinct shingle hashes of each row of an Arrow string column, row by row."""
    for _, _, data, at in chunks(column, SET_CHUNK):
        _, _, hashes, first = words(data, at)
        found, at = shingles(hashes, first, k)
        for a, b in zip(at[:-1], at[1:]):
            yield distinct(found[a:b])


def signed(values):
    return values.view(np.int64)


def planes(values, width: int) -> bytes:
    """Unsigned integers as byte planes, the low ``width`` bytes of each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(raw: bytes, n: int, width: int):
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack(*parts: bytes) -> bytes:
    body = b"".join(parts)
    head = np.array([len(body), *map(len, parts)], "<i8").tobytes()
    return np.array([len(parts)], "<i8").tobytes() + head + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[bytes]:
    k = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", k + 1, 8)
    body = pa.decompress(blob[8 * (k + 2) :], decompressed_size=int(sizes[0]), codec="zstd", asbytes=True)
    cuts = np.concatenate([[0], np.cumsum(sizes[1:])])
    return [body[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
