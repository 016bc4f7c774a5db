"""Ratings on their way to where they meet, many in one binary: what moves then is some two bytes a rating.

Ids that ascend are sent as differences of variable length, and ratings as places among their few different values; where there are
many, they are sent as they are. What comes out is bit for bit what went in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX = np.uint64(0x9E3779B97F4A7C15)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each id, from the id alone."""
    x = ids.astype(np.int64, copy=False).view(np.uint64) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return ((x >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _varints(values: np.ndarray) -> bytes:
    values = values.astype(np.int64, copy=False).view(np.uint64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        n += more
    start = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        here = np.flatnonzero(n > k)
        low = (values[here] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[here] + k] = low | np.where(n[here] > k + 1, np.uint64(128), np.uint64(0))
    return out.tobytes()


def _from_varints(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    start = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    n = last - start + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(n.max(initial=0))):
        here = np.flatnonzero(n > k)
        out[here] |= (data[start[here] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out.view(np.int64)


def _reals(values: np.ndarray) -> tuple[bytes, bytes]:
    """The different values and each value's place among them; all as they are if they are many."""
    bits = values.astype(np.float64, copy=False).view(np.int64)
    different, place = np.unique(bits, return_inverse=True)
    if len(different) > 256 or 8 * len(different) > 7 * len(bits):
        return b"", bits.tobytes()
    return different.tobytes(), place.astype(np.uint8).tobytes()


def _from_reals(different: np.ndarray, rest: np.ndarray) -> np.ndarray:
    if not len(different):
        return rest.view(np.float64)
    return different.view(np.float64)[rest]


def _sealed(parts: list[bytes]) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + squeeze.compress(b"".join(parts)) + squeeze.flush()


def _opened(blob: bytes, n: int) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{n}q", blob)
    data = np.frombuffer(zlib.decompress(memoryview(blob)[8 * n :]), np.uint8)
    ends = np.cumsum(sizes)
    return [data[e - s : e].copy() for s, e in zip(sizes, ends)]


def steps(ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences within lists, and of each list's first id from ``first``."""
    out = np.diff(ids, prepend=ids[:1])
    begin = np.cumsum(sizes) - sizes
    some = sizes > 0
    out[begin[some]] = ids[begin[some]] - first[some]
    return out


def _unstep(out: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.cumsum(out)
    begin = np.cumsum(sizes) - sizes
    some = sizes > 0
    before = np.zeros(len(sizes), np.int64)
    before[some] = sums[begin[some]] - out[begin[some]]
    return sums + np.repeat(first - before, sizes)


def pack(key: np.ndarray, base: np.ndarray, x: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ys: np.ndarray, after: bool = True) -> bytes:
    """Records (key, base, x), each with a list of ascending (ids, ys). ``after``: the ids come after their key, and are of its kind."""
    first = key if after else np.zeros_like(key)
    return _sealed([_varints(steps(key, np.array([len(key)]), np.zeros(1, np.int64))), base.astype(np.float64).tobytes(), *_reals(x), _varints(sizes), _varints(steps(ids, sizes, first)), *_reals(ys)])


def unpack(blob: bytes, after: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, base, x_of, x, sizes, ids, y_of, y = _opened(blob, 8)
    key = _from_varints(key)
    key, sizes = _unstep(key, np.array([len(key)]), np.zeros(1, np.int64)), _from_varints(sizes)
    first = key if after else np.zeros_like(key)
    return key, base.view(np.float64), _from_reals(x_of, x), sizes, _unstep(_from_varints(ids), sizes, first), _from_reals(y_of, y)


def spans(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for sizes[0] places, then the same of the others."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)


def lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Sizes of the lists, null ones empty, and all their elements."""
    sizes = np.diff(column.offsets.to_numpy())
    return sizes, column.flatten()


def filled(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def chunks(sizes: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Runs of records that hold some ``at_once`` elements; a record is not cut."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + at_once, "right")))
        yield at, to
        at = to
