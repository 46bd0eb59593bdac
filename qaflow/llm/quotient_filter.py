"""A counting quotient filter that loses nothing: a sorted multiset of packed n-grams in few bytes an entry.

Three ids of ``bits`` bits are one number. An invertible permutation of all such numbers (a Feistel network) spreads them
evenly; the upper bits of the result name the shard, the next ones are the *quotient*, all that is left is the *remainder*.
Nothing is cut off, so quotient and remainder give the ids back. A filter holds the entries of one shard in the order of
the permuted numbers: a bit for each quotient tells whether it occurs, a bit for each entry whether it is the last of its
quotient, then come the remainders in whole bytes, and a counter of one byte each; counts of 255 and more follow in 8
bytes. Filters are sorted, so merging is one pass over all their entries.
"""

from __future__ import annotations

import struct

import numpy as np

from .jaccard_join import mixed

HEAD = "<BBBIQQ"  # bits, shard bits, quotient bits, shard, entries, large counts
ROUNDS = 4
LARGE = 255


def _ones(n: int) -> np.uint64:
    return np.uint64((1 << n) - 1)


def permuted(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of three ids below ``2^bits`` (``bits <= 32``) to the upper ``bits`` and the lower ``2 * bits`` of a permuted number."""
    ids = ids.astype(np.uint64)
    high, low = ids[:, 0], ids[:, 1] << np.uint64(bits) | ids[:, 2]
    for k in range(ROUNDS):
        high = high ^ (mixed(low + np.uint64(2 * k + 1)) & _ones(bits))
        low = low ^ (mixed(high + np.uint64(2 * k + 2)) & _ones(2 * bits))
    return high, low


def restored(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """The ids of permuted numbers."""
    for k in reversed(range(ROUNDS)):
        low = low ^ (mixed(high + np.uint64(2 * k + 2)) & _ones(2 * bits))
        high = high ^ (mixed(low + np.uint64(2 * k + 1)) & _ones(bits))
    return np.stack([high, low >> np.uint64(bits), low & _ones(bits)], 1).astype(np.int64)


def tallied(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sum of the counts of each (of ones without counts)."""
    if not len(high):
        return high, low, np.zeros(0, np.int64)
    if 3 * bits <= 64:
        order = np.argsort(high << np.uint64(2 * bits) | low, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    sums = np.diff(np.append(first, len(high))) if counts is None else np.add.reduceat(counts[order], first)
    return high[first], low[first], sums.astype(np.int64)


def _bytes_of(x: np.ndarray, n: int) -> bytes:
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :].tobytes() if n else b""


def _from_bytes(data: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    if n:
        out[:, 8 - n :] = np.frombuffer(data, np.uint8).reshape(size, n)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def _widths(bits: int, shard_bits: int, q: int) -> tuple[int, int, int]:
    rest = bits - shard_bits - q  # bits of the upper number that stand in the remainder
    return rest, -(-rest // 8), -(-2 * bits // 8)


def build(high: np.ndarray, low: np.ndarray, counts: np.ndarray, bits: int, shard_bits: int) -> bytes:
    """The filter of one shard's distinct numbers, which are in order."""
    n = len(high)
    inner = bits - shard_bits
    q = min(inner, max(n - 1, 0).bit_length())
    rest, wide_high, wide_low = _widths(bits, shard_bits, q)
    within = high & _ones(inner)
    quotient = (within >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)[:n]
    large = counts >= LARGE
    head = struct.pack(HEAD, bits, shard_bits, q, int(high[0]) >> inner if n else 0, n, int(large.sum()))
    return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(last).tobytes(), _bytes_of(within & _ones(rest), wide_high), _bytes_of(low, wide_low),
                     np.minimum(counts, LARGE).astype(np.uint8).tobytes(), counts[large].astype("<u8").tobytes()])


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a filter in order, and their counts."""
    bits, shard_bits, q, shard, n, large = struct.unpack_from(HEAD, data)
    rest, wide_high, wide_low = _widths(bits, shard_bits, q)
    at = struct.calcsize(HEAD)

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size : at]

    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), np.uint8), count=1 << q))
    last = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n)
    run = np.cumsum(last) - last
    remainder, low = _from_bytes(take(n * wide_high), wide_high, n), _from_bytes(take(n * wide_low), wide_low, n)
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
    counts[counts == LARGE] = np.frombuffer(take(8 * large), "<u8").astype(np.int64)
    quotient = occupied[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
    high = np.uint64(shard << (bits - shard_bits)) | quotient << np.uint64(rest) | remainder
    return high, low, counts


def summed(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of all filters of one shard in order, and their counts."""
    if len(filters) == 1:
        return entries(filters[0])
    columns = list(zip(*map(entries, filters), strict=True))
    low, counts, high = (np.concatenate(columns.pop(k)) for k in (1, 1, 0))  # what is joined is let go
    return tallied(high, low, counts, struct.unpack_from(HEAD, filters[0])[0])


def merged(filters: list[bytes]) -> bytes:
    """One filter with the counts of all; they are of one shard."""
    bits, shard_bits = struct.unpack_from(HEAD, filters[0])[:2]
    return filters[0] if len(filters) == 1 else build(*summed(filters), bits, shard_bits)
