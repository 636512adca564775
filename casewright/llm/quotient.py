"""Counting quotient filters: sets of 64-bit fingerprints with counts, as bytes.

The leading bits of a fingerprint (its quotient) are not stored but told by two bit maps, one of the
quotients that occur and one of the places where a quotient's run of remainders ends; a slot holds a
remainder only. Counts above one stand beside a third bit map. Slots are sorted, so a filter gives back
its fingerprints exactly, and filters merge by merging their sorted slots, without loss.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<BBQ")


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def encode(fps: np.ndarray, counts: np.ndarray, skip: int = 0) -> bytes:
    """A filter of distinct ascending fingerprints that agree in their first skip bits (which it leaves out)."""
    n = len(fps)
    q = min(24, max(3, n.bit_length()), 64 - skip)
    rest = 64 - skip - q
    quotient = (fps << np.uint64(skip)) >> np.uint64(64 - q)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)[:n]
    width = -(-rest // 8)
    remainders = (fps & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    repeated = counts > 1
    return b"".join((HEAD.pack(q, skip, n), _bits(occupied), _bits(ends), _bits(repeated), remainders.tobytes(), counts[repeated].astype("<i8").tobytes()))


def decode(data: bytes, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints and their counts; lead is what the first skip bits were."""
    q, skip, n = HEAD.unpack_from(data)
    rest, at = 64 - skip - q, HEAD.size

    def flags(size: int) -> np.ndarray:
        nonlocal at
        got = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size, bitorder="little")
        at += -(-size // 8)
        return got.astype(bool)

    occupied, ends, repeated = flags(1 << q), flags(n), flags(n)
    width = -(-rest // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    counts = np.ones(n, np.int64)
    counts[repeated] = np.frombuffer(data, "<i8", int(repeated.sum()), at + n * width)
    run = np.cumsum(np.append(0, ends[:-1]))[:n].astype(np.int64)
    quotient = np.nonzero(occupied)[0].astype(np.uint64)[run] if n else np.zeros(0, np.uint64)
    fps = wide.view("<u8").ravel().astype(np.uint64) | (quotient << np.uint64(rest))
    return fps | np.uint64((lead << (64 - skip)) if skip else 0), counts


def gathered(fps: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending fingerprints and the sums of their counts."""
    order = np.argsort(fps, kind="stable")
    fps = fps[order]
    first = np.nonzero(np.append(True, fps[1:] != fps[:-1])[: len(fps)])[0]
    if not len(first):
        return fps, np.zeros(0, np.int64)
    ones = np.ones(len(fps), np.int64) if counts is None else counts[order]
    return fps[first], np.add.reduceat(ones, first)


def merged(filters: list[bytes], lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of several filters together."""
    parts = [decode(x, lead) for x in filters]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return gathered(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def split(fps: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """(block, filter) for each value of the leading bits that occurs."""
    if not bits or not len(fps):
        return [(0, encode(fps, counts))] if len(fps) else []
    block = (fps >> np.uint64(64 - bits)).astype(np.int64)
    first = np.nonzero(np.append(True, block[1:] != block[:-1]))[0]
    last = np.append(first[1:], len(fps))
    return [(int(block[a]), encode(fps[a:b], counts[a:b], bits)) for a, b in zip(first.tolist(), last.tolist())]
