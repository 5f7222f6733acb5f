"""Anchored cuts: sharding of all fixed-length substrings of a corpus without losing one.

Every window of ``length`` bytes chooses one anchor inside it, the leftmost of its
``k``-byte substrings with the smallest hash (of which the first ``64 - PLACE`` bits are compared).  The choice depends on the window's bytes
alone, whatever else is in the batch, so equal windows choose equal anchors at equal places.  Windows of a document
that choose the same anchor lie side by side; the bytes that they cover together are a
*cut*.  All occurrences of any window are in cuts with the same anchor hash.
"""

from __future__ import annotations

import numpy as np

from cytolake.llm.common import mix64


#: Bits of a place in a batch, which stand below those of a hash that are compared.
PLACE = 24


def ladder(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 8-byte and the ``k``-byte substrings at each place (``k`` a multiple of 8)."""
    n = data.size
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word[:n - 7] |= data[i:n - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    h8 = word * np.uint64(0x9E3779B97F4A7C15)
    h8 ^= h8 >> np.uint64(32)
    m = n - k + 1
    hk = h8[:m].copy()
    for i in range(1, k // 8):
        hk *= np.uint64(0xBF58476D1CE4E5B9)
        hk += h8[8 * i:m + 8 * i]
        hk ^= hk >> np.uint64(31)
    hk *= np.uint64(0x94D049BB133111EB)
    hk ^= hk >> np.uint64(29)
    return h8, hk


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of ``w`` values, by doubling."""
    have, out = 1, v
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:out.size - (w - have)], out[w - have:]) if have < w else out


def cuts(docs: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """``anchor hash, content hash, document's place in the list, start, size, anchor's place`` of every cut.

    The content hash (with the anchor hash: 128 bits) stands for the cut's bytes and the anchor's place in them.
    """
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    if not size.size or size.max() < length:
        return empty
    data = np.frombuffer(b"".join(docs), np.uint8)
    if data.size >> PLACE:
        raise ValueError(f"a batch of {data.size} bytes is too large")
    begin = np.cumsum(size) - size
    h8, hk = ladder(data, k)
    bits, place = np.uint64(PLACE), np.arange(hk.size, dtype=np.uint64)
    low = sliding_min((hk >> bits << bits) | place, length - k + 1)  # smallest hash, then leftmost
    anchor = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    # A cut opens at a document's first window and wherever the anchor changes; windows over a document's end don't count.
    last = begin + size - length
    long = np.flatnonzero(size >= length)
    valid = np.zeros(anchor.size + 1, np.int8)
    np.add.at(valid, begin[long], 1)
    np.add.at(valid, last[long] + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    opens = valid.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    opens[begin[long]] = True
    first = np.flatnonzero(opens)
    doc = long[np.searchsorted(begin[long], first, side="right") - 1]
    end = np.minimum(np.append(first[1:], anchor.size), last[doc] + 1) - 1 + length
    at = anchor[first]
    content = mix64((at - first).astype(np.uint64) << np.uint64(32) | (end - first).astype(np.uint64))
    # Eight-byte substrings at every eighth place from the start, and the last one, cover the cut.
    for i in range(0, 2 * length, 8):
        here = np.minimum(first + i, end - 8)
        content = mix64(content ^ h8[here]) * np.uint64(0x9E3779B97F4A7C15)
    return hk[at], content, doc, first - begin[doc], end - first, at - first
