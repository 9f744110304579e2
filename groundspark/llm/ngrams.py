"""Runs of words of a batch of texts as places in one buffer, with their XXH64, in numpy.

A batch's texts are folded, cut into pieces of bounded size and brought to single spaces, so that a run of words is one
range of bytes. Runs are hashed together, one class of equal lengths after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import xxhash

#: Bytes of text in a piece, about.
PIECE_BYTES = 1 << 19
#: Runs that are hashed together, so that what is in use stays in the processor's cache.
LOT = 1 << 17
#: Lower-cased ASCII letters, digits and all bytes beyond ASCII are of words; all else parts them.
ALPHANUMERIC = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Only ASCII white space parts words; A-Z are lower-cased.
BLANK = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))

#: The primes of XXH64.
P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges from this size on are hashed one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Piece:
    """Words of some texts in one buffer: ``start`` and ``size`` of each word, ``owner`` its text, ``fresh`` if no earlier piece had it."""

    def __init__(self, spans: list[tuple[int, bytes, int]]) -> None:
        raw = np.frombuffer(b" ".join([s for _, s, _ in spans]) + b" ", dtype=np.uint8)
        inside = raw != 32
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        first, stop = edge[::2], edge[1::2]
        offsets = np.cumsum([0, *(len(s) + 1 for _, s, _ in spans)])[:-1]
        span = np.searchsorted(offsets, first, side="right") - 1
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.text = np.concatenate([raw[keep], np.zeros(40, dtype=np.uint8)])
        self.size = stop - first
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.span = span
        self.owner = np.array([i for i, _, _ in spans])[span]
        nth = np.arange(len(span)) - np.searchsorted(span, span)
        self.fresh = nth >= np.array([c for _, _, c in spans])[span]

    @cached_property
    def lanes(self) -> np.ndarray:
        """The eight bytes that begin at each place, as a number."""
        return np.ndarray((len(self.text) - 8,), "<u8", buffer=self.text, strides=(1,)).copy()

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and size of every run of ``n`` words whose last word is fresh."""
        last = np.flatnonzero(self.fresh[n - 1 :]) + n - 1
        first = last - (n - 1)
        same = self.span[first] == self.span[last]
        first, last = first[same], last[same]
        return self.owner[last], self.start[first], self.start[last] + self.size[last] - self.start[first]

    def hashes(self, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
        """Unsigned XXH64 of every range."""
        out = np.empty(len(start), dtype=np.uint64)
        for at in range(0, len(start), LOT):
            out[at : at + LOT] = self._hashes(start[at : at + LOT], size[at : at + LOT], seed)
        return out

    def _hashes(self, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
        order = np.argsort(np.minimum(size, 255).astype(np.uint8), kind="stable")
        out, start, size = np.empty(len(start), dtype=np.uint64), start[order], size[order]
        whole = self.text.data
        stop = int(np.searchsorted(size, 32))
        out[order[stop:]] = [xxhash.xxh64_intdigest(whole[a : a + n], seed) for a, n in zip(start[stop:].tolist(), size[stop:].tolist(), strict=True)]
        edges = np.searchsorted(size, np.arange(33))
        for n in range(32):
            a, b = edges[n], edges[n + 1]
            if a == b:
                continue
            at, h = start[a:b], np.full(b - a, (seed + int(P5) + n) % (1 << 64), dtype=np.uint64)
            for k in range(0, n - 7, 8):
                h ^= _turn(self.lanes[at + k] * P2, 31) * P1
                h = _turn(h, 27) * P1 + P4
            k = n & 24
            if n & 7:
                tail = self.lanes[at + k]
                if n & 4:
                    h ^= (tail & np.uint64(0xFFFFFFFF)) * P1
                    h = _turn(h, 23) * P2 + P3
                    tail >>= np.uint64(32)
                for _ in range(n & 3):
                    h ^= (tail & np.uint64(255)) * P5
                    h = _turn(h, 11) * P1
                    tail >>= np.uint64(8)
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            out[order[a:b]] = h ^ (h >> np.uint64(32))
        return out

    def crc32(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of every range, a byte of all ranges at a time, the longest first."""
        lots = range(0, len(start), LOT)
        return np.concatenate([self._crc32(start[k : k + LOT], size[k : k + LOT]) for k in lots]) if len(start) else np.zeros(0, dtype=np.uint32)

    def _crc32(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        order = np.argsort(-size, kind="stable")
        out, start, size = np.empty(len(start), dtype=np.uint32), start[order], size[order]
        long, whole = int(np.searchsorted(-size, -LONG)), self.text.data
        out[order[:long]] = [zlib.crc32(whole[a : a + n]) for a, n in zip(start[:long].tolist(), size[:long].tolist(), strict=True)]
        start, size, crc = start[long:], size[long:], np.full(len(start) - long, 0xFFFFFFFF, dtype=np.uint32)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k))
            crc[:n] = CRC_TABLE[(crc[:n] ^ self.text[start[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
        out[order[long:]] = ~crc
        return out

    def equal(self, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the ranges numbered ``i`` and ``j`` hold the same bytes."""
        a, b, n = start[i], start[j], size[i]
        out = n == size[j]
        out &= ((self.lanes[a] ^ self.lanes[b]) << (8 * (8 - np.minimum(n, 8))).astype(np.uint64)) == 0
        left, k = np.flatnonzero(out & (n > 8)), 8
        while len(left):
            at = np.minimum(k, n[left] - 8)
            out[left] &= self.lanes[a[left] + at] == self.lanes[b[left] + at]
            k += 8
            left = left[n[left] > k]
        return out


def _spans(text: bytes, overlap: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts that end between words; a part begins with the last ``overlap`` words of the one before."""
    begin, carried, end = 0, 0, 0
    while end < len(text):
        end = text.find(b" ", end + limit) if len(text) - end > limit else len(text)
        end = len(text) if end < 0 else end
        yield text[begin:end], carried
        begin, carried = end, 0
        while carried < overlap and (stop := _stop(text, begin)):
            begin, carried = text.rfind(b" ", 0, stop) + 1, carried + 1


def _stop(text: bytes, at: int) -> int:
    """End of the last word before ``at``."""
    while at and text[at - 1] == 32:
        at -= 1
    return at


def pieces(texts: list[bytes | None], fold: bytes, longest: int, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts' words in pieces; every run of up to ``longest`` words has its last word fresh in one piece that holds the run whole."""
    held: list[tuple[int, bytes, int]] = []
    total = 0
    for i, text in enumerate(texts):
        for part, carried in _spans((text or b"").translate(fold), longest - 1, limit):
            held.append((i, part, carried))
            total += len(part) + 1
            if total >= limit:
                yield Piece(held)
                held, total = [], 0
    if held:
        yield Piece(held)
