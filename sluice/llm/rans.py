"""A static range asymmetric numeral system over token ids, in numpy.

States are 64-bit, renormalised by 32-bit words. Symbol i of a block belongs to
lane i modulo LANES, so that an array operation handles one step of all lanes.
The words of a step stand in the order of their lanes, and the decoder reads them
from front to back. At checkpoints, every EVERY symbols, a block records the
states and the place in the words: decoders can start at any of them.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 1024
EVERY = 1 << 18
LOW = np.uint64(1 << 31)
_32, _BITS = np.uint64(32), np.uint64(BITS)


@dataclass(frozen=True)
class Table:
    """freq: frequencies that add up to 2 ** BITS, 0 for ids that never occur."""

    freq: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        """From counts over the whole corpus; an id that occurs at all gets 1 at least."""
        counts = np.asarray(counts, np.float64)
        total = 1 << BITS
        if np.count_nonzero(counts) > total:
            raise ValueError("more ids than slots")
        if not counts.any():
            counts = np.ones(1)
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * total / counts.sum())), 0).astype(np.int64)
        # What rounding left over or took goes to the most frequent ids, for which it matters least.
        for k in np.argsort(-freq, kind="stable"):
            d = total - int(freq.sum())
            if d == 0:
                break
            freq[k] += d if d > 0 else -min(-d, int(freq[k]) - 1)
        return Table(freq.astype(np.uint32))

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.freq.astype("<u4").tobytes())
        return zlib.crc32(body).to_bytes(4, "little") + body

    @staticmethod
    def from_bytes(data: bytes) -> Table:
        if zlib.crc32(data[4:]) != int.from_bytes(data[:4], "little"):
            raise ValueError("frequency table: checksum differs")
        return Table(np.frombuffer(zlib.decompress(data[4:]), "<u4"))


class Coder:
    def __init__(self, table: Table):
        self.freq = table.freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), table.freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(states at the start, words, states at the checkpoints, their places in the words)."""
        n, state, out, marks = len(ids), np.full(LANES, LOW), [], []
        f, c = self.freq[ids], self.start[ids]
        if not f.all():
            raise ValueError("an id that the table doesn't have")
        for at in range((max(n, 1) - 1) // LANES * LANES, -1, -LANES):
            own, first = f[at : at + LANES], c[at : at + LANES]
            x = state[: len(own)]
            over = x >= own << np.uint64(63 - BITS)
            out.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(over, x >> _32, x)
            q, r = np.divmod(x, own)
            state[: len(own)] = (q << _BITS) + r + first
            if at and at % EVERY == 0:
                marks.append((state.copy(), len(out)))
        lengths = np.cumsum([0] + [len(x) for x in out[::-1]])
        words = np.concatenate(out[::-1]) if out else np.empty(0, "<u4")
        marks.reverse()
        places = np.array([lengths[len(out) - k] for _, k in marks], "<u4")
        return state, words, np.array([s for s, _ in marks], np.uint64).reshape(-1, LANES), places

    def decode(self, states: np.ndarray, words: np.ndarray, n: int, place: int = 0) -> np.ndarray:
        """n ids from a block's start or from a checkpoint; to a block's end, the states must come back to their first values."""
        x_all, ids, slots = states.astype(np.uint64).copy(), np.empty(n, np.uint32), np.uint64((1 << BITS) - 1)
        words = words.astype(np.uint64)
        for at in range(0, n, LANES):
            m = min(LANES, n - at)
            x = x_all[:m]
            slot = x & slots
            s = self.symbol[slot]
            ids[at : at + m] = s
            x = self.freq[s] * (x >> _BITS) + slot - self.start[s]
            low = x < LOW
            k = int(np.count_nonzero(low))
            if k:
                x[low] = (x[low] << _32) | words[place : place + k]
                place += k
            x_all[:m] = x
        self.last = x_all
        return ids
