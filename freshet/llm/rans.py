"""Static range asymmetric numeral system (rANS) over token ids.

One frequency table, normalised to 2**bits, is shared by all blocks of a data set. A block is
coded on its own by ``lanes`` interleaved coders: symbol i belongs to lane i % lanes, so one
step of coding is one vector operation over a row of ``lanes`` symbols. States are kept in
[2**31, 2**63) and renormalised by 32-bit words.

A coded block holds, besides the words, the final states of its lanes (where decoding starts),
checkpoints (states and word offset before every ``every``-th row, so that a long block can be
decoded from several places at a time) and a CRC-32 of its symbols.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LOW = 1 << 31
MOST_BITS = 24
MAGIC = b"RANB"
HEAD = struct.Struct("<4sIIIIII")  # magic, symbols, lanes, words, checkpoints, every, crc


def bits_for(symbols: int) -> int:
    """Table precision: fine enough for every symbol seen to have a share near its own."""
    return min(MOST_BITS, max(12, int(symbols).bit_length() + 2))


def normalise(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that add up to 2**bits; each symbol that was counted keeps at least 1."""
    counts = np.asarray(counts, dtype=np.int64)
    total, target = int(counts.sum()), 1 << bits
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.zeros(len(counts), dtype=np.uint32)
    if len(seen) > target:
        raise ValueError(f"{len(seen)} symbols don't fit a table of {target}")
    share = counts[seen].astype(np.float64) * (target / total)
    freq = np.maximum(1, np.floor(share)).astype(np.int64)
    short = target - int(freq.sum())
    if short > 0:  # to those that lost most by rounding
        order = np.lexsort((seen, -(share - freq)))
        freq[order] += short // len(seen)
        freq[order[: short % len(seen)]] += 1
    while short < 0:  # from those above 1, in proportion
        spare = freq - 1
        cut = np.minimum(spare, -(-spare * -short // max(1, int(spare.sum()))))
        before = np.cumsum(cut) - cut
        cut = np.clip(-short - before, 0, cut)
        freq -= cut
        short += int(cut.sum())
    out = np.zeros(len(counts), dtype=np.uint32)
    out[seen] = freq
    return out


class Table:
    """The shared table in the form the coders need."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        start = np.zeros(len(freq) + 1, dtype=np.uint64)
        np.cumsum(self.freq, out=start[1:])
        self.start = start[:-1]
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, symbols: np.ndarray, lanes: int = 2048, every: int = 256) -> bytes:
        """The block as bytes. Every symbol must have a frequency."""
        n = len(symbols)
        crc = zlib.crc32(symbols.astype("<u4").tobytes())
        lanes = max(1, min(lanes, n // 64))  # short blocks: few states to store
        if n and not self.freq[symbols].all():
            raise ValueError("a symbol that the table lacks")
        rows = -(-n // lanes) if n else 0
        shift = np.uint64(self.bits)
        room = np.uint64(63 - self.bits)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        emitted = 0
        marks: list[tuple[int, np.ndarray]] = []
        for r in range(rows - 1, -1, -1):
            own = symbols[r * lanes : (r + 1) * lanes]
            f, c = self.freq[own], self.start[own]
            x = state[: len(own)]
            out = x >= (f << room)
            if out.any():
                w = (x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                words.append(w[::-1])
                emitted += len(w)
                x = np.where(out, x >> np.uint64(32), x)
            q = x // f
            state[: len(own)] = (q << shift) + (x - q * f) + c
            if r and r % every == 0:
                marks.append((emitted, state.copy()))
        stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
        head = HEAD.pack(MAGIC, n, lanes, len(stream), len(marks), every, crc)
        points = b"".join(struct.pack("<I", emitted - at) + s.astype("<u8").tobytes() for at, s in reversed(marks))
        return head + state.astype("<u8").tobytes() + points + stream.astype("<u4").tobytes()

    def _open(self, block: bytes):
        magic, n, lanes, n_words, n_marks, every, crc = HEAD.unpack_from(block, 0)
        if magic != MAGIC:
            raise ValueError("not a coded block")
        at = HEAD.size
        points = [(0, np.frombuffer(block, "<u8", lanes, at))]
        at += 8 * lanes
        for _ in range(n_marks):
            points.append((struct.unpack_from("<I", block, at)[0], np.frombuffer(block, "<u8", lanes, at + 4)))
            at += 4 + 8 * lanes
        if len(block) != at + 4 * n_words:
            raise ValueError("a coded block of the wrong length")
        return n, lanes, every, crc, points, np.frombuffer(block, "<u4", n_words, at)

    def segments(self, block: bytes) -> int:
        """Into how many parts the checkpoints cut the block."""
        return len(self._open(block)[4])

    def decode_segment(self, block: bytes, k: int) -> np.ndarray:
        """The symbols from checkpoint k to the next, without the rest of the block."""
        n, lanes, every, _, points, words = self._open(block)
        return self._run(n, lanes, every, points, words, k)

    def _run(self, n, lanes, every, points, words, k: int) -> np.ndarray:
        at, state = points[k]
        state = state.astype(np.uint64)
        rows = -(-n // lanes) if n else 0
        first, last = k * every, min(rows, (k + 1) * every) if k + 1 < len(points) else rows
        out = np.empty(max(0, min(n, last * lanes) - first * lanes), dtype=np.uint32)
        shift, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        done = 0
        for r in range(first, last):
            here = min(lanes, n - r * lanes)
            x = state[:here]
            slot = x & mask
            s = self.slots[slot]
            out[done : done + here] = s
            done += here
            x = self.freq[s] * (x >> shift) + slot - self.start[s]
            low = x < LOW
            need = int(np.count_nonzero(low))
            if need:
                x[low] = (x[low] << np.uint64(32)) | words[at : at + need].astype(np.uint64)
                at += need
            state[:here] = x
        return out

    def decode(self, block: bytes) -> np.ndarray:
        """All symbols; a block that doesn't match its checksum is an error."""
        n, lanes, every, crc, points, words = self._open(block)
        parts = [self._run(n, lanes, every, points, words, k) for k in range(len(points))]
        symbols = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if zlib.crc32(symbols.astype("<u4").tobytes()) != crc:
            raise ValueError("a coded block is damaged")
        return symbols
