"""Static range asymmetric numeral system over interleaved lanes, in numpy.

One frequency table, scaled to ``1 << SCALE_BITS``, serves all blocks.  A block
is coded apart from all others: its ids are dealt to the lanes in turn and each
lane has a 64-bit state; a step codes one id in every lane at once and moves 32
bits of the states that would overflow to the stream.  Every
``checkpoint_steps`` steps the decoder's states and place are kept, so that a
decoder can start there.  A block carries the crc32 of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
SCALE = np.uint64(SCALE_BITS)
MASK = np.uint64((1 << SCALE_BITS) - 1)
BLOCK = struct.Struct("<IIIIII")  # ids, lanes, words, checkpoints, crc32 of the ids, crc32 of the rest


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``1 << SCALE_BITS``, 1 at least where a count is positive."""
    counts = counts.astype(np.float64)
    whole = 1 << SCALE_BITS
    if not counts.sum():
        return np.zeros(len(counts), np.uint32)
    if np.count_nonzero(counts) > whole:
        raise ValueError("more different ids than the table can hold")
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (whole / counts.sum()))), 0).astype(np.int64)
    over = int(f.sum()) - whole
    for i in np.argsort(-f, kind="stable"):
        if not over:
            break
        take = min(over, int(f[i]) - 1) if over > 0 else over
        f[i] -= take
        over -= take
    return f.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray, lanes: int = 4096, checkpoint_steps: int = 128):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.lanes, self.checkpoint_steps = lanes, checkpoint_steps
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray) -> bytes:
        """A block of ``ids``; each must have a positive frequency."""
        n = len(ids)
        lanes = max(1, min(self.lanes, n // 64))
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        n_words, marks = 0, []
        f_all, c_all = self.freq[ids], self.start[ids]
        for t in range(steps - 1, -1, -1):
            if t + 1 < steps and (t + 1) % self.checkpoint_steps == 0:
                marks.append((t + 1, n_words, x.copy()))
            f, c = f_all[t * lanes : (t + 1) * lanes], c_all[t * lanes : (t + 1) * lanes]
            own = x[: len(f)]
            full = np.flatnonzero(own >= (f << np.uint64(63 - SCALE_BITS)))
            if len(full):
                words.append((own[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                n_words += len(full)
                own[full] >>= WORD
            q = own // f
            own[:] = (q << SCALE) + (own - q * f) + c
        out = [x.astype("<u8").tobytes()]
        for step, left, states in reversed(marks):
            out.append(struct.pack("<II", step, n_words - left))
            out.append(states.astype("<u8").tobytes())
        out += [w.tobytes() for w in reversed(words)]
        body = b"".join(out)
        return BLOCK.pack(n, lanes, n_words, len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` of a block, from the checkpoint before them."""
        n, lanes, n_words, n_marks, crc, body_crc = BLOCK.unpack_from(block)
        body = memoryview(block)[BLOCK.size :]
        if zlib.crc32(body) != body_crc:
            raise ValueError("a block's bytes are damaged")
        whole = first == 0 and (last is None or last >= n)
        last = n if last is None else min(last, n)
        steps = -(-n // lanes)
        size = lanes * 8
        words = np.frombuffer(body, "<u4", n_words, size + n_marks * (8 + size)).astype(np.uint64)
        x, p, t = np.frombuffer(body, "<u8", lanes).copy(), 0, 0
        for k in range(n_marks):
            step, at = struct.unpack_from("<II", body, size + k * (8 + size))
            if step * lanes <= first:
                x, p, t = np.frombuffer(body, "<u8", lanes, size + k * (8 + size) + 8).copy(), at, step
        base = t * lanes
        stop = max(t, min(steps, -(-last // lanes)))
        out = np.empty(max(0, min(n, stop * lanes) - base), np.uint32)
        for t in range(t, stop):
            own = x[: min(lanes, n - t * lanes)]
            slot = own & MASK
            s = self.symbol[slot]
            out[t * lanes - base : t * lanes - base + len(own)] = s
            own[:] = self.freq[s] * (own >> SCALE) + slot - self.start[s]
            low = np.flatnonzero(own < LOW)
            if len(low):
                own[low] = (own[low] << WORD) | words[p : p + len(low)]
                p += len(low)
        if whole and zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids do not have its checksum")
        return out[first - base : last - base]
