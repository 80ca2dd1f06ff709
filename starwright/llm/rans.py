"""Static range asymmetric numeral system over 16-bit symbols (numpy).

One frequency table, scaled to 2**SCALE, is shared by all blocks.  A block is
coded by ``LANES`` interleaved coders: symbol i belongs to lane i % LANES, and
all lanes take a step at once.  States are 64 bits wide and shift out 32-bit
words, so any symbol costs close to its information content.

Block layout (little-endian): magic, symbols, words, CRC-32 of the coded bytes,
CRC-32 of the symbols (five unsigned 32-bit numbers); the final states (LANES
unsigned 64-bit numbers); the words in the order the decoder reads them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, LANES = 20, 512
SYMBOLS = 1 << 16
_MAGIC, _HEAD = 0x534E4152, struct.Struct("<5I")
_LOW = np.uint64(1 << 31)
_32, _SHIFT = np.uint64(32), np.uint64(SCALE)
_WORD, _SLOT = np.uint64(0xFFFFFFFF), np.uint64((1 << SCALE) - 1)


class Table:
    """Frequencies of the symbols, scaled: every symbol that occurs has at
    least one of the 2**SCALE slots."""

    def __init__(self, counts: np.ndarray):
        used = counts > 0
        total, spare = int(counts.sum()), (1 << SCALE) - int(used.sum())
        scaled = np.where(used, 1 + np.floor(counts / max(total, 1) * spare).astype(np.int64), 0)
        if total:
            scaled[scaled.argmax()] += (1 << SCALE) - scaled.sum()
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(scaled)[:-1])).astype(np.uint64)
        self.filler = int(scaled.argmax())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """Symbol of each slot; made when something is decoded."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._slots


def encode(symbols: np.ndarray, table: Table) -> bytes:
    n = len(symbols)
    steps = -(-n // LANES)
    padded = np.full(steps * LANES, table.filler, np.uint16)
    padded[:n] = symbols
    freq, start = table.freq[padded].reshape(steps, LANES), table.start[padded].reshape(steps, LANES)
    limit = freq << np.uint64(63 - SCALE)
    x, words = np.full(LANES, _LOW), []
    for i in range(steps - 1, -1, -1):
        f = freq[i]
        over = x >= limit[i]
        if over.any():
            words.append((x[over] & _WORD).astype("<u4"))
            x[over] >>= _32
        q = x // f
        x = (q << _SHIFT) + (x - q * f) + start[i]
    coded = x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))
    return _HEAD.pack(_MAGIC, n, sum(map(len, words)), zlib.crc32(coded),
                      zlib.crc32(symbols.astype("<u2").tobytes())) + coded


def decode(block: bytes, table: Table) -> np.ndarray:
    """Symbols of a block; an error if either checksum does not hold."""
    magic, n, n_words, coded_crc, symbols_crc = _HEAD.unpack_from(block)
    if magic != _MAGIC or zlib.crc32(block[_HEAD.size:]) != coded_crc:
        raise ValueError("damaged block")
    x = np.frombuffer(block, "<u8", LANES, _HEAD.size).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, _HEAD.size + 8 * LANES).astype(np.uint64)
    steps, at, slots = -(-n // LANES), 0, table.slots
    out = np.empty((steps, LANES), np.uint16)
    for i in range(steps):
        slot = x & _SLOT
        out[i] = s = slots[slot]
        x = table.freq[s] * (x >> _SHIFT) + slot - table.start[s]
        low = np.flatnonzero(x < _LOW)
        if low.size:
            x[low] = (x[low] << _32) | words[at: at + low.size]
            at += low.size
    symbols = out.reshape(-1)[:n]
    if at != n_words or zlib.crc32(symbols.astype("<u2").tobytes()) != symbols_crc:
        raise ValueError("damaged block")
    return symbols
