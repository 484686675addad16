"""CRC-32 of words and of runs of words: a run's CRC is put together from its words' by the algebra of GF(2)."""

from __future__ import annotations

import functools
import zlib

import numpy as np

_POLYNOMIAL = 0xEDB88320
#: Longer words have their CRC taken one by one; shorter ones all together, byte position by byte position.
SHORT = 48
_INK = np.zeros(256, dtype=bool)
_INK[ord("0") : ord("9") + 1] = _INK[ord("a") : ord("z") + 1] = _INK[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _step() -> np.ndarray:
    """What a byte does to the register: the polynomial's remainders of all bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


_STEP = _step()


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product of a 32 by 32 matrix over GF(2), given as its columns, with each x."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where((x >> np.uint32(i)) & np.uint32(1), columns[i], np.uint32(0))
    return out


@functools.cache
def _shift_tables(power: int) -> np.ndarray:
    """Four tables of 256: what appending 2**power zero bytes makes of each byte of a CRC."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = _STEP[columns & np.uint32(255)] ^ (columns >> np.uint32(8))  # one zero byte
    for _ in range(power):
        columns = _times(columns, columns)  # the matrix times itself: twice as many
    return np.stack([_times(columns, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC multiplied by the matrix that moves it over n_bytes further bytes, by the powers of two in n_bytes."""
    crc, left, power = crc.astype(np.uint32, copy=True), n_bytes.astype(np.int64, copy=True), 0
    while left.any():
        at = np.flatnonzero(left & 1)
        if len(at):
            t, x = _shift_tables(power), crc[at]
            crc[at] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
        left >>= 1
        power += 1
    return crc


def joined(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRCs of the concatenations, from those of their two parts."""
    return shifted(left, right_bytes) ^ right


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data with A-Z lower-cased, and starts and ends of its words: runs of digits, a-z and bytes beyond ASCII."""
    data = _LOWER[data]
    ink = np.concatenate([[False], _INK[data], [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return data, edge[::2], edge[1::2]


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each data[start:end]."""
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    out = np.empty(len(starts), dtype=np.uint32)
    short = order[: np.searchsorted(sizes[order], SHORT, side="right")]
    register, size = np.full(len(short), 0xFFFFFFFF, dtype=np.uint32), sizes[short]
    for k in range(int(size[-1]) if len(short) else 0):
        on = slice(int(np.searchsorted(size, k, side="right")), None)  # the words with a byte there
        register[on] = _STEP[(register[on] ^ data[starts[short[on]] + k]) & np.uint32(255)] ^ (register[on] >> np.uint32(8))
    out[short] = ~register
    for i in order[len(short) :]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def gram_crcs(crc: np.ndarray, sizes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to width words of one text, joined by a space, and the text of each run.

    crc, sizes and text are the words' own, in order. A run of k words is a run of k - 1 words, shifted over the next word and its space,
    with that added.
    """
    spaced = joined(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), crc, sizes) if width > 1 else crc
    run, of, runs, texts = crc, text, [crc], [text]
    for k in range(1, width):
        m = max(len(crc) - k, 0)
        inside = text[:m] == text[k : k + m]
        run = joined(run[:m], spaced[k : k + m], sizes[k : k + m] + 1)
        of = text[:m]
        runs.append(run[inside])
        texts.append(of[inside])
    return np.concatenate(runs), np.concatenate(texts)
