"""Vectorised 64-bit hashes of the words and word windows of texts (numpy over Arrow buffers).

A word's hash is a polynomial over random 64-bit values of its bytes, taken from prefix sums over a block of
texts, so there is no work per word in Python. A-Z are lower-cased by the value table; words are what stands
between the six ASCII white-space characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUES[65:91] = _VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _IPOW = _powers(_BASE, BLOCK + 1), _powers(_INV, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _block_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, starts, _ = located(data)
    return h, starts


def located(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of at most BLOCK bytes."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _POW[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _IPOW[starts] + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text, the hashes of its words in order (a null text has none). Texts are taken whole."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    i = 0
    while i < n:
        j = i + 1
        while j < n and offs[j + 1] - offs[i] + (j + 1 - i) <= BLOCK and valid[j] and valid[i]:
            j += 1
        if not valid[i]:
            yield np.zeros(0, np.uint64)
            i += 1
            continue
        if offs[j] - offs[i] > BLOCK:  # one long text: blocks end at white space (or, without any, are hashed as one)
            yield np.concatenate(list(_long(raw[offs[i] : offs[j]])))
        else:
            # Words may not run from one text into the next: a blank is put between them.
            size = int(offs[j] - offs[i]) + (j - i)
            if size > BLOCK:
                yield np.concatenate(list(_long(raw[offs[i] : offs[j]])))
                i = j
                continue
            block = np.full(size, 32, np.uint8)
            at = (offs[i:j] - offs[i]) + np.arange(j - i)
            fill = np.ones(size, bool)
            fill[(offs[i + 1 : j + 1] - offs[i]) + np.arange(j - i)] = False
            block[fill] = raw[offs[i] : offs[j]]
            h, starts = _block_hashes(block)
            cut = np.searchsorted(starts, at[1:])
            yield from np.split(h, cut)
        i = j


def _long(data: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            blanks = np.flatnonzero(SPACE[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # a single word longer than a block: hashed by itself
                stop = at + int(np.argmax(SPACE[data[at:]])) if SPACE[data[at:]].any() else len(data)
                word, acc = data[at:stop], 0
                for k in range(0, len(word), BLOCK):
                    piece = word[k : k + BLOCK]
                    acc = (acc * _BASE + int((_VALUES[piece] * _POW[: len(piece)]).sum(dtype=np.uint64))) & (2**64 - 1)
                yield mix(np.array([acc ^ len(word)], np.uint64))
                at = stop
                continue
        yield _block_hashes(data[at:end])[0]
        at = end
    yield np.zeros(0, np.uint64)


_STEP = [_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x2545F4914F6CDD1D), _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)]


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words; of fewer words, one of the whole sequence; of none, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    acc = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        acc += mix(words[i : len(words) - k + 1 + i] * _STEP[i % len(_STEP)] + _U(i + 1 + (k << 8)))
    return mix(acc)
