"""Words of many texts at once: numpy over the bytes of an Arrow string array.

UTF-8 bytes of a non-ASCII character are all 0x80 or more, so classes of words
that treat every non-ASCII character alike can be cut on bytes.  Words are told
apart by 64-bit hashes of their bytes and length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z; nothing else changes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing, and of words [^\x20\x09-\x0D]+.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
UNSPACED = np.ones(256, bool)
UNSPACED[[9, 10, 11, 12, 13, 32]] = False

_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _POWERS[name] = np.cumprod(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of large_string texts (null: empty) and offsets of texts in them."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    return (LOWER[np.frombuffer(data, np.uint8)[first:last]] if last > first else np.zeros(0, np.uint8)), offsets - first


def cut(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and where each text's words begin (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = of_word[data]
    # A text's end ends a word also where the next text goes on with one.
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    end_at = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return begin, end_at, np.searchsorted(begin, offsets)


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``hashes`` are taken; worth keeping for several calls over the same bytes."""
    up, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each [begin, end)."""
    total = sums(data) if total is None else total
    _, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        return mix((total[end] - total[begin]) * down[begin] + mix((end - begin).astype(np.uint64)))
