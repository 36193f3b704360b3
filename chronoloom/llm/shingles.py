"""64-bit hashes of words and of word shingles, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np

from chronoloom.llm.common import mix64

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_PINV = pow(_P, -1, 1 << 64)
_STEP, _MASK = 1 << 20, (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_tables: list[np.ndarray] = []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_tables() -> list[np.ndarray]:
    if not _tables:
        _tables.extend((_powers(_P, _STEP + 1), _powers(_PINV, _STEP + 1)))
    return _tables


def _polynomials(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most _STEP bytes: each word's polynomial in _P, begin and end."""
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables()
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_FOLD[b] * power[: len(b)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts], starts, ends


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word (run of bytes that aren't white space), with A-Z folded; equal wherever the word stands.

    Texts are read in steps; a word that goes on in the next step carries its polynomial over, whatever its length."""
    out, value, length = [], 0, 0
    for k in range(0, len(raw), _STEP):
        part = raw[k : k + _STEP]
        found, starts, ends = _polynomials(part)
        if length and len(starts) and starts[0] == 0:
            found[0] = (value + int(found[0]) * pow(_P, length, 1 << 64)) & _MASK
            length += int(ends[0])
        elif length:
            out.append(np.array([value], np.uint64))
            length = 0
        if len(ends) and ends[-1] == len(part):  # open: it may go on
            length = length if len(ends) == 1 and length else int(ends[-1] - starts[-1])
            value, found = int(found[-1]), found[:-1]
        else:
            length = 0
        out.append(found)
    if length:
        out.append(np.array([value], np.uint64))
    return mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all shingles of size words; with fewer words the whole sequence is one; none without words."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        mult = _powers(0xD6E8FEB86659FD93, n + 1)[1:]
        return mix64((words * mult).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(n * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    mult = _powers(0xE7037ED1A0B428DB, size + 1)[1:]
    total = words[: n - size + 1] * mult[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * mult[k]
    return np.unique(mix64(total))


def of_text(text: str | None, size: int = 5) -> np.ndarray:
    return shingle_set(word_hashes((text or "").encode("utf-8", "surrogatepass")), size)
