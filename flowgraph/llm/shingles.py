"""Word shingles of whole texts, as sorted sets of 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are worked on at once (one longer text is worked on alone).
HELD = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 products wrap."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.arange(256)
_BYTE[65:91] += 32  # A-Z
_VALUE = mix(_BYTE.astype(np.uint64) + _U(0xA5A5A5A5))
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _lots(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    first, lot, size = 0, [], 0
    for i, text in enumerate(texts):
        lot.append((text or "").encode())
        size += len(lot[-1])
        if size >= HELD or len(lot) >= 4096:
            yield first, lot
            first, lot, size = i + 1, [], 0
    if lot:
        yield first, lot


def _sets(lot: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(lot) + b" ", np.uint8)
    begins = np.cumsum([1, *(len(x) + 1 for x in lot)])
    gap = _GAP[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    doc = np.searchsorted(begins, starts, "right") - 1
    # The polynomial of each word from running sums: divided by the base's power where the word starts.
    sums = np.cumsum(np.where(gap, _U(0), _VALUE[data]) * _powers(_BASE, len(data)))
    word = mix((sums[ends - 1] - sums[starts - 1]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    counts = np.bincount(doc, minlength=len(lot))
    first = np.cumsum(counts) - counts
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | _U(1)
    n = max(0, len(word) - width + 1)
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :][:n]) if n else np.empty(0, np.int64)
    hashes = np.zeros(len(whole), np.uint64)
    for j in range(width):
        hashes += word[whole + j] * odd[j]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):  # fewer words than a shingle has: all of them as one
        own = np.flatnonzero(counts[doc] < width)
        at = np.cumsum(counts[short]) - counts[short]
        few = np.add.reduceat(word[own] * odd[own - first[doc[own]]], at) + mix(counts[short].astype(np.uint64) + _U(77))
        hashes, who = np.concatenate([hashes, few]), np.concatenate([doc[whole], short])
    else:
        who = doc[whole]
    hashes = mix(hashes)
    order = np.lexsort((hashes, who))
    hashes, who = hashes[order], who[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(who[new], minlength=len(lot))


def sets(texts: Iterable[str | None], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, distinct hashes of each text in ascending order end to end, their counts), lot by lot."""
    with np.errstate(over="ignore"):
        for first, lot in _lots(texts):
            yield (first, *_sets(lot, width))


def set_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set as a whole."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _U(0x5851F42D4C957F2D)))])
        ends = np.cumsum(counts)
        return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64)
