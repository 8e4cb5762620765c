"""Hashed word shingles of many texts at once, in numpy.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z in lower case. A word's 64-bit hash reads it
eight bytes at a time, a shingle's hash joins those of its words in order. Texts are taken in pieces of about CHUNK
bytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Odd multipliers with about half of their bits set.
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = h * _K[k]
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of data, which must begin with a blank and end with nine."""
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, size = edges[0::2], edges[1::2] - edges[0::2]
    return starts, run_hashes(data, starts, size)[0]


def run_hashes(data: bytes, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first eight bytes of runs of data, which must go on for eight bytes behind the last start. Runs of up to eight bytes that agree in both are equal."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    head = eights[starts] & _MASKS[np.minimum(size, 8)]
    h = _mix(head + size.astype(np.uint64) * _K[3], 0)
    at = np.flatnonzero(size > 8)
    done = 8
    while len(at):
        left = np.minimum(size[at] - done, 8)
        h[at] = _mix(h[at] + (eights[starts[at] + done] & _MASKS[left]), 1)
        done += 8
        at = at[size[at] > done]
    return _mix(_mix(h, 2), 1), head


def _join(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    out = words[: max(n, 0)].copy()
    for i in range(1, width):
        out = _mix(out, 0) + words[i : n + i] if n > 0 else out
    return _mix(_mix(out, 2), 1)


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text, the ascending distinct hashes of its shingles; a text with fewer words is one shingle, without words none."""
    for part in _pieces([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        data = b" " + b" ".join(part).translate(_LOWER) + b" " * 9
        starts, words = word_hashes(data)
        joined = _join(words, width)
        ends = np.cumsum([len(t) + 1 for t in part]) + 1
        cuts = np.searchsorted(starts, ends).tolist()
        lo = 0
        for hi in cuts:
            if hi - lo >= width:
                s = np.sort(joined[lo : hi - width + 1])
                if len(s) > 1:
                    new = np.empty(len(s), bool)
                    new[0] = True
                    np.not_equal(s[1:], s[:-1], out=new[1:])
                    s = s[new]
                yield s
            elif hi > lo:
                yield _mix(_join(words[lo:hi], hi - lo) + np.uint64(hi - lo), 3)
            else:
                yield np.zeros(0, np.uint64)
            lo = hi
