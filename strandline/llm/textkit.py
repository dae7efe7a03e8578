"""Hashes of words and shingles over Arrow text columns, computed a batch at a time.

Words are runs of bytes other than space and U+0009 to U+000D of the UTF-8 text (these bytes never occur inside a
longer code point); A-Z are lower-cased first where asked. A word's hash starts from its length and mixes in its bytes
eight at a time by a bijection, so no two words of one length of up to eight bytes share one and longer words have no
common structure that could make them collide; words over LONG bytes are hashed by BLAKE2b. Among a billion different
words two share a 64-bit hash with a chance of about 3 % in all, so counts by hash stand for counts by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, np.uint8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0
_P = U(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20
#: Words of more bytes than this are hashed one by one.
LONG = 64
#: By number of bytes that a word still has: which bits of its next eight bytes belong to it.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and the len + 1 row offsets into them; null rows are empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offsets else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most limit bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _segment(raw: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of raw; cuts: positions where a row starts."""
    w = _WORD[raw]
    prev, nxt = np.zeros_like(w), np.zeros_like(w)
    prev[1:], nxt[:-1] = w[:-1], w[1:]
    cuts = cuts[cuts < len(raw)]
    prev[cuts] = 0
    nxt[cuts[cuts > 0] - 1] = 0
    starts, ends = np.flatnonzero(w > prev), np.flatnonzero(w > nxt) + 1
    if lower:
        raw = _LOWER[raw]
    return _hash_words(raw, starts, ends - starts), starts


def _hash_words(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))  # the 8 bytes from each place
    h = mix(sizes.astype(np.uint64) * _P)
    some, at, left = np.arange(len(starts)), starts, sizes
    for _ in range(LONG // 8):
        h[some] = mix(h[some] ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _P
        more = left > 8
        if not more.any():
            break
        some, at, left = some[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        word = raw[starts[i] : starts[i] + sizes[i]].tobytes()
        h[i] = U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
    return h


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the rows, in order, and len + 1 offsets of the rows' words."""
    raw, off = text_bytes(col)
    hashes, at, a = [], [], 0
    while a < len(raw):
        b = min(len(raw), a + _SEGMENT)
        if b < len(raw):  # cut at a separator or at the start of a row, never inside a word
            window = raw[a:b]
            gaps = np.flatnonzero(_WORD[window] == 0)
            row = off[np.searchsorted(off, b, "right") - 1]
            b = max(a + int(gaps[-1]) + 1 if len(gaps) else 0, int(row))
            while b <= a or (b < len(raw) and b != row and _WORD[raw[b - 1]]):
                more = np.flatnonzero(_WORD[raw[max(a, b) : max(a, b) + _SEGMENT]] == 0)  # a word longer than a segment
                nxt = int(off[min(len(off) - 1, np.searchsorted(off, max(a, b), "right"))])
                b = min(max(a, b) + (int(more[0]) + 1 if len(more) else _SEGMENT), nxt if nxt > max(a, b) else len(raw), len(raw))
                row = b if b in (nxt, len(raw)) else -1
        inside = off[(off >= a) & (off < b)] - a
        h, s = _segment(raw[a:b], inside, lower)
        hashes.append(h)
        at.append(s + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(at), off)


_STEP = U(0xD6E8FEB86659FD93)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words of h, over row borders too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    v = np.full(size, n, np.uint64)
    for j in range(n):
        v = (v ^ h[j : j + size]) * _STEP
        v ^= v >> U(29)
    return mix(v)


def shingle_sets(h: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """By row: the sorted distinct hashes of its n-word shingles; of fewer words, the whole sequence as one."""
    every = windows(h, n)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= n:
            s = np.sort(every[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        else:
            yield windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)
