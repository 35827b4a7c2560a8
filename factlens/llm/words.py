"""Vectorised words, word hashes and word windows over blocks of texts.

Arrow string columns arrive as one byte buffer with offsets; everything here works on
such a buffer with numpy, so no Python object is made per word. Three word rules are used:

* ``SPACE``: words are the runs of ``[^\\x20\\x09-\\x0D]``, unchanged;
* ``SPACE_LOWER``: the same words, A-Z lower-cased;
* ``ALNUM``: A-Z lower-cased, words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Both separators sets are ASCII, so working on UTF-8 bytes equals working on characters.
A null text has no words. Blocks hold half a MB of text (or one longer document), which
bounds memory whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers of the rolling hashes


def _rule(separator) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, the byte as it counts) for every byte value."""
    word = np.array([not separator(b) for b in range(256)])
    as_byte = np.arange(256, dtype=np.uint8)
    return word, as_byte


def _space_rule():
    return _rule(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)


def _alnum_rule():
    word, as_byte = _rule(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)
    as_byte[0x41:0x5B] += 0x20
    return word, as_byte


SPACE, ALNUM = _space_rule(), _alnum_rule()
SPACE_LOWER = SPACE[0], ALNUM[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """An independent 64-bit hash of 64-bit values per seed."""
    return mix(x ^ U((seed * 0xA0761D6478BD642F + 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF))


class _Cache(dict):
    """Never shipped with its content when this module is pickled to a worker."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of ``base`` and of its inverse modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(1 << max(16, (n - 1).bit_length()), b, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = out[0], out[1]
    return have


def _rolling(values: np.ndarray, base: int):
    """``h(start, end)``: hash of values[start:end] that does not depend on its place."""
    power, inverse = _powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return lambda start, end: mix((total[end] - total[start]) * inverse[start] + mix((end - start).astype(U)))


class Words:
    """Words of a block: ``starts``/``ends`` byte offsets, ``first[i]:first[i+1]`` the words of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule) -> None:
        word, as_byte = rule
        self.data, self.offsets, self.n_rows = data, offsets, len(offsets) - 1
        m = word[data]
        s, e = m.copy(), m.copy()
        if len(m):
            s[1:] &= ~m[:-1]
            e[:-1] &= ~m[1:]
            full = offsets[1:] > offsets[:-1]
            a, b = offsets[:-1][full], offsets[1:][full] - 1
            s[a], e[b] = m[a], m[b]
        self.starts, self.ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self._as_byte = as_byte

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        letters = mix(np.arange(256, dtype=U) + U(1))
        return _rolling(letters[self._as_byte[self.data]], BASES[0])(self.starts, self.ends)

    def window_starts(self, k: int) -> np.ndarray:
        """Word indices at which a window of k words of one row starts."""
        n = self.counts
        room = np.maximum(n - k + 1, 0)
        begin = np.repeat(self.first[:-1], room)
        step = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
        return begin + step

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space, as they stand in the text."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j]))


def rolling(hashes: np.ndarray, which: int = 0):
    """Hash of consecutive words by (start, end) word index; two independent kinds."""
    return _rolling(hashes, BASES[1 - which % 2] if which else BASES[0])


def blocks(batch: pa.RecordBatch, column: str, rule, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) pieces of a batch, each of a few MB or one row."""
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type)
    if not len(text):
        return
    _, off, raw = text.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[text.offset: text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, Words(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], rule)
        lo = hi


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def concat_batches(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)
