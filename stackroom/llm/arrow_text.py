"""Vectorised text helpers over Arrow batches: slicing, tokenising and hashing without per-word Python.

A batch's texts are one UTF-8 buffer; all helpers work on that buffer with numpy, so that a task
holds a few copies of a slice of bounded size and nothing else. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is handled alone.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_table(separators: bytes, lower: bool) -> np.ndarray:
    """256 entries: a blank for a separator, else the byte itself (A-Z lower-cased if asked)."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 32
    return t


#: Words are runs of anything but ASCII white space.
SPACED = word_table(bytes([0x20, *range(9, 14)]), False)
#: The same after lower-casing A-Z.
SPACED_LOWER = word_table(bytes([0x20, *range(9, 14)]), True)
#: Words are runs of digits, letters and anything beyond ASCII, A-Z lower-cased.
ALNUM_LOWER = word_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many bytes of text (one row at least). At the end what Arrow's pool keeps goes back, as a worker process lives on for other tasks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, s in enumerate(sizes.tolist()):
            if held and held + s > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += s
        yield batch.slice(first)
    pa.default_memory_pool().release_unused()


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, and where each begins and the last ends."""
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


@dataclass
class Tokens:
    rows: np.ndarray  #: first word of each text, and the number of words at the end
    begin: np.ndarray  #: first byte of each word, in the flat buffer
    end: np.ndarray  #: the byte after each word
    hash: np.ndarray  #: 64 bits of each word
    offsets: np.ndarray  #: first byte of each text
    data: np.ndarray  #: the flat buffer as it was

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def word(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def tokenize(col: pa.Array, table: np.ndarray) -> Tokens:
    """Every word of every text with its hash; no word reaches over a text's end."""
    data, offsets = flat(col)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint64), offsets, data)
    mapped = table[data]
    is_word = np.zeros(n + 2, bool)
    is_word[1:-1] = mapped != 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(is_word[1:-1] & (~is_word[:-2] | edge[:-1]))
    end = np.flatnonzero(is_word[1:-1] & (~is_word[2:] | edge[1:])) + 1
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((mapped.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = mix((sums[end] - sums[begin]) * inverse[begin])
    return Tokens(np.searchsorted(begin, offsets), begin, end, h, offsets, data)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that tokenize() gives these words; they are taken as lower-cased already."""
    table = np.arange(256, dtype=np.uint8)
    out = []
    for w in words:
        b = table[np.frombuffer(w, np.uint8)].astype(np.uint64) + np.uint64(1)
        out.append((b * _powers(len(b) + 1)[0][: len(b)]).sum(dtype=np.uint64))
    return mix(np.array(out, np.uint64))


def split_words(text: str | None, table: np.ndarray) -> list[bytes]:
    """The words of one text, as tokenize() finds them."""
    return [w for w in table[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split(b" ") if w] if text else []


def shingles(tok: Tokens, width: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and each text's first one (with the count at the end).

    With whole_if_short, a text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    counts = np.diff(tok.rows)
    full = np.maximum(counts - width + 1, 0)
    h = tok.hash
    n = len(h)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc[: n - k] = acc[: n - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
    keep = np.ones(n, bool)
    tail = np.minimum(counts, width - 1)  # the last words of a text begin no shingle of their own
    ends = tok.rows[1:]
    for k in range(1, width):
        keep[ends[tail >= k] - k] = False
    values = mix(acc[keep])
    if not whole_if_short:
        return values, np.concatenate([[0], np.cumsum(full)])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j, i in enumerate(short.tolist()):
            a = np.uint64(counts[i])
            for x in h[tok.rows[i] : tok.rows[i + 1]]:
                with np.errstate(over="ignore"):
                    a = a * np.uint64(0xD6E8FEB86659FD93) + x
            own[j] = a
        first = np.concatenate([[0], np.cumsum(full)])
        values = np.insert(values, first[short], mix(own))
        full = full.copy()
        full[short] = 1
    return values, np.concatenate([[0], np.cumsum(full)])


def list_array(values: pa.Array, rows: np.ndarray) -> pa.Array:
    """A list column: row i holds values[rows[i]:rows[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values)
