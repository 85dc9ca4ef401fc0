"""Words of whole texts as Arrow arrays, found by the classes of their bytes.

Every class boundary of the contracts is an ASCII character, so bytes tell words apart as
code points would. Texts are taken in portions of a few megabytes, so memory is bounded by
the longest single text. Only ASCII capitals are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PORTION = 2 << 20
GAP, WORD, BREAK = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _classes(word, breaks: bytes = b"") -> np.ndarray:
    kinds = np.array([WORD if word(b) else GAP for b in range(256)], np.uint8)
    kinds[list(breaks)] = BREAK
    return kinds


# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALPHANUMERIC = _classes(lambda b: b >= 0x80 or chr(b).isalnum())
# `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`
LETTERS = _classes(lambda b: b >= 0x80 or chr(b).isalpha())
# `[^\x20\x09]+` in pieces between `[.,;:!?\x0A-\x0D]`
SPACED = _classes(lambda b: b not in b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
# Between single spaces
CHUNKS = _classes(lambda b: b != 0x20)


@dataclass
class Words:
    """Words of a portion in order: their text, the row and the piece (rows are pieces of
    their own) that holds each, the bytes that it takes, from the start of the portion, and
    the bytes of its row before it."""

    words: pa.StringArray
    row: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    end: np.ndarray
    inner: np.ndarray

    def coded(self) -> tuple[np.ndarray, pa.StringArray]:
        """A number for each word, and the distinct words by number."""
        encoded = self.words.dictionary_encode()
        return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def portions_by_size(batches: Iterator[pa.RecordBatch], text: str, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text, or of one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def find_words(texts: pa.Array, kinds: np.ndarray, lower: bool = True) -> Words:
    """Words of every text; null has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = kinds[data]
    inside = kind == WORD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    letters = _LOWER[data[inside]] if lower else data[inside]
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(letters))
    row = np.searchsorted(offsets, start, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), start) + row
    return Words(words, row, piece, start, end, start - offsets[row])


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over the whole number."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def digests(words: pa.StringArray) -> np.ndarray:
    """A 64-bit digest of each word, which must not be empty. The same on every machine."""
    if not len(words):
        return np.empty(0, np.uint64)
    words = pa.concat_arrays([words]) if words.offset == 0 else words.take(pa.array(np.arange(len(words))))
    bounds = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[: bounds[-1]].astype(np.uint64) + np.uint64(1)
    sizes = np.diff(bounds)
    powers = np.cumprod(np.full(int(sizes.max()), _BASE))
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    return mixed(np.add.reduceat(data * powers[place], bounds[:-1]) + sizes.astype(np.uint64))


def rolled(word_digests: np.ndarray, n: int) -> np.ndarray:
    """Digest of every ``n`` words in a row."""
    count = len(word_digests) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = word_digests[:count].copy()
    for i in range(1, n):
        total = total * _STEP + word_digests[i : i + count]
    return mixed(total + np.uint64(n))
