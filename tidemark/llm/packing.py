"""Best-fit packing by minimum bin slack.

Pieces of equal length are interchangeable, so bins are planned on the histogram of lengths
(at most ``capacity`` numbers, whatever the corpus holds). For each bin a subset-sum over a
bitset finds the fullest feasible combination of the lengths left; the combination is then
removed as often as the counts allow, which is what repeating the search bin by bin does.
Spark tokenizes, counts, numbers the pieces of each length and places them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, number_in_groups
from tidemark.llm.tokens import CHUNKS, find_words, portions_by_size

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k"
# White space twice or at the end, or what may be a special token: such texts are encoded whole.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_APART = rf"{_SPACE}{_SPACE}|{_SPACE}\z|<\|"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids, as little-endian uint32 bytes, of texts.

    No token of the vocabulary's pattern reaches across a place where a space follows a
    visible character, so where no two white-space characters meet, a text's ids are those
    of its space-led chunks. The distinct chunks of a portion are encoded in one call and
    told apart by the bytes that each token stands for. Other texts are encoded whole.
    """

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self._ranks = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._sizes[list(ranks.values())] = [len(token) for token in ranks]
        self._file = public_tokenizers.path(f"{vocabulary}.json")
        self._full = None

    def _ids(self, text: str) -> np.ndarray:
        return self._ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def _whole(self, text: str) -> bytes:
        if "<|" not in text:
            return self._ids(text).tobytes()
        if self._full is None:  # it may hold a special token, which only the tokenizer itself treats as one
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self._file)
        return np.array(self._full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space-led chunks one after the other, and where each one's begin."""
        led = pc.binary_join_element_wise(pa.scalar(""), chunks, " ")
        ids = self._ids("".join(led.to_pylist()))
        sizes = pc.binary_length(led).to_numpy(zero_copy_only=False)
        return ids, np.searchsorted(np.cumsum(self._sizes[ids]), np.cumsum(sizes) - sizes, side="right")

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a portion; null is empty."""
        apart = pc.fill_null(pc.match_substring_regex(texts, _APART), False)
        out = [self._whole(text) if whole else b"" for text, whole in zip(texts.to_pylist(), apart.to_pylist(), strict=True)]
        rest = np.flatnonzero(~apart.to_numpy(zero_copy_only=False))
        found = find_words(texts.take(pa.array(rest)), CHUNKS, lower=False)
        if not len(found.row):
            return out
        codes, words = found.coded()
        starts = np.searchsorted(found.row, np.arange(len(rest) + 1))
        ids, first = self._chunks(words)
        counts = np.diff(np.append(first, len(ids)))
        # The first chunk of a text has a space before it only where the text begins with one.
        bare = starts[:-1][np.diff(starts) > 0]
        bare = bare[found.inner[bare] == 0]
        own = [self._ids(chunk) for chunk in found.words.take(pa.array(bare)).to_pylist()]
        begins, lengths = first[codes], counts[codes]
        lengths[bare] = [len(i) for i in own]
        begins[bare] = len(ids) + np.cumsum(lengths[bare]) - lengths[bare]
        flat = np.concatenate([ids, *own])
        ends = np.cumsum(lengths)
        tokens = flat[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()
        edges = np.concatenate([[0], ends])[starts] * 4
        for i, row in enumerate(rest.tolist()):
            out[row] = tokens[edges[i] : edges[i + 1]]
        return out


def _cut_ids(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and checksum of each piece; only the first may be short."""
    total = len(ids) // 4
    start, length = 0, total % capacity or min(total, capacity)
    while start < total:
        yield start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, length = start + length, capacity


def tokenized_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids with the end id
    after them. A null or empty text has the end id alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in portions_by_size(batches, "text"):
            rows = [
                (doc_id, number, *piece)
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True)
                for number, piece in enumerate(_cut_ids(ids + end, capacity))
            ]
            if rows:
                ids, number, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE_SCHEMA)


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``capacity`` that
    holds the largest one, long lengths preferred among equals."""
    top = max(left)
    taken = {top: 1}
    room, mask = capacity - top, (1 << (capacity - top + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    sums = 1
    for length in sorted((x for x in left if x <= room)):
        spare, lot = min(left[length] - (length == top), room // length), 1
        while spare > 0:
            lot = min(lot, spare)
            steps.append((sums, length, lot))
            sums |= (sums << (length * lot)) & mask
            spare, lot = spare - lot, lot * 2
    rest = sums.bit_length() - 1
    for before, length, lot in reversed(steps):
        # The longest lengths came last: use them wherever the rest can still be made up.
        if rest >= length * lot and before >> (rest - length * lot) & 1:
            taken[length] = taken.get(length, 0) + lot
            rest -= length * lot
    return taken


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations with the number of bins that use each. Every one leaves some length with
    fewer pieces than it needs of it, so their number depends on the capacity, not the corpus."""
    left = {length: n for length, n in histogram.items() if n > 0}
    plan = []
    while left:
        combination = fullest(left, capacity)
        times = min(left[length] // need for length, need in combination.items())
        plan.append((combination, times))
        for length, need in combination.items():
            left[length] -= need * times
            if not left[length]:
                del left[length]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length: first rank, first bin, pieces per bin and offset of each run of slots."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for combination, times in plan:
        offset = 0
        for length, need in sorted(combination.items(), reverse=True):
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, first_bin, need, offset))
            used[length] = rank + need * times
            offset += need * length
        first_bin += times
    return {length: np.array(runs, np.int64) for length, runs in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to pieces, which
    need ``doc_id, piece, length`` and may repeat. Returns no rows for no pieces. ``pieces`` is read
    several times: pass a written table."""
    histogram = {row[0]: row[1] for row in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = _slots(plan_bins(histogram, capacity))
    ranked = number_in_groups(pieces, ["length"], ["doc_id", "piece"], sum(histogram.values()))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                here = length == value
                runs = slots[value]
                run = runs[np.searchsorted(runs[:, 0], rank[here], side="right") - 1]
                place_in_run = rank[here] - run[:, 0]
                sequence[here] = run[:, 1] + place_in_run // run[:, 2]
                offset[here] = run[:, 3] + place_in_run % run[:, 2] * value
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.select(*[c for c in ranked.columns if c != "rank"], "rank").mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts become one piece of the end id; repeated rows are packed as often
    as they occur; an empty table gives no rows; other columns are not read.
    """
    packed = pack(cut(tokenized_pieces(docs, vocabulary, capacity), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
