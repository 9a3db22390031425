"""Words, lines and their hashes for many texts at once, as numpy arrays over UTF-8 bytes.

Both word definitions used here keep every byte from 0x80 on, so a text can be cut at byte level.
A block holds whole texts and about `BLOCK_BYTES` bytes; one longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowlens.llm.ship import by_value

by_value(__name__)

BLOCK_BYTES = 1 << 18
SUMMED_BYTES = 5 << 20  # longer blocks take the hash span by span

_CODES = np.arange(256)
NOT_BLANK = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))
NOT_NEWLINE = _CODES != 0x0A
# digits, a-z and every byte outside ASCII
ALNUM = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, 5 modulo 8
_BYTE_VALUES = {seed: mix(_CODES.astype(np.uint64) + np.uint64(1000 * seed + 1)) for seed in (0, 1)}
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_tables: dict[int, np.ndarray] = {}


def _powers_of(factor: np.uint64, n: int) -> np.ndarray:
    table = _tables.get(int(factor))
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK_BYTES), factor, np.uint64)
        table[0] = 1
        _tables[int(factor)] = table = np.cumprod(table)
    return table


def _power_table(n: int) -> np.ndarray:
    return _powers_of(_MULTIPLIER, n)


def _inverse_table(n: int) -> np.ndarray:
    return _powers_of(_INVERSE, n)


@dataclass
class Block:
    """Texts `first` to `first + rows` of a column; text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Block:
        return Block(self.first, LOWER[self.data], self.offsets)

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        running = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=running[1:])
        return np.diff(running[self.offsets])


@dataclass
class Spans:
    """Runs of wanted bytes inside the texts of a block, in order."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # index of each text's first span, and the end

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield Block(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def spans(block: Block, wanted: np.ndarray) -> Spans:
    """Maximal runs of bytes with `wanted[byte]`; none crosses the end of a text."""
    keep = wanted[block.data]
    inner = block.offsets[(block.offsets > 0) & (block.offsets < len(keep))]
    before = np.zeros(len(keep), bool)
    before[1:] = keep[:-1]
    before[inner] = False
    starts = np.flatnonzero(keep & ~before)
    after = np.zeros(len(keep), bool)
    after[:-1] = keep[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(keep & ~after) + 1
    first = np.searchsorted(starts, block.offsets)
    rows = np.repeat(np.arange(block.rows, dtype=np.int64), np.diff(first))
    return Spans(starts, ends, rows, first)


def span_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and where each begins (with the end)."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    where = np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)
    return data[where], offsets


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit hash of the bytes of each (non-empty) span."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        if len(data) <= SUMMED_BYTES:
            # a span's polynomial is a difference of running sums, moved to power zero
            running = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[seed][data] * _power_table(len(data))[: len(data)], out=running[1:])
            sums = (running[ends] - running[starts]) * _inverse_table(len(data))[starts]
        else:
            taken, offsets = span_bytes(data, starts, ends)
            within = np.arange(offsets[-1], dtype=np.int64) - np.repeat(offsets[:-1], lengths)
            values = _BYTE_VALUES[seed][taken] * _power_table(int(lengths.max()))[within]
            sums = np.add.reduceat(values, offsets[:-1])
        return mix(sums + lengths.astype(np.uint64) * _MULTIPLIER)


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    taken, offsets = span_bytes(data, starts, ends)
    return pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(taken)]
    )


def gram_hashes(hashes: np.ndarray, size: int, multiplier: int = 0xD6E8FEB86659FD95) -> np.ndarray:
    """Hash of every `size` consecutive hashes (whichever text they belong to), by doubling."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(multiplier)
        done, done_size = None, 0
        power, power_size, factor = hashes, 1, base
        left = size
        while left:
            if left & 1:
                if done is None:
                    done, done_size = power, power_size
                else:
                    n = len(hashes) - done_size - power_size + 1
                    done = done[:n] * factor + power[done_size : done_size + n]
                    done_size += power_size
            left >>= 1
            if left:
                n = len(hashes) - 2 * power_size + 1
                power = power[:n] * factor + power[power_size : power_size + n]
                factor = factor * factor
                power_size *= 2
    return mix(done)


def windows(words: Spans, size: int) -> np.ndarray:
    """Indexes of words at which a window of `size` words of the same text begins."""
    if len(words) < size:
        return np.empty(0, np.int64)
    rows = words.rows
    return np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :])


def covered(n: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a run of `size` places from one of `starts`."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:n]) > 0


def repeated(values: np.ndarray) -> np.ndarray:
    """Marks the values that occur more than once."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values


def with_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Values made different between texts."""
    with np.errstate(over="ignore"):
        return mix(values + mix(rows.astype(np.uint64) + np.uint64(77)))
