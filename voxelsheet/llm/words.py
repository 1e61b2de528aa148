"""Words, shingles and their 64-bit hashes for whole Arrow batches of texts.

A word is a maximal run of ASCII letters and digits (A-Z count as a-z) and of
all characters above U+007F. In UTF-8 that can be decided byte by byte, so a
batch is handled as one byte array, a bounded stretch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRETCH = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@lru_cache(maxsize=1)
def _tables():
    byte = np.arange(256)
    is_word = ((byte >= 48) & (byte <= 57)) | ((byte >= 97) & (byte <= 122)) | ((byte >= 65) & (byte <= 90)) | (byte >= 128)
    lowered = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    value = mix(lowered.astype(_U) + _U(0x9E3779B97F4A7C15))
    base = pow(3, 37, 1 << 64) | 1
    power = np.cumprod(np.full(STRETCH + 1, base, _U)) * _U(pow(base, -1, 1 << 64))
    back = np.cumprod(np.full(STRETCH + 1, pow(base, -1, 1 << 64), _U)) * _U(base)
    return is_word, value, power, back


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and the offsets of each; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def runs(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts, and the index each belongs to, in runs of about ``limit`` bytes.

    A text above the limit is cut at white space into pieces, so that the
    memory of what follows is bounded however long a text is.
    """
    _, offsets = text_bytes(texts)
    if offsets[-1] <= 2 * limit:
        yield texts, np.arange(len(texts))
        return
    held, owner, size = [], [], 0
    for k, text in enumerate(texts.to_pylist()):
        for piece in _pieces(text or "", limit):
            held.append(piece)
            owner.append(k)
            size += len(piece)
            if size >= limit:
                yield pa.array(held, pa.string()), np.array(owner)
                held, owner, size = [], [], 0
    yield pa.array(held, pa.string()), np.array(owner, int)


def _pieces(text: str, limit: int) -> Iterator[str]:
    start = 0
    while len(text) - start > limit:
        cut = max(text.rfind(" ", start, start + limit), text.rfind("\n", start, start + limit)) + 1
        cut = cut if cut > start else start + limit
        yield text[start:cut]
        start = cut
    yield text[start:]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and for each text the index of its first word."""
    word = _tables()[0][data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(word)]] = False
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the lower-cased bytes of each span; spans are in order and do not overlap."""
    return part_hashes(data, start, end, [(start, end)])[0]


def part_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of several parts (start and end arrays) of the same spans."""
    _, value, power, back = _tables()
    out = [np.zeros(len(start), _U) for _ in parts]
    done = 0
    while done < len(start):
        low = start[done]
        stop = int(np.searchsorted(end, low + STRETCH, "right"))
        if stop <= done:  # one span longer than a stretch
            for k, (s, e) in enumerate(parts):
                out[k][done] = _long_hash(data[s[done]:e[done]], value)
            done += 1
            continue
        part = value[data[low:end[stop - 1]]]
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(part, out=total[1:])
        for k, (s, e) in enumerate(parts):
            s, e = s[done:stop] - low, e[done:stop] - low
            out[k][done:stop] = mix((total[e] - total[s]) * back[s] + (e - s).astype(_U))
        done = stop
    return out


def _long_hash(data: np.ndarray, value: np.ndarray) -> int:
    """The same function of a very long span, block by block."""
    _, _, power, _ = _tables()
    total, factor, mask = 0, 1, (1 << 64) - 1
    for at in range(0, len(data), STRETCH):
        piece = value[data[at:at + STRETCH]] * power[: min(STRETCH, len(data) - at)]
        total = (total + int(piece.sum(dtype=_U)) * factor) & mask
        factor = factor * int(power[STRETCH]) & mask
    return int(mix(np.array([(total + len(data)) & mask], _U))[0])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and for each text the index of its first word."""
    hashes, counts = [], np.zeros(len(column), np.int64)
    for texts, owner in runs(column):
        data, offsets = text_bytes(texts)
        start, end, first = word_spans(data, offsets)
        hashes.append(span_hashes(data, start, end))
        np.add.at(counts, owner, np.diff(first))
    return np.concatenate(hashes), np.r_[0, np.cumsum(counts)]


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the text of each.

    A text of fewer words, but not none, is one run of all its words.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - first[:-1][text]
    whole = place + size <= counts[text]
    head = (place == 0) & (counts[text] < size)
    total = np.zeros(len(hashes), _U)
    for k in range(size):
        shifted = np.zeros(len(hashes), _U)
        shifted[: max(0, len(hashes) - k)] = hashes[k:]
        inside = whole | (head & (k < counts[text]))
        total = np.where(inside, mix(total * _U(0x9E3779B97F4A7C15) + shifted), total)
    keep = whole | head
    return total[keep], text[keep]
