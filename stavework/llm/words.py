"""Words and word shingles of whole texts as 64-bit hashes, computed on Arrow buffers.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Every function works
on arrays, a bounded piece of text at a time, so one long text costs no more memory than its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
PIECE = 4 << 20
_CHUNK = 1 << 17
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    lower = np.arange(256)
    lower[65:91] += 32
    return mix((lower.astype(np.uint64) + np.uint64(1)) * _MULT)


_CODES = _byte_codes()
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * _MULT) | np.uint64(1)


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first, data): word hashes with byte spans, and each text's first word (n + 1 entries)."""
    data, offsets = text_buffer(texts)
    if not len(data):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64), data
    separator = _SEPARATOR[data]
    begins = ~separator
    ends = begins.copy()
    begins[1:] &= separator[:-1]
    ends[:-1] &= separator[1:]
    filled = offsets[:-1] < offsets[1:]
    at = offsets[:-1][filled]
    begins[at] = ~separator[at]
    at = offsets[1:][filled] - 1
    ends[at] = ~separator[at]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        upto = max(k + 1, int(np.searchsorted(stops, starts[k] + _CHUNK, side="right")))
        origin = starts[k]
        span = stops[upto - 1] - origin
        power, inverse = _power_tables(span + 1)
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum(_CODES[data[origin : origin + span]] * power[:span], out=sums[1:])
        a, b = starts[k:upto] - origin, stops[k:upto] - origin
        hashes[k:upto] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _MULT)
        k = upto
    if len(_powers[0]) > 4 * _CHUNK:
        _powers.clear()
    return hashes, starts, stops, np.searchsorted(starts, offsets), data


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): each text's shingle hashes with repeats, text i's at bounds[i]:bounds[i + 1].

    A text with fewer words than `width` has its whole sequence as one; one without words has none.
    """
    counts = np.diff(first)
    total = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    full = len(hashes) - width + 1
    if full > 0:
        rolled = np.zeros(full, np.uint64)
        for k in range(width):
            rolled += hashes[k : k + full] * _PLACES[k]
        owner = np.repeat(np.arange(len(counts)), counts)[:full]
        inside = np.arange(full) <= first[owner + 1] - width
        out[np.repeat(counts >= width, total)] = mix(rolled[inside])
    few = np.flatnonzero((counts > 0) & (counts < width))
    whole = counts[few].astype(np.uint64) * _MULT
    for k in range(width - 1):
        longer = counts[few] > k
        whole[longer] += hashes[first[few[longer]] + k] * _PLACES[width + k]
    out[bounds[few]] = mix(whole)
    return out, bounds


def distinct(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's codes once, in rising order, with the new bounds."""
    codes = codes.copy()
    edges = bounds.tolist()
    for a, b in zip(edges, edges[1:]):
        codes[a:b].sort()
    keep = np.ones(len(codes), bool)
    keep[1:] = codes[1:] != codes[:-1]
    keep[bounds[:-1][bounds[:-1] < len(codes)]] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def slices(texts: pa.Array, limit: int = PIECE) -> Iterator[pa.Array]:
    """The texts in runs of about `limit` bytes; every row, in order."""
    for part in pieces(pa.record_batch([texts], names=["text"]), "text", limit):
        yield part.column("text")


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes; every row, in order."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    slot = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
