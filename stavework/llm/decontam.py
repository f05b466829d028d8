"""Benchmark passages in documents: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

A CGK walk reads a string with a pointer that moves on or stays by a random bit of (step, symbol), and
writes the symbol it stands on. Strings at a small edit distance give walks at a small Hamming distance,
so equal symbols at a few sampled steps are likely. Symbols here are words (A-Z lower-cased). Item windows
and document windows of one size are embedded `repeats` times; where all sampled steps of a repeat agree,
the item is aligned to the text there and the edit distance is computed in full.

Items under SHORTEST words allow no edit (up to four words) or one. They are looked up exactly: whole, and for
one edit by their halves, one of which an edit leaves as it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from stavework.llm import words as W

REPEATS, SAMPLED = 8, 2
EDITS = 0.2
SHORTEST = 8
START_BYTES, LEAST_STARTS = 5, 2
BLOCK_BYTES = 4 << 20
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_PAD = np.uint64(0)
_CACHE: dict = {}


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with each character of a script that is written without spaces as a word of its own."""
    data, _ = W.text_buffer(texts)
    if not ((data >= 0xE0) & (data != 0xE2)).any():  # no such script has other lead bytes; 0xE2 begins quotes and dashes
        return texts
    return pc.replace_substring_regex(texts.cast(pa.large_string()), UNSPACED, r" \0 ")


def window_size(words: int) -> int:
    """Windows of an item: the largest of 6, 9, 13, 19, 28, ... that is at most three quarters of it."""
    size = SHORTEST * 3 // 4
    while size * 3 // 2 <= words * 3 // 4:
        size = size * 3 // 2
    return size


def _steps(size: int, repeat: int) -> list[int]:
    rng = np.random.default_rng([size, repeat])
    return sorted(1 + int(x) for x in rng.choice(2 * size - 1, SAMPLED, replace=False))


def _movers(repeat: int, steps: int) -> np.ndarray:
    return W.mix(np.arange(1, steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(repeat << 32)) | np.uint64(1)


class _Filter:
    """A bitmap in front of sorted keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = np.uint64(64 - max(10, (16 * len(self.keys)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(self.keys >> self.shift).astype(np.int64)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keep = np.flatnonzero(self.bits[(keys >> self.shift).astype(np.int64)])
        if len(keep):
            at = np.minimum(np.searchsorted(self.keys, keys[keep]), len(self.keys) - 1)
            keep = keep[self.keys[at] == keys[keep]]
        return keep


def _walk(x: np.ndarray, starts: np.ndarray, size: int, repeat: int, filters: list | None) -> tuple[np.ndarray, np.ndarray, list]:
    """(alive, keys, partial keys): the sampled symbols of each window as a key; with filters, windows without a partner drop out on the way."""
    steps = _steps(size, repeat)
    movers = _movers(repeat, steps[-1] + 1)
    alive, at = np.arange(len(starts)), starts.astype(np.int64)
    end = at + size
    key = x[at].copy()
    partial, taken = [], 0
    for j in range(steps[-1] + 1):
        symbol = x[at]
        symbol[at >= end] = _PAD
        if j == steps[taken]:
            key = W.mix(key * np.uint64(3) + symbol)
            partial.append(key)
            if filters is not None:
                keep = filters[taken](key)
                alive, at, end, key, symbol = alive[keep], at[keep], end[keep], key[keep], symbol[keep]
                if not len(alive):
                    break
            taken += 1
            if taken == len(steps):
                break
        at = at + ((symbol * movers[j]) >> np.uint64(63)).astype(np.int64)
    return alive, key, partial


def _runs(x: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A key of the `size` words at each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out += x[starts + k] * W._PLACES[k]
    return W.mix(out)


class _Exact:
    """Runs of `size` words of short items, (words, item, offset) each, found wherever they stand in a text."""

    def __init__(self, size: int, entries: list[tuple[np.ndarray, int, int]]):
        self.size = size
        x = np.concatenate([e[0] for e in entries])
        keys = _runs(x, size * np.arange(len(entries)), size)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], np.array([e[1] for e in entries])[order], np.array([e[2] for e in entries])[order]
        self.begins, self.filter = _Filter(x[::size]), _Filter(keys)

    def __call__(self, x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, offset) of every run found, starts rising."""
        starts = place[self.begins(x[place])]
        keys = _runs(x, starts, self.size)
        keep = self.filter(keys)
        starts, keys = starts[keep], keys[keep]
        lo, hi = np.searchsorted(self.keys, keys, side="left"), np.searchsorted(self.keys, keys, side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(starts, n), self.item[at], self.offset[at]


class Index:
    """All windows of the items under all repeats, and short items whole and by halves."""

    def __init__(self, texts: list[str]):
        hashes, starts, ends, first, _ = W.words(spaced(pa.array(texts, pa.string())))
        hashes = np.where(hashes == _PAD, np.uint64(1), hashes)
        self.items = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        content = (ends - starts) >= START_BYTES
        by_size: dict[int, list] = {}
        for i, words in enumerate(self.items):
            if len(words) >= SHORTEST:
                size = window_size(len(words))
                offsets = np.arange(len(words) - size + 1)
                heavy = offsets[content[first[i] + offsets]]
                longest = np.sort(np.argsort(-(ends - starts)[first[i] + offsets], kind="stable")[:LEAST_STARTS])
                by_size.setdefault(size, []).append((i, heavy if len(heavy) >= LEAST_STARTS else longest))
        self.sizes = []
        for size, entries in sorted(by_size.items()):
            flat, begin, owner, offset, place = [], [], [], [], 0
            for i, offsets in entries:
                flat += [self.items[i], np.zeros(2 * size + 2, np.uint64)]
                begin.append(place + offsets)
                owner.append(np.full(len(offsets), i))
                offset.append(offsets)
                place += len(self.items[i]) + 2 * size + 2
            x, begin, owner, offset = np.concatenate(flat), np.concatenate(begin), np.concatenate(owner), np.concatenate(offset)
            repeats = []
            for r in range(REPEATS):
                _, key, partial = _walk(x, begin, size, r, None)
                order = np.argsort(key, kind="stable")
                repeats.append(([_Filter(p) for p in partial], key[order], owner[order], offset[order]))
            self.sizes.append((size, _Filter(x[begin]), repeats))
        self.widest = max((s for s, _, _ in self.sizes), default=SHORTEST)
        whole, halves = {}, {}
        for i, words in enumerate(self.items):
            if 0 < len(words) < SHORTEST:
                whole.setdefault(len(words), []).append((words, i, 0))
                if int(EDITS * len(words)):
                    middle = len(words) // 2
                    for offset, half in ((0, words[:middle]), (middle, words[middle:])):
                        halves.setdefault(len(half), []).append((half, i, offset))
        self.whole, self.halves = ([_Exact(n, e) for n, e in sorted(x.items())] for x in (whole, halves))

    def matches(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text the (item, distance, first word) of each item within the edit limit, at its best place."""
        hashes, _, _, first, _ = W.words(spaced(texts))
        n = len(first) - 1
        found: list[dict] = [{} for _ in range(n)]
        if not (self.sizes or self.whole) or not len(hashes):
            return [[] for _ in range(n)]
        gap = 2 * self.widest + 2
        x = np.zeros(len(hashes) + gap * n, np.uint64)
        place = np.arange(len(hashes)) + gap * np.repeat(np.arange(n), np.diff(first))
        x[place] = np.where(hashes == _PAD, np.uint64(1), hashes)
        tried: set = set()
        origins = first + gap * np.arange(len(first))
        for exact in self.whole:
            starts, item, _ = exact(x, place)
            doc = np.searchsorted(origins, starts, side="right") - 1
            _, once = np.unique(doc * len(self.items) + item, return_index=True)
            for d, i, s in zip(doc[once].tolist(), item[once].tolist(), (starts - origins[doc])[once].tolist()):
                found[d][i] = (0, s)
        for exact in self.halves:
            starts, item, offset = exact(x, place)
            doc = np.searchsorted(origins, starts, side="right") - 1
            for d, s, i, o in zip(doc.tolist(), starts.tolist(), item.tolist(), offset.tolist()):
                if found[d].get(i, (1, 0))[0]:
                    self._verify(x, s, i, o, gap, first, tried, found)
        for size, begins, repeats in self.sizes:
            starts = place[begins(x[place])]
            for r, (filters, keys, owner, offset) in enumerate(repeats):
                alive, key, _ = _walk(x, starts, size, r, filters)
                if not len(alive):
                    continue
                lo, hi = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                for a, b, s in zip(lo.tolist(), hi.tolist(), starts[alive].tolist()):
                    for k in range(a, b):
                        self._verify(x, s, int(owner[k]), int(offset[k]), gap, first, tried, found)
        return [sorted((i, d, s) for i, (d, s) in f.items()) for f in found]

    def _verify(self, x, start, item, offset, gap, first, tried, found) -> None:
        aligned = start - offset
        if (item, aligned) in tried:
            return
        tried.add((item, aligned))
        doc = int(np.searchsorted(first + gap * np.arange(len(first)), start, side="right")) - 1
        origin = int(first[doc]) + gap * doc
        words = self.items[item]
        limit = int(EDITS * len(words))
        a = max(origin, aligned - limit)
        text = x[a : min(origin + int(first[doc + 1] - first[doc]), aligned + len(words) + limit)]
        distance = best_distance(words, text)
        if distance <= limit:
            now = (distance, max(aligned, origin) - origin)
            found[doc][item] = min(found[doc].get(item, now), now)


def best_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance, in words, of the item to any part of the text."""
    run = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item):
        new = np.minimum(row + 1, np.concatenate([[k + 1], row[:-1] + (text != word)]))
        row = np.minimum.accumulate(new - run) + run
    return int(row.min())


def _index(texts: tuple) -> Index:
    name = hashlib.sha256("\0".join(texts).encode()).hexdigest()
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = Index(list(texts))
    return _CACHE[name]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The items in blocks of about BLOCK_BYTES of text, each small enough for every task."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = rows.agg(F.sum(F.length("text") + 50)).first()[0] or 0
    blocks = int(size) // BLOCK_BYTES + 1
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        block.sort(key=lambda r: (r["id"] is None, r["id"] if r["id"] is not None else 0, r["text"]))
        if block:
            yield [r["id"] for r in block], tuple(r["text"] for r in block)


def found_items(texts: tuple, text_col: str = "text") -> Column:
    """Per whole text the matched items of one block: array of (item, distance, start_word), item its place in the block."""
    @F.arrow_udf("array<struct<item:int,distance:int,start_word:int>>")
    def run(column: pa.Array) -> pa.Array:
        index = _index(texts)
        out = [m for piece in W.slices(column) for m in index.matches(piece)]
        kind = pa.list_(pa.struct([("item", pa.int32()), ("distance", pa.int32()), ("start_word", pa.int32())]))
        return pa.array([[{"item": i, "distance": d, "start_word": s} for i, d, s in m] for m in out], kind)

    return run(F.col(text_col))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, distance, item_words, start_word): one row per document row and item found in it.

    An item is found where some part of the text is within 0.2 of its words in edit distance (words, A-Z lower-cased).
    Windows start on words of START_BYTES bytes or more; an item with under LEAST_STARTS such starts has the windows
    on its LEAST_STARTS longest words indexed, as one edit would else take the few away.
    Each hit is exact; the search reaches the recall that tests measure, and always finds verbatim passages.
    Items under eight words are always found, within no edit up to four words and within one up to seven. In scripts
    written without spaces (UNSPACED) every character is a word, in items, edits, item_words and start_word alike.
    Null, empty and blank texts match nothing; nor do null, empty and blank items. Repeated items and
    documents each give their rows; other columns are not read; empty tables give no rows.
    """
    base = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    out = None
    for ids, texts in item_blocks(items, item_col, item_text):
        names = F.array(*[F.lit(i) for i in ids])
        lengths = F.array(*[F.lit(int(n)) for n in np.diff(W.words(spaced(pa.array(texts, pa.string())))[3])])
        hits = base.select(id_col, F.explode(found_items(texts, "_text")).alias("m"))
        rows = hits.select(id_col, F.element_at(names, F.col("m.item") + 1).alias(item_col), F.col("m.distance").alias("distance"),
                           F.element_at(lengths, F.col("m.item") + 1).alias("item_words"), F.col("m.start_word").alias("start_word"))
        out = rows if out is None else out.union(rows)
    if out is None:
        return base.select(id_col, F.lit(None).cast(items.schema[item_col].dataType).alias(item_col), F.lit(0).alias("distance"), F.lit(0).alias("item_words"), F.lit(0).alias("start_word")).where("false")
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    for _, texts in item_blocks(items, item_col, item_text):
        docs = docs.where(F.size(found_items(texts, text_col)) == 0)
    return docs
