"""Phrase collocations by top-order marginalisation.

Every word occurrence is one row of lead-window columns: the word and the words that follow it in its piece, five in
all, padded at the piece's end. Only these longest windows are counted; Spark's ROLLUP over (lang, w1 .. w5) then sums
successively shorter prefixes, which gives the count of all words of a language, of each word and of each phrase at once.

A window is also padded from the word on that makes its prefix too rare to be listed; a window without a word still
counts for its language. For that, two passes count by hash slot: words and pairs, then longer n-grams whose pairs may be
frequent. A slot's count is at least that of each of its n-grams, so what is cut off occurs fewer than `least` times
and no prefix that matters changes. The slots take at most SLOTS bits however large the corpus; when it outgrows them
fewer windows are cut, which costs time but changes no row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stavework.llm import words as W
from stavework.session import share

LONGEST, LEAST, TOP = 5, 100, 2000
SLOTS, LEAST_SLOTS, RANGES, BYTES_A_SLOT = 1 << 25, 1 << 16, 1 << 10, 32
PARTS = 64
_ID_BITS = 21
RUN = 1 << 20
_VOCABULARY, _WINDOWS = 1 << 18, 1 << 21
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_BREAKS + b"\t", b"." * len(_BREAKS) + b" ")
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")


def _runs(texts: list[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The texts in runs of about a megabyte with a break between texts; a run that ends inside a long text says so."""
    held, size = [], 0
    for text in texts:
        if size + len(text) > RUN and held:
            yield b".".join(held), False
            held, size = [], 0
        at = 0
        while len(text) - at > RUN and (cut := _GAP.search(text, at + RUN)):
            yield text[at : cut.start()], True
            at = cut.start()
        held.append(text[at:] if at else text)
        size += len(held[-1])
        if at:
            yield held.pop(), False
            size = 0
    if held:
        yield b".".join(held), False


class _Words:
    """Numbers and hashes of the words that a task has met; 0 is a break or the padding."""

    def __init__(self) -> None:
        self.ids = defaultdict(count().__next__)
        self.ids[b"."]
        self.hashes = np.zeros(1, np.uint64)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def hashed(self) -> np.ndarray:
        known, new = len(self.hashes), len(self.ids)
        if new > known:
            fresh = [xxhash.xxh64_intdigest(w) for w in list(self.ids)[known:]]
            self.hashes = np.concatenate([self.hashes, np.array(fresh, np.uint64)])
        return self.hashes


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words, n): pieces of text with `.` for a break, of which the first n words start windows here.

    A long text comes in several runs; the last words of one stand in front of the next.
    """
    langs = pc.dictionary_encode(batch.column("lang"))
    texts = batch.column("text").cast(pa.large_binary())
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = texts.filter(pc.equal(langs.indices, k)).to_pylist()
        carry: list[bytes] = []
        for run, goes_on in _runs(own):
            words = carry + run.lower().translate(_FOLD).replace(b".", b" . ").split()
            n = max(0, len(words) - LONGEST + 1) if goes_on else len(words)
            yield lang, words, n
            carry = words[n:]


class _Grams:
    """The n-grams that start at each place of a run of words, one word longer at a time, with a hash code each."""

    def __init__(self, met: _Words, lang: str, words: list[bytes], n: int) -> None:
        ids = met.numbered(words)
        self.ids = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
        self.hashes = met.hashed()[self.ids]
        self.at, self.length = np.flatnonzero(ids[:n] > 0), 1
        self.codes = W.mix(self.hashes[self.at] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))

    def slots(self, bits: int) -> np.ndarray:
        return (self.codes >> np.uint64(64 - bits)).astype(np.int64)

    def keep(self, which: np.ndarray) -> None:
        self.at, self.codes = self.at[which], self.codes[which]

    def longer(self) -> np.ndarray:
        """Goes on with the next word where there is one; the places of that word."""
        self.keep(self.ids[self.at + self.length] > 0)
        after = self.at + self.length
        self.codes = W.mix(self.codes * np.uint64(0x9E3779B97F4A7C15) + self.hashes[after])
        self.length += 1
        return after


def _marks(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def _short(grams: _Grams, marked: np.ndarray, bits: int) -> np.ndarray:
    """Leaves the pairs of marked words in `grams` that are marked; whether the pair at each place is."""
    grams.keep(marked[grams.slots(bits)])
    grams.longer()
    grams.keep(marked[grams.slots(bits)])
    fine = np.zeros(len(grams.ids), bool)
    fine[grams.at] = True
    return fine


def frequent_slots(rows: DataFrame, bits: int, least: int, shorter: bytes | None = None) -> bytes:
    """A bit per slot: whether its n-grams occur `least` times or more together, over the whole corpus.

    Counts words and pairs, or with the bits of those (`shorter`) the n-grams of three words and more whose pairs all have
    their bit. Tasks count into one array and send it in compressed ranges; each range is summed as it streams by.
    """
    ranges = min(RANGES, (1 << bits) // 8)
    width = (1 << bits) // ranges

    def run(batches):
        met, total = _Words(), np.zeros(1 << bits, np.uint32)
        marked = _marks(shorter) if shorter else None
        for batch in batches:
            for lang, words, n in _sequences(batch):
                if len(met.ids) > _VOCABULARY:
                    met = _Words()
                grams = _Grams(met, lang, words, n)
                if marked is None:
                    np.add.at(total, grams.slots(bits), 1)
                    grams.longer()
                    np.add.at(total, grams.slots(bits), 1)
                    continue
                fine = _short(grams, marked, bits)
                while grams.length < LONGEST:
                    grams.keep(fine[grams.at + grams.length - 1])
                    grams.longer()
                    np.add.at(total, grams.slots(bits), 1)
        codec = pa.Codec("zstd", 1)
        for k in range(ranges):
            part = total[k * width : (k + 1) * width]
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([codec.compress(part.tobytes(), asbytes=True)], pa.binary())], names=["part", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for k, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(codec.decompress(blob, width * 4, asbytes=True), np.uint32).astype(np.uint64)
        for k, counts in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["part", "bits"])

    sent = rows.mapInArrow(run, "part int, counts binary").repartition("part")
    out = bytearray((1 << bits) // 8)
    for row in sent.mapInArrow(merge, "part int, bits binary").collect():
        out[row["part"] * width // 8 : row["part"] * width // 8 + len(row["bits"])] = row["bits"]
    return bytes(out)


def _packed(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return ids[0] << _ID_BITS | ids[1], ids[2] << 2 * _ID_BITS | ids[3] << _ID_BITS | ids[4]


def _unpacked(head: np.ndarray, tail: np.ndarray) -> list[np.ndarray]:
    mask = (1 << _ID_BITS) - 1
    return [head >> _ID_BITS, head & mask, tail >> 2 * _ID_BITS, tail >> _ID_BITS & mask, tail & mask]


def _tallied(head: np.ndarray, tail: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows once, their counts added."""
    order = np.lexsort((tail, head))
    head, tail = head[order], tail[order]
    starts = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]))
    return head[starts], tail[starts], np.add.reduceat(counts[order], starts)


class _Windows:
    """A task's windows: new ones by the numbers of the words met, tallied ones by those of the words that windows hold."""

    def __init__(self) -> None:
        self.names = defaultdict(count().__next__)
        self.names[b""]
        self.tallies: dict[str, tuple] = {}
        self.new: dict[str, list] = defaultdict(list)
        self.waiting = 0

    def add(self, lang: str, ids: list[np.ndarray]) -> None:
        self.new[lang].append(_packed(ids))
        self.waiting += len(ids[0])

    def tally(self, words: list[bytes]) -> None:
        ones = lambda x: np.ones(len(x), np.int64)
        for lang, parts in self.new.items():
            head, tail = (np.concatenate(x) for x in zip(*parts))
            head, tail, counts = _tallied(head, tail, ones(head))
            ids = _unpacked(head, tail)
            lookup = np.zeros(len(words), np.int64)
            for i in np.unique(np.concatenate(ids)).tolist():
                lookup[i] = self.names[words[i] if i else b""]
            head, tail = _packed([lookup[x] for x in ids])
            before = self.tallies.get(lang)
            if before:
                head, tail, counts = (np.concatenate(x) for x in zip(before, (head, tail, counts)))
            self.tallies[lang] = _tallied(head, tail, counts)
        self.new, self.waiting = defaultdict(list), 0

    def full(self) -> bool:
        return len(self.names) > _VOCABULARY or sum(len(t[0]) for t in self.tallies.values()) > _WINDOWS // 2

    def rows(self) -> Iterator[pa.RecordBatch]:
        text = pa.array(list(self.names), pa.binary()).cast(pa.string())
        for lang, (head, tail, counts) in self.tallies.items():
            for a in range(0, len(head), 1 << 16):
                part = slice(a, a + (1 << 16))
                columns = [text.take(pa.array(x)) for x in _unpacked(head[part], tail[part])]
                yield pa.record_batch([pa.array([lang] * len(columns[0])), *columns, pa.array(counts[part])], names=["lang", "w1", "w2", "w3", "w4", "w5", "c"])


def windows(rows: DataFrame, shorter: bytes, longer: bytes, bits: int) -> DataFrame:
    """(lang, w1 .. w5, c): the windows with their counts; an empty word is padding."""
    def run(batches):
        short, long = _marks(shorter), _marks(longer)
        met, found = _Words(), _Windows()
        for batch in batches:
            for lang, words, n in _sequences(batch):
                grams = _Grams(met, lang, words, n)
                starts = grams.at
                if not len(starts):
                    continue
                column = np.zeros((LONGEST, len(grams.ids)), np.int64)
                column[0, starts] = np.where(short[grams.slots(bits)], grams.ids[starts], 0)
                _short(grams, short, bits)
                column[1, grams.at] = grams.ids[grams.at + 1]
                while grams.length < LONGEST:
                    grams.longer()
                    grams.keep(long[grams.slots(bits)])
                    column[grams.length - 1, grams.at] = grams.ids[grams.at + grams.length - 1]
                found.add(lang, list(column[:, starts]))
                if found.waiting > _WINDOWS or len(met.ids) > _VOCABULARY:
                    found.tally(list(met.ids))
                    met = _Words()
                    if found.full():
                        yield from found.rows()
                        found = _Windows()
        found.tally(list(met.ids))
        yield from found.rows()

    counted = rows.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, w4 string, w5 string, c long")
    return counted.groupBy("lang", "w1", "w2", "w3", "w4", "w5").agg(F.sum("c").alias("c"))


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, least: int) -> DataFrame:
    """(lang, words, a): `words` empty for all words of the language, else each word and phrase that occurs `least` times."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (min(max(size // BYTES_A_SLOT, LEAST_SLOTS), SLOTS) - 1).bit_length()
    names = [f"w{k + 1}" for k in range(LONGEST)]
    shorter = frequent_slots(rows, bits, least)
    counted = windows(rows, shorter, frequent_slots(rows, bits, least, shorter), bits).rollup("lang", *names).agg(F.sum("c").alias("a"))
    held = F.filter(F.array(*names), lambda w: w.isNotNull())  # a rolled-up column is null
    counted = counted.where("lang is not null").select("lang", held.alias("words"), "a")
    return counted.where((F.size("words") == 0) | (F.col("a") >= least) & (F.get("words", F.size("words") - 1) != ""))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The `top` phrases of 2 to 5 words of each language: (lang, rank, phrase, a, l, r, n, score).

    a is the phrase's count, n the language's words, l and r the counts of the two parts at the cut with the lowest
    score floor(1000 a n / (l r)), the first of equal ones. A phrase with a longer one around it that is as frequent is left
    out: counts fall with length, so a neighbour one word longer shows it. Ties in score go to the higher a, then to
    the phrase that comes first by UTF-8 bytes.

    * Null texts are empty, null languages `und`. Ids are not read, and repeated rows count as often as they stand. An
      empty table, or one without a phrase of `least` occurrences, gives no rows.
    * Only the two columns are read. A long text is read in pieces that share their edge words.
    * Products are decimals of 38 digits; scores stay below 10 n.
    """
    counts = share(phrase_counts(docs, text_col, lang_col, least))
    n = counts.where(F.size("words") == 0).select("lang", F.col("a").alias("n"))
    known = counts.where(F.size("words") > 0).select("lang", "words", F.array_join("words", " ").alias("phrase"), "a")
    parts = known.select("lang", "phrase", "a")
    cuts = known.where(F.size("words") > 1).select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(words, cut + 1, size(words)), ' ')").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(n, "lang")
    exact = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"({exact('1000 * a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    inner = F.explode(F.array(F.expr("array_join(slice(words, 1, size(words) - 1), ' ')"), F.expr("array_join(slice(words, 2, size(words) - 1), ' ')"))).alias("phrase")
    around = known.where(F.size("words") > 2).select("lang", inner, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where("longer is null or longer < a")
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
