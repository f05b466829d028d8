"""Cross-entropy difference: bigram models of a target domain and of all documents over one vocabulary score each document.

Words seen fewer than CUTOFF times in the corpus are one unknown word in both models; every other word is part of the
vocabulary, however many there are. Both models interpolate bigram, unigram and uniform estimates with the same weights,
so they differ in their counts alone. The score of a document is the mean over its words of
(loss under the target model - loss under the background model), in bits: lower is nearer to the target.

No task holds the vocabulary. Texts are written once as pieces of word numbers with the piece's own words; a piece asks
for the counts of its words, then of its bigrams, by bucket of their hashes, and gets them back in the order it asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stavework.llm import words as W
from stavework.session import release, share

CUTOFF = 3
BIGRAM, UNIGRAM = 0.6, 0.35
BUCKET_ENTRIES, LEAST_BUCKETS = 2_000_000, 64
_UNKNOWN, _START = np.uint64(0), np.uint64(1)
_ANSWER = "piece long, kind int, bucket int, n binary, t binary, e binary, et binary"
_SUMMARY, _WORDS, _BIGRAMS = -1, 0, 1


def _pack(x: np.ndarray) -> bytes:
    """Length and bytes of the array, all first bytes first and compressed, so that small numbers take little room."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Rising hashes as their steps."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


def _parts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of rising hashes: each bucket has an equal range of them, so the parts follow one another."""
    slots = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [(int(slots[a]), a, b) for a, b in zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist())]


def _asked(piece: int, keys: np.ndarray, buckets: int, tallies: list[np.ndarray], names: list[str]) -> pa.Table:
    """One row per bucket with its part of the keys and their tallies."""
    parts = _parts(keys, buckets)
    columns = [pa.array([p[0] for p in parts], pa.int32()), pa.array([piece] * len(parts), pa.int64()), pa.array([_pack_keys(keys[a:b]) for _, a, b in parts], pa.binary())]
    return pa.table(columns + [pa.array([_pack(x[a:b]) for _, a, b in parts], pa.binary()) for x in tallies], names=["bucket", "piece", "keys", *names])


def _summed(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(entries of each row, place of every entry among the distinct keys, sums of the distinct keys) of one bucket."""
    keys = [_unpack_keys(b) for b in table.column("keys").to_pylist()]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in names:
        x = np.concatenate([_unpack(b, np.int32) for b in table.column(name).to_pylist()])
        total = np.zeros(int(place.max()) + 1, np.int64)
        np.add.at(total, place, x)
        sums.append(total)
    return np.array([len(k) for k in keys]), place, sums


def _answers(table: pa.Table, kind: int, sizes: np.ndarray, place: np.ndarray, sums: list[np.ndarray]) -> pa.Table:
    ends = np.cumsum(sizes)
    spans = list(zip((ends - sizes).tolist(), ends.tolist()))
    blobs = [pa.array([_pack(x[place[a:b]]) for a, b in spans], pa.binary()) for x in sums]
    blobs += [pa.array([b""] * len(spans), pa.binary())] * (4 - len(blobs))
    return pa.table([table.column("piece"), pa.array([kind] * len(spans), pa.int32()), table.column("bucket"), *blobs], names=["piece", "kind", "bucket", "n", "t", "e", "et"])


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words rising, the number of every occurrence's word by falling frequency, the place of each number among the words)."""
    words, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    ranks = np.argsort(-n, kind="stable").astype(np.int32)
    number = np.empty(len(words), np.int32)
    number[ranks] = np.arange(len(words), dtype=np.int32)
    return words, number[at], ranks


def text_pieces(rows: DataFrame) -> DataFrame:
    """(piece, entries, total, words, ranks, at, codes, lengths, marks): every text as numbers of its piece's distinct words, the commonest first."""
    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text", 2 * W.PIECE):
                hashes, _, _, first, _ = W.words(part.column("text"))
                words, at, ranks = _numbered(hashes)
                marks = np.asarray(part.column("target").to_numpy(zero_copy_only=False), bool)
                blobs = [_pack_keys(words), _pack(ranks), _pack(at.astype(np.int32)), np.asarray(part.column("code")).tobytes(), _pack(np.diff(first).astype(np.int32)), _pack(marks)]
                yield pa.record_batch([pa.array([len(words)], pa.int64()), pa.array([len(at)], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]],
                                      names=["entries", "total", "words", "ranks", "at", "codes", "lengths", "marks"])

    out = rows.select("text", "code", "target").mapInArrow(run, "entries long, total long, words binary, ranks binary, at binary, codes binary, lengths binary, marks binary")
    return out.select(F.monotonically_increasing_id().alias("piece"), "*")


class _Piece:
    """One row of `text_pieces`."""

    def __init__(self, row: dict):
        self.id = row["piece"]
        self.words, self.at = _unpack_keys(row["words"]), _unpack(row["ranks"], np.int32)[_unpack(row["at"], np.int32)]
        self.codes, self.lengths = np.frombuffer(row["codes"], np.int64), _unpack(row["lengths"], np.int32).astype(np.int64)
        self.marks = np.repeat(_unpack(row["marks"], bool), self.lengths)
        ends = np.cumsum(self.lengths)
        filled = self.lengths > 0
        self.starts, self.lasts, self.filled = (ends - self.lengths)[filled], ends[filled] - 1, filled

    def word_tallies(self) -> list[np.ndarray]:
        """n, t: occurrences in all and in target texts; e, et: those that end a text, with no further word behind them."""
        count = lambda at: np.bincount(at, minlength=len(self.words)).astype(np.int32)
        n, t = count(self.at), count(self.at[self.marks])
        last = self.lasts
        return [n, t, count(self.at[last]), count(self.at[last[self.marks[last]]])]

    def learn_words(self, answers: pa.Table) -> None:
        self.n, self.t, self.e, self.et = _gathered(answers, _WORDS, ("n", "t", "e", "et"))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct bigram keys, place of every occurrence among them)."""
        symbols = np.where(self.n >= CUTOFF, self.words, _UNKNOWN)[self.at]
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[self.starts] = _START
        return np.unique(W.mix(W.mix(before + np.uint64(0x9E3779B97F4A7C15)) ^ symbols), return_inverse=True)


def _gathered(answers: pa.Table, kind: int, names: tuple) -> list[np.ndarray]:
    """The answers of one kind, in the order of the piece's own keys."""
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    return [np.concatenate([_unpack(r[name], np.int64) for r in rows]) for name in names]


def word_answers(pieces: DataFrame, buckets: int) -> DataFrame:
    """Each piece's words with their counts in the corpus, and a summary row of each bucket: vocabulary, n, t, e, et, and the last four of unknown words."""
    names = ["n", "t", "e", "et"]

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                piece = _Piece(row)
                yield from _asked(piece.id, piece.words, buckets, piece.word_tallies(), names).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        sizes, place, sums = _summed(table, names)
        rare = sums[0] < CUTOFF
        summary = np.array([np.count_nonzero(~rare), *[x.sum() for x in sums], *[x[rare].sum() for x in sums]], np.int64)
        first = pa.table([pa.array([-1], pa.int64()), pa.array([_SUMMARY], pa.int32()), table.column("bucket")[:1], pa.array([summary.tobytes()], pa.binary()), *[pa.array([b""], pa.binary())] * 3], names=["piece", "kind", "bucket", *names])
        return pa.concat_tables([first, _answers(table, _WORDS, sizes, place, sums)])

    asked = pieces.mapInArrow(ask, "bucket int, piece long, keys binary, n binary, t binary, e binary, et binary")
    return asked.groupBy("bucket").applyInArrow(merge, _ANSWER)


def bigram_answers(pieces: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Each piece's bigrams with their counts in the corpus. A piece asks for a bigram once, so a frequent one is an entry of each piece."""
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int32)
        if not left.num_rows or not left.column("total")[0].as_py():
            return _asked(0, np.zeros(0, np.uint64), buckets, [none, none], ["n", "t"])
        piece = _Piece(left.to_pylist()[0])
        piece.learn_words(right)
        keys, place = piece.bigrams()
        count = lambda at: np.bincount(at, minlength=len(keys)).astype(np.int32)
        return _asked(piece.id, keys, buckets, [count(place), count(place[piece.marks])], ["n", "t"])

    def merge(table: pa.Table) -> pa.Table:
        return _answers(table, _BIGRAMS, *_summed(table, ["n", "t"]))

    asked = pieces.groupBy("piece").cogroup(words.where(F.col("kind") == _WORDS).groupBy("piece")).applyInArrow(ask, "bucket int, piece long, keys binary, n binary, t binary")
    return asked.groupBy("bucket").applyInArrow(merge, _ANSWER)


def text_losses(pieces: DataFrame, words: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(code, n, target, background): summed losses per text code; equal texts add up, which leaves their means alone."""
    size, n, t, e, et, rare_n, rare_t, rare_e, rare_et = np.sum([np.frombuffer(r["n"], np.int64) for r in words.where(F.col("kind") == _SUMMARY).select("n").collect()] or [np.zeros(9, np.int64)], axis=0).tolist()

    def bits(pair, one, context, total) -> np.ndarray:
        return -np.log2(BIGRAM * pair / np.maximum(context, 1) + UNIGRAM * one / max(total, 1) + (1 - BIGRAM - UNIGRAM) / (size + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not left.column("total")[0].as_py():
            return pa.table({k: pa.array([], pa.int64() if k in ("code", "n") else pa.float64()) for k in ("code", "n", "target", "background")})
        piece = _Piece(left.to_pylist()[0])
        piece.learn_words(right)
        _, place = piece.bigrams()
        pair_n, pair_t = _gathered(right, _BIGRAMS, ("n", "t"))
        known = piece.n >= CUTOFF

        def sums(pair, one, end, rare, rare_end, total, starts):
            one, followed = np.where(known, one, rare)[piece.at], np.where(known, one - end, rare - rare_end)[piece.at]
            context = np.empty_like(followed)
            context[1:] = followed[:-1]
            context[piece.starts] = starts
            return np.add.reduceat(bits(pair[place], one, context, total), piece.starts)

        return pa.table({"code": piece.codes[piece.filled], "n": piece.lengths[piece.filled], "target": sums(pair_t, piece.t, piece.et, rare_t, rare_et, t, et),
                         "background": sums(pair_n, piece.n, piece.e, rare_n, rare_e, n, e)})

    answers = words.where(F.col("kind") == _WORDS).union(bigrams)
    got = pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, "code long, n long, target double, background double")
    return got.groupBy("code").agg(F.sum("n").alias("n"), F.sum("target").alias("target"), F.sum("background").alias("background"))


def cross_entropy_difference(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, loss_target, loss_background, score) per document, in bits per word; `target` is a SQL condition on `docs`.

    * The background is all documents, the target those that meet the condition (null counts as no). All words of all texts are counted.
      The shared vocabulary is every word with at least CUTOFF occurrences; any other word is one unknown word.
    * Null, empty and blank texts score 0 with losses 0. With no target document the target model is uniform.
      Equal texts score alike; null or repeated ids each keep their row. An empty table gives no rows. Columns beyond
      id, text and those of the condition are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.expr(target).cast("boolean"), F.lit(False)).alias("target"), F.xxhash64(text_col).alias("code"))
    pieces = share(text_pieces(rows))
    entries, total = pieces.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    word_buckets, buckets = (max(LEAST_BUCKETS, int(x) // BUCKET_ENTRIES) for x in (entries, total))
    words = share(word_answers(pieces, word_buckets))
    release(spark)
    bigrams = share(bigram_answers(pieces, words, buckets))
    release(spark)
    sums = text_losses(pieces, words, bigrams)
    mean = lambda c: F.round(F.coalesce(F.col(c) / F.col("n"), F.lit(0.0)), 6)
    out = rows.select("id", "code").join(sums, "code", "left")
    out = out.select(F.col("id").alias(id_col), mean("target").alias("loss_target"), mean("background").alias("loss_background"))
    return out.withColumn("score", F.round(F.col("loss_target") - F.col("loss_background"), 6))
