"""SimHash near duplicates by anchor-point covering.

The 64 bits are two halves of 32; fingerprints that differ in at most 4 bits differ in at most 2 within one half. The
anchors of a half are the words whose set bit numbers XOR to zero (a Hamming code and one free bit): every word is
within radius 1 of one. The point halfway between two halves that differ in 2 bits is within 1 of both, so some anchor
is within radius 1 + 1 of both: a fingerprint is copied to all anchors within 2 of each half, 33 on average, and those
of one anchor are compared. An anchor with more than LIMIT fingerprints goes to the finest covering instead, where each
64-bit word is an anchor of radius 0 and copies go to all words within 2: its members are all within 4 of each other, so
a star links them, and the work stays in proportion to the members however many there are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stavework.llm import words as W
from stavework.llm.graph import components
from stavework.session import share

WORDS, SEED, DISTANCE = 4, 42, 4
LIMIT, FEW, GROUP_ROWS = 32_768, 16, 1_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(raw: bytes):
    """The text's words in lists of a few megabytes, cut between words."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + W.PIECE) if at + W.PIECE < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].lower().split()
        at = end


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of `width` words joined by one space."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1])
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)


def fingerprint(raw: bytes | None) -> int:
    """The text's fingerprint: each bit that over half of the shingle hashes have; zero without words."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in _word_runs(raw or b""):
        carry += words
        if len(carry) >= WORDS:
            codes = _hashes(carry, WORDS)
            total += len(codes)
            for k in range(0, len(codes), W.PIECE // 64):
                ones += np.unpackbits(codes[k : k + W.PIECE // 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            carry = carry[1 - WORDS :]
    if not total and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): one row per document, the fingerprint as a long of the same bits."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            codes = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column("id"), pa.array(codes.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _cover(syndrome: int) -> list[int]:
    """What to flip in a half of this syndrome to reach every anchor within 2: the bit or nothing, then pairs of bits."""
    nearest = [1 << syndrome] if syndrome else [0, 1]
    return nearest + [1 << i | 1 << (i ^ syndrome) for i in range(32) if i < i ^ syndrome and syndrome]


def copies(points: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor within 2 of one of its halves."""
    flips = F.array(*[F.array(*[F.lit(m).cast("long") for m in _cover(s)]) for s in range(32)])
    checks = [sum(1 << i for i in range(32) if i >> k & 1) for k in range(5)]

    def of_half(half: int) -> DataFrame:
        part = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        syndrome = sum((F.bit_count(part.bitwiseAND(F.lit(c))) % 2) * (1 << k) for k, c in enumerate(checks))
        anchors = F.transform(F.get(flips, syndrome.cast("int")), lambda m: part.bitwiseXOR(m) + F.lit(half << 32))
        return points.select(F.explode(anchors).alias("anchor"), "fp")

    return of_half(0).union(of_half(1))


def near(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links among all these fingerprints join, one per fingerprint at most.

    A component is grown from its first member; each of its members is compared with those not yet in a component.
    """
    left, right, rest = [], [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, (1 << 20) // len(rest))
            now, front = front[:step], front[step:]
            hits = np.bitwise_count(rest[:, None] ^ now[None, :]) <= DISTANCE
            reached = hits.any(axis=1)
            left.append(rest[reached])
            right.append(now[hits[reached].argmax(axis=1)])
            front, rest = np.concatenate([front, rest[reached]]), rest[~reached]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compared(table: pa.Table) -> pa.Table:
    """Links among the fingerprints of each anchor: all of them where an anchor has few, else enough to join them."""
    anchors, fps = table.column("anchor").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((fps, anchors))
    anchors, fps = anchors[order], fps[order]
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    sizes = np.diff(np.append(starts, len(fps)))
    few = np.repeat(sizes <= FEW, sizes)
    u, v = [], []
    for apart in range(1, FEW):
        at = np.flatnonzero(few[:-apart] & (anchors[:-apart] == anchors[apart:]))
        at = at[np.bitwise_count(fps[at] ^ fps[at + apart]) <= DISTANCE]
        u.append(fps[at])
        v.append(fps[at + apart])
    for a, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        x, y = near(fps[a : a + n])
        u.append(x)
        v.append(y)
    links = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
    return pa.table({"u": links[:, 0].copy().view(np.int64), "v": links[:, 1].copy().view(np.int64)})


def stars(points: DataFrame) -> DataFrame:
    """(u, v): links among these fingerprints by the finest covering; exact, with 2,081 short rows per fingerprint."""
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in flips])
    posts = points.select(F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"), "fp")
    middle = posts.groupBy("word").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select("word", "v")
    return posts.join(middle, "word").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def links(points: DataFrame) -> DataFrame:
    """(u, v): links of at most DISTANCE bits that join exactly the fingerprints (fp: long, distinct) which all links join."""
    posts = copies(points)
    sizes = share(posts.groupBy("anchor").count().where("count > 1"))
    rows, most = sizes.where(f"count <= {LIMIT}").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], sizes.agg(F.max("count")).first()[0] or 0
    groups = max(64, -(-int(rows) // GROUP_ROWS))
    usual = posts.join(sizes.where(f"count <= {LIMIT}").select("anchor"), "anchor").withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    out = usual.groupBy("part").applyInArrow(_compared, "u long, v long")
    if most > LIMIT:
        crowded = posts.join(sizes.where(f"count > {LIMIT}").select("anchor"), "anchor", "left_semi").select("fp").distinct()
        out = out.union(stars(share(crowded)))
    return out.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, fingerprint, component_id), links where fingerprints differ in at most 4 bits.

    * Words are runs of bytes other than blanks, A-Z in lower case; shingles of 4 words with repeats, of all words in a
      shorter text. Null, empty and blank texts have fingerprint zero and link like any other.
    * component_id is the least id reachable over links. Rows without an id take part as texts; a group of such rows
      alone has a null component_id. Repeated rows each get their row.
    * Only the two columns are read. An empty table gives no rows. A long text is read in pieces.
    """
    signed = share(fingerprints(docs, id_col, text_col))
    points = share(signed.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(points.select("fp")))
    rooted = points.join(found, points["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return signed.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
