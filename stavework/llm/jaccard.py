"""Exact Jaccard join on word shingles by vertical partitioning, up to connected components.

The global order of shingles is cut into fragments by hash. Candidates come from one half of the
order only: a linked pair may differ in a fifth of its shingles, so it must agree within the half,
and there on one of each text's rarest few. Overlaps are then counted fragment by fragment and
summed per pair, for pairs whose sketches do not rule a link out: a sketch holds the parity of the
codes per slot, and two sets differ by at least as many codes as their sketches by bits. Texts with
equal sets are one class; classes already known to be connected are never compared again, so a large
group of near copies costs stars, not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stavework.llm import words as W
from stavework.llm.graph import components
from stavework.session import release, share

SHORT, OVERLAP = 250, 200
BUCKET_TOKENS = 1_000_000
SLICE = 1 << 20  # bytes of text whose words and shingles a worker holds at once
FRAGMENTS, FIRST_FRAGMENTS = 8, 5
SLOTS, SLOTS_A_TEXT, RANGES = 1 << 25, 32, 1 << 10
_SHORT_SALT = np.uint64(0xA24BAED4963EE407)


def _class_keys(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key per set of codes: sums of two mixes, mixed again."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        a = np.add.reduceat(W.mix(codes + np.uint64(0x51ED270B)), bounds[filled])
        b = np.bitwise_xor.reduceat(W.mix(codes ^ np.uint64(0x7F4A7C159E3779B9)), bounds[filled])
        out[filled] = W.mix(a ^ W.mix(b + np.diff(bounds)[filled].astype(np.uint64)))
    return out


def _sets(texts: pa.Array, width: int):
    hashes, _, _, first, _ = W.words(texts)
    return W.distinct(*W.shingles(hashes, first, width))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = 5) -> DataFrame:
    """(id, n, cls, rep): set size, class key and a hash of the text, one row per document."""
    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text", SLICE):
                codes, bounds = _sets(part.column("text"), width)
                yield pa.record_batch([part.column("id"), pa.array(np.diff(bounds)), pa.array(_class_keys(codes, bounds).view(np.int64)), part.column("rep")],
                                      names=["id", "n", "cls", "rep"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("rep"))
    return rows.mapInArrow(run, f"id {kind}, n long, cls long, rep long")


def _sketch(codes: np.ndarray) -> np.ndarray:
    """The parity of the codes in each of twice to four times as many slots, 64 to a word; one of half the slots is the exclusive or of its halves."""
    slots = max(64, 1 << (2 * len(codes) - 1).bit_length())
    odd = np.bincount((codes & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _zones(texts: pa.Array, width: int, seen: set):
    """For each new set, its candidate zone and sketch: all codes of a short text, those of the lower half of the order of a long one."""
    codes, bounds = _sets(texts, width)
    keys, sizes = _class_keys(codes, bounds).view(np.int64), np.diff(bounds)
    upper = codes >= np.uint64(1 << 63)
    for i in np.flatnonzero(sizes).tolist():
        key, n = int(keys[i]), int(sizes[i])
        if key in seen:
            continue
        seen.add(key)
        own = codes[bounds[i] : bounds[i + 1]]
        sketch = _sketch(own)
        if n < SHORT:
            yield key, 0, n, np.sort(W.mix(own ^ _SHORT_SALT)), sketch
        if n >= OVERLAP:
            half = own[~upper[bounds[i] : bounds[i + 1]]]
            if len(half) <= n // 5:
                raise ValueError("a text has too few shingles in the lower half of the order")
            yield key, 1, n, half, sketch


def _piece_zones(texts: pa.Array, width: int, seen: set) -> list:
    """The zones of a piece, whose words and shingles are held for one slice of it at a time."""
    return [zone for part in W.slices(texts, SLICE) for zone in _zones(part, width, seen)]


def _runs(piece: int, zones: list, buckets: int) -> pa.RecordBatch:
    """What a piece of texts sends: a run of its distinct zone tokens for every bucket, and its own table.

    A run says at which of the piece's distinct tokens it starts. The table (bucket below zero) holds class, level, set
    size, zone size and words of the sketch of each zone, then the sketches, and in the order of the tokens which zones hold
    them; it travels to the piece's answers.
    """
    sizes = np.array([len(z[3]) for z in zones])
    order = np.argsort(flat := np.concatenate([z[3] for z in zones]), kind="stable")
    tokens, counts = np.unique(flat, return_counts=True)
    owners = np.repeat(np.arange(len(zones), dtype=np.uint16 if len(zones) <= 1 << 16 else np.uint32), sizes)[order]
    slots = (tokens >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(tokens), np.int64)
    cuts = np.flatnonzero(np.diff(slots, prepend=-1)).tolist()
    counts, n = counts.astype(np.uint32), len(cuts)
    spans = list(zip(cuts, [*cuts[1:], len(tokens)]))
    own = np.array([(z[0], z[1], z[2], len(z[3]), len(z[4])) for z in zones], np.int64)
    return pa.record_batch([
        pa.array([*slots[cuts].tolist(), -1 - (piece + (piece >> 32)) % buckets], pa.int32()),
        pa.array([piece] * (n + 1), pa.int64()),
        pa.array([*cuts, 0], pa.int64()),
        pa.array([*[tokens[a:b].tobytes() for a, b in spans], b""], pa.binary()),
        pa.array([*[counts[a:b].tobytes() for a, b in spans], counts.tobytes()], pa.binary()),
        pa.array([None] * n + [own.tobytes()], pa.binary()),
        pa.array([None] * n + [np.concatenate([z[4] for z in zones]).tobytes()], pa.binary()),
        pa.array([None] * n + [owners.tobytes()], pa.binary()),
    ], names=["bucket", "piece", "start", "tokens", "counts", "zones", "sketches", "owners"])


def _answered(table: pa.Table) -> pa.Table:
    """The runs of one bucket with the tokens that two or more zones hold: their places in the piece and counts in the corpus. Tables pass."""
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["piece", "tokens", "counts", "zones", "sketches", "owners"]).append_column("places", pa.array([None] * len(table), pa.binary()))
    runs = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    sizes = np.array([len(x) for x in runs])
    tokens = np.concatenate(runs)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).astype(np.int64)
    ends = np.cumsum(sizes)
    places = np.arange(len(tokens)) - np.repeat(ends - sizes - table.column("start").to_numpy(), sizes)
    order = np.argsort(tokens, kind="stable")
    starts = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[0]] ^ np.uint64(1)))
    sums = np.add.reduceat(counts[order], starts)
    df = np.empty(len(tokens), np.int64)
    df[order] = np.repeat(sums, np.diff(starts, append=len(tokens)))
    kept = np.flatnonzero(df > 1)
    cuts = np.searchsorted(kept, np.concatenate([[0], ends]))
    out: list = [[], [], [], []]
    for i, piece in enumerate(table.column("piece").to_pylist()):
        if cuts[i] < cuts[i + 1]:
            at = kept[cuts[i] : cuts[i + 1]]
            out[0].append(piece), out[1].append(tokens[at].tobytes()), out[2].append(df[at].tobytes()), out[3].append(places[at].astype(np.int32).tobytes())
    none = pa.array([None] * len(out[0]), pa.binary())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), none, none, none, pa.array(out[3], pa.binary())],
                    names=["piece", "tokens", "counts", "zones", "sketches", "owners", "places"])


def _piece_heads(table: pa.Table) -> pa.Table:
    """(cls, level, n, head, sketch) of one piece's zones, from its table and the answers to its runs."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["zones"] is not None)
    answers = [r for r in rows if r["zones"] is None]
    zones = np.frombuffer(own["zones"], np.int64).reshape(-1, 5)
    read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in answers] or [np.empty(0, kind)])
    tokens, df, places = read("tokens", np.int64), read("counts", np.int64), read("places", np.int32)
    counts = np.frombuffer(own["counts"], np.uint32).astype(np.int64)
    owners = np.frombuffer(own["owners"], np.uint32 if len(own["owners"]) > 2 * counts.sum() else np.uint16)
    held = counts[places]
    ends = np.cumsum(held)
    at = np.repeat(np.cumsum(counts)[places] - held - (ends - held), held) + np.arange(held.sum())
    owner, df, tokens = owners[at].astype(np.int64), np.repeat(df, held), np.repeat(tokens, held)
    order = np.lexsort((tokens, df, owner))
    shared = np.bincount(owner, minlength=len(zones))
    keep = np.minimum(np.maximum(zones[:, 2] // 5 + 1 - (zones[:, 3] - shared), 0), shared)
    firsts = np.cumsum(shared) - shared
    some = np.flatnonzero(keep)
    values = [tokens[order[a : a + k]] for a, k in zip(firsts[some].tolist(), keep[some].tolist())]
    offsets = pa.array(np.concatenate([[0], np.cumsum(keep[some])]).astype(np.int32))
    heads = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*values, np.empty(0, np.int64)])))
    ends = np.cumsum(zones[:, 4])
    words = np.frombuffer(own["sketches"], np.int64)
    kept = [words[b - k : b] for b, k in zip(ends[some].tolist(), zones[some, 4].tolist())]
    offsets = pa.array(np.concatenate([[0], np.cumsum(zones[some, 4])]).astype(np.int32))
    sketches = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*kept, np.empty(0, np.int64)])))
    columns = [pa.array(zones[some, 0]), pa.array(zones[some, 1].astype(np.int32)), pa.array(zones[some, 2]), heads, sketches]
    return pa.table(columns, names=["cls", "level", "n", "head", "sketch"])


def heads(docs: DataFrame, text_col: str, width: int, buckets: int) -> DataFrame:
    """(cls, level, n, head, sketch): the rarest zone tokens of each text, as many as a linked text can't all lack.

    Of z zone tokens at most n // 5 may be missing in a linked text, so one of the n // 5 + 1 rarest
    is common. Tokens that one text alone holds come first in the order and are not listed.

    Pieces of texts ask for the counts of their distinct tokens by bucket and get those of shared ones back, so tokens never
    become rows and one that many texts hold is one entry of each piece. A piece is named by its place in its partition.
    """
    def run(batches):
        seen: set = set()
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in W.pieces(batch, "text"):
                if zones := _piece_zones(part.column("text"), width, seen):
                    yield _runs(piece, zones, buckets)
                    piece += 1

    asked = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, piece long, start long, tokens binary, counts binary, zones binary, sketches binary, owners binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered, "piece long, tokens binary, counts binary, zones binary, sketches binary, owners binary, places binary")
    return answers.groupBy("piece").applyInArrow(_piece_heads, "cls long, level int, n long, head array<long>, sketch array<long>").dropDuplicates(["cls", "level"])


def _overlap_needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((n + m) * percent / (100 + percent) - 1e-9)


def _common_needed(n: Column, m: Column, percent: int) -> Column:
    """How many tokens the heads of two linked texts of n and m shingles share at least.

    A linked pair has o = ceil(p (n + m) / (1 + p)) shingles in common, so n - o of one text are missing in the other. A head holds
    n // 5 + 1 tokens with those of one text alone; of the head that ends first in the order, all tokens but the missing ones are in the other.
    """
    o = _overlap_needed(n, m, percent)
    one = lambda x: F.floor(x / 5) + 1 - (x - o)
    return F.greatest(F.least(one(n), one(m)), F.lit(1))


def _apart(a: str, b: str) -> Column:
    """By how many bits the sketches in columns `a` and `b`, of sets of similar sizes, differ.

    Codes of both sets cancel out, so the sketches differ by at most as many bits as the sets by codes. Sizes that may link
    lie a quarter apart at most, so one sketch has at most twice the words of the other and is folded once.
    """
    words = F.least(F.size(a), F.size(b))
    halves = lambda c: F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    fold = lambda c: F.when(F.size(c) > words, halves(c)).otherwise(F.col(c))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _may_link(a: str, b: str, n: Column, m: Column, percent: int) -> Column:
    """Whether the sketches of sets of sizes n and m leave a link possible."""
    return _apart(a, b) <= n + m - 2 * _overlap_needed(n, m, percent)


def _slots(id_: str, rep: str, slots: int) -> list[Column]:
    """The three slots of a text."""
    return [F.pmod(F.xxhash64(id_, rep, F.lit(k)), F.lit(slots)) for k in range(3)]


def marked_slots(chosen: DataFrame, slots: int) -> bytes:
    """A bit per slot: whether it is one of a text of `chosen` (id, rep). Ranges of slots are put together in tasks."""
    width = slots // min(RANGES, slots // 8)

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False)
            for k in np.unique(at // width).tolist():
                found.setdefault(k, np.zeros(width, bool))[at[at // width == k] % width] = True
        for k, marks in found.items():
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["part", "bits"])

    dealt = chosen.select(F.explode(F.array(*_slots("id", "rep", slots))).alias("slot")).repartition(F.expr(f"slot div {width}"))
    out = bytearray(slots // 8)
    for row in dealt.mapInArrow(merge, "part long, bits binary").collect():
        out[row["part"] * width // 8 : (row["part"] + 1) * width // 8] = row["bits"]
    return bytes(out)


def segments(docs: DataFrame, id_col: str, text_col: str, width: int, chosen: DataFrame) -> DataFrame:
    """(cls, fragment, codes, rest): the sets of the classes in `chosen` (cls, id, rep), cut by ranges of the order; `rest` counts the codes of later fragments.

    Texts are not shuffled to be chosen: each task passes those whose slots are all marked by the chosen ones, and classes
    that pass by chance are dropped by their keys. The slots take at most SLOTS bits however large the corpus; when it
    outgrows them more sets travel to be dropped, which changes no row.
    """
    slots = min(max(1 << 16, 1 << (chosen.count() * SLOTS_A_TEXT - 1).bit_length()), SLOTS)
    bits = marked_slots(chosen, slots)

    def run(batches):
        seen: set = set()
        step = np.uint64((1 << 64) // FRAGMENTS)
        marks = np.frombuffer(bits, np.uint8)
        for batch in batches:
            slot = np.stack([batch.column(f"slot{k}").to_numpy(zero_copy_only=False) for k in range(3)])
            batch = batch.filter(pa.array((marks[slot >> 3] << (slot & 7).astype(np.uint8) & 128).all(axis=0)))
            for part in W.pieces(batch, "text", SLICE):
                codes, bounds = _sets(part.column("text"), width)
                keys, sizes = _class_keys(codes, bounds).view(np.int64).tolist(), np.diff(bounds)
                out: list = [[], [], [], []]
                for i in np.flatnonzero(sizes).tolist():
                    if keys[i] in seen:
                        continue
                    seen.add(keys[i])
                    own = codes[bounds[i] : bounds[i + 1]]
                    cuts = np.searchsorted(own, np.arange(1, FRAGMENTS, dtype=np.uint64) * step)
                    for k, piece in enumerate(np.split(own, cuts)):
                        out[0].append(keys[i]), out[1].append(k), out[2].append(piece.view(np.int64)), out[3].append(len(own) - (int(cuts[k]) if k < len(cuts) else len(own)))
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.int32())], names=["cls", "fragment", "codes", "rest"])

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rep"), F.col(text_col).alias("text"))
    texts = texts.select("text", *[slot.alias(f"slot{k}") for k, slot in enumerate(_slots("id", "rep", slots))])
    found = texts.mapInArrow(run, "cls long, fragment int, codes array<long>, rest int")
    return found.join(chosen.select("cls"), "cls", "left_semi").dropDuplicates(["cls", "fragment"])


def _similar(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, nu, nv) that link: partial overlaps per fragment, summed per pair.

    The first fragments are counted for every pair; later ones only for pairs that would still link if
    all that is left of the smaller set were common. Every class has a row for each fragment, so no pair is lost.
    """
    counted = pairs.withColumn("o", F.lit(0).cast("long"))
    for low, high in ((0, FIRST_FRAGMENTS), (FIRST_FRAGMENTS, FRAGMENTS)):
        own = parts.where((F.col("fragment") >= low) & (F.col("fragment") < high))
        left = own.select(F.col("cls").alias("u"), "fragment", F.col("codes").alias("a"), F.col("rest").alias("ra"))
        right = own.select(F.col("cls").alias("v"), "fragment", F.col("codes").alias("b"), F.col("rest").alias("rb"))
        partial = counted.withColumnRenamed("o", "before").join(left, "u").join(right, ["v", "fragment"])
        partial = partial.select("u", "v", "nu", "nv", "before", F.least("ra", "rb").alias("rest"), F.size(F.array_intersect("a", "b")).cast("long").alias("o"))
        summed = partial.groupBy("u", "v", "nu", "nv", "before").agg(F.sum("o").alias("o"), F.min("rest").alias("rest"))
        at_most = F.col("before") + F.col("o") + F.col("rest")
        counted = summed.where(at_most * 100 >= (F.col("nu") + F.col("nv") - at_most) * percent).select("u", "v", "nu", "nv", (F.col("before") + F.col("o")).alias("o"))
    return counted.select("u", "v")


def _likely(pairs: DataFrame, tops: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) with sizes whose sketches are as near, and whose heads share as many tokens, as those of linked texts must."""
    left = tops.select(F.col("cls").alias("u"), "level", F.col("n").alias("nu"), F.col("head").alias("a"), F.col("sketch").alias("su"))
    right = tops.select(F.col("cls").alias("v"), "level", F.col("n").alias("nv"), F.col("head").alias("b"), F.col("sketch").alias("sv"))
    joined = pairs.join(left, "u").join(right, ["v", "level"])
    nu, nv = F.col("nu"), F.col("nv")
    return joined.where(_may_link("su", "sv", nu, nv, percent) & (F.size(F.array_intersect("a", "b")) >= _common_needed(nu, nv, percent))).select("u", "v", "nu", "nv").distinct()


def postings(tops: DataFrame, percent: int) -> DataFrame:
    """(token, cls, level, n, after): the head tokens at which a link can first show; `after` counts the head from there to its end.

    At the first common token of two heads all others they share come later, so a link that needs k common tokens shows
    at one with k left in both heads. What the sizes in a token's list allow bounds k from below: between two sizes the
    need is least at one of them, but for two tokens of rounding.
    """
    rows = tops.select("cls", "level", "n", F.size("head").alias("held"), F.posexplode("head").alias("place", "token"))
    lists = rows.groupBy("token").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("members")).where("members > 1").drop("members")
    n, after = F.col("n"), F.col("held") - F.col("place")
    smallest, largest = F.greatest("least", F.ceil(n * percent / 100)), F.least("most", F.floor(n * 100 / percent))
    need = F.least(_common_needed(n, smallest, percent), _common_needed(n, largest, percent)) - 2
    return rows.join(lists, "token").where(after >= need).select("token", "cls", "level", "n", after.alias("after"))


def _labelled(posts: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Posting lists with the component known so far (comp) and the list's commonest one (main), where a list holds several."""
    if edges is None:
        known = posts.withColumn("comp", F.col("cls"))
    else:
        found = components(edges)
        known = posts.join(found, posts["cls"] == found["node"], "left").select(*posts.columns, F.coalesce("component", "cls").alias("comp"))
    main = known.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    return known.join(main, "token")


def _nearest_first(pairs: DataFrame, edges: DataFrame, parts: DataFrame, percent: int, rounds: int) -> DataFrame:
    """`edges` and the links among `pairs` (u, v, nu, nv, apart) that connect what all of these would.

    Each class is first compared with the one whose sketch is nearest, `rounds` times; pairs that these links have put into
    one component are not counted. So a group of near copies that no list's commonest component holds costs about
    its classes, not its pairs; pairs that stay between components are all counted.
    """
    for _ in range(rounds):
        pair = F.struct((F.col("apart") / (F.col("nu") + F.col("nv"))).alias("share"), "u", "v", "nu", "nv")
        ends = pairs.select(F.explode(F.array("u", "v")).alias("end"), pair.alias("pair"))
        nearest = share(ends.groupBy("end").agg(F.min("pair").alias("pair")).select("pair.u", "pair.v", "pair.nu", "pair.nv").distinct())
        if nearest.isEmpty():
            return edges
        edges = share(edges.union(linked(nearest, parts, percent)))
        found = components(edges)
        for side in ("u", "v"):
            known = found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
            pairs = pairs.join(known, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        pairs = share(pairs.where("cu <> cv").drop("cu", "cv").join(nearest.select("u", "v"), ["u", "v"], "left_anti").select("u", "v", "nu", "nv", "apart"))
        release(pairs.sparkSession)
    return share(edges.union(linked(pairs.drop("apart"), parts, percent)))


def links(tops: DataFrame, parts: DataFrame, percent: int = 80, rounds: int = 3) -> DataFrame:
    """Verified links (u, v) that connect exactly the classes that all links connect.

    `rounds` times each posting list compares its members with one member of its commonest component;
    the last round compares every member outside that component with all of other components, each
    pair at its first common token. Pairs within a known component are never formed, so the last
    round is exact and the ones before only make it small. Pairs are counted in full only if their heads agree enough,
    the nearest first.
    """
    edges, posts = None, share(postings(tops, percent))
    for turn in range(rounds):
        lists = share(_labelled(posts, edges))
        if lists.isEmpty():
            return edges if edges is not None else lists.select(F.col("cls").alias("u"), F.col("cls").alias("v"))
        hub = lists.where("comp = main").groupBy("token").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)), F.col("cls").alias("hub"), F.col("n").alias("hn"))).alias("h")).select("token", "h.hub", "h.hn")
        pairs = lists.join(hub, "token").where((F.col("comp") != F.col("main")) & _similar(F.col("n"), F.col("hn"), percent))
        pairs = pairs.select(F.least("cls", "hub").alias("u"), F.greatest("cls", "hub").alias("v")).distinct()
        found = linked(_likely(pairs, tops, percent), parts, percent)
        edges = share(found if edges is None else edges.union(found))
        release(tops.sparkSession)
    lists = share(_labelled(posts, edges))
    if lists.isEmpty():
        return edges
    full = lists.join(tops.select("cls", "level", "head", "sketch"), ["cls", "level"])
    a = full.where("comp <> main").select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("after").alias("fa"), F.col("head").alias("ha"), F.col("sketch").alias("sa"))
    b = full.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("after").alias("fb"), F.col("head").alias("hb"), F.col("sketch").alias("sb"), (F.col("comp") != F.col("main")).alias("outside"))
    same, need = F.array_intersect("ha", "hb"), _common_needed(F.col("na"), F.col("nb"), percent)
    once = (F.col("ca") != F.col("cb")) & (~F.col("outside") | (F.col("a") < F.col("b"))) & _similar(F.col("na"), F.col("nb"), percent)
    once = once & (F.least("fa", "fb") >= need) & _may_link("sa", "sb", F.col("na"), F.col("nb"), percent) & (F.size(same) >= need) & (F.get(same, F.lit(0)) == F.col("token"))
    pairs = a.join(b, "token").where(once)
    pairs = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("nu"),
                         F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nv"), _apart("sa", "sb").alias("apart"))
    pairs = share(pairs.groupBy("u", "v", "nu", "nv").agg(F.min("apart").alias("apart")))
    release(pairs.sparkSession)
    return _nearest_first(pairs, edges, parts, percent, rounds)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (id, n_shingles, component_id), links where 100 * intersection >= percent * union.

    * The set of a text: distinct `width`-word shingles; with fewer words the whole sequence as one; null, empty or
      blank texts have none, link with nothing and are their own component.
    * component_id is the least id reachable over links. Rows without an id take part as texts, but name no
      component: a group of such rows alone has a null component_id. Repeated rows each get their row.
    * Only the two columns are read, so any other column may be there. An empty table gives no rows.
    * Sets are compared by 64-bit hashes of shingles; `percent` must be at least 80, as the zone is sized for it.
    """
    if percent < 80:
        raise ValueError("the zone is sized for 80 percent or more")
    signed = share(signatures(docs, id_col, text_col, width))
    total = signed.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(0, (int(total) // BUCKET_TOKENS)).bit_length()
    full = docs.where(F.col(text_col).isNotNull())
    tops = share(heads(full, text_col, width, buckets))
    release(docs.sparkSession)
    token = tops.select("cls", F.explode("head").alias("token"))
    several = token.groupBy("token").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most").select("token")
    alive = token.join(several, "token", "left_semi").select("cls").distinct()
    reps = signed.where("n > 0").join(alive, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("id", "rep")).alias("r")).select("cls", "r.id", "r.rep")
    parts = share(segments(full, id_col, text_col, width, share(reps)))
    release(docs.sparkSession)
    found = components(links(tops, parts, percent))
    release(docs.sparkSession)
    classes = signed.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"))
    classes = classes.join(found, classes["cls"] == found["node"], "left").select("cls", F.coalesce("component", "cls").alias("root"), "least")
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(groups, "root").select("cls", "component_id")
    linked_rows = signed.where("n > 0").join(named, "cls").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked_rows.union(alone)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near duplicates: that of the least id, of several texts under it that of the least hash.

    * A document is an id with a text. Rows that share an id but not the text are documents of their own, so no text
      is lost through another one's id; rows that share both are one, of which the least row stays (maps, which have no
      order, compare as JSON).
    * Rows without an id can't be named by a group and stay, as do null, empty and blank texts of any id.
    * All columns are kept, whatever their names and types; an empty table gives no rows.
    """
    columns = docs.columns
    key = F.when(F.col(f"`{id_col}`").isNotNull(), F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text")))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    keyed = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    kept = share(jaccard_components(keyed, "key", "text")).where("key = component_id").select("key").distinct()
    release(docs.sparkSession)
    unordered = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    order = F.struct(*[F.col("row").getField(c) for c in columns if c not in unordered], *[F.to_json(F.struct(F.col("row").getField(c))) for c in unordered])
    single = keyed.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", order).alias("row"))
    rows = single.select("row").union(keyed.where("key is null").select("row"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])
