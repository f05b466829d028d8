"""SimHash components against plain versions."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from stavework.llm import simhash

SCHEMA = "doc_id long, text string, fp string, anchor int, component string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(points):
    comp = {p: p for p in points}
    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= 4 and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = {p: new if c == old else c for p, c in comp.items()}
    return comp


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], SCHEMA)


def check(spark, texts):
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    comp = plain_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    want = sorted(((i, f"{p:016x}", least.get(comp[p])) for i, p in prints), key=str)
    assert sorted(map(tuple, simhash.simhash_components(rows(spark, texts)).collect()), key=str) == want


def near_copies(n):
    rnd = random.Random(n)
    vocabulary = [f"W{k}" for k in range(300)]
    texts = []
    for size in (1, 3, 4, 5, 40, 150, 400):
        base = [rnd.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, 8):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(size)] = rnd.choice(vocabulary)
            texts.append((len(texts), rnd.choice([" ", "\n", "\t "]).join(w)))
    return texts


def test_components_against_all_pairs(spark):
    texts = near_copies(1) + [(900, None), (901, ""), (902, " \n"), (None, "lone row"), (None, "lone row"), (4, "again"), (4, "again"), (5, "É x")]
    check(spark, texts)
    assert simhash.simhash_components(rows(spark, [])).count() == 0


def test_crowded_anchors_take_the_finest_covering(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIMIT", 3)
    check(spark, near_copies(2))


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(3000)) + "  end"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash.W, "PIECE", 64)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)
    assert simhash.fingerprint(b"x" * 1000 + b" y") == plain_fingerprint("x" * 1000 + " y")


def test_every_pair_within_the_threshold_shares_an_anchor(spark):
    rnd = random.Random(3)
    pairs = []
    for k in range(400):
        a, b = rnd.getrandbits(64), 0
        for bit in rnd.sample(range(64) if k % 2 else range(32 * (k % 4 // 2), 32 * (k % 4 // 2) + 32), 4):
            b |= 1 << bit
        pairs.append((k, a, a ^ b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(k, signed(x)) for k, *ab in pairs for x in ab], "k int, fp long")
    points = table.select("fp").distinct()
    posts = simhash.copies(points)
    found = table.join(posts, "fp").groupBy("k", "anchor").agg(F.countDistinct("fp").alias("n")).where("n = 2").select("k").distinct()
    assert found.count() == len(pairs) and posts.count() <= 34 * points.count()
    assert {tuple(sorted((r["u"], r["v"]))) for r in simhash.links(points).collect()} >= {tuple(sorted((signed(a), signed(b)))) for _, a, b in pairs}


def test_near_joins_what_all_pairs_join():
    import numpy as np
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    points = list({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 9))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(50)})
    u, v = simhash.near(np.array(points, np.uint64))
    comp = plain_components(points)
    own = {p: p for p in points}
    for a, b in zip(u.tolist(), v.tolist()):
        assert (a ^ b).bit_count() <= 4
        old, new = own[a], own[b]
        own = {p: new if c == old else c for p, c in own.items()}
    assert len({(comp[p], own[p]) for p in points}) == len(set(comp.values())) == len(set(own.values()))
