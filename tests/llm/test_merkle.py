"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from stavework.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, path int"
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
            paths[i].append((run[: a % 16], run[a % 16 + 1 :]))
            at[i] = a // 16
        nodes = [digest("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    keys = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per = {}
    for k in keys:
        members = sorted((r for r in rows if r[1] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        per[k] = (members, *tree([leaf(r) for r in members]))
    root, over = tree([per[k][1] for k in keys])
    for k, rest in zip(keys, over):
        for r, path in zip(per[k][0], per[k][2]):
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf((*r[:4], r[4].translate(LOWER)) if bad else r)
            for before, after in path + rest:
                h = digest("".join([*before, h, *after]))
            yield r[0], leaf(r), per[k][1], root, digest("".join("".join(a + b) for a, b in path + rest)), h, h == root


def rows_of(n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None, "\u00e9", "z"]), "en", i, rnd.choice(["Abc", "abc", None, "", "\u00c9 X"])) for i in range(n)]
    rows += [(None, "a", None, None, None), (5, "a", "en", 5, "Zz"), (5, "a", "en", 5, "Zz"), (9000, "lone", None, None, "Q" * 300_000)]
    return rows + [(10_000 + k, f"s{k}", "en", 1, "T") for k in range(20)]


@pytest.mark.parametrize("n, digits", [(500, 1), (500, 3), (40, 2)])
def test_manifest_against_a_plain_tree(spark, n, digits):
    rows = rows_of(n)
    got = merkle.merkle_manifest(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), digits=digits).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_none_one_and_many_equal_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(empty).count() == 0
    one = [(1, None, None, None, None)]
    assert [tuple(r) for r in merkle.merkle_manifest(spark.createDataFrame([(*one[0], "x", 1)], SCHEMA)).collect()] == list(plain(one))
    same = [(7, "s", "en", 1, "T")] * 40
    got = merkle.merkle_manifest(spark.createDataFrame([(*r, "x", 1) for r in same], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(same)))
