"""One-to-one matching against plain searches, and chunks of equal row counts."""

import random

import pytest
from pyspark.sql import functions as F

from stavework.operators import ordered as O
from stavework.operators import truth as T


def largest(refs, ests, fits):
    """The size of a largest matching, by augmenting paths."""
    owner = {}

    def place(i, seen):
        for j, e in enumerate(ests):
            if j not in seen and fits(refs[i], e):
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(refs)))


def lists(rnd, n):
    return [round(rnd.choice([rnd.uniform(0, 2), rnd.randrange(8) * 0.25]), 3) for _ in range(n)]


@pytest.mark.parametrize("rows", [3, 4096])
def test_event_f_is_of_a_largest_matching(spark, monkeypatch, rows):
    monkeypatch.setattr(T, "CHUNK_ROWS", rows)
    rnd = random.Random(rows)
    tracks = {k: (lists(rnd, rnd.randrange(1, 40)), lists(rnd, rnd.randrange(0, 40))) for k in range(25)}
    tracks |= {100: ([1.0] * 5, [1.0] * 5), 101: ([1.0, 1.05, 1.1], [1.0, 1.0, 1.17]), 102: ([1.0], []), 103: ([1.0, 2.0], [1.07, 2.071])}
    table = lambda side: spark.createDataFrame([(k, t) for k, v in tracks.items() for t in v[side]] + [(200, None)], "track_id long, t double")
    got = {r["track_id"]: r for r in T.event_f(table(0), table(1), 0.07).collect()}
    assert set(got) == set(tracks)
    for k, (refs, ests) in tracks.items():
        best = largest(refs, ests, lambda a, b: abs(round(a * 1e6) - round(b * 1e6)) <= 70000)
        assert got[k]["matched"] == best and got[k]["f"] == pytest.approx(2 * best / (len(refs) + len(ests))), k
    assert got[100]["f"] == 1.0


def test_regions_take_the_first_free_estimate(spark):
    rnd = random.Random(9)

    def some():
        at, out = 0, []
        while at < 60:
            at += rnd.choice([2, 2, 2, 3, 7])
            end = at + rnd.choice([0, 0, 1, 1, 4])
            out.append((at, end))
            at = end
        return out

    tracks = {k: (some(), some()) for k in range(30)} | {50: ([(3, 4)], []), 51: ([], [(3, 4)])}
    table = lambda side: spark.createDataFrame([(k, a, b) for k, v in tracks.items() for a, b in v[side]], "track_id long, first int, last int")
    got = {r["track_id"]: (r["n_ref"], r["n_est"], r["matched"]) for r in T.region_match(table(0), table(1)).collect()}
    for k, (refs, ests) in tracks.items():
        free, matched = list(ests), 0
        for a, b in refs:
            hit = next((e for e in free if abs(e[0] - a) <= 1 and abs(e[1] - b) <= 1), None)
            if hit:
                free.remove(hit)
                matched += 1
        assert got[k] == (len(refs), len(ests), matched), k


def test_ranged_windows_equal_plain_ones(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(1000 + F.col("id") % 997).alias("track_id"), F.rand(3).alias("t"), F.col("id").alias("i"))
    cut = O.ranged(rows, ["track_id"], ["t", "i"])
    got = O.with_position(cut, ["track_id"], ["t", "i"], 0)
    got = O.with_running_sum(got, ["track_id"], ["t", "i"], 0, {"total": F.col("i")})
    got = O.with_neighbour(got, ["track_id"], ["t", "i"], 0, {"before": "i"})
    w = "over (partition by track_id order by t, i)"
    want = rows.selectExpr("track_id", "i", f"row_number() {w} - 1 as pos", f"sum(i) {w} as total", f"lag(i) {w} as before")
    assert got.selectExpr("track_id", "i", "pos", "total", "before").exceptAll(want.selectExpr("track_id", "i", "cast(pos as bigint) pos", "total", "before")).count() == 0
