"""Operators without a SQL oracle, against brute force on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from stavework.operators import grid as G
from stavework.operators import riff as RF
from stavework.operators import structure as T
from stavework.operators import truth as TR


def test_containment_of_written_out_cases(spark):
    c, g, a, d, cg = ["C:maj"], ["G:maj"], ["A:min"], ["D:min"], ["C:maj", "G:maj"]
    cases = [
        ([c, g], [a, c, g, d], 0.0),  # lies inside
        ([a, c, g, d], [c, g], 0.0),  # in either order
        ([c, g], [c, a, g], 0.5),  # one gap over two bars
        ([cg], [c], 0.5),  # half of the triads shared
        ([c, g, c], [g, c, g], 1 / 3),  # equal lengths: one bar dropped
        ([c, g], [a, d], 1.0),
        ([[]], [[]], 0.0),
        ([[], c], [c, [], c, c], 0.0),  # chordless bars are equal
        ([], [c], 0.0),
        ([], [], 0.0),
    ]
    df = spark.createDataFrame([(i, x, y) for i, (x, y, _) in enumerate(cases)], "id int, a array<array<string>>, b array<array<string>>")
    got = {r["id"]: r["distance"] for r in T.containment(df).collect()}
    assert got == {i: pytest.approx(w, abs=1e-8) for i, (_, _, w) in enumerate(cases)}


def test_components_follow_chains(spark):
    nodes = spark.createDataFrame([(1, n) for n in range(9)], "track_id int, node int")
    e = [(0, 1), (1, 2), (2, 3), (3, 4), (6, 7)]
    edges = spark.createDataFrame([(1, a, b) for x, y in e for a, b in ((x, y), (y, x))], "track_id int, src int, dst int")
    got = {r["node"]: r["comp"] for r in T.components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 6, 8: 8}


def plans(spark, *tracks):
    """Each track a list of (label, bars), a bar a string of triad letters."""
    sections = [(t, i, label) for t, track in enumerate(tracks) for i, (label, _) in enumerate(track)]
    bars = [(t, i, 100 * i + b, list(triads)) for t, track in enumerate(tracks) for i, (_, content) in enumerate(track) for b, triads in enumerate(content)]
    out = T.section_plan(spark.createDataFrame(sections, "track_id bigint, section int, label string"),
                         spark.createDataFrame(bars, "track_id bigint, section int, bar int, triad_set array<string>"))
    rows = sorted((r["track_id"], r["k"], r["label"], r["members"], r["start_bar"], r["end_bar"]) for r in out.collect())
    return [[r[2:] for r in rows if r[0] == t] for t in range(len(tracks))]


def test_plan_merges_sandwiches_then_fragments(spark):
    cg, wide = ["C", "G"] * 4, ["C", "G", "A"] * 3
    got = plans(
        spark,
        [("chorus", cg), ("verse", ["C"] * 4), ("chorus", cg), ("verse", ["G"] * 3), ("verse", cg)],
        [("chorus", cg), ("verse", ["C"]), ("chorus", cg), ("verse", ["G"]), ("chorus", cg)],  # a chain of sandwiches
        [("chorus", cg), ("verse", ["A"]), ("chorus", cg)],  # a triad of its own
        [("verse", cg), ("verse", ["C", "G"]), ("verse", ["A", "C", "G"] * 3)],  # equal distance: the earlier
        [("verse", wide), ("verse", ["G", "C"]), ("verse", ["A", "G", "C"] * 3)],  # the nearer
        [("verse", ["C"]), ("bridge", cg), ("chorus", ["C"]), ("intro", cg)],  # nothing to join
        [("chorus", cg), ("verse", ["C"]), ("verse", ["C", "G"]), ("chorus", cg)],  # a fragment merge makes a sandwich
    )
    assert got == [
        [("chorus", "0,1,2", 0, 20), ("verse", "3,4", 20, 31)],
        [("chorus", "0,1,2,3,4", 0, 26)],
        [("chorus", "0", 0, 8), ("verse", "1", 8, 9), ("chorus", "2", 9, 17)],
        [("verse", "0,1", 0, 10), ("verse", "2", 10, 19)],
        [("verse", "0", 0, 9), ("verse", "1,2", 9, 20)],
        [("verse", "0", 0, 1), ("bridge", "1", 1, 9), ("chorus", "2", 9, 10), ("intro", "3", 10, 18)],
        [("chorus", "0,1,2,3", 0, 19)],
    ]


def test_vocal_edges_are_inserted_or_moved(spark):
    cases = [
        ([0, 20], [(8, 14, False)], [0, 8, 14, 20]),
        ([0, 10, 20], [(12, 30, False)], [0, 12, 20, 30]),  # 10 is close to 12 and moves
        ([0, 38], [(36, 40, True)], [0, 38]),  # a trailing run adds nothing
        ([0, 10, 14], [(12, 30, False)], [0, 10, 14, 30]),  # two close starts
        ([0, 8], [(8, 11, False)], [0, 8]),  # a start on an edge stays
        ([0, 20, 35], [(20, 33, False), (34, 40, True)], [0, 20, 35]),  # nothing moves from a trailing run on
        ([0, 20], [(2, 38, False)], [0, 20]),  # too close to the first start and to the end
        ([0, 20, 23], [(18, 26, False)], [0, 18, 26]),  # two edges of one stretch
        ([5], [], [5]),
    ]
    b = spark.createDataFrame([(t, x, 40) for t, (starts, _, _) in enumerate(cases) for x in starts], "track_id bigint, start_bar int, n_bars int")
    r = spark.createDataFrame([(t, *run) for t, (_, runs, _) in enumerate(cases) for run in runs], "track_id bigint, start_bar int, end_bar int, trailing boolean")
    got = T.insert_vocal_boundaries(b, r).collect()
    assert [sorted(x["start_bar"] for x in got if x["track_id"] == t) for t in range(len(cases))] == [w for _, _, w in cases]


def test_short_runs_merge_forward_and_a_tail_folds_back(spark):
    ids = [0, 0, 0, 1, 2, 2, 2, 2, 0]
    df = spark.createDataFrame([(1, b, c) for b, c in enumerate(ids)], "track_id int, bar int, cluster int")
    got = sorted((r["start_bar"], r["end_bar"], r["cluster"]) for r in G.cluster_boundaries(df, 2).collect())
    assert got == [(0, 3, 0), (3, 9, 2)]


def test_region_matches_are_one_to_one(spark):
    ref = spark.createDataFrame([(1, 0, 3), (1, 5, 5), (1, 20, 22)], "track_id int, first int, last int")
    est = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 6, 6), (1, 30, 31)], "track_id int, first int, last int")
    row = TR.region_match(ref, est).first()
    assert (row["matched"], row["event_f"]) == (2, pytest.approx(4 / 7))


def test_riff_votes_the_commonest_pitch_and_reports_support(spark):
    bars = [[60, 2064], [60, 2064], [60, 2067]]
    df = spark.createDataFrame([(1, 0, i, 8, n) for i, n in enumerate(bars)], "track_id int, section int, bar int, width int, notes array<bigint>")
    row = RF.choose_riff(df).first()
    assert (row["candidate"], row["notes"], row["unit"]) == ("majority", [60, 2064], 1)
    assert row["support"] == pytest.approx((1 + 2 / 3) / 2)


def test_thinning_long_runs_by_pointers_equals_folding_them(spark):
    rng = random.Random(4)
    rows = sorted({(t, round(rng.uniform(0, 60), 3)) for t in range(3) for _ in range(150)})
    df = spark.createDataFrame(rows, "track_id int, x double")
    want = []
    for t in range(3):
        last = None
        for x in (x for u, x in rows if u == t):
            if last is None or x - last >= 1.5:
                want.append((t, x))
                last = x
    for limit in (10_000, 3):
        assert sorted(map(tuple, G.thin(df, ["track_id"], "x", 1.5, 10.0, long_run=limit).collect())) == want
