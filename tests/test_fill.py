"""Filling silent bars: one search for the events over the bars, and overlaps at the buckets' edges."""

from pyspark.sql import functions as F

from stavework.operators import fill as L, intervals as I


def test_fill_looks_for_the_events_over_bars_once(spark, monkeypatch):
    calls, plain = [], L.over_bars
    monkeypatch.setattr(L, "over_bars", lambda *a, **k: calls.append(1) or plain(*a, **k))
    events = spark.createDataFrame([(1, 0, 0.0, 10.0, "C:maj"), (1, 1, 10.0, 30.0, "N"), (1, 2, 30.0, 40.0, "G:maj")], "track_id long, event long, start double, end double, label string")
    bars = spark.createDataFrame([(1, b, b * 10.0, b * 10.0 + 10.0) for b in range(4)], "track_id long, bar int, start double, end double")
    energy = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.01), (1, 3, 0.7)], "track_id long, bar int, energy double")
    major = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    chroma = spark.createDataFrame([(1, b, major) for b in range(4)], "track_id long, bar int, chroma array<double>")
    got = L.fill_silent_bars(events, bars, chroma, energy, 10.0).orderBy("start").select("start", "end", "label", "filled").collect()
    assert [tuple(r) for r in got] == [(0.0, 10.0, "C:maj", False), (10.0, 20.0, "C:maj", True), (20.0, 30.0, "N", False), (30.0, 40.0, "G:maj", False)]
    assert L.chorded_energy_reference(events, bars, energy, 10.0).first()["reference"] == 0.6
    assert len(calls) == 3  # cutting the silences, all events over bars, and the line above


def test_overlap_at_bucket_edges(spark):
    spans = [(i, a, b) for i, (a, b) in enumerate([(0.0, 10.0), (10.0, 20.0), (5.0, 25.0), (9.9999995, 10.0), (9.9999995, 10.0000005), (9.0, 10.000002), (20.0, 20.0), (-5.0, 0.0), (None, 3.0), (29.0, 30.5)])]
    left = spark.createDataFrame([(1, *s) for s in spans], "track_id long, i int, a double, b double")
    right = left.select("track_id", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    for eps in (0.0, 1e-6):
        got = sorted((r["i"], r["j"]) for r in I.overlap(left, right, ["track_id"], ("a", "b"), ("c", "d"), 10.0, eps).collect())
        kept = [(i, a, b) for i, a, b in spans if a is not None and b > a]
        assert got == sorted((i, j) for i, a, b in kept for j, c, d in kept if min(b, d) - max(a, c) > eps)
