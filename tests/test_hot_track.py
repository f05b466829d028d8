"""Operators over events give the same rows in chunks of equal row counts as in chunks of a width."""

import random

import pytest
from pyspark.sql import functions as F

from stavework.operators import grid as G
from stavework.operators import harmony_spans as H
from stavework.operators import ordered as O
from stavework.operators import signal as S

K = ["track_id"]


@pytest.fixture(scope="module")
def beats(spark):
    rnd = random.Random(11)
    rows = []
    for track, n in [(0, 1500)] + [(t, rnd.randrange(1, 60)) for t in range(1, 80)]:
        at = 0.0
        for i in range(n):
            at += rnd.choice([0.5, 0.5, 0.5, 0.25, 2.5, 0.0 if track else 0.5])
            rows.append((track, track * 10_000 + i, round(at, 3), rnd.choice("abb"), rnd.choice([None, 60, 62])))
    return spark.createDataFrame(rows, "track_id int, event_id int, t double, label string, note int").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0 and O.CHUNK not in a.columns


def test_beats(beats):
    strict = beats.dropDuplicates(["track_id", "t"])
    for run in (lambda c: G.fill_gaps(strict, c).withColumn("t", F.round("t", 6)), lambda c: G.double_beats(beats, c), lambda c: G.tempo(beats, c),
                lambda c: G.thin(strict, K, "t", 1.1, c), lambda c: G.thin(strict, K, "t", 1.1, c, long_run=5)):
        same(run(None), run(7.0))
    still = beats.select("track_id", "event_id", F.floor("t").cast("double").alias("t"))
    assert G.fill_gaps(still.withColumn("t", F.lit(1.0)), None).where("origin <> 'detected'").count() == 0 and G.fill_gaps(still, None).count() >= still.count()
    placed = O.with_position(strict, K, ["t"], 7.0, "i").cache()
    down = placed.where("event_id % 5 = 0").select("track_id", "i")
    same(G.normalise_octave(placed.select("track_id", "i", "t"), down, 0.9, None), G.normalise_octave(placed.select("track_id", "i", "t"), down, 0.9, 7.0))


def test_spans_notes_and_strokes(beats):
    spans = beats.select("track_id", "event_id", F.col("t").alias("start"), (F.col("t") + 1).alias("end"), "label", F.lit(0.5).alias("share"))
    same(G.run_collapse(spans, ["start", "event_id"], None), G.run_collapse(spans, ["start", "event_id"], 7.0))
    pieces = beats.where("event_id % 3 = 0")
    same(H.splice(beats.where("event_id % 3 <> 0"), pieces, None), H.splice(beats.where("event_id % 3 <> 0"), pieces, 7.0))
    notes = beats.withColumn("root", F.lit(0))
    same(S.note_shares(notes, K, ["t", "event_id"], None), S.note_shares(notes, K, ["t", "event_id"], 7.0))
    frames = beats.select("track_id", (F.col("t") + 0.01).alias("ft"), (F.col("event_id") % 9 + 1.0).alias("level"))
    on = beats.select("track_id", F.col("event_id").alias("onset_id"), "t", F.lit(0.2).alias("slot_seconds"))
    same(S.stroke_decay(on, frames, 2.0, None), S.stroke_decay(on, frames, 2.0, 7.0))


@pytest.fixture
def small_partitions(spark):
    """Small tables too are dealt over all partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_chunk_is_much_larger_than_the_median(beats, small_partitions):
    many = beats.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("t", F.col("t") + F.col("copy") * 1e-5)
    cut = O.chunked(many, K, ["t", "event_id"], None)
    sizes = sorted(r["count"] for r in cut.groupBy(O.CHUNK).count().collect())
    hot = many.where("track_id = 0").count()
    assert hot > many.count() / 3 and sizes[-1] <= 3 * sizes[len(sizes) // 2] and cut.where("track_id = 0").select(O.CHUNK).distinct().count() >= 3
