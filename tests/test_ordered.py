"""Chunked windows must equal plain ones wherever the chunk edges fall."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.operators import intervals as I
from stavework.operators import ordered as O

K = ["track_id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(0 if i % 3 else i % 5, i, rng.choice([None, "a", "b"]), round(rng.uniform(0, 100), 3)) for i in range(400)]
    return spark.createDataFrame(data, "track_id int, i int, v string, t double").cache()


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_position_neighbour_and_sums_match_plain_windows(rows, width):
    w = Window.partitionBy("track_id").orderBy("t", "i")
    got = O.with_position(rows, K, ["t", "i"], width)
    got = O.with_neighbour(got, K, ["t", "i"], width, {"prev": "v"})
    got = O.with_neighbour(got, K, ["t", "i"], width, {"next": "i"}, ahead=True)
    got = O.with_running_sum(got, K, ["t", "i"], width, {"total": F.col("i")})
    got = O.with_last_known(got, K, ["t", "i"], width, {"known": "v"})
    want = rows.select(
        "*", (F.row_number().over(w) - 1).alias("pos"), F.lag("v").over(w).alias("prev"), F.lead("i").over(w).alias("next"),
        F.sum("i").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.last("v", True).over(w).alias("known"))
    cols = ["track_id", "i", "pos", "prev", "next", "total", "known"]
    key = lambda r: (r["track_id"], r["i"])
    assert sorted(map(tuple, got.select(cols).collect()), key=lambda r: r[:2]) == sorted(map(tuple, want.select(cols).collect()), key=lambda r: r[:2])
    assert key


def test_runs_count_changes_across_chunks(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbbacc")], "track_id int, i int, v string")
    got = {r["i"]: r["run"] for r in O.with_runs(df, K, ["i"], 2, "v").collect()}
    assert [got[i] for i in range(8)] == [1, 1, 2, 2, 2, 3, 4, 4]


def test_halo_frames_equal_plain_frames(rows):
    w = Window.partitionBy("track_id").orderBy("pos").rowsBetween(-2, 2)
    placed = O.with_position(rows, K, ["t", "i"], 10.0).cache()
    near = Window.partitionBy("track_id", O.CHUNK).orderBy("pos").rowsBetween(-2, 2)
    got = O.with_halo(placed, K, "pos", 2, size=5).withColumn("m", F.percentile("t", 0.5).over(near)).where("_own")
    want = placed.withColumn("m", F.percentile("t", 0.5).over(w))
    assert sorted(map(tuple, got.select("track_id", "i", "m").collect())) == sorted(map(tuple, want.select("track_id", "i", "m").collect()))


def test_exact_median_of_a_group_over_the_sketch_size(spark):
    df = spark.range(250_001).select((F.lit(1)).alias("g"), ((F.col("id") * 7919) % 250_001).cast("double").alias("v"))
    small = spark.createDataFrame([(2, 1.0), (2, 4.0), (3, 5.0)], "g int, v double")
    got = {r["g"]: r["median"] for r in O.exact_median(df.unionByName(small), ["g"], "v").collect()}
    assert got == {1: 125000.0, 2: 2.5, 3: 5.0}


def test_range_joins_match_brute_force(spark):
    rng = random.Random(3)
    pts = [(rng.randint(0, 1), i, round(rng.uniform(0, 50), 2)) for i in range(120)]
    spans = [(rng.randint(0, 1), i, a, round(a + rng.uniform(0.5, 20), 2)) for i, a in enumerate(round(rng.uniform(0, 50), 2) for _ in range(40))]
    p = spark.createDataFrame(pts, "track_id int, pid int, t double")
    s = spark.createDataFrame(spans, "track_id int, sid int, lo double, hi double")
    got = sorted((r["pid"], r["sid"]) for r in I.point_in_span(p, s, K, "t", "lo", "hi", 3.0).collect())
    assert got == sorted((b, d) for a, b, t in pts for c, d, lo, hi in spans if a == c and lo <= t < hi)
    s2 = s.selectExpr("track_id", "sid as sid2", "lo as lo2", "hi as hi2")
    pairs = sorted((r["sid"], r["sid2"]) for r in I.overlap(s, s2, K, ("lo", "hi"), ("lo2", "hi2"), 3.0).collect())
    assert pairs == sorted((b, d) for a, b, x, y in spans for c, d, u, v in spans if a == c and min(y, v) - max(x, u) > 0)
    near = sorted((r["pid"], r["q"]) for r in I.within(p, p.selectExpr("track_id", "pid as q", "t as u"), K, "t", "u", 0.5, "inner").collect())
    assert near == sorted((b, d) for a, b, t in pts for c, d, u in pts if a == c and abs(t - u) <= 0.5)
    assert statistics
