"""Votes on literal bars, against plain Python over the same bars."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from stavework.functions import rhythm as R
from stavework.operators import chance as C
from stavework.operators import votes as V
from stavework.params import VoteParams

SEC = V.SECTION


def masks(text):
    return sum(1 << i for i, c in enumerate(text) if c in "Sx"), sum(1 << i for i, c in enumerate(text) if c == "x")


def bars(spark, sections):
    rows = [(t, s, b, len(text), *masks(text)) for (t, s), texts in sections.items() for b, text in enumerate(texts)]
    return spark.createDataFrame(rows, "track_id int, section int, bar int, width int, strike bigint, mute bigint")


def agree(a, b):
    pairs = [(x, y) for x, y in zip(a, b) if not (x == y == "-")]
    return sum(1.0 if x == y else 0.5 if "-" not in (x, y) else 0.0 for x, y in pairs) / len(pairs) if pairs else 1.0


def vote(texts):
    n, w = len(texts), len(texts[0])
    k = [sum(t[j] != "-" for t in texts) for j in range(w)]
    m = [sum(t[j] == "x" for t in texts) for j in range(w)]
    out = ["x" if 2 * m[j] > k[j] else "S" if 3 * k[j] > n and k[j] >= 2 else "-" for j in range(w)]
    out = [c if 3 * k[j] > n and k[j] >= 2 else "-" for j, c in enumerate(out)]
    floor = round(0.6 * statistics.median(sum(c != "-" for c in t) for t in texts))
    for j in sorted((j for j in range(w) if out[j] == "-"), key=lambda j: (-k[j], j))[:max(0, floor - sum(c != "-" for c in out))]:
        out[j] = "S"
    return "".join(out)


@pytest.fixture(scope="module")
def sections():
    rng = random.Random(11)
    out = {(t, s): ["".join(rng.choice("S-S-x") for _ in range(8)) for _ in range(rng.randint(1, 9))] for t in range(4) for s in range(3)}
    out[(9, 0)] = ["S-S-S-S-", "-xS--S-x"] * 5  # alternates in pairs
    out[(9, 1)] = ["--------"] * 4
    return out


def text(row, s="strike", m="mute", w=8):
    return "".join("x" if row[m] >> j & 1 else "S" if row[s] >> j & 1 else "-" for j in range(w))


def test_topped_vote_and_leave_one_out(spark, sections):
    df = bars(spark, sections)
    got = {(r["track_id"], r["section"]): text(r, "vote_strike", "vote_mute") for r in V.section_vote(df).collect()}
    assert got == {k: vote(v) for k, v in sections.items()}
    loo = {(r["track_id"], r["section"]): r["score_majority"] for r in V.majority_loo(df).collect()}
    for k, v in sections.items():
        want = agree(v[0], vote(v)) if len(v) == 1 else statistics.mean(agree(b, vote(v[:i] + v[i + 1:])) for i, b in enumerate(v))
        assert loo[k] == pytest.approx(want, abs=1e-9)


def test_medoid_is_the_same_when_patterns_are_blocked(spark, sections, monkeypatch):
    units = V.units_of_bars(bars(spark, sections))
    plain = sorted(map(tuple, V.medoid(V.agreement_sums(units)).drop("score_medoid").collect()))
    monkeypatch.setattr(V, "BLOCK", 2)
    assert sorted(map(tuple, V.medoid(V.agreement_sums(units)).drop("score_medoid").collect())) == plain


def test_alternating_section_votes_two_bars(spark, sections):
    row = V.choose_pattern(bars(spark, sections)).where("track_id = 9 and section = 0").first()
    assert (row["unit"], row["phase"], text(row, w=16)) == (2, 0, "S-S-S-S--xS--S-x")


def test_chance_paths_agree_and_noise_is_not_structured(spark, sections):
    p = VoteParams(chance_shuffles=60)
    units = V.units_of_bars(bars(spark, sections)).cache()
    a = {r[:2]: r[2] for r in map(tuple, C.chance_p(units, 8, p=p).collect())}
    b = {r[:2]: r[2] for r in map(tuple, C.chance_p(units, 8, p=p, local_bars=3).collect())}
    assert a == b
    assert a[(9, 1)] == 1.0


def test_swap_distance(spark):
    cases = [("S---S---", "-S---S--", 2), ("S-------", "SS------", 8), ("SSSS----", "----SSSS", 16), ("--------", "--------", 0)]
    df = spark.createDataFrame([(masks(a)[0], masks(b)[0], w) for a, b, w in cases], "a bigint, b bigint, want bigint")
    got = df.select(R.swap_distance(F.col("a"), F.col("b"), F.lit(8)).alias("d"), "want").collect()
    assert all(r["d"] == r["want"] for r in got)


def test_chance_of_groups_cut_by_batches(spark, sections):
    p = VoteParams(chance_shuffles=60)
    units = V.units_of_bars(bars(spark, sections)).cache()
    drawn = C.chance_p(units, 8, p=p)
    assert "FlatMapGroupsInPandas" not in drawn._jdf.queryExecution().executedPlan().toString()  # a call per group costs more than its draws
    whole = sorted(map(tuple, drawn.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(tuple, C.chance_p(units, 8, p=p).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_votes_sort_no_slots(spark, sections):
    """A vote is worked out within its row: left-out votes of many patterns would be sorted eight rows each."""
    units = V.units_of_bars(bars(spark, sections)).cache()
    for votes in (V.majority_loo(units), V.section_vote(units)):
        plan = votes._jdf.queryExecution().optimizedPlan().toString()
        assert "AS rank" not in plan and "row_number" not in plan.split("InMemoryRelation")[0]


def test_vote_of_groups_with_units_of_two_widths(spark):
    rows = [(1, 0, w, *masks(t)) for w, t in ((4, "S---"), (4, "S-x-"), (2, "SS"))]
    df = spark.createDataFrame(rows, "track_id long, section int, width int, strike long, mute long")
    counts = V.slots_of(V.slot_counts(df)).withColumn("floor", F.lit(2))
    got = sorted((r["width"], r["n"], r["vote_strike"], r["vote_mute"]) for r in V.vote_of(counts, SEC, min_support=1).collect())
    assert got == [(2, 1, 0b11, 0), (4, 2, 0b101, 0b100)]
