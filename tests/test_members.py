"""The member-level strum job on written-out members, one track per case."""

import pytest
from pyspark.sql import functions as F

from stavework.plans import members as P

A, B, C, OTHER = "S-S-S-S-", "-S---S--", "SSSS----", "S-S-S---"
REST = "--------"
# track: (bars, None where one rests; members as (section, start, end); riff members; trailing bars)
TRACKS = {
    # the second member starts on the figure's second bar, the third plays something else, the fourth rests
    1: ([A, B] * 4 + [B, A] * 3 + [C] * 6 + [None] * 4, [(0, 0, 8), (0, 8, 14), (0, 14, 20), (0, 20, 24)], [], 0),
    # like the first member, but not the same; the second section's longest member rests
    2: ([A] * 6 + [OTHER] * 5 + [None] * 7 + [A] * 5, [(0, 0, 6), (0, 6, 11), (1, 11, 18), (1, 18, 23)], [], 0),
    3: ([A] * 6 + [OTHER] * 5, [(0, 0, 6), (0, 6, 11)], [1], 0),
    4: ([A, A, None, A, A, A] + [C] * 5, [(0, 0, 11)], [], 5),
}


def masks(text):
    return sum(1 << i for i, c in enumerate(text) if c in "Sx"), sum(1 << i for i, c in enumerate(text) if c == "x")


@pytest.fixture(scope="module")
def job(spark):
    bars = [(t, b, 8, *masks(x or REST), x is None) for t, (texts, *_) in TRACKS.items() for b, x in enumerate(texts)]
    members = [(t, s, m, a, b) for t, (_, spans, *_) in TRACKS.items() for m, (s, a, b) in enumerate(spans)]
    riffs = [(t, spans[m][0], m) for t, (_, spans, riffs, _) in TRACKS.items() for m in riffs]
    records, heads = P.member_job(
        spark.createDataFrame(bars, "track_id int, bar int, width int, strike bigint, mute bigint, rests boolean"),
        spark.createDataFrame(members, "track_id int, section int, member int, start_bar int, end_bar int"),
        spark.createDataFrame([(t, d) for t, (*_, d) in TRACKS.items() if d], "track_id int, drop long"),
        spark.createDataFrame(riffs, "track_id int, section int, member int"), 8, seed=F.col("track_id"))
    text = lambda r: "".join("S" if r["p_strike"] >> j & 1 else "-" for j in range(8))
    rows = records.collect()
    return {(r["track_id"], r["bar"]): (text(r), r) for r in rows}, {(r["track_id"], r["section"]): r for r in heads.collect()}, len(rows)


def printed(job, track, bars):
    return [job[0][track, b][0] for b in bars]


def lent(job, track, bars):
    return {job[0][track, b][1]["from_section"] for b in bars}


def test_every_bar_has_one_record(job):
    assert job[2] == len(job[0]) == sum(len(texts) for texts, *_ in TRACKS.values())


def test_members_print_the_sections_vote_in_their_own_phase(job):
    assert printed(job, 1, range(8)) == [A, B] * 4 and lent(job, 1, range(8)) == {False}
    assert printed(job, 1, range(8, 14)) == [B, A] * 3 and lent(job, 1, range(8, 14)) == {True}
    assert printed(job, 1, range(14, 20)) == [C] * 6 and lent(job, 1, range(14, 20)) == {False}
    head = job[1][1, 0]
    assert head["member"] == 0 and head["unit"] == 2 and not head["silent"]


def test_a_silent_member_is_empty_and_uncertain(job):
    for b in range(20, 24):
        text, row = job[0][1, b]
        assert text == REST and row["rests"] and row["uncertain"] and row["confidence"] == 0 and row["unit"] == 1


def test_a_riff_keeps_its_own_vote(job):
    assert printed(job, 2, range(6, 11)) == [A] * 5 and lent(job, 2, range(6, 11)) == {True}
    assert printed(job, 3, range(6, 11)) == [OTHER] * 5 and lent(job, 3, range(6, 11)) == {False}


def test_a_silent_longest_member_lends_no_vote(job):
    head = job[1][2, 1]
    assert head["silent"] and head["uncertain"] and head["member"] == 2 and head["strike"] == 0
    assert printed(job, 2, range(18, 23)) == [A] * 5 and lent(job, 2, range(18, 23)) == {False}


def test_trailing_bars_are_recorded_not_voted_and_rests_print_nothing(job):
    assert printed(job, 4, range(11)) == [A, A, REST, A, A, A] + [A] * 5
    rest = job[0][4, 2][1]
    assert rest["rests"] and not rest["uncertain"] and rest["unit"] == 1 and rest["chance_p"] is None
    assert job[1][4, 0]["confidence"] == 1.0


def test_longest_member_is_the_earlier_of_equals(spark):
    members = spark.createDataFrame([(1, 0, 4, 8, 12), (1, 0, 2, 0, 4), (1, 1, 3, 4, 8)], "track_id int, section int, member int, start_bar int, end_bar int")
    assert {(r["section"], r["longest"]) for r in P.longest_members(members).collect()} == {(0, 2), (1, 3)}
