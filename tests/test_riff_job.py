"""The riff job: pitches named from frames at the strokes, the members' riff flags, the gate and the tab."""

import datetime as dt
import json
import random
import statistics

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stavework.catalog import jobs as CJ
from stavework.operators import riff as RF
from stavework.plans import jobs as J

TUNING = [67, 60, 64, 69]
LINE = [60, 60, 62, 63, 62, 60, 67, 65]
TAB = "0:1:0 1:1:0 2:1:2 3:1:3 4:1:2 5:1:0 6:0:0 7:2:1"
BARS = "track_id int, section int, bar int, start double, end double, width int"
STROKES = "track_id int, bar int, slot int"
FRAMES = "track_id int, ft double, midi double"


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    """The query on a line of eight notes a day in the first section: tracks 1 as it is, 2 unvoiced, 3 with a muted stroke, 7 gated."""
    folder, rows = tmp_path_factory.mktemp("tables"), []
    for track in (1, 2, 3, 7):
        for bar in range(7):
            for slot, pitch in enumerate(LINE):
                kind = {2: "signup", 3: "error" if slot == 3 else "view"}.get(track, "view")
                at = dt.datetime(2024, 1, 1) + dt.timedelta(days=bar, hours=3 * slot, minutes=10)
                rows.append((len(rows), at, track, kind, 1.0, json.dumps({"k": 2 * (pitch - 40)})))
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    types = [pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.float64(), pa.string()]
    pq.write_table(pa.table({n: pa.array(c, t) for n, t, c in zip(names, types, zip(*rows))}), folder / "events.parquet")
    chroma = [[float(i == j % 12) for i in range(64)] for j in range(20)]
    pq.write_table(pa.table({"vec_id": pa.array(range(20), pa.int64()), "embedding": pa.array(chroma, pa.list_(pa.float32())), "label": pa.array([j % 10 for j in range(20)], pa.int32())}), folder / "embeddings.parquet")
    return {(r["track_id"], r["section"]): r for r in CJ.riff_job(spark, str(folder)).collect()}


def test_the_tab_is_of_the_pitches_heard(job):
    row = job[1, 0]
    assert (row["unit"], row["agreement"], row["support"], row["reason"], row["tab"]) == (1, 1.0, 1.0, None, TAB)


def test_muted_strokes_are_named_too(job):
    assert job[3, 0]["tab"] == TAB


def test_a_group_that_is_no_riff_does_not_print(job):
    assert (job[7, 0]["reason"], job[7, 0]["tab"]) == ("not a riff", None)


def test_no_pitch_heard_is_the_reason(job):
    assert [job[k]["reason"] for k in ((2, 0), (1, 1))] == ["named 0.00 < 0.60"] * 2
    assert len(job) == 16


def test_a_note_lasts_to_the_next_stroke_or_the_bars_end(spark):
    bars = spark.createDataFrame([(1, 0, 0, 0.0, 8.0, 8), (1, 0, 1, 8.0, 16.0, 8), (1, 0, 2, 16.0, 24.0, 8)], BARS)
    strokes = spark.createDataFrame([(1, 0, 0), (1, 0, 4), (1, 1, 6), (1, 1, 2)], STROKES)
    frames = [
        (0.05, 90.0), (0.1, 60.0), (3.8, 62.0), (3.95, 90.0), (3.0, None),  # skipped, 61 of two voiced of three, skipped
        (4.2, 64.0), (5.0, None), (6.0, None), (8.1, 90.0),  # a third voiced; the next bar's frame
        (10.5, 60.0), (10.6, 61.0),  # 60.5, to the even number
    ]
    frames = spark.createDataFrame([(1, t, m) for t, m in frames], FRAMES)
    rows = RF.note_bars(bars, strokes, frames, 8.0, 0.1, 0.1).orderBy("bar").collect()
    assert [(r["notes"], r["strokes"]) for r in rows] == [([61], 2), ([2060], 2), ([], 0)]
    assert RF.named_share(RF.note_bars(bars, strokes, frames, 8.0, 0.1, 0.1)).first()["named_share"] == 0.5


def mean(xs):
    return sum(xs) / len(xs)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def alike(a, b):
    return mean([a.get(s) == b.get(s) for s in {*a, *b}]) if a or b else 1.0


def majority(bars):
    out = {}
    for s in sorted({s for b in bars for s in b}):
        heard = [b[s] for b in bars if s in b]
        if len(heard) * 2 >= len(bars):
            out[s] = min(heard, key=lambda p: (-heard.count(p), p))
    return out


def unit_and_phase(bars):
    """Two bars where the best alternating pair beats the best bar by the margin."""
    n = len(bars)
    if n < 4:
        return 1, 0
    one = max(mean([jaccard(a, b) for j, b in enumerate(bars) if j != i]) for i, a in enumerate(bars))
    two = [round(mean([jaccard(bars[k], bars[s + (k - s) % 2]) for k in range(n) if k not in (s, s + 1)]), 9) for s in range(n - 1)]
    s = two.index(max(two))
    good = round(two[s] - one, 9) >= 0.1 and (n - s % 2) // 2 >= 3 and min(len(bars[s]), len(bars[s + 1])) >= 2
    return (2, s % 2) if good else (1, 0)


def plain(bars, strokes, frames, riff):
    """The riff stage over one group, bar by bar."""
    heard, total = [], 0
    for bar, start, end, width in bars:
        slot_s = (end - start) / width
        times = [(s, start + s * slot_s) for s in sorted(strokes.get(bar, []))]
        total += len(times)
        notes = {}
        for (s, lo), stop in zip(times, [t for _, t in times[1:]] + [end]):
            window = [m for t, m in frames if lo + 0.02 <= t < min(stop, end) - 0.01]
            voiced = [m for m in window if m is not None]
            if window and len(voiced) / len(window) >= 0.5:
                notes[s] = round(statistics.median(voiced))
        heard.append(notes)
    width = bars[0][3]
    unit, phase = unit_and_phase([set(b) for b in heard])
    units = heard if unit == 1 else [a | {s + width: m for s, m in b.items()} for a, b in zip(heard[phase::2], heard[phase + 1 :: 2])]
    others = lambda i: [b for j, b in enumerate(units) if j != i] or units
    scores = [round(mean([alike(b, o) for o in others(i)]), 9) for i, b in enumerate(units)]
    best = scores.index(max(scores))
    loo = mean([alike(b, majority(others(i))) for i, b in enumerate(units)])
    medoid = round(scores[best] - loo, 9) >= 0.04 and len(units[best]) >= 2
    notes, agreement = (units[best], scores[best]) if medoid else (majority(units), loo)
    support = mean([mean([b.get(s) == m for b in units]) for s, m in notes.items()]) if notes else 0.0
    named = sum(map(len, heard)) / total if total else 0.0
    fails = [(not named, "named"), (agreement < 0.7, "agreement"), (support < 0.75, "support"), (named < 0.6, "named"), (not riff, "not")]
    reason = next((word for failed, word in fails if failed), None)
    tab = None
    if reason is None:
        shift = min(range(-2, 3), key=lambda s: (-sum(60 <= m + 12 * s <= 81 for m in notes.values()), abs(s), -s))
        places = []
        for s, m in notes.items():
            m += 12 * shift
            while m < 60:
                m += 12
            while m > 81:
                m -= 12
            fret, string = min((m - o, i) for i, o in enumerate(TUNING) if m >= o)
            places.append(((s + width) % (2 * width) if unit == 2 and phase else s, string, fret))
        tab = " ".join(f"{s}:{i}:{f}" for s, i, f in sorted(places))
    return unit, "medoid" if medoid else "majority", round(agreement, 6), round(support, 6), round(named, 6), reason, tab


def test_the_job_equals_the_stage_bar_by_bar(spark):
    rng, bars, strokes, frames, flags, want = random.Random(11), [], [], [], [], {}
    for track in range(60):
        noise, lost, period = rng.choice([0, 0, 0.02, 0.1, 0.4]), rng.choice([0, 0, 0.1, 0.5, 1]), rng.choice([1, 2])
        figure = [{s: rng.randint(45, 90) for s in range(8) if rng.random() < 0.6} for _ in range(period)]
        mine, struck, heard, riff = [], {}, [], rng.random() < 0.8
        for bar in range(rng.randint(1, 9)):
            start, end = 2.0 * bar, 2.0 * bar + 2.0
            mine.append((bar, start, end, 8))
            struck[bar] = [s for s in range(8) if (s in figure[bar % period]) != (rng.random() < noise)]
            pitch, unvoiced = 60.0, False
            for i in range(40):  # a frame each 50 ms, a slot each 250 ms
                if i % 5 == 0 and i // 5 in struck[bar]:
                    pitch, unvoiced = figure[bar % period].get(i // 5, 60) + (rng.random() < noise) * 2.0, rng.random() < lost
                heard.append((start + i * 0.05, None if unvoiced and rng.random() < 0.7 else pitch + rng.choice([-0.3, 0, 0.3])))
        bars += [(track, 0, *b) for b in mine]
        strokes += [(track, b, s) for b, slots in struck.items() for s in slots]
        frames += [(track, *f) for f in heard]
        flags += [(track, 0, True)] if riff else []
        want[track] = plain(mine, struck, heard, riff)
    rows = J.riff_job(
        spark.createDataFrame(bars, BARS), spark.createDataFrame(strokes, STROKES), spark.createDataFrame(frames, FRAMES),
        spark.createDataFrame(flags, "track_id int, section int, riff boolean"), ["track_id", "section"], TUNING, 2.0, 0.02, 0.01).collect()
    word = lambda r: r["reason"] and r["reason"].split()[0]
    got = {r["track_id"]: (r["unit"], r["candidate"], *[round(r[c], 6) for c in ("agreement", "support", "named_share")], word(r), r["tab"]) for r in rows}
    assert got == want
    assert {(w[0], w[6] is not None) for w in want.values()} == {(unit, prints) for unit in (1, 2) for prints in (False, True)}
    assert {"named", "agreement", "not"} < {w[5] for w in want.values()}
