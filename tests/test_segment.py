"""One k-means per track against a plain one, and written-out clusters."""

import random

import pytest

from stavework.operators import segment as G

SCHEMA = "track_id int, bar int, dim int, z double"
K = ["track_id"]


def table(spark, tracks):
    return spark.createDataFrame([(t, b, d, float(z)) for t, bars in tracks.items() for b, f in enumerate(bars) for d, z in enumerate(f)], SCHEMA)


def apart(a, b):
    return round(sum((x - y) * (x - y) for x, y in zip(a, b)), 9)


def plain(bars, min_k=3, max_k=6, rounds=100):
    bars = [[round(x, 9) for x in f] for f in bars]
    chosen = [max(range(len(bars)), key=lambda i: (apart(bars[i], [0] * len(bars[i])), -i))]
    while len(chosen) < max_k:
        d = [min(apart(f, bars[s]) for s in chosen) for f in bars]
        best = max(range(len(bars)), key=lambda i: (d[i], -i))
        if d[best] == 0:
            break
        chosen.append(best)
    for k in [k for k in range(min_k, max_k + 1) if k <= len(chosen)] or [len(chosen)]:
        at = [bars[s] for s in chosen[:k]]
        for _ in range(rounds):
            own = [min(range(k), key=lambda c: (apart(f, at[c]), c)) for f in bars]
            new = [[round(sum(x) / len(x), 9) for x in zip(*[f for f, o in zip(bars, own) if o == c])] if c in own else at[c] for c in range(k)]
            if new == at:
                break
            at = new
        own = [min(range(k), key=lambda c: (apart(f, at[c]), c)) for f in bars]
        share = max(map(own.count, set(own))) / len(own)
        if share <= 0.6:
            break
    order = list(dict.fromkeys(own))
    return [order.index(o) for o in own], k, share


def test_every_track_has_its_own_model(spark):
    rnd = random.Random(3)
    tracks = {t: [[rnd.gauss(c * 4, 0.7), rnd.gauss(-c, 0.7)] for c in (rnd.choice([0, 0, 0, 1, 2]) for _ in range(rnd.randrange(9, 40)))] for t in range(8)}
    tracks[8] = [[rnd.gauss(0, 1), 0.0] for _ in range(30)]
    got = {}
    for r in G.segment_bars(table(spark, tracks), K).collect():
        got.setdefault(r["track_id"], {})[r["bar"]] = r
    for t, bars in tracks.items():
        labels, k, share = plain(bars)
        own = [got[t][b] for b in range(len(bars))]
        assert [r["cluster"] for r in own] == labels and {(r["k"], r["converged"]) for r in own} == {(k, True)}
        assert own[0]["share"] == pytest.approx(share)


def test_written_out_clusters(spark):
    a, b, c, d = [0.0, 5.0], [5.0, 0.0], [-5.0, 0.0], [0.0, -5.0]
    tracks = {1: [a, a, b, b, a, c, c, a, b, a], 2: [a] * 8 + [b, c, d], 3: [a, b, a], 4: [a] * 12, 5: [a, b] * 6}
    got = {}
    for r in sorted(G.segment_bars(table(spark, tracks), K).collect(), key=lambda r: r["bar"]):
        got.setdefault(r["track_id"], []).append((r["cluster"], r["k"]))
    assert [x for x, _ in got[1]] == [0, 0, 1, 1, 0, 2, 2, 0, 1, 0] and got[1][0][1] == 3
    assert [x for x, _ in got[2]] == [0] * 8 + [1, 2, 3] and got[2][0][1] == 4
    assert got[3] == [(0, 1)] * 3 and got[4] == [(0, 1)] * 12 and got[5] == [(0, 2), (1, 2)] * 6
    assert G.segment_bars(table(spark, tracks).where("false"), K).count() == 0


def test_a_model_that_runs_out_of_rounds_says_so(spark):
    rnd = random.Random(5)
    tracks = {1: [[rnd.gauss(0, 1), rnd.gauss(0, 1)] for _ in range(60)]}
    out = G.segment_bars(table(spark, tracks), K, rounds=1)
    assert out.count() == 60 and out.where("converged").count() == 0
