"""Connected components and the choice of texts against plain versions."""

import random

import numpy as np
import pyarrow as pa

from stavework.llm import graph, jaccard
from stavework.llm import words as W


def plain(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


def shapes():
    rng = random.Random(5)
    chain = [(x, x + 1) for x in rng.sample(range(1000, 1060), 60)]
    star = [(-7, x) for x in range(2000, 2040)]
    loose = [(rng.randrange(40), rng.randrange(3000, 3100)) for _ in range(30)]
    return chain + star + loose + star[:5] + [(-(1 << 62), 1 << 62)]


def test_components_whatever_a_task_may_hold(spark):
    want = plain(shapes())
    edges = spark.createDataFrame([*shapes(), (9999, 9999), (None, 3), (4, None)], "u long, v long").repartition(7)
    for most in (graph.HELD, 16):
        assert sorted(map(tuple, graph.components(edges, most).collect())) == sorted(want.items())
    assert graph.components(edges.where("false")).count() == 0


def test_a_small_table_takes_no_rounds(spark, monkeypatch):
    written = []
    share = graph.share
    monkeypatch.setattr(graph, "share", lambda df: written.append(1) or share(df))
    graph.components(spark.createDataFrame(shapes(), "u long, v long")).count()
    assert len(written) == 2


def test_texts_are_chosen_without_a_shuffle_of_texts(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(5 + i % 9)) for i in range(300)]
    docs = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts + texts[:40])], "id long, text string")
    keys = [int(jaccard._class_keys(*W.distinct(*W.shingles(*[W.words(pa.array([t]))[k] for k in (0, 3)], 5))).view(np.int64)[0]) for t in texts[:60]]
    rows = docs.where("id < 60 or id is null").selectExpr("id", "text", "xxhash64(text) rep").collect()
    rep = {r["text"]: r["rep"] for r in rows}
    chosen = spark.createDataFrame([(k, i if i % 50 else None, rep[t]) for i, (k, t) in enumerate(zip(keys, texts))], "cls long, id long, rep long")
    for slots in (1 << 25, 1 << 8):
        monkeypatch.setattr(jaccard, "SLOTS", slots)
        parts = jaccard.segments(docs, "id", "text", 5, chosen)
        below = parts._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1]
        assert "Join" not in below
        got = parts.groupBy("cls").agg({"fragment": "count"}).collect()
        assert sorted(map(tuple, got)) == sorted((k, jaccard.FRAGMENTS) for k in keys)
