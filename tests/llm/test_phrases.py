"""Phrase collocations against plain counts."""

import random
import re
from collections import Counter

from stavework.llm import phrases

SCHEMA = "doc_id long, text string, lang string, w1 string, n int, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, least, top):
    counts, n = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, w[i : i + k]] += 1
    held = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    found = {}
    for (lang, w), a in held.items():
        inside = any(o == lang and len(v) > len(w) and 100 * b >= 100 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (o, v), b in held.items())
        if not inside:
            score, _, l, r = min((1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def some_texts():
    rnd = random.Random(8)
    fixed = ["new york city", "on the other hand", "As A matter of fact", "la la la la", "été 中"]
    out = []
    for k in range(120):
        parts = [rnd.choice(fixed) if rnd.random() < 0.4 else f"w{rnd.randrange(12)}" for _ in range(40)]
        out.append((rnd.choice([" ", "  ", "\t"]).join(p + rnd.choice(["", "", "", ",", "\n", ".", "!\x0b"]) for p in parts), ["en", "en", "de", None, "und"][k % 5]))
    return out + [(None, "en"), ("", None), (" \t", "fr"), ("...", "en"), (out[0][0], "en"), ("lone", "xx"), ("a\x00b c d", "en")]


def rows(spark, texts):
    return spark.createDataFrame([(None if k % 7 == 0 else k % 50, t, lang, "x", 1, "y") for k, (t, lang) in enumerate(texts)], SCHEMA)


def test_collocations_against_plain_counts(spark):
    texts = some_texts()
    for least, top in ((20, 2000), (5, 7)):
        got = phrases.collocations(rows(spark, texts), least=least, top=top).collect()
        assert sorted(map(tuple, got)) == plain(texts, least, top) and got
    assert phrases.collocations(rows(spark, [])).count() == phrases.collocations(rows(spark, [(None, None), ("one two", "en")])).count() == 0


def test_collocations_in_few_slots_and_small_pieces(spark, monkeypatch):
    texts = some_texts()
    texts.append((" ".join(t for t, lang in texts if t and lang == "en"), "en"))
    monkeypatch.setattr(phrases, "LEAST_SLOTS", 64)
    monkeypatch.setattr(phrases, "SLOTS", 64)
    got = phrases.collocations(rows(spark, texts), least=20).collect()
    assert sorted(map(tuple, got)) == plain(texts, 20, 2000)
    texts, whole = texts[-1:], [w for run in phrases._sequences(batch(texts[-1:])) for w in run[1][: run[2]]]
    for piece in (50, 7):
        monkeypatch.setattr(phrases, "RUN", piece)
        assert [w for run in phrases._sequences(batch(texts)) for w in run[1][: run[2]]] == whole
        runs = list(phrases._sequences(batch(texts)))
        assert len(runs) > 20 and all(len(w) - n in (0, phrases.LONGEST - 1) or n == 0 for _, w, n in runs)


def batch(texts):
    import pyarrow as pa
    return pa.record_batch([pa.array([t for t, _ in texts]), pa.array([lang for _, lang in texts])], names=["text", "lang"])


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    table = [("en", [], 10 * big), ("en", ["a"], big), ("en", ["b"], big - 1), ("en", ["a", "b"], big - 2)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: spark.createDataFrame(table, "lang string, words array<string>, a long"))
    got = phrases.collocations(rows(spark, [])).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big - 2, big, big - 1, 10 * big, 1000 * (big - 2) * 10 * big // (big * (big - 1)))]


def test_windows_are_tallied_over_vocabularies(monkeypatch):
    import numpy as np
    from collections import Counter
    monkeypatch.setattr(phrases, "_VOCABULARY", 3)
    rnd, held, want, rows = random.Random(5), phrases._Windows(), Counter(), Counter()
    for turn in range(30):
        words = [b".", *{f"w{rnd.randrange(6)}".encode() for _ in range(4)}]
        ids = np.array([[rnd.randrange(len(words)) for _ in range(8)] for _ in range(5)])
        want.update(("en", *(words[i].decode() if i else "" for i in w)) for w in ids.T)
        held.add("en", list(ids))
        held.tally(words)
        if held.full() or turn == 29:
            for b in held.rows():
                for *key, c in zip(*b.to_pydict().values()):
                    rows[tuple(key)] += c
            held = phrases._Windows()
    assert rows == want
