"""Operators on vectors and pages against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from stavework.llm import topk, urls, warc


def test_top_k_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    table = [(k, (centres[k % 6] * (0.2 if k % 5 else 3.0) + rng.normal(size=8) * (0.05 if k % 2 else 0.6)).round(3).tolist()) for k in range(300)]
    table += [(300, table[0][1]), (301, table[1][1]), (302, [1.0, 2.0]), (303, [])]
    odd = [(400, None), (500, [1.0, None]), (600, [float("nan")] * 8), (None, [1.0] * 8), (0, table[0][1])]
    df = spark.createDataFrame([(i, v, "extra") for i, v in table + odd], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in table}
    for q in (i for i in ints if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:7]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert not got
    assert topk.top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_url_rules_against_a_loop(spark):
    rnd = random.Random(4)
    hosts = ["a.net", "net", "EXAMPLE.net", "x.example.com", "example.com.evil", "s.org", "planet", ""]
    table = [(k, f"http{'s' * (k % 2)}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/de/x/y', '/fr/1?a=/en/', '#/en/', '//'])}") for k in range(200)]
    table += [(500, None), (501, "no scheme"), (502, ""), (None, "http://a.net/"), (3, table[3][1]), (504, "http://" + "a." * 3000 + "net" + "/en" * 3000)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/d", "block"), ("org", "/fr/", "allow"), ("net", "/", "allow"), ("net", "/en/", "block"), (None, "/", "block"), ("", "/", "block")]
    got = urls.url_verdicts(spark.createDataFrame([(i, u, "h") for i, u in table], "page_id long, url string, host string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def judge(url):
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fit) if fit else None
        return host, path, best[2] if best else None, best[3] if best else "allow"

    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted([tuple(r) for r in got], key=key) == sorted([(i, *judge(u)) for i, u in table], key=key)
    none = urls.url_verdicts(spark.createDataFrame(table, "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(table)


def test_archives_round_trip_and_are_the_same_bytes(spark, tmp_path):
    same = "<p>" + "é" * 80
    table = [(k, f"http://h/{k}", f"<html>{k}" + "x" * (37 * k % 900)) for k in range(60)] + [(70, "u\r\nX: y", same), (61, None, same), (90, "http://h", same), (91, "http://h", "short"), (92, "http://h", "short"), (93, "u", None), (94, "u", ""), (None, "u", same), (61, None, same)]
    df = spark.createDataFrame([(*r, "x") for r in table], "page_id long, url string, html string, payload string")
    read = {}
    for name, pages in (("one", df), ("two", df.repartition(5))):
        manifest = warc.write_archive(pages, f"{tmp_path}/{name}", shard_bytes=6000, roll_bytes=1500)
        assert manifest.count() > 3 and manifest.select("shard").distinct().count() > 1
        read[name] = {p.name: p.read_bytes() for p in (tmp_path / name).iterdir() if p.name.startswith("part-")}
        assert not (tmp_path / name / "_temporary").exists()
        back = warc.read_archive(spark, f"{tmp_path}/{name}", manifest).collect()
        assert len(back) == len(table)
        kinds = {(r["key"], r["record_type"], r["refers_to"]) for r in back if r["payload_bytes"] == len(same.encode())}
        assert kinds == {(61, "response", None), (70, "revisit", 61), (90, "revisit", 61), (None, "response", None)}
        got = {r["key"]: r["payload"].decode() for r in back if r["record_type"] == "response"}
        assert all(got[k] == (html or "") for k, _, html in table if k in got and k is not None)
    assert read["one"] == read["two"]
    assert warc.write_archive(df.where("false"), f"{tmp_path}/none").count() == 0
