"""Folder names of sources, and levels against bars."""

from stavework.functions import titles as T
from stavework.operators import validate as V

from pyspark.sql import functions as F


def test_slugs_of_links_files_and_odd_names(spark):
    want = {
        "https://youtu.be/AbCdEfGhI_-": "abcdefghi_-", "C:\\Music\\My Song_01.final.MP3": "my-song-01-final", "/a/b/Été 2.wav/": "été-2",
        "plain": "plain", "https://x.org/p/q.html?a=b.c": "q-html-a-b", "___.mp3": "song-35bc8cec", ".hidden": "song-da39a3ee", "": "song-da39a3ee",
    }
    df = spark.createDataFrame([(s,) for s in [*want, None]], "s string")
    got = {r["s"]: r["slug"] for r in df.select("s", T.slug_for(F.col("s")).alias("slug")).collect()}
    import hashlib
    want["___.mp3"] = "song-" + hashlib.sha1(b"___").hexdigest()[:8]
    assert got == {**want, None: None}


def test_levels_are_one_per_bar_or_none(spark):
    rows = lambda *counts: spark.createDataFrame([(t, b) for t, n in counts for b in range(n)], "track_id long, bar int")
    got = V.level_constraints(rows((1, 4), (2, 4), (3, 4), (4, 4)), rows((1, 4), (2, 3), (3, 4), (5, 2)), rows((1, 4), (3, 5))).collect()
    assert sorted(map(tuple, got)) == [
        (2, "not one loudness per bar", 3), (3, "not one vocal level per bar", 5), (4, "not one loudness per bar", 0), (5, "not one loudness per bar", 2)]
