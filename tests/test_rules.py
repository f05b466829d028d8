"""Small rules whose expectation is written out."""

import pytest
from pyspark.sql import functions as F

from stavework.functions import harte, keys, titles
from stavework.operators import grid, truth


@pytest.mark.parametrize("gap", [0.3, 0.7])
@pytest.mark.parametrize("step", [0.1, 0.07])
def test_thinning_is_one_rule_for_short_and_long_runs(spark, gap, step):
    points = [step * k for k in range(120)]
    kept = [points[0]]
    for x in points[1:]:
        if x >= kept[-1] + gap:
            kept.append(x)
    df = spark.createDataFrame([(1, x) for x in points], "track_id long, t double")
    for long_run in (3, 65536):
        assert sorted(r["t"] for r in grid.thin(df, ["track_id"], "t", gap, 4.0, long_run).collect()) == kept


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_titles(spark):
    assert one(spark, titles.untagged(F.lit("'\"'\"'\"Song\"'\"'\"'"))) == "Song"
    assert one(spark, titles.title_slug(F.lit("Šílený Łuk Ő"))) == "sileny-uk-o"
    links = {"https://www.youtube.com/watch?a=1&v=abcdefghijk": "abcdefghijk", "youtu.be/abcdefghijk?t=3": "abcdefghijk", "https://m.youtube.com/shorts/abcdefghijk": "abcdefghijk", "https://youtube.com/embed/videoseries": None, "https://notyoutube.com/live/abcdefghijk": None,
             "https://youtube-nocookie.com/embed/abcdefghijk": "abcdefghijk", "https://youtu.be/tooshort": None, "no link": None}
    for link, want in links.items():
        assert one(spark, titles.video_id(F.lit(link))) == want, link


def test_triads_and_keys(spark):
    for label, want in {"C:maj(9": "C:maj", "Db:min7/5": "Db:min", "N": "N", "?": "?", "G:5": "G:5"}.items():
        assert one(spark, harte.to_triad(F.lit(label))) == want
    for args, want in {(0, "major", 7, "major"): ("fifth", 0.5), (7, "major", 0, "major"): ("fifth", 0.0), (0, "major", 9, "minor"): ("relative", 0.3), (0, "major", 0, "minor"): ("parallel", 0.2), (9, "minor", 0, "major"): ("relative", 0.3), (1, "major", 4, "minor"): ("other", 0.0)}.items():
        cols = [F.lit(x) for x in args]
        assert (one(spark, keys.relation(*cols)), one(spark, keys.weighted_score(*cols))) == want


def test_overlap_counts_pitch_classes(spark):
    a = spark.createDataFrame([(1, 0.0, 2.0, "C#:maj")], "track_id long, start double, end double, triad string")
    b = spark.createDataFrame([(1, 0.0, 2.0, "Db:maj")], "track_id long, start double, end double, triad string")
    assert tuple(truth.label_overlap(a, b, 10.0).first())[1:] == (1.0, 1.0, 1.0)
