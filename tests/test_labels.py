"""Chord labels are read once a row, and give the same parts either way."""

from pyspark.sql import functions as F

from stavework.functions import harte as H
from stavework.operators import fill as L

LABELS = ["N", "X", None, "", "C", "C:maj", "Db:min7", "F#:5", "G:(1,5)", "A:maj/3", "Bb", "B#:hdim7/b5", "E:odd", "H:maj", "C:7(b9)/5", "Ab:sus4", "C:(3)", "D/1"]


def test_parts_read_once(spark):
    label = F.col("label")
    events = spark.createDataFrame([(i, x, 0.0, 1.5) for i, x in enumerate(LABELS)], "event int, label string, start double, end double")
    parsed = H.parsed(events)
    assert parsed.columns == [*events.columns, "pc", "quality", "triad", "triad_q", "plain", "dur"]
    chord = ~H.is_no_chord(label) & H.root(label).isNotNull()
    plain = events.select("event", F.when(chord, H.pitch_class(H.root(label))), F.when(chord, H.quality(label)), H.to_triad(label),
                          F.when(chord, F.when(H.quality(label) == "5", "5").otherwise(H.triad_quality(label))), F.coalesce(H.plain_major_root(label).isNotNull(), F.lit(False)))
    got = parsed.select("event", "pc", "quality", "triad", "triad_q", "plain")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    stored = parsed.where("event >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert stored.count("regexp_extract") <= 6  # four parts, the root twice as a null stands for no text, and the lead of an unreadable label


def test_template_reads_root_and_notes_once(spark):
    df = spark.createDataFrame([(x,) for x in LABELS], "label string")
    text = df.select(H.template(F.col("label")).alias("t"))._jdf.queryExecution().analyzed().toString()
    inner = text[text.rindex("lambdafunction(cast(array_contains"):text.rindex("sequence(")] if "sequence(" in text else text
    assert "regexp_extract" not in inner[:400]
    got = {r[0]: r[1] for r in df.select("label", H.template(F.col("label"))).collect()}
    assert got["Db:min7"] == [0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0] and got["N"] is None and got["E:odd"] is None


def test_best_match_sums_in_generated_code(spark):
    chroma = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.1, 0.0, 0.9, 0.2, 0.0, 1.0, 0.0, 0.0, 0.3, 0.0]), (1, 1, [0.5] * 12), (2, 0, [1.0] + [0.0] * 11)], "track_id long, bar int, chroma array<double>")
    bits = lambda *on: [float(i in on) for i in range(12)]
    chords = spark.createDataFrame([(1, "C:maj", bits(0, 4, 7)), (1, "G:maj", bits(2, 7, 11))], "track_id long, label string, template array<double>")
    match = L.best_matches(chroma, chords)
    assert "aggregate(zip_with" not in match._jdf.queryExecution().optimizedPlan().toString()
    (row,) = match.collect()
    assert (row["track_id"], row["bar"], row["label"]) == (1, 0, "C:maj") and round(row["best"], 6) == 0.971961 and row["runner_up"] < 0.2
