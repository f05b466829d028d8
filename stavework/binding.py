"""The driver's synthetic tables read as track tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.operators.ordered import with_neighbour

DAY = 86400.0
N_BARS = 30
SLOTS = 8
EVENT_CHUNK = None  # windows over events run in chunks of equal row counts

# Fixed values of the binding: one bar per day, four sections per track.
SECTIONS = [(0, "verse", 0, 7), (1, "chorus", 7, 14), (2, "verse", 14, 21), (3, "outro", 21, 30)]
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
QUALITY = {"view": "maj", "click": "min", "purchase": "7", "error": "dim"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def micros_since_2024(ts: Column) -> Column:
    """Whole microseconds from 2024-01-01, independent of the session time zone."""
    days = F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("track_id"),
        "event_id",
        (micros_since_2024(F.col("ts")) / 1e6).alias("t"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "track_id",
        F.col("event_id").alias("onset_id"),
        "t",
        (F.col("event_type") == "error").alias("muted"),
        F.col("value").alias("centroid"),
        F.col("k").cast("double").alias("zcr"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id")).distinct()


def section_of(bar: Column) -> Column:
    out = F.lit(None).cast("int")
    for number, _label, lo, hi in reversed(SECTIONS):
        out = F.when((bar >= lo) & (bar < hi), F.lit(number)).otherwise(out)
    return out


def bars(spark: SparkSession, sf_dir: str, slots: int = SLOTS) -> DataFrame:
    return (
        tracks(spark, sf_dir)
        .select("track_id", F.explode(F.sequence(F.lit(0), F.lit(N_BARS - 1))).alias("bar"))
        .select(
            "track_id",
            section_of(F.col("bar")).alias("section"),
            "bar",
            (F.col("bar") * DAY).alias("start"),
            ((F.col("bar") + 1) * DAY).alias("end"),
            F.lit(slots).alias("width"),
        )
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("section"), F.lit(label).alias("label"), F.lit(a).alias("start_bar"), F.lit(b).alias("end_bar")
        )
        for n, label, a, b in SECTIONS
    ])
    return tracks(spark, sf_dir).select("track_id", F.inline(rows))


def chord_label(k: Column, event_type: Column) -> Column:
    root = F.element_at(F.array(*[F.lit(s) for s in SHARPS]), (F.pmod(k, F.lit(12)) + 1).cast("int"))
    quality = F.lit(None).cast("string")
    for name, q in QUALITY.items():
        quality = F.when(event_type == name, F.lit(q)).otherwise(quality)
    return F.when(event_type == "signup", F.lit("N")).otherwise(F.concat(root, F.lit(":"), quality))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label span per event, up to the track's next event; the last event has no span."""
    ev = events(spark, sf_dir)
    return (
        with_neighbour(ev, ["track_id"], ["t", "event_id"], EVENT_CHUNK, {"end": "t"}, ahead=True)
        .where("end is not null")
        .select(
            "track_id", F.col("event_id").alias("span_id"), F.col("t").alias("start"), "end",
            chord_label(F.col("k"), F.col("event_type")).alias("label"),
        )
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The irregular beats: each track's events."""
    return events(spark, sf_dir).select("track_id", "event_id", "t", F.col("k"))


def regular_beats(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """A regular beat grid per track: beat i covers [start, end), four to a bar at 6 hours."""
    per_bar = 24 // hours
    return (
        tracks(spark, sf_dir)
        .select("track_id", F.explode(F.sequence(F.lit(0), F.lit(N_BARS * per_bar - 1))).alias("i"))
        .select(
            "track_id", "i",
            (F.col("i") * (hours * 3600.0)).alias("start"),
            ((F.col("i") + 1) * (hours * 3600.0)).alias("end"),
            F.floor(F.col("i") / per_bar).cast("int").alias("bar"),
            (F.col("i") % per_bar).alias("beat"),
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame measures from the line items: one stem per return flag, time in days since 1995."""
    li = _read(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return li.select(
        F.col("l_suppkey").alias("track_id"),
        F.when(F.col("l_returnflag") == "A", "guitar").when(F.col("l_returnflag") == "R", "bass")
        .otherwise("mix").alias("stem"),
        day.cast("double").alias("t"),
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("frame"),
        F.col("l_quantity").alias("n_samples"),
        F.col("l_extendedprice").alias("sumsq"),
        F.col("l_discount").alias("low_power"),
        (F.col("l_discount") + F.col("l_tax")).alias("total_power"),
    )


FRAME_BAR = 90.0  # days per frame bar
FRAME_BARS = 28


def frame_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 bars of 90 days over the frames of each supplier, seven bars to a section."""
    li = _read(spark, sf_dir, "lineitem")
    return (
        li.select(F.col("l_suppkey").alias("track_id")).distinct()
        .select("track_id", F.explode(F.sequence(F.lit(0), F.lit(FRAME_BARS - 1))).alias("bar"))
        .select(
            "track_id", F.floor(F.col("bar") / 7).cast("int").alias("section"), "bar",
            (F.col("bar") * FRAME_BAR).alias("start"), ((F.col("bar") + 1) * FRAME_BAR).alias("end"),
            F.lit(8).alias("width"),
        )
    )


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-bin vectors from the embeddings' first twelve entries, shifted to be non-negative for powers."""
    emb = _read(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("label").cast("long").alias("track_id"),
        "vec_id",
        F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("chroma"),
    )
