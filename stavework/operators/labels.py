"""Section names from cluster recurrence, loudness and vocals.

Bars are folded to one row per segment first; the windows below run over a track's segments, which
are its sections, not its bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.operators.intervals import best
from stavework.params import GRID, GridParams

KEYS = ["track_id"]


def segment_rows(segments: DataFrame, bars: DataFrame, p: GridParams = GRID) -> DataFrame:
    """Per segment: its commonest cluster (the earlier one on a tie), size, dB sum, vocal bars, low-vocal flag.

    `segments` (track_id, seg, start_bar, end_bar), `bars` (track_id, bar, seg, cluster, db, vocal).
    """
    counts = bars.groupBy("track_id", "seg", "cluster").agg(F.count("*").alias("c"), F.min("bar").alias("first"))
    mode = best(counts, ["track_id", "seg"], [-F.col("c"), F.col("first")]).select("track_id", "seg", "cluster")
    sums = bars.groupBy("track_id", "seg").agg(F.count("*").alias("n"), F.sum("db").alias("db"), F.count_if("vocal").alias("sung"))
    w = Window.partitionBy("track_id")
    rows = segments.join(mode, ["track_id", "seg"]).join(sums, ["track_id", "seg"])
    edge = (F.col("seg") == F.min("seg").over(w)) | (F.col("seg") == F.max("seg").over(w))
    low = F.col("sung") / F.col("n") < F.when(edge, p.edge_instrumental_below).otherwise(p.instrumental_below)
    rows = rows.withColumn("_low", low)
    return rows.withColumn("low", F.col("_low") & ~F.min("_low").over(w)).drop("_low")


def cluster_roles(rows: DataFrame, p: GridParams = GRID) -> DataFrame:
    """Per cluster of the sung segments: occurrences, bars, mean dB, vocal share and its role.

    Sung segments of one cluster with only low-vocal ones between are one occurrence.
    """
    order = Window.partitionBy("track_id").orderBy("seg")
    sung = rows.where("not low").withColumn("_new", F.coalesce((F.lag("cluster").over(order) != F.col("cluster")), F.lit(True)))
    sung = sung.withColumn("occurrence", F.sum(F.col("_new").cast("int")).over(order))
    whole = Window.partitionBy("track_id")
    c = sung.groupBy("track_id", "cluster").agg(
        F.count_distinct("occurrence").alias("occ"), F.sum("n").alias("bars"), (F.sum("db") / F.sum("n")).alias("db"), (F.sum("sung") / F.sum("n")).alias("voice"))
    c = c.withColumn("big", F.col("bars") > p.split_share * F.sum("bars").over(whole))
    c = c.withColumn("again", (F.col("occ") >= 2) & ~F.col("big")).withColumn("any_again", F.max("again").over(whole))
    voiced = F.col("voice") >= p.chorus_min_vocal
    rank = F.when(F.col("any_again") & F.col("again") & voiced, F.struct(F.round("db", 9), -F.col("cluster"))).when(
        ~F.col("any_again") & ~F.col("big") & voiced, F.struct(F.col("bars").cast("double"), -F.col("cluster")))
    c = c.withColumn("_best", F.max(rank).over(whole)).withColumn("chorus", F.coalesce(-F.col("_best")["col2"] == F.col("cluster"), F.lit(False)))
    c = c.withColumn("_v", F.max(F.when(F.col("again") & ~F.col("chorus"), F.struct(F.col("bars"), -F.col("cluster")))).over(whole))
    c = c.withColumn("verse", F.when(F.max("big").over(whole), F.col("big")).otherwise(F.coalesce(-F.col("_v")["col2"] == F.col("cluster"), F.lit(False))))
    margin = F.max(F.when(F.col("chorus"), F.col("db"))).over(whole) - F.max(F.when((F.col("occ") >= 2) & ~F.col("chorus"), F.col("db"))).over(whole)
    return c.withColumn("margin", margin).select("track_id", "cluster", "occ", "bars", "db", "voice", "chorus", "verse", "margin")


def label_sections(rows: DataFrame, roles: DataFrame, p: GridParams = GRID) -> DataFrame:
    """Named sections with confidence; neighbouring low-vocal segments become one."""
    w = Window.partitionBy("track_id")
    order = w.orderBy("seg")
    occ_order = F.sum(F.when(~F.col("low"), F.coalesce((F.last(F.when(~F.col("low"), F.col("cluster")), True).over(
        order.rowsBetween(Window.unboundedPreceding, -1)) != F.col("cluster")), F.lit(True)).cast("int"))).over(order)
    d = rows.withColumn("occurrence", F.when(~F.col("low"), occ_order))
    d = d.withColumn("first_seg", F.min("seg").over(Window.partitionBy("track_id", "occurrence"))).withColumn(
        "last_seg", F.max("seg").over(Window.partitionBy("track_id", "occurrence")))
    d = d.withColumn("seg_0", F.min("seg").over(w)).withColumn("seg_n", F.max("seg").over(w)).withColumn("n_bars", F.max("end_bar").over(w))
    d = d.withColumn("merge", F.col("low") & F.coalesce(F.lag("low").over(order), F.lit(False)))
    d = d.withColumn("group", F.sum(F.when(F.col("merge"), 0).otherwise(1)).over(order))
    d = d.join(roles.select("track_id", "cluster", "occ", "chorus", "verse", "margin"), ["track_id", "cluster"], "left")
    once = F.col("occ") == 1
    sung = F.when(F.col("verse"), "verse").when(F.col("chorus"), "chorus").when(once & (F.col("first_seg") == F.col("seg_0")), "intro").when(
        once & (F.col("last_seg") == F.col("seg_n")), "outro").otherwise("verse")
    g = d.withColumn("sung_label", sung).groupBy("track_id", "group").agg(
        F.min("start_bar").alias("start_bar"), F.max("end_bar").alias("end_bar"), F.max("low").alias("low"), F.max("n_bars").alias("n_bars"),
        F.max("sung_label").alias("sung_label"), F.max("margin").alias("margin"))
    quiet = F.when(F.col("start_bar") == 0, "intro").when(F.col("end_bar") == F.col("n_bars"), "outro").otherwise("instrumental")
    unsure = F.coalesce(F.round("margin", 9) < p.low_margin_db, F.lit(False))
    return g.select("track_id", "start_bar", "end_bar", F.when(F.col("low"), quiet).otherwise(F.col("sung_label")).alias("label"),
                    F.when(F.col("low"), 0.5).when(unsure, 0.3).otherwise(0.5).alias("confidence"))
