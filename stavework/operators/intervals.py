"""Range joins as equi joins: both sides carry a time bucket, so a hot track spreads over buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "_bucket"
# Spans spread over buckets take many times the bytes of the file they were read from, by which Spark judges whether a
# table is small enough to send to every task by way of the driver. So these joins always sort both sides.
SORTED = "merge"


def point_in_span(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    point: str,
    lo: str,
    hi: str,
    width: float,
    how: str = "inner",
    slack: float = 0.0,
) -> DataFrame:
    """Each point with every span holding it: lo - slack <= point < hi - slack (slack shifts eps rules).

    Span columns other than the keys must not clash with the points' columns. Each span is
    copied once per bucket it covers; each point sits in one bucket, so no pair is repeated.
    """
    left = points.withColumn(BUCKET, F.floor(F.col(point) / width).cast("long"))
    right = spans.where(F.col(hi) > F.col(lo)).withColumn(
        BUCKET,
        F.explode(F.sequence(
            F.floor((F.col(lo) - slack) / width).cast("long"), F.floor((F.col(hi) - slack) / width).cast("long")
        )),
    )
    on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, BUCKET]]
    on += [F.col(f"p.{point}") >= F.col(f"s.{lo}") - slack, F.col(f"p.{point}") < F.col(f"s.{hi}") - slack]
    joined = left.alias("p").join(right.alias("s").hint(SORTED), on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(BUCKET)
    return joined.select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"s.{c}") for c in spans.columns if c not in keys],
    )


def overlap(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    l_span: tuple[str, str],
    r_span: tuple[str, str],
    width: float,
    min_overlap: float = 0.0,
) -> DataFrame:
    """Pairs whose spans overlap by more than `min_overlap`, with the overlap in `overlap`.

    Both sides are copied into their buckets; a pair is kept only in the bucket of its later
    start, so it appears once. That start lies more than `min_overlap` before the end, so a span that
    ends on a bucket's edge needs no copy beyond it.
    """
    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        first, last = (F.floor(c / width).cast("long") for c in (F.col(lo), F.col(hi) - min_overlap))
        return df.where(F.col(hi) > F.col(lo)).withColumn(BUCKET, F.explode(F.sequence(first, F.greatest(first, last))))

    a, b = spread(left, *l_span).alias("l"), spread(right, *r_span).alias("r")
    start = F.greatest(F.col(f"l.{l_span[0]}"), F.col(f"r.{r_span[0]}"))
    end = F.least(F.col(f"l.{l_span[1]}"), F.col(f"r.{r_span[1]}"))
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, BUCKET]]
    on += [end - start > min_overlap, F.floor(start / width) == F.col(f"l.{BUCKET}")]
    return a.join(b.hint(SORTED), on).select(
        *[F.col(f"l.{c}") for c in left.columns],
        *[F.col(f"r.{c}") for c in right.columns if c not in keys],
        (end - start).alias("overlap"),
    )


def within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], l_point: str, r_point: str, radius: float, how: str
) -> DataFrame:
    """Band join |l - r| <= radius; the right side is copied into its neighbouring buckets.

    For `left_anti` and `left_semi` only the left columns come back.
    """
    a = left.withColumn(BUCKET, F.floor(F.col(l_point) / radius).cast("long")).alias("l")
    b = right.withColumn(
        BUCKET,
        F.explode(F.array(*[(F.floor(F.col(r_point) / radius) + d).cast("long") for d in (-1, 0, 1)])),
    ).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, BUCKET]]
    on.append(F.abs(F.col(f"l.{l_point}") - F.col(f"r.{r_point}")) <= radius)
    joined = a.join(b.hint(SORTED), on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(BUCKET)
    return joined.select(
        *[F.col(f"l.{c}") for c in left.columns],
        *[F.col(f"r.{c}") for c in right.columns if c not in keys],
    )


def best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key by an explicit total order, as an aggregate (partial per task, no group sort)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return picked.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])
