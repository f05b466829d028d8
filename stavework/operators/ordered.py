"""Windows over a track's sequence that survive one track holding a third of all rows.

A plain `partitionBy(track_id)` window sends a whole track to one task. Here every window
runs inside a *chunk* of the track and only a one-row-per-chunk summary is windowed over the
whole track, then joined back on (track, chunk). No task ever holds more than one chunk of
rows or one track's chunk summaries. Without a width a chunk is a range of (track, order) with
as many rows as any other, see `ranged`; with one it is the order column divided by it, which
suits columns that number rows, as bars do.

Rows that have their chunks already, from `chunked`, keep them from one call to the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.session import share

CHUNK = "_chunk"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df`, written once, in chunks of about equal row counts that the windows here use in place of a width.

    Rows are dealt by ranges of (keys, order), so a long track lies in as many chunks as its share of the rows asks
    for and short ones share a range. `order` must tell a track's rows apart if the order of ties matters.
    """
    by = [*keys, *order]
    cut = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return share(cut.withColumn(CHUNK, F.spark_partition_id().cast("long")))


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None) -> DataFrame:
    """`df` with the chunk number of each row, unless it has one."""
    if CHUNK in df.columns:
        return df
    return ranged(df, keys, order) if width is None else df.withColumn(CHUNK, F.floor(F.col(order[0]) / F.lit(width)).cast("long"))


def _windows(keys: Sequence[str], order: Sequence[str]):
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    return inside, across


def _join_back(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(summary, [*keys, CHUNK], "left")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None, name: str = "pos"
) -> DataFrame:
    """0-based position of each row in its group."""
    rows = chunked(df, keys, order, width)
    inside, across = _windows(keys, order)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        rows.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        _join_back(rows.withColumn("_rn", F.row_number().over(inside)), summary, keys)
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long"))
        .select(*[c for c in df.columns if c != name], name)
    )


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: float | None,
    columns: Mapping[str, str | Column],
    ahead: bool = False,
) -> DataFrame:
    """The values of the previous row (the next one with `ahead`) under new names; null at the edge."""
    rows = chunked(df, keys, order, width)
    inside, across = _windows(keys, order)
    held = F.struct(*[_col(c).alias(n) for n, c in columns.items()])
    by = F.struct(*[F.col(o) for o in order])
    rows = rows.withColumn("_held", held)
    edge = F.min_by if ahead else F.max_by
    shift = F.lead if ahead else F.lag
    summary = (
        rows.groupBy(*keys, CHUNK).agg(edge("_held", by).alias("_edge"))
        .select(*keys, CHUNK, shift("_edge").over(across).alias("_edge"))
    )
    rows = rows.withColumn("_near", shift("_held").over(inside))
    out = _join_back(rows, summary, keys)
    value = F.coalesce(F.col("_near"), F.col("_edge"))
    return out.select(
        *[c for c in df.columns if c not in columns],
        *[value[n].alias(n) for n in columns],
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: float | None,
    sums: Mapping[str, str | Column],
) -> DataFrame:
    """Running totals up to and including each row."""
    rows = chunked(df, keys, order, width)
    inside, across = _windows(keys, order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    for n, c in sums.items():
        rows = rows.withColumn(f"_v_{n}", _col(c))
    summary = rows.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    summary = summary.select(
        *keys, CHUNK, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    for n in sums:
        rows = rows.withColumn(f"_r_{n}", F.sum(f"_v_{n}").over(running))
    out = _join_back(rows, summary, keys)
    return out.select(
        *[c for c in df.columns if c not in sums],
        *[(F.coalesce(F.col(f"_r_{n}"), F.lit(0)) + F.col(f"_b_{n}")).alias(n) for n in sums],
    )


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: float | None,
    columns: Mapping[str, str | Column],
    ahead: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """The last non-null value at or before each row (first at or after with `ahead`)."""
    rows = chunked(df, keys, order, width)
    direction = [F.col(o).desc() for o in order] if ahead else [F.col(o).asc() for o in order]
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*direction).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    across = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if ahead else F.col(CHUNK)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    by = F.struct(*[F.col(o) for o in order])
    pick = F.min_by if ahead else F.max_by
    for n, c in columns.items():
        rows = rows.withColumn(f"_v_{n}", _col(c))
    summary = rows.groupBy(*keys, CHUNK).agg(
        *[pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), by)).alias(f"_s_{n}") for n in columns]
    )
    summary = summary.select(
        *keys, CHUNK, *[F.last(f"_s_{n}", ignorenulls=True).over(across).alias(f"_b_{n}") for n in columns]
    )
    for n in columns:
        rows = rows.withColumn(f"_r_{n}", F.last(f"_v_{n}", ignorenulls=True).over(inside))
    out = _join_back(rows, summary, keys)
    return out.select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(f"_r_{n}", f"_b_{n}").alias(n) for n in columns],
    )


def with_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: float | None,
    value: str | Column,
    name: str = "run",
) -> DataFrame:
    """A run number that grows whenever `value` changes from one row to the next."""
    line = chunked(df, keys, order, width)
    marked = with_neighbour(
        line.withColumn("_now", _col(value)), keys, order, width, {"_was": F.struct("_now")}
    )
    change = F.when(F.col("_was").isNull(), 1).when(
        ~F.col("_was")["_now"].eqNullSafe(F.col("_now")), 1
    ).otherwise(0)
    return with_running_sum(marked, keys, order, width, {name: change}).select(*[c for c in df.columns if c != name], name)


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, reach: int, size: int = 65536) -> DataFrame:
    """Rows copied to the chunks whose `reach`-wide frames they fall in; `_own` marks the original.

    Adds `_chunk`; a window over (keys, _chunk) then sees up to `reach` rows on either side.
    """
    lo = F.floor((F.col(pos) - reach) / size)
    hi = F.floor((F.col(pos) + reach) / size)
    own = F.floor(F.col(pos) / size)
    return (
        df.withColumn(CHUNK, F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)))
        .withColumn("_own", F.col(CHUNK) == own)
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str | Column, out: str = "median", weight: str | Column | None = None
) -> DataFrame:
    """The interpolating median per group, exact, without holding a group's values in one task.

    Pass 1 brackets the median per group with a mergeable quantile sketch (groups up to 1e5
    rows use their whole range). Pass 2 counts what lies below the bracket and, per distinct
    value, what lies inside it, so only about 2e-4 of a large group is ranked.
    """
    w = F.lit(1).cast("long") if weight is None else _col(weight)
    base = df.select(*keys, _col(value).cast("double").alias("_v"), w.alias("_w")).where("_v is not null")
    if weight is not None:  # weighted input is pre-aggregated, so its values are few
        stats = base.groupBy(*keys).agg(
            F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
    else:
        stats = base.groupBy(*keys).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
            F.percentile_approx("_v", [0.4999, 0.5001], 100000).alias("_q"),
        ).select(
            *keys, "_n",
            F.when(F.col("_n") <= 100000, F.col("_min")).otherwise(F.col("_q")[0]).alias("_lo"),
            F.when(F.col("_n") <= 100000, F.col("_max")).otherwise(F.col("_q")[1]).alias("_hi"),
        )
    inside = (
        base.join(stats, list(keys)).where("_v <= _hi")
        .groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .agg(F.sum("_w").alias("_c"))
    )
    ranked = inside.withColumn(
        "_cum", F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    )
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    return ranked.groupBy(*keys).agg(
        ((F.min(F.when(F.col("_cum") >= lower, F.col("_v")))
          + F.min(F.when(F.col("_cum") >= upper, F.col("_v")))) / 2.0).alias(out)
    )


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
