"""Bars of every track clustered by their features: one k-means per track and k, all of them at once as table work.

Seeds are picked farthest first, so those of a smaller k are the first of a larger one. A round assigns every bar for every k
that its track has not settled, by a join on the track, and averages the clusters in one aggregate; only centres are
written between rounds, a few rows per track. Coordinates and distances are rounded to nine places, so results do not
depend on the order of sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stavework.session import share

# The numbers of clusters tried, the largest cluster's share that is split further, the bars a track needs.
MIN_K, MAX_K, SPLIT_SHARE, MIN_BARS = 3, 6, 0.6, 9
ROUNDS = 100


def bar_vectors(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bar, f): the long rows (keys, bar, dim, z) as one array per bar, in order of `dim`."""
    held = F.array_sort(F.collect_list(F.struct("dim", "z")))
    return features.groupBy(*keys, "bar").agg(held.alias("f")).select(*keys, "bar", F.transform("f", lambda x: F.round(x["z"], 9)).alias("f"))


def distance(a: Column, b: Column) -> Column:
    """Squared distance of two arrays, to nine places."""
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.round(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x), 9)


def seeds(vectors: DataFrame, keys: list[str], k: int = MAX_K) -> DataFrame:
    """(keys, n, bars, at): each track's bar count, its first `k` seeds and their vectors; fewer where vectors are equal.

    The first seed is the bar farthest from the origin, which is the mean of scaled features; each next one is the bar
    farthest from its nearest seed. The earlier bar wins a tie.
    """
    far = lambda d: F.max_by(F.struct("bar", "f"), F.struct(d, -F.col("bar")))
    first = vectors.groupBy(*keys).agg(F.count("*").alias("n"), far(distance(F.col("f"), F.transform("f", lambda x: F.lit(0.0)))).alias("s"))
    chosen = share(first.select(*keys, "n", F.array("s.bar").alias("bars"), F.array("s.f").alias("at")))
    for _ in range(k - 1):
        near = vectors.join(chosen, keys).withColumn("d", F.array_min(F.transform("at", lambda s: distance(F.col("f"), s))))
        found = near.where("d > 0").groupBy(*keys).agg(far(F.col("d")).alias("s"))
        grown = chosen.join(found, keys, "left")
        added = lambda old, new: F.when(F.col("s").isNull(), F.col(old)).otherwise(F.concat(old, F.array(new)))
        chosen = share(grown.select(*keys, "n", added("bars", "s.bar").alias("bars"), added("at", "s.f").alias("at")))
    return chosen


def nearest(f: Column, centres: Column) -> Column:
    """The number of the centre nearest to `f`, the first of equal ones."""
    places = F.transform(centres, lambda c, i: F.struct(distance(f, c).alias("d"), i.alias("i")))
    return F.array_min(places)["i"]


def assigned(vectors: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, bar, cluster, f): every bar's nearest centre for every k of its track; `centres` (keys, k, at)."""
    return vectors.join(centres, keys).select(*keys, "k", "bar", nearest(F.col("f"), F.col("at")).alias("cluster"), "f")


def openings(vectors: DataFrame, keys: list[str], min_k: int = MIN_K, max_k: int = MAX_K) -> DataFrame:
    """(keys, n, k, at): the seeds that each k of a track starts from.

    A track with fewer distinct bars than k has no model of that k; one with fewer than `min_k` has its largest possible one.
    """
    found = seeds(vectors, keys, max_k)
    ks = F.filter(F.sequence(F.lit(min_k), F.lit(max_k)), lambda k: k <= F.size("at"))
    ks = F.when(F.size("at") < min_k, F.array(F.size("at"))).otherwise(ks)
    return found.select(*keys, "n", "at", F.explode(ks).alias("k")).withColumn("at", F.slice("at", F.lit(1), F.col("k")))


def _means(labelled: DataFrame, keys: list[str], dims: int) -> DataFrame:
    mean = F.array(*[F.round(F.avg(F.get("f", F.lit(d))), 9) for d in range(dims)])
    one = labelled.groupBy(*keys, "k", "cluster").agg(mean.alias("mean"))
    return one.groupBy(*keys, "k").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("means"))


def fit(vectors: DataFrame, keys: list[str], min_k: int = MIN_K, max_k: int = MAX_K, rounds: int = ROUNDS) -> DataFrame:
    """(keys, n, k, at, converged): the centres of every track and k, moved until none changes or `rounds` are over.

    A cluster that loses all its bars keeps its centre. All bars have the same number of features.
    """
    open_, done = openings(vectors, keys, min_k, max_k), []
    dims = vectors.agg(F.max(F.size("f"))).first()[0] or 1
    for _ in range(rounds):
        means = _means(assigned(vectors, open_, keys), keys, dims)
        moved = F.transform("at", lambda c, i: F.coalesce(F.try_element_at("means", i), c))
        after = open_.join(means, [*keys, "k"]).select(*keys, "n", "k", moved.alias("at"), (moved == F.col("at")).alias("converged"))
        after = share(after)
        done.append(after.where("converged"))
        open_ = after.where("not converged")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*done, open_])


def segment_bars(features: DataFrame, keys: list[str], min_k: int = MIN_K, max_k: int = MAX_K, split_share: float = SPLIT_SHARE,
                 min_bars: int = MIN_BARS, rounds: int = ROUNDS) -> DataFrame:
    """Every bar's cluster (keys, bar, cluster, k, share, converged), with each track's own k.

    `features` is long: (keys, bar, dim, z). k is the least from `min_k` on whose largest cluster holds at most `split_share` of the
    bars, or else the largest. Clusters are numbered by their first bars. A track under `min_bars` bars is one cluster.
    """
    vectors = share(bar_vectors(features, keys))
    counted = vectors.groupBy(*keys).agg(F.count("*").alias("n"))
    short = vectors.join(counted.where(F.col("n") < min_bars), keys, "left_semi").select(
        *keys, "bar", F.lit(0).alias("cluster"), F.lit(1).alias("k"), F.lit(1.0).alias("share"), F.lit(True).alias("converged"))
    long = vectors.join(counted.where(F.col("n") >= min_bars), keys, "left_semi")
    model = share(fit(long, keys, min_k, max_k, rounds))
    labelled = assigned(long, model, keys).drop("f")
    sizes = labelled.groupBy(*keys, "k", "cluster").agg(F.count("*").alias("size"), F.min("bar").alias("first"))
    sizes = sizes.withColumn("number", F.row_number().over(Window.partitionBy(*keys, "k").orderBy("first")) - 1)
    shares = sizes.groupBy(*keys, "k").agg((F.max("size") / F.sum("size")).alias("share")).join(model.select(*keys, "k", "converged"), [*keys, "k"])
    fits = F.col("share") <= split_share
    chosen = shares.groupBy(*keys).agg(F.coalesce(F.min(F.when(fits, F.col("k"))), F.max("k")).alias("k"))
    numbers = share(sizes.join(chosen, [*keys, "k"]).join(shares, [*keys, "k"]).select(*keys, "k", "cluster", "number", "share", "converged"))
    out = assigned(long, model.join(chosen, [*keys, "k"], "left_semi"), keys).join(numbers, [*keys, "k", "cluster"])
    return out.select(*keys, "bar", F.col("number").alias("cluster"), "k", "share", "converged").unionByName(short)
