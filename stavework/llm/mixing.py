"""Mixing sources to target weights by nested hash thresholds.

Each source's extra budget is met by taking the documents whose hash lies under a threshold. The
threshold is found from histograms of size by (source, size class, hash bucket); only the bucket that
the budget ends in is split further, so no documents are sorted and the tables stay small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from stavework.llm import words as W
from stavework.session import share

WEIGHTS = (5, 2, 1)
MOST = 3
LEVELS, LEVEL_BITS = 4, 12


@F.arrow_udf(LongType())
def _word_count(texts: pa.Array) -> pa.Array:
    out = []
    for piece in W.slices(texts):
        data, offsets = W.text_buffer(piece)
        begins = ~W._SEPARATOR[data]
        filled = offsets[:-1] < offsets[1:]
        firsts = begins[offsets[:-1][filled]]
        begins[1:] &= W._SEPARATOR[data[:-1]]
        begins[offsets[:-1][filled]] = firsts
        sums = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
        out.append(np.diff(sums[offsets]))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())


def unit_hash(id_col: str, text_col: str) -> Column:
    """48 bits of md5 of the id, of the text where the id is null."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with _size (words), _class (its bit length) and _u (the hash)."""
    out = docs.withColumn("_size", _word_count(F.col(text_col)))
    return out.withColumn("_class", F.length(F.bin("_size"))).withColumn("_u", unit_hash(id_col, text_col))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, total, place): place from 0 in code-point order, null last, without one task for all sources.

    Sources are dealt by range; the few partition sizes give each partition its first place.
    """
    ordered = share(sizes.orderBy(F.col("source").isNull(), "source").select("source", "total", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    starts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("k"))
    starts = starts.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ordered.join(starts, part == starts["part"]).select("source", "total", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, total, target): shares by weight of all sizes, at most MOST times the source's own; the excess is dealt again by weight."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    rows = share(ranked_sources(sizes).withColumn("w", weight))
    whole, all_weight = rows.agg(F.sum("total"), F.sum("w")).first()
    level, fixed = (float(whole) / all_weight if whole else 0.0), -1
    while whole:
        full = F.col("total") * MOST < F.col("w") * level
        count, spent, used = rows.where(full).agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if count == fixed:
            break
        fixed, level = count, float(whole - MOST * spent) / float(all_weight - used)
    return rows.withColumn("target", F.least(F.col("total") * float(MOST), F.col("w") * level)).select("source", "total", "target")


def search(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """For each stratum (s, c, budget) the hash its budget ends in: (s, c, budget, prefix, below, unit).

    `below` is the size of the documents under the hash `prefix`, `unit` that of the documents at it. Each level
    is a histogram of the one bucket in which the budget ends, over the next bits of the hash.
    """
    edge = strata.select("s", "c", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("unit"))
    bits = LEVELS * LEVEL_BITS
    for level in range(1, LEVELS + 1):
        edge, shift = share(edge), bits - level * LEVEL_BITS
        inside = rows.where("_size > 0").join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("_class") == F.col("c")) & (F.shiftright("_u", shift + LEVEL_BITS) == F.col("prefix")))
        cells = inside.groupBy("s", "c", "budget", "below", F.shiftright("_u", shift).alias("cell")).agg(F.sum("_size").alias("unit"))
        order = Window.partitionBy("s", "c").orderBy("cell")
        running = cells.withColumn("upto", F.col("below") + F.sum("unit").over(order)).withColumn("last", F.lead("cell").over(order).isNull())
        crossing = running.where((F.col("upto") > F.col("budget")) | F.col("last")).groupBy("s", "c", "budget").agg(F.min(F.struct("cell", "upto", "unit")).alias("x"))
        edge = crossing.select("s", "c", "budget", F.col("x.cell").alias("prefix"), (F.col("x.upto") - F.col("x.unit")).alias("below"), F.col("x.unit").alias("unit"))
    return share(edge)


def thresholds(docs: DataFrame, source_col: str) -> DataFrame:
    """(s, st, target, copies, cuts): each source's size, target, whole copies, and the thresholds of its size classes.

    A target is so many whole copies of its source and a rest. The rest is shared by size class in proportion, each class
    gets its threshold, and the documents at the thresholds are taken from the largest on while they fit. What is then still
    missing moves the threshold of one class, the smallest that can hold it, so a source of many documents misses its
    target by about one short document, and any source by at most half of its longest.
    """
    rows = share(docs.select(F.col(source_col).alias("source"), "_size", "_class", "_u"))
    sums = share(rows.groupBy("source", "_class").agg(F.sum("_size").alias("total")))
    goal = targets(sums.groupBy("source").agg(F.sum("total").alias("total")))
    copies = F.when(F.col("st") > 0, F.least(F.floor(F.col("target") / F.col("st")), F.lit(MOST))).otherwise(0)
    goal = share(goal.select(F.col("source").alias("s"), F.col("total").alias("st"), "target").withColumn("copies", copies))
    strata = sums.join(goal, F.col("source").eqNullSafe(F.col("s"))).where("total > 0")
    strata = share(strata.select("s", F.col("_class").alias("c"), "total", ((F.col("target") - F.col("copies") * F.col("st")) * F.col("total") / F.col("st")).alias("budget")))
    edge = search(rows, strata)
    units = edge.groupBy("s").agg(F.sum(F.col("budget") - F.col("below")).alias("rest"), F.sort_array(F.collect_list(F.struct((-F.col("unit")).alias("n"), "c"))).alias("units"))

    def step(acc, x):
        take = -x["n"] <= acc["rest"]
        return F.struct((acc["rest"] + F.when(take, x["n"]).otherwise(0)).alias("rest"), F.when(take, F.concat(acc["kept"], F.array(x["c"]))).otherwise(acc["kept"]).alias("kept"))

    folded = F.aggregate("units", F.struct(F.col("rest").alias("rest"), F.array().cast("array<int>").alias("kept")), step)
    kept = units.select(F.col("s").alias("s2"), folded.alias("f")).select("s2", "f.rest", "f.kept")
    first = edge.join(kept, F.col("s").eqNullSafe(F.col("s2"))).withColumn("kept", F.array_contains("kept", F.col("c"))).drop("s2")
    room = strata.select(F.col("s").alias("s2"), F.col("c").alias("c2"), "total")
    first = share(first.join(room, F.col("s").eqNullSafe(F.col("s2")) & (F.col("c") == F.col("c2"))).drop("s2", "c2"))
    got = F.col("below") + F.when(F.col("kept"), F.col("unit")).otherwise(0)
    fits = F.col("total") - got >= F.col("rest")
    moved = first.groupBy("s").agg(F.min(F.struct((~fits).alias("full"), F.when(fits, F.col("c").cast("long")).otherwise(got - F.col("total")).alias("by"), "c", (got + F.col("rest")).alias("budget"))).alias("m"))
    second = search(rows, moved.select("s", "m.c", "m.budget"))
    second = second.select("s", "c", "prefix", (F.col("unit") <= 2 * (F.col("budget") - F.col("below"))).alias("kept"))
    cuts = first.select("s", "c", "prefix", "kept", F.lit(0).alias("turn")).union(second.withColumn("turn", F.lit(1)))
    cuts = cuts.groupBy("s", "c").agg(F.max(F.struct("turn", "prefix", "kept")).alias("t"))
    done = cuts.select("s", F.struct("c", "t.prefix", "t.kept").alias("t")).groupBy(F.col("s").alias("s3")).agg(F.collect_list("t").alias("cuts"))
    return share(goal.join(done, F.col("s").eqNullSafe(F.col("s3")), "left").drop("s3"))


def taken(docs: DataFrame, cuts: DataFrame, source_col: str) -> DataFrame:
    """Adds _source_size, _target and _taken: size times the whole copies, once more under the threshold."""
    mine = F.filter("cuts", lambda t: t["c"] == F.col("_class"))[0]
    more = (F.col("_u") < mine["prefix"]) | ((F.col("_u") == mine["prefix"]) & mine["kept"])
    joined = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("s")))
    out = joined.withColumn("_taken", F.col("_size") * (F.col("copies") + F.coalesce(more, F.lit(False)).cast("long")))
    return out.withColumn("_source_size", F.col("st")).withColumn("_target", F.round("target", 6)).drop("s", "st", "target", "copies", "cuts")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) per document; taken is size times 0 to 3.

    Size is the number of words of the whole text, 0 for null. Sources in code-point order, null last, weigh 5, 2, 1,
    repeating; a source's target is at most three times its size. Documents without words take nothing. Rows with the same id
    (without one: the same text) share a hash and are taken or left together. Reruns and other partitionings agree.
    An empty table gives no rows; other columns are not read.
    """
    rows = share(sized(docs.select(F.col(id_col), F.col(text_col), F.col(source_col).alias("_source")), id_col, text_col).drop(text_col))
    out = taken(rows, thresholds(rows, "_source"), "_source")
    return out.select(id_col, F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents the mix takes, with all their columns and `copies`, how often each is taken.

    The written table of sizes finds the thresholds; texts are then filtered in one pass, joined only with the small table of sources.
    """
    names = docs.columns
    work = docs.select(*[F.col(f"`{c}`").alias(f"_d{k}") for k, c in enumerate(names)])
    own = {c: f"_d{k}" for k, c in enumerate(names)}
    rows = sized(work, own[id_col], own[text_col])
    cuts = thresholds(rows.select(own[source_col], "_size", "_class", "_u"), own[source_col])
    out = taken(rows, cuts, own[source_col]).where("_taken > 0")
    return out.select(*[F.col(own[c]).alias(c) for c in names], (F.col("_taken") / F.col("_size")).cast("int").alias("copies"))
