"""Merkle manifest of a dataset: a root per source, a root of all, and every row's proof, by nested-struct rollup.

A leaf is the digest of a row; the leaves of a source ascend by id, and every 16 consecutive nodes become the digest of
their digests until one is left. The place of a leaf is written as base-16 digits. Within a block of 16 ** digits leaves
the digit columns are grouped away one after another, each step nesting the structs of the one before in an array; a
block is bounded, so no row grows with its source. Block digests are far fewer and go through the same step again. The
path above a block travels as one more row of its group, so transform and explode turn the nested rows into proofs and no
join meets the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stavework.session import share

FAN, DIGITS = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`df` with `rank` (from 0, within `key`, by `order`) and `n`, the rows of the key; a null key is a key.

    Rows are dealt by ranges of (key, order), so a key of any size spreads over tasks and repeated rows do too. What
    is joined back is one row per range and key: fewer than ranges and keys together.
    """
    sorted_rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*[F.col(c).asc_nulls_first() for c in [key, *order, "_tie"]])
    sorted_rows = sorted_rows.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [key, *order, "_tie"]]).drop("_tie")
    placed = share(sorted_rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    runs = placed.groupBy(key, "_range").agg(F.min("_at").alias("first"), F.count("*").alias("rows"))
    runs = runs.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.select(F.col(key).alias("_key"), F.col("_range").alias("_run"), (F.col("first") - F.col("before")).alias("_shift"), F.sum("rows").over(Window.partitionBy(key)).alias("n"))
    joined = placed.join(runs, placed[key].eqNullSafe(runs["_key"]) & (F.col("_range") == F.col("_run")))
    return joined.withColumn("rank", F.col("_at") - F.col("_shift")).drop("_at", "_range", "_key", "_run", "_shift")


def _nested(nodes: DataFrame, key: str, digits: int, payload: list[str]) -> DataFrame:
    """(key, n, block, node, kids, above): one row per block; `kids` nests `digits` levels of at most 16 structs each.

    `nodes` has key, n, rank, node, the payload columns, and `above`; rows with `above` carry the path over a block and
    stand at the rank of its first leaf, without a node.
    """
    out = nodes.withColumn("block", F.floor(F.col("rank") / FAN**digits).cast("long"))
    for level in range(digits):
        out = out.withColumn(f"d{level}", F.when(F.col("node").isNotNull(), F.floor(F.col("rank") / FAN**level).cast("long") % FAN))
    out = out.repartition(key, "block").select(key, "n", "block", *[f"d{k}" for k in range(digits)], "node", "above", F.struct(*payload).alias("kids"))
    for level in range(digits):
        member = F.when(F.col(f"d{level}").isNotNull(), F.struct(F.col(f"d{level}").alias("digit"), "node", "kids"))
        out = out.groupBy(key, "n", "block", *[f"d{k}" for k in range(level + 1, digits)]).agg(F.sort_array(F.collect_list(member)).alias("kids"), F.first("above", ignorenulls=True).alias("above"))
        joined = F.array_join(F.transform("kids", lambda k: k["node"]), "")
        out = out.withColumn("node", F.when(F.size("kids") > 0, F.when(F.col("n") > FAN**level, F.sha2(joined, 256)).otherwise(joined)))
    return out


def _with_siblings(kids: Column) -> Column:
    """Each member of a run with the digests before it and after it, joined."""
    text = lambda part: F.array_join(F.transform(part, lambda k: k["node"]), "")
    return F.transform(kids, lambda k, i: F.struct(k["node"].alias("node"), k["kids"].alias("kids"), text(F.slice(kids, F.lit(1), i)).alias("left"), text(F.slice(kids, i + 2, F.lit(FAN))).alias("right")))


def proofs(nodes: DataFrame, key: str, payload: list[str], above: DataFrame, digits: int) -> DataFrame:
    """`nodes` with `path`: the siblings left and right of the node, level by level, then what `above` (key, n, block, above) holds for its block."""
    tips = above.select(key, "n", (F.col("block") * FAN**digits).alias("rank"), F.lit(None).cast("string").alias("node"), *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in payload], "above")
    kind = above.schema["above"].dataType
    out = _nested(nodes.select(key, "n", "rank", "node", *payload, F.lit(None).cast(kind).alias("above")).unionByName(tips), key, digits, payload)
    out = out.select(key, "n", F.col("above.path").alias("path"), "above", "kids")
    for level in reversed(range(digits)):
        out = out.select(key, "n", "path", "above", F.explode(_with_siblings(F.col("kids"))).alias("k"))
        step = F.array(F.struct(F.col("k.left").alias("left"), F.col("k.right").alias("right")))
        out = out.select(key, "n", F.when(F.col("n") > FAN**level, F.concat(step, "path")).otherwise(F.col("path")).alias("path"), "above", F.col("k.kids").alias("kids"), F.col("k.node").alias("node"))
    return out.select(key, "n", "path", "above", "node", *[F.col(f"kids.{c}").alias(c) for c in payload])


def block_paths(nodes: DataFrame, key: str, digits: int) -> DataFrame:
    """(key, n, block, above: struct(path, top)): the way from each block's digest to the one digest of its key.

    `nodes` has key, n, rank and node. Each turn has 16 ** digits times fewer rows than the one before.
    """
    plain = nodes.select(key, "n", "rank", "node", F.lit(None).cast("string").alias("above"))
    blocks = share(_nested(plain, key, digits, ["rank"]).select(key, F.col("n").alias("_n"), F.col("block").alias("rank"), "node"))
    width = FAN**digits
    blocks = blocks.withColumn("n", F.ceil(F.col("_n") / width).cast("long"))
    if not blocks.where("n > 1").isEmpty():
        higher = block_paths(blocks, key, digits)
        found = proofs(blocks.withColumn("_block", F.col("rank")), key, ["_block", "_n"], higher, digits)
        return share(found.select(key, F.col("_n").alias("n"), F.col("_block").alias("block"), F.struct("path", F.col("above.top").alias("top")).alias("above")))
    return blocks.select(key, F.col("_n").alias("n"), F.col("rank").alias("block"), F.struct(F.array().cast(_STEP).alias("path"), F.col("node").alias("top")).alias("above"))


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    text_col: str = "text", digits: int = DIGITS) -> DataFrame:
    """One row per document: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    `proof_sha256` digests all siblings from the leaf to the root of all sources. `folded_root` folds the leaf as a
    reader would find it: of every row whose id's CRC-32 is a multiple of 5 the text has its A-Z in lower case, which a
    text that has none survives; `verified` tells whether the fold meets the root.

    * Any column may be null; a null source is a source of its own and comes first, a null id is never tampered with and
      comes first in its source. Rows with one id are ordered by their leaves; repeated rows are leaves of their own
      with equal digests, so their order doesn't show in a root. Then which of them gets which proof is left open.
    * Other columns are ignored. Long texts are hashed whole, in the scan; only digests are shuffled. An empty table gives no rows.
    """
    altered = F.translate(F.col(text_col), UPPER, LOWER)
    whole = digest(*[field(F.col(c)) for c in columns])
    found = F.when(F.crc32(F.col(id_col).cast("string")) % 5 == 0, digest(*[field(altered if c == text_col else F.col(c)) for c in columns]))
    leaves = share(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("key"), whole.alias("node"), found.alias("found")))
    rows = share(ranked(leaves, "key", ["id", "node"]))
    upper = block_paths(rows, "key", digits)
    tops = share(ranked(upper.select(F.col("key"), F.col("above.top").alias("node")).distinct().select(F.lit(0).alias("all"), "key", "node"), "all", ["key"]))
    roots = proofs(tops, "all", ["key"], block_paths(tops, "all", digits), digits)
    roots = roots.select(F.col("key").alias("_key"), F.col("path").alias("over"), F.col("above.top").alias("root"))
    upper = upper.join(roots, upper["key"].eqNullSafe(roots["_key"]))
    upper = upper.select("key", "n", "block", F.struct(F.concat("above.path", "over").alias("path"), F.col("above.top").alias("subroot"), "root").alias("above"))
    out = proofs(rows, "key", ["id", "found"], upper, digits)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    fold = F.aggregate("path", F.coalesce("found", "node"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = out.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), F.col("above.subroot").alias("subroot"), F.col("above.root").alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
