"""Quality scores learned from preference pairs (Bradley-Terry): logistic loss on feature differences.

A document's strength is linear in features of its whole text; the chance that one document is
preferred to another is the logistic function of the difference of their strengths. The strength is
then cut at a quantile, the share of label 0 among the labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stavework.llm import folds, words as W

SAMPLE, PAIRS = 20_000, 60_000
_KINDS = np.full(256, 5, np.uint8)
_KINDS[[32, 9, 11, 12, 13]] = 0
_KINDS[10] = 1
_KINDS[97:123] = 2
_KINDS[65:91] = 3
_KINDS[48:58] = 4
_KINDS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 6
_KINDS[128:] = 7


def features(texts: pa.Array) -> np.ndarray:
    """One row per text; a text without words gives zeros."""
    hashes, starts, ends, first, data = W.words(texts)
    n = len(first) - 1
    counts = np.diff(first).astype(float)
    full = np.flatnonzero(counts > 0)
    out = np.zeros((n, 32))
    if not len(full):
        return out
    edge = first[full]
    kinds = _KINDS[data]
    length = ends - starts
    m = counts[full]

    def per_text(values):
        return np.add.reduceat(values.astype(np.float64), edge)

    within = {}
    for k in (2, 3, 4, 5, 6, 7):
        run = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        within[k] = run[ends] - run[starts]
    lines = np.concatenate([[0], np.cumsum(kinds == 1, dtype=np.int64)])
    size = per_text(length)
    columns = [np.log1p(m), np.log1p(size), size / m, np.sqrt(np.maximum(per_text(length.astype(float) ** 2) / m - (size / m) ** 2, 0))]
    columns += [per_text(within[k]) / size for k in (2, 3, 4, 5, 6, 7)]
    letters = within[2] + within[3] + within[7]
    columns.append(per_text(letters == 0) / m)
    columns.append(per_text((within[3] > 1) & (within[2] == 0)) / m)
    columns.append(per_text(within[5] > 0) / m)
    columns.append(per_text(within[6] > 0) / m)
    columns.append(per_text(length > 20) / m)
    columns.append(per_text(length <= 3) / m)
    columns.append((lines[ends[first[full + 1] - 1]] - lines[starts[edge]]) / m)
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    same[edge] = 0
    columns.append(per_text(same) / m)
    sorted_codes, bounds = W.distinct(hashes, first)
    columns.append(np.diff(bounds)[full] / m)
    columns.append(np.log1p(m) * columns[-1])
    pairs, pair_bounds = W.shingles(hashes, first, 2)
    codes, bounds = W.distinct(pairs, pair_bounds)
    columns.append(np.diff(bounds)[full] / np.maximum(np.diff(pair_bounds)[full], 1))
    ratios = np.stack(columns, axis=1)
    odd = [5, 6, 7, 8, 10, 11, 12, 16, 17]
    table = np.concatenate([ratios, np.log(ratios[:, odd] + 0.003)], axis=1)
    out[full, : table.shape[1]] = table
    out[full, 31] = 1.0
    return out


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 40) -> dict:
    """Weights from preference pairs: every rejected row meets accepted ones, at most `pairs` pairs in all.

    Without both labels there is nothing to compare: every score is then the share of label 1 (0.5 without labels).
    """
    if not len(x) or good.all() or not good.any():
        return {"flat": float(good.mean()) if len(x) else 0.5}
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - centre) / scale, -8, 8)
    rng = np.random.default_rng(7)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    count = min(pairs, max(len(up), len(down)) * 4)
    a = np.resize(rng.permutation(up), count)
    b = rng.permutation(np.resize(down, count))
    d = z[a] - z[b]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / count + ridge * np.eye(len(w))
        move = np.linalg.solve(bend, gradient)
        w -= move
        if np.abs(move).max() < 1e-7:
            break
    strength = z @ w
    cut = float(np.quantile(strength, 1.0 - good.mean(), method="midpoint"))
    return {"centre": centre, "scale": scale, "w": w, "cut": cut}


def apply_model(model: dict, x: np.ndarray) -> np.ndarray:
    if "flat" in model:
        return np.full(len(x), model["flat"])
    z = np.clip((x - model["centre"]) / model["scale"], -8, 8)
    return np.round(1.0 / (1.0 + np.exp(-np.clip(z @ model["w"] - model["cut"], -30, 30))), 9)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """The model of a bounded sample: about `sample` labelled learning rows, chosen by a hash of the id.

    Labels given several times are averaged, at least 0.5 is label 1; null labels and ids are left out.
    """
    named = labels.where(folds.learnable(id_col) & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).alias("good"))
    rows = named.count()
    chosen = F.broadcast(named.where(folds.thinned(id_col, F.lit(rows), sample)).withColumnRenamed(id_col, "label_id"))
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(chosen, "label_id")

    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                x = features(part.column("text"))
                yield pa.record_batch([part.column("label_id"), part.column("good"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "good", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.mapInArrow(run, f"id {kind}, good boolean, x array<double>").toPandas()
    got = got.assign(key=[tuple(x) for x in got["x"]]).sort_values(["id", "key"], kind="stable")
    x = np.array(got["key"].to_list()) if len(got) else np.zeros((0, 32))
    return fit_pairs(x, got["good"].to_numpy(bool))


def score(model: dict, text_col: str = "text") -> Column:
    """The score of every whole text, 0 to 1."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = [apply_model(model, features(piece)) for piece in W.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(F.col(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per document: score 0 to 1, predicted 1 from 0.5 on.

    Null, empty and blank texts are scored as a text without words. Ids may be null or repeated; each row is
    scored by its text alone, so equal texts have equal scores. An empty table gives no rows. Columns other than
    id and text are not read.
    """
    model = fit(docs, labels, id_col, text_col)
    return docs.select(F.col(id_col), folds.held_out(id_col).alias("held_out"), score(model, text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
