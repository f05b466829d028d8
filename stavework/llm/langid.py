"""Language of whole texts by nearest centroid: normalised TF-IDF byte n-grams, several clustered centroids per language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stavework.llm import folds, words as W
from stavework.session import share

BITS, ORDERS = 14, (2, 3, 4)
PER_LANGUAGE, CENTROIDS = 400, 4
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts of each text, over lower-cased letters with anything else as one blank."""
    data, offsets = W.text_buffer(texts)
    out = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b, W.PIECE):
            text = _FOLD[data[at : min(b, at + W.PIECE)]]
            text = np.concatenate([[32], text, [32]]).astype(np.uint32)
            text = text[np.concatenate([[True], (text[1:] != 32) | (text[:-1] != 32)])]
            for order in ORDERS:
                if len(text) >= order:
                    code = np.zeros(len(text) - order + 1, np.uint32)
                    for k in range(order):
                        code |= text[k : len(text) - order + 1 + k] << np.uint32(8 * k)
                    code = (code * np.uint32(2654435761) + np.uint32(order * 40503)) * np.uint32(2246822519)
                    out[i] += np.bincount(code >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def vectors(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(raw) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def cluster(v: np.ndarray, k: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, least cosine): spherical k-means from farthest-first seeds, and each cluster's first percentile of cosine."""
    seeds = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(seeds) < min(k, len(v)):
        near = (v @ v[seeds].T).max(axis=1)
        near[seeds] = 2
        seeds.append(int(np.argmin(near)))
    c = v[seeds].copy()
    for _ in range(turns):
        owner = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (owner == j).any():
                c[j] = v[owner == j].mean(axis=0)
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    best = (v @ c.T).max(axis=1)
    owner = np.argmax(v @ c.T, axis=1)
    floor = np.array([np.quantile(best[owner == j], 0.01) if (owner == j).any() else 1.0 for j in range(len(c))])
    return c, floor


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict | None:
    """Centroids of a bounded sample: about `per_language` learning rows of each language, chosen by a hash of the id.

    None if no row can be learned from.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(folds.learnable("id") & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sizes = rows.groupBy("lang").count()  # one row a language, far less than the centroids that the driver holds later
    sample = share(rows.join(F.broadcast(sizes), "lang").where(folds.thinned("id", F.col("count"), per_language)).select("id", "lang", "text"))

    def document_counts(batches):
        total, n = np.zeros(1 << BITS), 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                for k in range(0, part.num_rows, 64):
                    raw = counts(part.column("text").slice(k, 64))
                    total, n = total + (raw > 0).sum(axis=0), n + len(raw)
        yield pa.record_batch([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "df"])

    got = sample.coalesce(8).mapInArrow(document_counts, "n long, df array<double>").collect()
    n = sum(r["n"] for r in got)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.sum([r["df"] for r in got], axis=0))).astype(np.float32) + np.float32(0.1)

    def one_language(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        texts = table.column("text").combine_chunks()
        v = np.concatenate([vectors(counts(texts.slice(k, 64)), idf) for k in range(0, len(texts), 64)])
        c, floor = cluster(v, centroids)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c)), "floor": pa.array(floor, pa.float64()), "c": pa.array([x.astype(np.float32).tobytes() for x in c], pa.binary())})

    found = sample.groupBy("lang").applyInArrow(one_language, "lang string, floor double, c binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["c"])))
    return {"idf": idf, "langs": [r["lang"] for r in found], "floor": np.array([r["floor"] for r in found]), "c": np.stack([np.frombuffer(r["c"], np.float32) for r in found])}


def predict(model: dict, text_col: str = "text") -> Column:
    """(lang, score, rejected) of each text: the nearest centroid, its cosine, and whether that lies under the cluster's usual range."""
    @F.arrow_udf("lang string, score double, rejected boolean")
    def run(texts: pa.Array) -> pa.Array:
        best, value = [np.zeros(0, np.int64)], [np.zeros(0)]
        for piece in W.slices(texts):
            for k in range(0, len(piece), 64):
                near = vectors(counts(piece.slice(k, 64)), model["idf"]) @ model["c"].T
                best.append(np.argmax(near, axis=1))
                value.append(near.max(axis=1))
        at, cosine = np.concatenate(best), np.clip(np.round(np.concatenate(value).astype(float), 6), 0, 1)
        return pa.StructArray.from_arrays([pa.array([model["langs"][k] for k in at], pa.string()), pa.array(cosine), pa.array(cosine < model["floor"][at])], names=["lang", "score", "rejected"])

    return run(F.col(text_col))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) per document.

    A text that is null or has no letter is `und` with score 0 and rejected; so is everything if no row can be
    learned from. Any other text gets its nearest language, whatever its distance, and `rejected` tells whether
    that distance is out of range. Ids may be null or repeated; equal texts get equal answers. An empty table
    gives no rows.
    """
    model = fit(docs, id_col, text_col, lang_col)
    base = docs.select(F.col(id_col), folds.held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    if model is None:
        return base.select(id_col, "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    known = F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False))
    got = base.select(id_col, "held_out", known.alias("_known"), predict(model, "_text").alias("_p"))
    return got.select(id_col, "held_out", F.when(F.col("_known"), F.col("_p.lang")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("_known"), F.col("_p.score")).otherwise(0.0).alias("score"), (~F.col("_known") | F.col("_p.rejected")).alias("rejected"))
