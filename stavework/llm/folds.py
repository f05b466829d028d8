"""The fixed split into learning rows and held-out rows, and bounded samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id, which no model learns from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def thinned(id_col: str, rows: Column, bound: int) -> Column:
    """Keeps each id with chance bound / rows, by a hash of the id alone: about `bound` rows, the same on every run."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 40)) * rows < F.lit(bound) * F.lit(1 << 40).cast("double")
