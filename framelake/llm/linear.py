"""Small pieces that the two text classifiers share: folded bytes, labelled samples, and a solver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_case(buf: np.ndarray, separators: int = 0x20) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; all other ASCII bytes become separators."""
    out = buf.copy()
    upper = (buf >= 0x41) & (buf <= 0x5A)
    out[upper] += 0x20
    out[(out < 0x61) | ((out > 0x7A) & (out < 0x80))] = separators
    accent = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    out[1:][accent] += 0x20
    return out


def fold_number(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, label: str, per_label: int, key: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, list, dict]:
    """About ``per_label`` rows of each label (all of a rare one), the same at every run; the labels; their counts.
    Rows are drawn by the hash of ``key``, so rows alike in it are drawn together."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}
    if not counts:
        return df.where(F.lit(False)), [], {}
    scale = 1 << 30
    limits = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(scale if n <= per_label else int(scale * per_label / n)))])
    return df.where(F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(scale)) < limits[F.col(label)]), sorted(counts), counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
