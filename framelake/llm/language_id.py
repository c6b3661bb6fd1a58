"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed byte n-grams (1 to 3, case and
punctuation folded) learns each bit.  A text's language is the codeword of least loss, each bit's
logistic loss weighted by how well that bit's classifier does on that language.  Where the two
nearest codewords are closer than ``margin``, the answer is flagged as ambiguous.

Fitting uses at most ``sample_rows`` labelled rows in all (each language its share; a documented
bound); prediction reads every whole text and nothing else of a row.

Results: null text, or one without a letter: ``und``, score 0, ambiguous. Nothing to learn from:
``und`` for all. One language only: that one. Empty tables give no rows; repeated rows are each
answered; texts of any length are read whole. Ties of two codewords: the first by name, ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.llm.linear import bounded_sample, fold_case, fold_number, sigmoid
from framelake.llm.textops import Chunk, chunks, pack, unpack

BITS = 12  # of a feature's number
CHUNK, ROWS = 1 << 20, 256
UNDETERMINED = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1.  Up to 6 languages: the exhaustive code (any two rows differ in
    2**(n-2) places).  More: of 64 random codes of 12 log2(n) bits, the one whose nearest rows
    are farthest apart."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        bits = (np.arange(1, 2 ** (n - 1))[None, :] >> np.arange(n)[:, None]) & 1
        return (2 * bits - 1).astype(np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    width = int(np.ceil(12 * np.log2(n)))
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        split = np.abs(code.sum(0)) < n  # every classifier must have two sides
        apart = (width - code.astype(int) @ code.T)[~np.eye(n, dtype=bool)].min() // 2
        if split.all() and apart > far:
            best, far = code, apart
    if best is None:
        raise ValueError("no code found")
    return best


def features(c: Chunk) -> np.ndarray:
    """Rows of unit length: log counts of the hashed n-grams of each text."""
    rows, n = len(c), len(c.buf)
    buf = fold_case(c.buf).astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(c.offs))
    rest = c.offs[1:][row] - np.arange(n) if n else row
    counts = np.zeros(rows << BITS, np.int64)
    gram = np.zeros(n, np.uint32)
    for size in (1, 2, 3):
        gram[: n - size + 1] |= buf[size - 1 :] << np.uint32(8 * (size - 1)) if n >= size else 0
        at = (gram | np.uint32(size << 24)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
        whole = rest >= size
        counts += np.bincount((row[whole] << BITS) + at[whole], minlength=rows << BITS)
    x = np.log1p(counts.reshape(rows, 1 << BITS), dtype=np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)


def has_letter(c: Chunk) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = ((c.buf | 0x20) >= 0x61) & ((c.buf | 0x20) <= 0x7A)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = total[c.offs[1:]] > total[c.offs[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, c.buf[c.offs[i] : c.offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # language x bit, rows add up to 1
    mean: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every row to every codeword."""
        z = (x - self.mean) @ self.weights + self.bias
        return np.einsum("nlb,lb->nl", np.logaddexp(0, -z[:, None, :] * self.code[None]), self.trust)


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 250, decay: float = 1e-5, own: bool = False) -> Model:
    """All bits' logistic regressions together, by accelerated full gradients.  ``own``: x may be overwritten."""
    code = codewords(len(languages))
    mean = x.mean(0) if len(x) else np.zeros(1 << BITS, np.float32)
    centred = np.subtract(x, mean, out=x if own else None)
    target = code[labels].astype(np.float32)
    share = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    weight = (share[labels] / share[labels].sum())[:, None].astype(np.float32)  # languages count alike
    w = look = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = look_b = np.zeros(code.shape[1], np.float32)
    step = np.float32(4 / max(float((weight[:, 0] * np.einsum("ij,ij->i", centred, centred)).sum()), 1e-6))
    for k in range(rounds if code.shape[1] else 0):
        pull = weight * target * sigmoid(-target * (centred @ look + look_b))
        new = look + step * (centred.T @ pull - decay * look)
        new_b = look_b + step * pull.sum(0)
        go = np.float32(k / (k + 3))
        look, look_b, w, b = new + go * (new - w), new_b + go * (new_b - b), new, new_b
    right = (np.sign(centred @ w + b) == target).astype(np.float64)
    trust = np.stack([right[labels == i].mean(0) if (labels == i).any() else np.ones(code.shape[1]) for i in range(len(languages))]) if languages else np.ones(code.shape)
    trust = np.maximum(trust, 1e-3)
    return Model(languages, code.astype(np.float32), w, b, trust / np.maximum(trust.sum(1, keepdims=True), 1e-9), mean)


def learn(labelled: DataFrame, sample_rows: int = 6000) -> Model:
    """A model of ``labelled`` (doc_id, text, lang) from at most about ``sample_rows`` of its rows."""
    known = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    n = known.select("lang").distinct().count()
    sample, _, _ = bounded_sample(known, "lang", max(1, sample_rows // max(n, 1)), ("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, CHUNK, max_rows=ROWS):
            x, ok = features(c), has_letter(c)
            rows = [pack(np.flatnonzero(r).astype(np.uint16), r[r > 0]) if good else None for r, good in zip(x, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([c.batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "x"])

    got = [(r[0], unpack(r[1])) for r in sample.mapInArrow(run, "lang string, x binary").collect() if r[1] is not None]
    languages = sorted({g[0] for g in got})
    got.sort(key=lambda g: (g[0], g[1][1].sum(), g[1][0].tobytes()))
    x, labels = np.zeros((len(got), 1 << BITS), np.float32), np.array([languages.index(g[0]) for g in got], np.int64)
    for i, (_, (at, value)) in enumerate(got):
        x[i, at] = value
    del got
    return fit(x, labels, languages, own=True)


def identify(docs: DataFrame, model: Model, margin: float = 0.05) -> DataFrame:
    """``docs`` (any columns; text) with lang_pred, score and ambiguous; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    n = len(model.languages)
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, CHUNK, max_rows=ROWS):
            ok = has_letter(c) & bool(n)
            best, score, near = np.full(len(c), n), np.zeros(len(c)), ~ok
            if ok.any():
                p = -model.losses(features(c)) * max(model.code.shape[1], 1)
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                order = np.sort(p, axis=1)
                best = np.where(ok, p.argmax(1), n)
                score = np.where(ok, order[:, -1], 0.0)
                near = ~ok | ((order[:, -1] - (order[:, -2] if n > 1 else 0)) < margin)
            yield pa.RecordBatch.from_arrays([*c.batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(near)], names=schema.names)

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, held_out_fold: int = 2, folds: int = 4, sample_rows: int = 6000, margin: float = 0.05) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of ``docs`` (doc_id, text, lang)."""
    held = fold_number(folds) == held_out_fold
    model = learn(docs.where(~held), sample_rows)
    out = identify(docs.select("doc_id", "text"), model, margin)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
