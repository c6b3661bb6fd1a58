"""Toxicity scores by a classifier that is regularised by counterfactuals.

Features: how often a text has a word (case folded, letters only), or a word with a certain prefix,
and its length.  The model is a logistic regression over those whose presence tells the labels
apart best.

For every labelled text of the sample that mentions an identity term, texts with all of that term's
mentions swapped for each other term of its group are made and turned into features like any text.
What the swap does to the text's score, in log odds (so that sure scores are held like others), is squared,
averaged over the text's swaps and over all texts with swaps, and penalised.  So no group's mere mention
moves the score, while labels still speak for words that matter.

Fitting uses at most ``sample_rows`` labelled rows (a documented bound); scoring reads every
whole text and nothing else of a row.

Results: null and empty texts get the score of a text without known words.  No labelled rows:
score 0 for all.  A doc_id with several labels counts once with each; of several texts of a labelled doc_id
one, by hash, is learned from; labels without a doc_id are not.  Repeated rows are each scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.llm.linear import bounded_sample, fold_case, fold_number, sigmoid
from framelake.llm.textops import U64, Chunk, byte_span_hashes, chunks, pack, unpack, word_spans

CHUNK = 2 << 20

# Groups of terms that may stand for one another; a parameter of ``learn``.
IDENTITY_GROUPS = (
    ("he", "she"),
    ("him", "her"),
    ("er", "sie"),
    ("il", "elle"),
    ("él", "ella"),
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("blind", "deaf", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos"),
)


PREFIXES = range(4, 10)  # bytes; the stems that inflected and compound words share


def features(c: Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, feature, log count) of every distinct feature of every text, and each text's
    log number of words.  Features: words, and prefixes of longer words.  ``wanted``: keep these only."""
    buf = fold_case(c.buf)
    starts, ends, first = word_spans(buf, c.offs)
    row = np.repeat(np.arange(len(c)), np.diff(first))
    spans, rows, kinds = [(starts, ends)], [row], [np.zeros(len(row), U64)]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        spans.append((starts[long], starts[long] + k))
        rows.append(row[long])
        kinds.append(np.ones(len(long), U64))
    code = byte_span_hashes(buf, np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans]))
    code ^= np.concatenate(kinds) * U64(0x5851F42D4C957F2D)
    row = np.concatenate(rows)
    if wanted is not None:
        table = np.zeros(1 << 22, bool)  # most features are none that is wanted
        table[wanted >> U64(42)] = True
        may = np.flatnonzero(table[code >> U64(42)])
        may = may[np.isin(code[may], wanted)]
        row, code = row[may], code[may]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[at], code[at], np.log1p(np.diff(np.append(at, len(row)))), np.log1p(np.diff(first))


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray  # features, ascending
    weights: np.ndarray
    by_length: float
    bias: float

    def score(self, row: np.ndarray, code: np.ndarray, value: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of texts whose features are all in the vocabulary."""
        at = np.searchsorted(self.vocabulary, code)
        return sigmoid(np.bincount(row, self.weights[at] * value, len(length)) + self.by_length * length + self.bias)


def term_features(term: str) -> np.ndarray:
    """All features that a term's mention gives a text: its word and the word's prefixes."""
    data = np.frombuffer(term.encode(), np.uint8)
    return features(Chunk(None, data, np.array([0, len(data)])))[1]


def swapped(text: str, groups: tuple[tuple[str, ...], ...]) -> list[str]:
    """The text with all mentions of each identity term in it swapped for each other term of its group."""
    out = []
    for group in groups:
        for term in group:
            mention = _mention(term)
            if mention.search(text):
                out += [mention.sub(other, text) for other in group if other != term]
    return out


@lru_cache(maxsize=4096)
def _mention(term: str) -> re.Pattern:
    return re.compile(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", re.IGNORECASE)


def changes(text: str, groups: tuple[tuple[str, ...], ...], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What swaps change in a text's features: (number of the swap, feature, difference)."""
    swap, code, value = [], [], []
    others = swapped(text, groups)
    for number, other in enumerate(others):
        data = [x.encode() for x in (text, other)]
        row, codes, values, _ = features(Chunk(None, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])), wanted)
        both, at = np.unique(codes, return_inverse=True)
        change = np.bincount(at, np.where(row == 1, values, -values), len(both))
        some = np.flatnonzero(np.abs(change) > 1e-12)
        swap.append(np.full(len(some), number))
        code.append(both[some])
        value.append(change[some])
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return join(swap, np.int64), join(code, U64), join(value, np.float32)


@dataclass(frozen=True)
class Swaps:
    """Of all swapped texts: the weight of each, and what it changes (its number, feature, difference)."""

    share: np.ndarray
    row: np.ndarray
    code: np.ndarray
    value: np.ndarray


NO_SWAPS = Swaps(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.float32))


def fit(x: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray, swaps: Swaps = NO_SWAPS, strength: float = 10.0, decay: float = 1e-5, rounds: int = 500, odds: float | None = None) -> Model:
    """``x``: features of all texts (see ``features``).  ``strength``: weight of the counterfactual
    penalty (0: none).  ``odds``: of label 1 among all labelled rows, where the sample's differ."""
    row, code, value, length = x
    n = len(labels)
    if not n or labels.min() == labels.max():
        return Model(np.zeros(0, U64), np.zeros(0), 0.0, 50.0 if n and labels.any() else -50.0)
    vocabulary, at = np.unique(np.concatenate((code, swaps.code)), return_inverse=True)
    at, swap_at = at[: len(code)], at[len(code) :]
    rate = labels.mean()
    base = np.log(rate / (1 - rate))
    k = len(vocabulary)
    w = np.zeros(k + 2)  # features, length, bias
    w[k + 1] = base
    m, v = np.zeros_like(w), np.zeros_like(w)
    middle = length.mean()
    for step in range(1, rounds + 1):  # Adam on full gradients
        error = sigmoid(np.bincount(row, w[at] * value, n) + w[k] * (length - middle) + w[k + 1]) - labels
        g = np.concatenate((np.bincount(at, error[row] * value, k) / n, [(error * (length - middle)).mean(), error.mean()]))
        g[:k] += decay * w[:k]
        if strength and len(swaps.share):
            change = np.bincount(swaps.row, w[swap_at] * swaps.value, len(swaps.share))
            g[:k] += np.bincount(swap_at, (2 * strength * swaps.share * change)[swaps.row] * swaps.value, k)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
    shift = np.log(odds) - base if odds else 0.0
    return Model(vocabulary, w[:k], float(w[k]), float(w[k + 1] - w[k] * middle + shift))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, vocabulary: int = 20_000, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, **fitting) -> Model:
    """A model of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic), from at most about ``sample_rows`` labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") != 0).cast("int").alias("toxic")).distinct()
    sample, _, counts = bounded_sample(known, "toxic", sample_rows // 2)
    sample = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by sample_rows
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, CHUNK):
            row, code, _, _ = features(c)
            toxic = c.ints("toxic")[row]
            feature, at = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(np.bincount(at, minlength=len(feature))), pa.array(np.bincount(at, toxic, len(feature)).astype(np.int64))], names=["feature", "seen", "toxic"])

    rate = counts.get(1, 0) and min(counts[1], sample_rows // 2) / sum(min(n, sample_rows // 2) for n in counts.values())
    totals = sample.mapInArrow(count, "feature long, seen long, toxic long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    lift = F.abs(F.col("toxic") - rate * F.col("seen")) / F.sqrt(F.col("seen") * (rate * (1 - rate)) + 1)
    # terms that the sample hardly has get no weight, so swaps for them pull a term's own weight to nothing
    terms = np.unique(np.concatenate([np.zeros(0, U64), *(term_features(t) for g in groups for t in g)])).view(np.int64).tolist()
    lift = F.when(F.col("feature").isin(terms), 1e9).otherwise(lift)
    best = totals.where(F.col("seen") >= 3).withColumn("lift", lift).where("lift > 2").orderBy(F.desc("lift"), "feature").limit(vocabulary)
    wanted = np.sort(np.array([r[0] for r in best.select("feature").collect()], np.int64).view(U64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, CHUNK):
            row, code, value, length = features(c, wanted)
            cuts = np.searchsorted(row, np.arange(len(c) + 1))
            packed = [pack(code[a:b], value[a:b].astype(np.float32), *changes(c.buf[s:e].tobytes().decode("utf-8", "replace"), groups, wanted)) for a, b, s, e in zip(cuts[:-1], cuts[1:], c.offs[:-1], c.offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.batch.column("toxic"), pa.array(length), pa.array(packed, pa.binary())], names=["toxic", "length", "x"])

    got = [(r[0], r[1], *unpack(r[2])) for r in sample.mapInArrow(vectors, "toxic int, length double, x binary").collect()]
    got.sort(key=lambda g: (g[0], g[1], *(a.tobytes() for a in g[2:])))
    sizes = [len(g[2]) for g in got]
    join = lambda i, kind: np.concatenate([g[i] for g in got]) if got else np.zeros(0, kind)
    x = np.repeat(np.arange(len(got)), sizes), join(2, U64), join(3, np.float32), np.array([g[1] for g in got])
    many = np.array([g[4].max() + 1 if len(g[4]) else 0 for g in got], np.int64)  # swaps of each text
    first = np.cumsum(many) - many
    share = np.repeat(1 / np.maximum(many, 1), many) / max((many > 0).sum(), 1)
    swaps = Swaps(share, join(4, np.int64) + np.repeat(first, [len(g[4]) for g in got]).astype(np.int64), join(5, U64), join(6, np.float32))
    return fit(x, np.array([g[0] for g in got], np.int64), swaps, odds=counts[1] / counts[0] if len(counts) == 2 else None, **fitting)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns; text) with score and predicted; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    schema = StructType(docs.schema.fields[:]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, CHUNK):
            s = model.score(*features(c, model.vocabulary))
            yield pa.RecordBatch.from_arrays([*c.batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5, sample_rows: int = 8_000, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); ``labels``: doc_id, toxic."""
    held = fold_number(folds) == held_out_fold
    marks = labels.where(~held).select("doc_id", "toxic")
    model = learn(docs.where(~held), marks, sample_rows, **fitting)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
