"""MinHash search for short texts (queries) inside long ones, verified by exact containment.

1. Queries become rows: their distinct shingles and, as they are partitioned by size, the band keys of
   their partition.  What every task needs of all of them are two bit tables, of their shingles and of
   their band keys, whose size is bounded; nothing else of the queries leaves their table.
2. Documents are read once.  Of each, only the shingles that the table may have can count; they are laid
   end to end, so that a query whose shingles are scattered over the text lies together again, once with
   all their occurrences and once with the first ones alone.  For every partition (queries of up to S
   shingles) windows of about 1.25 S of them are signed, which overlap so that any S in a row lie in one.
   A query of the partition and its window are of like size, so their Jaccard index has a floor, from
   which follow rows and number of bands so that a match collides with at least the chance asked for.
3. Documents' keys and queries' keys are joined, and each pair that meets is verified: the share of the
   query's distinct shingles that the document has.

Queries under five words have no shingle of five.  With ``short`` each is one shingle of its own
length, looked up among all the document's runs of that many words.

Texts are compared by words of letters and digits, ASCII and Latin-1 letters in lower case; words and
shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from framelake.llm.graph import cut, fresh
from framelake.llm.textops import U64, Chunk, byte_span_hashes, chunks, gram_hashes, mix, ragged, text_hash, word_spans

SHINGLE = 5
CHUNK = 2 << 20
MOST_BITS = 29  # a bit table has 2**MOST_BITS places at most; fuller tables let more through, and lose nothing
SALTS = 16

_STEP = U64(0x9E3779B97F4A7C15)


def fold(buf: np.ndarray) -> np.ndarray:
    """Letters in lower case, digits; all other ASCII bytes become spaces."""
    out = buf.copy()
    upper = (buf >= 0x41) & (buf <= 0x5A)
    out[upper] += 0x20
    digit = (buf >= 0x30) & (buf <= 0x39)
    out[(out < 0x80) & ~digit & ((out < 0x61) | (out > 0x7A))] = 0x20
    accent = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    out[1:][accent] += 0x20
    return out


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of its first (one more at the end)."""
    buf = fold(buf)
    starts, ends, first = word_spans(buf, offs)
    return byte_span_hashes(buf, starts, ends), first


@dataclass(frozen=True)
class Partition:
    """Queries of over most / 2 and up to ``most`` distinct shingles, and the windows that look for them."""

    most: int
    step: int  # shingles between windows
    span: int  # windows' shingles
    rows: int  # of a band
    bands: int

    @staticmethod
    def of(most: int, threshold: float, chance: float) -> Partition:
        least, step = most // 2 + 1, max(1, most // 4)
        span = (-(-most // step) + 1) * step if most > 1 else 1
        floor = threshold * least / (span + least - threshold * least)
        return Partition(most, step, span, *bands_for(min(floor, 1.0), chance))

    def keys(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Band keys of the sets of shingles that begin at ``starts``: a row for each."""
        out = np.zeros((len(starts), self.bands), U64) + np.arange(self.bands, dtype=U64) + U64(self.most << 32)
        for i in range(self.rows * self.bands):
            odd, add = mix(np.array([2 * i + 1, 2 * i + 2], U64) * _STEP)
            least = np.minimum.reduceat(values * (odd | U64(1)) + add, starts) if len(starts) else np.zeros(0, U64)
            out[:, i % self.bands] = mix(out[:, i % self.bands] * _STEP + least)
        return out


def bands_for(floor: float, chance: float) -> tuple[int, int]:
    """Rows and number of bands by which sets of Jaccard index ``floor`` collide with at least ``chance``: as
    many rows as 64 hashes allow, one row and as many bands as it takes where they allow none."""
    if not 0 < floor <= 1 or not 0 < chance < 1:
        raise ValueError("threshold and chance must be over 0, chance under 1")
    needed = [1 if floor == 1 else int(np.ceil(np.log1p(-chance) / np.log1p(-(floor**r)))) for r in range(1, 9)]
    rows = max((r for r, n in enumerate(needed, 1) if r * n <= 64), default=1)
    return rows, needed[rows - 1]


def size_class(n: int) -> int:
    """The partition's ``most`` for a query of n shingles."""
    return 1 << max(0, int(n) - 1).bit_length()


def _prepare(queries: DataFrame, threshold: float, chance: float, short: bool) -> DataFrame:
    """(qid, query_id, part, n_query, grams, keys): ``part`` is the partition, or minus the words of a short query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, CHUNK):
            hashes, first = words(c.buf, c.offs)
            grams, _, run = gram_hashes(hashes, first, SHINGLE, short)
            length, parts, own, keys = np.diff(first), [], [], []
            for i, (a, b) in enumerate(zip(run[:-1], run[1:], strict=True)):
                own.append(np.unique(grams[a:b]))
                if not len(own[i]):
                    parts.append(0)
                    keys.append(own[i])
                elif length[i] < SHINGLE:
                    parts.append(-int(length[i]))
                    keys.append(own[i])
                else:
                    parts.append(size_class(len(own[i])))
                    keys.append(Partition.of(parts[i], threshold, chance).keys(own[i], np.zeros(1, np.int64))[0])
            lists = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (own, keys)]
            yield pa.RecordBatch.from_arrays([c.batch.column("query_id"), pa.array(parts, pa.int32()), pa.array([len(x) for x in own], pa.int64()), *lists], names=["query_id", "part", "n_query", "grams", "keys"])

    made = queries.select(F.col("query_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "query_id long, part int, n_query long, grams array<long>, keys array<long>")
    return cut(made.where("part <> 0").withColumn("qid", F.monotonically_increasing_id()))


def bit_table(values: DataFrame, count: int) -> np.ndarray:
    """Which places of a table some value falls on, a bit for each, for values in a column of arrays.  Every task
    sends its own table of the same bounded size, and they are joined by or, some at a time."""
    bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(count + 1))) + 4))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[place(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(U64), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], names=["bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for one in batch.column(0):
                table |= np.frombuffer(one.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["bits"])

    tables = values.mapInArrow(mark, "bits binary").coalesce(16).mapInArrow(join, "bits binary").coalesce(1).mapInArrow(join, "bits binary")
    return np.frombuffer(tables.first()["bits"], np.uint8)


def place(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values) >> U64(64 - bits)).astype(np.int64)


def known(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the table may have each value."""
    at = place(values, (8 * len(table)).bit_length() - 1)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _first_of_each(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where each distinct pair stands first, by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return order[new]


@dataclass(frozen=True)
class Search:
    """What a task needs to know of all queries."""

    partitions: list[Partition]
    short: list[int]  # words of short queries
    grams: np.ndarray  # bit tables
    keys: np.ndarray

    def document(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk's texts: (text's number, shingle) that queries may have, (text's number, key) likewise."""
        hashes, first = words(c.buf, c.offs)
        grams, _, run = gram_hashes(hashes, first, SHINGLE)
        hit = np.flatnonzero(known(grams, self.grams))
        row, value = np.searchsorted(run, hit, "right") - 1, grams[hit]
        rows, keys = [], []
        for n in self.short:
            runs, _, cuts = gram_hashes(hashes, first, n)
            may = np.flatnonzero(known(runs, self.keys))
            rows.append(np.searchsorted(cuts, may, "right") - 1)
            keys.append(runs[may])
        short_rows, short_keys = np.concatenate([*rows, row[:0]]), np.concatenate([*keys, value[:0]])
        once = np.sort(_first_of_each(row, value))
        for at in (np.arange(len(row)), once):
            for p in self.partitions:
                for r, k in self._windows(p, row[at], value[at]):
                    rows.append(r)
                    keys.append(k)
        key_rows, keys = np.concatenate([*rows, row[:0]]), np.concatenate([*keys, value[:0]])
        some = _first_of_each(key_rows, keys)
        return np.concatenate([row[once], short_rows]), np.concatenate([value[once], short_keys]), key_rows[some], keys[some]

    def _windows(self, p: Partition, row: np.ndarray, value: np.ndarray, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text's number, key) of a partition's windows over shingles laid end to end, some windows at a time."""
        texts, begins = np.unique(row, return_index=True)
        ends = np.append(begins[1:], len(row))
        # the last window of a text is its first that reaches the end
        many = np.maximum(-(-(ends - begins - p.span) // p.step), 0) + 1
        text = np.repeat(np.arange(len(texts)), many)
        start = ragged(np.zeros(len(texts), np.int64), many) * p.step + begins[text]
        size = np.minimum(start + p.span, ends[text]) - start
        for at in range(0, len(start), max(1, block // p.span)):
            to = at + max(1, block // p.span)
            some = size[at:to]
            keys = p.keys(value[ragged(start[at:to], some)], np.cumsum(some) - some)
            good = known(keys.ravel(), self.keys)
            yield np.repeat(texts[text[at:to]], p.bands)[good], keys.ravel()[good]


def _find(docs: DataFrame, search: Broadcast) -> DataFrame:
    """(uid, other columns, hits, keys) of the rows of ``docs`` (text, others) that have a key of some query."""
    names = [c for c in docs.columns if c != "text"]
    schema = StructType([docs.schema[c] for c in names]).add("hits", ArrayType(LongType())).add("keys", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        for c in chunks(batches, CHUNK):
            row, gram, key_row, key = s.document(c)
            have = np.unique(key_row)
            if len(have):
                order = np.argsort(row, kind="stable")
                row, gram = row[order], gram[order]
                lists = []
                for of, values in ((row, gram), (key_row, key)):
                    lo, hi = np.searchsorted(of, have), np.searchsorted(of, have, "right")
                    cuts = np.concatenate(([0], np.cumsum(hi - lo)))
                    lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values[ragged(lo, hi - lo)].view(np.int64))))
                taken = [c.batch.column(n).take(pa.array(have)) for n in names]
                yield pa.RecordBatch.from_arrays([*taken, *lists], names=[*names, "hits", "keys"])

    return cut(docs.select(*names, "text").mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()))


def matches(docs: DataFrame, queries: DataFrame, threshold: float = 0.8, chance: float = 0.9999, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified matches (uid, qid, query_id, n_query, n_shared, containment, shared) of ``queries`` (query_id, text) in
    ``docs`` (any columns but these; text), and documents' rows with a match or almost one: (uid, their columns)."""
    asked = _prepare(queries, threshold, chance, short)
    parts = asked.groupBy("part").agg(F.sum("n_query").alias("grams"), F.sum(F.size("keys")).alias("keys")).collect()  # one row for each power of two
    tables = [bit_table(asked.select(c), sum(r[c] for r in parts)) for c in ("grams", "keys")]
    search = Search([Partition.of(r["part"], threshold, chance) for r in sorted(parts) if r["part"] > 0], sorted(-r["part"] for r in parts if r["part"] < 0), *tables)
    found = _find(docs, docs.sparkSession.sparkContext.broadcast(search))
    # a query that a third of all documents hold has as many rows on one side of this join; it is salted
    salt = F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")
    doc_keys = found.select("uid", salt.alias("salt"), F.explode("keys").alias("key"))
    query_keys = asked.select("qid", F.explode("keys").alias("key")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = doc_keys.join(query_keys, ["key", "salt"]).select("uid", "qid").distinct()
    pairs = pairs.join(found.select("uid", "hits"), "uid").withColumn("salt", salt)
    wanted = asked.select("qid", "query_id", "n_query", "grams").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = pairs.join(wanted, ["qid", "salt"]).withColumn("shared", F.array_intersect("grams", "hits")).withColumn("n_shared", F.size("shared").cast("long"))
    good = pairs.where(F.col("n_shared") >= threshold * F.col("n_query") - 1e-9)
    return good.select("uid", "qid", "query_id", "n_query", "n_shared", (F.col("n_shared") / F.col("n_query")).alias("containment"), "shared"), found.drop("hits", "keys")


def contained(docs: DataFrame, queries: DataFrame, threshold: float = 0.8, chance: float = 0.9999, short: bool = False) -> DataFrame:
    """(doc_id, query_id, n_query, n_shared, containment) of ``queries`` (query_id, text) in ``docs`` (doc_id, text):
    one row per pair of rows.  ``short``: queries under five words are looked for, too."""
    found, rows = matches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), queries, threshold, chance, short)
    return found.join(rows, "uid").select("doc_id", "query_id", "n_query", "n_shared", "containment")


FEW = 100_000  # rows of under 100 bytes that are sent to all tasks


def without(docs: DataFrame, queries: DataFrame, threshold: float = 0.8, chance: float = 0.9999, few: int = FEW) -> DataFrame:
    """``docs`` (any columns; doc_id, text) without the rows that hold one of ``queries`` (query_id, text).  Rows are
    told by doc_id and the text's SHA-256.  Up to ``few`` rows with a match are broadcast, and rows then
    filtered where they lie; more are joined."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"), F.col("text").cast("string"))
    found, rows = matches(keyed, queries, threshold, chance)
    bad = cut(rows.join(found.select("uid").distinct(), "uid", "left_semi").select("id", "hash").distinct())
    if bad.limit(few + 1).count() <= few:
        bad = F.broadcast(bad)
    key, digest = fresh(docs, "key"), fresh(docs, "digest")
    told = docs.withColumns({key: F.col("doc_id").cast("long"), digest: text_hash()})
    return told.join(bad, F.col(key).eqNullSafe(bad.id) & (F.col(digest) == bad.hash), "left_anti").drop(key, digest)
