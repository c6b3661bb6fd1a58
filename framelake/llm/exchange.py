"""Rounds of questions from buckets of documents to buckets of hashes.

The substring operators hold texts in *document buckets* (about 2 MB of whole texts each) and compare
what they find in *hash buckets*.  A round: every document bucket writes a *letter*, an array of
distinct items and what it says of each, cut up by the items' hashes; every hash bucket merges what
it is sent and judges it; answers name the sender's items by its own tags, or by their numbers in its
letter, which it then makes anew.  Texts are shuffled once; later rounds reuse that exchange.

Up to ``fan`` hash buckets are written to directly.  Beyond, *routers* stand between: one for each
``fan`` document buckets and each of ``fan`` parts of the hash buckets.  A router merges the letters of
its senders into one of its own, so a document bucket sends and a hash bucket gets about a square
root of the messages, and a passage that is everywhere is merged on the way.

Nothing is collected; every step is a plain shuffle, so a lost executor's part is recomputed.
Within a document bucket rows are put in a fixed order, so recomputed buckets are identical.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.llm.textops import U64, chunks, forget, pack, ragged, unpack

MESSAGE = "bucket int, payload binary"

Letter = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Layout:
    """How many buckets of each kind; ``fan``: most hash buckets that a document bucket writes to itself."""

    documents: int
    hashes: int
    fan: int = 256

    @staticmethod
    def of(docs: DataFrame, document_mb: float = 2.0, hash_mb: float = 8.0) -> Layout:
        """From the total length of all texts (one aggregate over the text column)."""
        total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Layout(max(least, int(total / (document_mb * 1e6)) + 1), max(least, int(total / (hash_mb * 1e6)) + 1))

    @property
    def routed(self) -> bool:
        return self.hashes > self.fan

    @property
    def width(self) -> int:
        """Of a router's column: parts of the hash buckets, and document buckets to a part's router."""
        return int(np.ceil(np.sqrt(self.hashes)))


@dataclass(frozen=True)
class Round:
    """``spread``: a letter's items as numbers that deal them.  ``merge``: of several letters (each with
    ascending items) one letter, and for every item of theirs, end to end, its number in it.
    ``judge``: of a merged letter, (item, fields...), by ascending item, any number of each.
    ``pick``: some of a letter's items.  ``write``/``read``: a letter as bytes."""

    spread: Callable[[Letter], np.ndarray]
    merge: Callable[[list[Letter]], tuple[Letter, np.ndarray]]
    judge: Callable[[Letter], Letter]
    pick: Callable[[Letter, np.ndarray], Letter] = lambda letter, at: tuple(a[at] for a in letter)
    write: Callable[[Letter], Letter] = lambda letter: letter
    read: Callable[[Letter], Letter] = lambda letter: letter


@dataclass
class Bucket:
    """The documents of one bucket in a fixed order; ``null``: those without a doc_id, behind all others."""

    ids: np.ndarray
    null: np.ndarray
    buf: np.ndarray
    offs: np.ndarray
    carried: pa.Table | None = None

    @staticmethod
    def of(payloads: list[bytes], carried: bool = False) -> Bucket:
        forget()
        parts = [unpack(p) for p in payloads]
        if not parts:
            return Bucket(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(1, np.int64))
        rest = pa.concat_tables([pa.ipc.open_stream(p[4].tobytes()).read_all() for p in parts]) if carried else None
        ids, null, lengths, buf = (np.concatenate([p[i] for p in parts]) for i in range(4))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        texts = [buf[s : s + n].tobytes() for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        order = np.array(sorted(range(len(ids)), key=lambda i: (null[i], ids[i], texts[i])), np.int64)
        del texts
        buf = buf[ragged(starts[order], lengths[order])]
        return Bucket(ids[order], null[order].astype(bool), buf, np.concatenate(([0], np.cumsum(lengths[order]))), rest and rest.take(order))

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket number, the positions that hold it."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(bucket[at[0]]), at


def messages(pairs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([p[0] for p in pairs], pa.int32()), "payload": pa.array([p[1] for p in pairs], pa.binary())})


def _stream(batch: pa.RecordBatch) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def document_buckets(docs: DataFrame, layout: Layout, carry: tuple[str, ...] = (), chunk_bytes: int = 2 << 20) -> DataFrame:
    """Texts dealt to document buckets by doc_id and text, compressed; null texts are empty.  ``carry``: columns
    to take along."""
    names = [f"__carried_{i}" for i in range(len(carry))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, chunk_bytes):
            column = c.batch.column("doc_id")
            ids, null = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)
            lengths = np.diff(c.offs)
            out = []
            for b, at in by_bucket(c.ints("bucket")):
                rest = [_stream(c.batch.select(names).take(pa.array(at)))] if names else []
                out.append((b, pack(ids[at], null[at], lengths[at], c.buf[ragged(c.offs[at], lengths[at])], *rest)))
            yield from messages(out).to_batches()

    rest = [F.col(f"`{c}`").alias(a) for c, a in zip(carry, names, strict=True)]
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(layout.documents)).cast("int").alias("bucket")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), bucket, *rest).mapInArrow(deal, MESSAGE)


def _deliver(letters: list[list[np.ndarray]], answers: Letter, origin: np.ndarray, part: int) -> list[tuple[int, bytes]]:
    """Answers about merged items as messages to the senders of the letters that were merged."""
    out, at, (item, *fields) = [], 0, answers
    for who, size, tags, *_ in letters:
        own = origin[at : at + int(size[0])]
        at += len(own)
        lo, hi = np.searchsorted(item, own), np.searchsorted(item, own, "right")
        count = hi - lo
        if count.any():
            rows = ragged(lo, count)
            names = tags if len(tags) else np.arange(len(own), dtype=np.int32)
            out.append((int(who[0]), pack(np.array([part], np.int32), np.repeat(names, count), *(f[rows] for f in fields))))
    return out


def _collect(parts: dict[int, np.ndarray], payloads: list[bytes]) -> Letter | None:
    """Answers from several parts as (number in the whole letter, fields...), by ascending number."""
    got = [unpack(p) for p in payloads]
    if not got:
        return None
    item = np.concatenate([parts[int(g[0][0])][g[1]] for g in got])
    order = np.argsort(item, kind="stable")
    return (item[order], *(np.concatenate([g[i] for g in got])[order] for i in range(2, len(got[0]))))


def consult(letters: DataFrame, r: Round, layout: Layout) -> DataFrame:
    """Answers to letters (see ``post``): messages to the document buckets."""
    width = layout.width

    def merged(table: pa.Table) -> tuple[list[list[np.ndarray]], Letter, np.ndarray]:
        got = [unpack(p) for p in sorted(table.column("payload").to_pylist())]
        letter, origin = r.merge([r.read(tuple(g[3:])) for g in got])
        return got, letter, origin

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        got, letter, origin = merged(table)
        return messages(_deliver(got, r.judge(letter), origin, key[0].as_py()))

    if not layout.routed:
        return letters.groupBy("bucket").applyInArrow(judge, MESSAGE)

    def forward(key: tuple, table: pa.Table) -> pa.Table:
        _, letter, _ = merged(table)
        return messages(_written(letter, key[0].as_py(), r, layout, False, None))

    def back(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return messages([])
        got, letter, origin = merged(left)
        parts = dict(by_bucket(_destination(letter, r, layout)))
        return messages(_deliver(got, _collect(parts, sorted(right.column("payload").to_pylist())), origin, key[0].as_py() % width))

    judged = letters.groupBy("bucket").applyInArrow(forward, MESSAGE).groupBy("bucket").applyInArrow(judge, MESSAGE)
    return letters.groupBy("bucket").cogroup(judged.groupBy("bucket")).applyInArrow(back, MESSAGE)


def _destination(letter: Letter, r: Round, layout: Layout) -> np.ndarray:
    return (r.spread(letter) % U64(layout.hashes)).astype(np.int32)


def _parts(letter: Letter, r: Round, layout: Layout, routed: bool) -> dict[int, np.ndarray]:
    to = _destination(letter, r, layout)
    return dict(by_bucket(to % layout.width if routed else to))


def _written(letter: Letter, number: int, r: Round, layout: Layout, routed: bool, tags: np.ndarray | None) -> list[tuple[int, bytes]]:
    out, row = [], number // layout.width * layout.width
    tags = np.zeros(0, np.int32) if tags is None else tags.astype(np.int32)
    for to, at in _parts(letter, r, layout, routed).items():
        out.append((row + to if routed else to, pack(np.array([number], np.int32), np.array([len(at)], np.int32), tags[at] if len(tags) else tags, *r.write(r.pick(letter, at)))))
    return out


def post(number: int, letter: Letter, r: Round, layout: Layout, tags: np.ndarray | None = None) -> pa.Table:
    """A document bucket's letter as messages.  Its items ascend as ``merge`` wants them."""
    return messages(_written(letter, number, r, layout, layout.routed, tags))


def answered(letter: Letter, answers: list[bytes], r: Round, layout: Layout) -> Letter | None:
    """What the answers say of a letter without tags, made anew: (number of the item, fields...), or None."""
    return _collect(_parts(letter, r, layout, layout.routed), sorted(answers)) if answers else None


def tagged(answers: list[bytes]) -> Letter | None:
    """What the answers say of a letter with tags: (tag, fields...) in any order, or None."""
    got = [unpack(p)[1:] for p in sorted(answers)]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else None


def send(buckets: DataFrame, step: Callable[[int, Bucket], pa.Table]) -> DataFrame:
    """Messages from document buckets alone."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return step(key[0].as_py(), Bucket.of(table.column("payload").to_pylist()))

    return buckets.groupBy("bucket").applyInArrow(run, MESSAGE)


def meet(buckets: DataFrame, answers: DataFrame, step: Callable[[int, Bucket, list[bytes]], pa.Table], schema: str | StructType, carried: bool = False) -> DataFrame:
    """Documents with the answers to their bucket.  ``carried``: the step wants the carried columns."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return step(key[0].as_py(), Bucket.of(left.column("payload").to_pylist(), carried), right.column("payload").to_pylist())

    return buckets.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)
