"""Near-duplicate classes by ProbMinHash.

A text is a weighted set: its shingles of five words (one shingle if it has fewer words), each
weighted by how often it occurs.  Likeness is the probability Jaccard index, which ignores the
texts' lengths: the chance that two signatures agree in a slot.

1. Signature: every shingle is a Poisson process whose rate is its weight; each arrival falls in
   a random slot, and a slot keeps the shingle of its earliest arrival.  A process ends as soon as
   its next arrival is later than the latest slot of its text.
2. Banding: 24 bands of 5 slots; a pair of likeness 0.8 shares a band with chance 0.9999.  Exact
   copies are merged before, by SHA-256.  Every member of a band is tied to the band's
   least member only, and connected components of these ties are the candidate groups.
3. Verification: inside a candidate group links are exact.  With M the sum of the smaller
   normalised weights, M / (2 - M) <= likeness <= M; only in between is the index worked out.
   Documents compare themselves to all of their group, those of small classes first, until all that
   have not done so are in one class: from then on no link can join two classes.

Groups over ``block`` documents are dealt to blocks, each a task of its own.  Their largest classes meet
through ``ambassadors`` of each, 32 blocks at a time, then 32 of these, and so on.  Documents outside a
block's largest class visit those blocks of the group that have a document with a band of theirs; if
largest classes are still apart, the members of all but one class's do the same.  Visitors come in slices
of their own, so no task holds more than a block and a slice, whatever a group's size.

Results: texts without words are alike only if equal. Null text: empty. Null doc_id: the largest
id (after all others). Rows that share a doc_id (or have none) but not a text are documents of their own; a class is named
by doc_id and text. Empty tables give no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.containment import bit_table, known
from framelake.llm.graph import components, cut, fresh
from framelake.llm.textops import U64, chunks, gram_hashes, group_starts, mix, ragged, text_bytes, text_hash, word_hashes

SHINGLE = 5
BANDS, ROWS = 24, 5
CHUNK = 2 << 20
SALTS = 16


def weighted_shingles(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, shingle, weight), sorted by text and shingle."""
    words, first = word_hashes(buf, offs)
    grams, _, run = gram_hashes(words, first, size, short=True)
    row = np.repeat(np.arange(len(run) - 1), np.diff(run))
    keys = np.sort((row.astype(U64) << U64(48)) | (grams >> U64(16)))
    at = group_starts(keys)
    return (keys[at] >> U64(48)).astype(np.int64), keys[at] & U64((1 << 48) - 1), np.diff(np.append(at, len(keys))).astype(float)


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """The ProbMinHash of every text: for each slot the shingle that arrived first (0: none)."""
    when = np.full(rows * slots, np.inf)
    who = np.zeros(rows * slots, U64)
    clock, drawn, rest = np.zeros(len(row)), 0, np.arange(len(row))
    while len(rest):
        draws = int(min(64, max(1, 200_000 // len(rest))))
        number = (drawn + np.arange(1, draws + 1)).astype(U64)
        dice = mix(shingle[rest][:, None] * U64(0x9E3779B97F4A7C15) + number * U64(0xBF58476D1CE4E5B9))
        wait = -np.log(((dice >> U64(11)).astype(float) + 0.5) / (1 << 53)) / weight[rest][:, None]
        arrive = clock[rest][:, None] + np.cumsum(wait, axis=1)
        slot = row[rest][:, None] * slots + (mix(dice) % U64(slots)).astype(np.int64)
        slot, times = slot.ravel(), arrive.ravel()
        useful = np.flatnonzero(times < when[slot])
        slot, times = slot[useful], times[useful]
        np.minimum.at(when, slot, times)
        won = times == when[slot]
        who[slot[won]] = shingle[rest][useful[won] // draws]
        clock[rest] = arrive[:, -1]
        drawn += draws
        latest = when.reshape(rows, slots).max(1)
        rest = rest[clock[rest] < latest[row[rest]]]
    return who.reshape(rows, slots)


def band_hashes(sign: np.ndarray, bands: int, width: int) -> np.ndarray:
    out = np.zeros((len(sign), bands), U64) + np.arange(bands, dtype=U64)
    for j in range(width):
        out = mix(out * U64(0x9E3779B97F4A7C15) + sign[:, j::width][:, :bands])
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard index of two weight vectors over the same shingles, in n log n."""
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(x > 0, y / np.where(x > 0, x, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    low = np.cumsum(x)  # where y/x is no greater, x's share counts
    high = y.sum() - np.cumsum(y)
    last = np.searchsorted(ratio, ratio[both], "right") - 1
    return float((1 / (low[last] / x[both] + high[last] / y[both])).sum())


class Group:
    """The documents of a block: exact links and the classes they make."""

    def __init__(self, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, threshold: float) -> None:
        self.n, self.threshold = n, threshold
        total = np.bincount(row, weight, n)
        self.weight = weight / total[row]
        self.cut = np.searchsorted(row, np.arange(n + 1))
        order = np.argsort(shingle, kind="stable")
        starts = group_starts(shingle[order])
        size = np.diff(np.append(starts, len(order)))
        self.item = np.empty(len(order), np.int64)  # each entry's shingle
        self.item[order] = np.repeat(np.arange(len(starts)), size)
        self.starts, self.size = starts, size
        self.doc, self.by_item = row[order], self.weight[order]

    def links(self, i: int) -> np.ndarray:
        """All documents at least as like i as the threshold."""
        mine = slice(self.cut[i], self.cut[i + 1])
        items, own = self.item[mine], self.weight[mine]
        at = ragged(self.starts[items], self.size[items])
        least = np.bincount(self.doc[at], np.minimum(self.by_item[at], np.repeat(own, self.size[items])), self.n)
        sure, open_ = least / (2 - least) >= self.threshold, np.flatnonzero(least >= self.threshold - 1e-9)
        out = [j for j in open_ if j != i and (sure[j] or self.exact(i, int(j)) >= self.threshold - 1e-9)]
        return np.array(out, np.int64)

    def exact(self, i: int, j: int) -> float:
        a, b = slice(self.cut[i], self.cut[i + 1]), slice(self.cut[j], self.cut[j + 1])
        items = np.union1d(self.item[a], self.item[b])
        x, y = np.zeros(len(items)), np.zeros(len(items))
        x[np.searchsorted(items, self.item[a])] = self.weight[a]
        y[np.searchsorted(items, self.item[b])] = self.weight[b]
        return likeness(x, y)

    def classes(self, known: np.ndarray | None = None, guest: np.ndarray | None = None) -> np.ndarray:
        """For every document a class number; stops when no link can join two classes any more.

        ``known``: classes that are known to begin with; ``guest``: who need compare themselves, the links
        of all others among themselves being in these classes."""
        label = np.arange(self.n) if known is None else np.unique(known, return_inverse=True)[1]
        waiting = np.ones(self.n, bool) if guest is None else guest.copy()
        unsure = waiting.copy() if guest is None else np.ones(self.n, bool)  # whose links are not all known
        size = np.bincount(label, minlength=self.n)
        members: dict[int, list[int]] = {}
        for i, c in enumerate(label.tolist()):
            members.setdefault(c, []).append(i)
        while True:
            open_ = np.flatnonzero(waiting)
            if not len(open_) or (label[unsure] == label[open_[0]]).all():
                return label
            i = int(open_[np.argmin(size[label[open_]])])
            waiting[i] = unsure[i] = False
            found = self.links(i)
            for j in found[np.unique(label[found], return_index=True)[1]]:  # one of each class, whatever it is called by now
                a, b = int(label[i]), int(label[j])
                if a == b:
                    continue
                if size[a] < size[b]:
                    a, b = b, a
                label[members[b]] = a
                members[a] += members.pop(b)
                size[a] += size[b]


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in order and weighted shingles of a group's texts, a chunk at a time; each once."""
    table = table.sort_by([("text_id", "ascending"), ("text", "ascending")])
    ids = table.column("text_id").to_numpy()
    parts, at = [], 0
    for c in chunks(iter(table.select(["text_id", "text"]).to_batches()), CHUNK):
        r, s, w = weighted_shingles(c.buf, c.offs)
        parts.append((r + at, s, w))
        at += len(c)
    row, shingle, weight = (np.concatenate([p[i] for p in parts]) for i in range(3))
    first = np.concatenate(([True], ids[1:] != ids[:-1]))  # repeated rows count once
    keep = first[row]
    number = np.cumsum(first) - 1
    return ids[first], number[row[keep]], shingle[keep], weight[keep]


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, block: int = 512, ambassadors: int = 8) -> DataFrame:
    """(doc_id, class_id, class_text) for every row of ``docs`` (doc_id, text): the least doc_id of its
    class, and the hash of the text that has it there (the least such hash).  The two together name a class."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash().alias("hash"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, CHUNK):
            row, shingle, weight = weighted_shingles(c.buf, c.offs)
            codes = band_hashes(signatures(row, shingle, weight, len(c), bands * rows), bands, rows).view(np.int64)
            filled = np.bincount(row, minlength=len(c)) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(filled * bands))), pa.int32()), pa.array(codes[filled].ravel()))
            yield pa.RecordBatch.from_arrays([c.batch.column("doc_id"), c.batch.column("hash"), lists], names=["doc_id", "hash", "bands"])

    signed = cut(docs.mapInArrow(sign, "doc_id long, hash binary, bands array<long>"))
    # every distinct text has a number, in the order of its least doc_id and its hash
    by_age = F.col("rep").asc_nulls_last(), F.col("hash")
    copies = signed.groupBy("hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copies = cut(copies.repartitionByRange(*by_age).sortWithinPartitions(*by_age).withColumn("text_id", F.monotonically_increasing_id()))
    reps = copies.select("rep", F.col("hash").alias("rep_hash"), "text_id")
    first = (F.col("hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    slots = signed.join(reps, first).select("text_id", F.explode("bands").alias("band"))  # of each distinct text
    leads = slots.groupBy("band").agg(F.min("text_id").alias("lead"), F.max("text_id").alias("last")).where("lead <> last").select("band", "lead")
    ties = slots.join(leads, "band").where("text_id <> lead").select(F.col("text_id").alias("a"), F.col("lead").alias("b")).distinct()
    groups = cut(_groups(ties))
    sizes = groups.groupBy("grp").count().where(F.col("count") > block).select("grp", F.ceil(F.col("count") / block).alias("blocks"))
    placed = groups.join(sizes, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
    large = sizes.limit(1).count() > 0
    members = cut(placed.join(reps, "text_id").select("grp", "blk", "text_id", "rep", "rep_hash"))
    texts = _perhaps(docs, members).join(members, first).select("grp", "blk", "text_id", "text")
    if large:
        texts = cut(texts)

    def classes(key: tuple, table: pa.Table) -> pa.Table:
        ids, row, shingle, weight = _load(table)
        label = Group(row, shingle, weight, len(ids), threshold).classes()
        order = np.lexsort((ids, label))
        least = ids[order][group_starts(label[order])]
        _, number, count = np.unique(label, return_inverse=True, return_counts=True)
        main = number == np.argmax(count)
        return pa.table({"grp": pa.array(np.full(len(ids), key[0].as_py())), "blk": pa.array(np.full(len(ids), key[1].as_py()), pa.int32()), "text_id": ids, "class": least[number], "main": main})

    linked = texts.groupBy("grp", "blk").applyInArrow(classes, "grp long, blk int, text_id long, class long, main boolean")
    if large:
        linked = _across(cut(linked), texts, signed, reps, sizes, threshold, ambassadors)
    # classes' names and copies' classes are found by salted keys, as one class or text may have any number of them
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit("salt")), F.lit(SALTS)).cast("int")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    found = cut(linked.select("text_id", "class"))
    names = found.select("class").distinct().join(copies.withColumnRenamed("text_id", "class"), "class").select("class", F.col("rep").alias("class_id"), F.col("hash").alias("class_text"), F.explode(salts).alias("salt"))
    named = found.withColumn("salt", salt("text_id")).join(names, ["class", "salt"]).select("text_id", "class_id", "class_text")
    whole = copies.join(named, "text_id", "left").select(
        "hash", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("class_text", "hash").alias("class_text"),
        F.explode(F.when(F.col("n") > 1, salts).otherwise(F.array(salt("rep")))).alias("salt"),
    )
    whole = signed.select("doc_id", "hash", salt("doc_id").alias("salt")).join(whole, ["hash", "salt"])
    return whole.select("doc_id", "class_id", "class_text")


def _perhaps(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` without nearly all rows that are no group's members, so that their texts are not shuffled: every task
    knows the members' keys by a bit table, which loses none."""
    n = members.count()
    if not n:
        return docs
    table = docs.sparkSession.sparkContext.broadcast(bit_table(members.select(F.array(F.xxhash64("rep_hash", "rep"))), n))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(3).to_numpy(zero_copy_only=False).view(U64)
            yield batch.select([0, 1, 2]).filter(pa.array(known(keys, table.value)))

    return docs.select("doc_id", "text", "hash", F.xxhash64("hash", "doc_id")).mapInArrow(some, docs.schema)


def _groups(ties: DataFrame) -> DataFrame:
    """(text_id, grp) from ties (a, b) of texts to the least members of their bands.

    A document has at most one tie per band.  It follows the least of its leads; that this lead goes
    with its others is said once for all documents alike, so the graph to settle is that of leads.
    """
    followed = cut(ties.groupBy("a").agg(F.min("b").alias("lead"), F.collect_set("b").alias("leads")))
    leads = followed.select(F.explode("leads").alias("b")).distinct()
    own = followed.select("a", "lead").join(leads, F.col("a") == F.col("b"), "left_semi")
    between = followed.select(F.col("lead").alias("a"), F.explode("leads").alias("b")).where("a <> b").union(own).distinct()
    settled = components(between)
    nodes = followed.select(F.col("a").alias("text_id"), "lead").union(leads.join(followed, leads.b == followed.a, "left_anti").select("b", "b"))
    return nodes.join(settled, F.col("lead") == F.col("node"), "left").select("text_id", F.coalesce("label", "lead").alias("grp"))


FAN = 32  # blocks whose ambassadors meet in one task
SLICE = 4096  # visitors that come together


def _across(linked: DataFrame, texts: DataFrame, signed: DataFrame, reps: DataFrame, sizes: DataFrame, threshold: float, ambassadors: int) -> DataFrame:
    """Classes of groups that lie in several blocks, joined where a link crosses blocks."""
    split = cut(linked.join(sizes, "grp"))
    # texts and bands of these groups alone
    texts = texts.join(sizes.select("grp"), "grp", "left_semi")
    first = (F.col("hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    members = split.select("grp", "blk", "text_id").join(reps, "text_id")
    banded = cut(signed.join(members, first).select("grp", "blk", "text_id", "bands"))
    outside = _visit(split.where(~F.col("main")), split, texts, banded, threshold)
    edges = cut(_assemble(split, texts, threshold, ambassadors).union(outside))
    joined = components(edges).select(F.col("node").alias("class"), F.col("label").alias("to"))
    # largest classes that are still apart: members of all but the least class visit as well
    mains = split.where("main").select("grp", "blk", "class").distinct()
    top = mains.join(joined, "class", "left").withColumn("now", F.coalesce("to", "class"))
    apart = cut(top.withColumn("least", F.min("now").over(Window.partitionBy("grp"))).where("now <> least").select("grp", "blk", "class").distinct())
    if apart.limit(1).count():
        more = _visit(split.where("main").join(apart, ["grp", "blk", "class"], "left_semi"), split, texts, banded, threshold)
        joined = components(edges.union(more)).select(F.col("node").alias("class"), F.col("label").alias("to"))
    return linked.join(joined, "class", "left").select("text_id", F.coalesce("to", "class").alias("class"))


def _merged(ids: np.ndarray, old: np.ndarray, new: np.ndarray) -> pa.Table:
    """(a, b) for every old class that is in one new class with another."""
    order = np.argsort(new, kind="stable")
    starts = group_starts(new[order])
    head = np.repeat(old[order[starts]], np.diff(np.append(starts, len(order))))
    pairs = np.unique(np.stack([old[order], head], 1)[old[order] != head], axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _known(table: pa.Table, ids: np.ndarray, column: str) -> np.ndarray:
    at = table.column("text_id").to_numpy()
    order = np.argsort(at, kind="stable")
    return table.column(column).to_numpy()[order[np.searchsorted(at, ids, sorter=order)]]


def _assemble(split: DataFrame, texts: DataFrame, threshold: float, ambassadors: int) -> DataFrame:
    """(a, b): largest classes of blocks that are one, by some members of each, FAN blocks at a time."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        ids, row, shingle, weight = _load(table)
        old = _known(table, ids, "class")
        new = Group(row, shingle, weight, len(ids), threshold).classes(old)
        return _merged(ids, old, new)

    most = split.agg(F.max("blocks")).first()[0] or 0
    by = Window.partitionBy("grp", "unit").orderBy(F.xxhash64("text_id", F.lit("ambassador")), "text_id")
    few = split.where("main").select("grp", F.col("blk").alias("unit"), "text_id", "class")
    edges = None
    while most > 1:
        few = few.withColumn("r", F.row_number().over(by)).where(F.col("r") <= ambassadors).drop("r")
        few = cut(few.join(texts.select("grp", "text_id", "text"), ["grp", "text_id"]).withColumn("unit", F.floor(F.col("unit") / FAN).cast("int")) if edges is None else few.withColumn("unit", F.floor(F.col("unit") / FAN).cast("int")))
        found = few.select("grp", "unit", "text_id", "text", "class").groupBy("grp", "unit").applyInArrow(meet, "a long, b long")
        edges = found if edges is None else edges.union(found)
        most = -(-most // FAN)
    return edges


def _visit(visitors: DataFrame, split: DataFrame, texts: DataFrame, banded: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes that are one by links between visitors and the blocks of their group that they visit."""

    def bands_of(key: tuple, table: pa.Table) -> pa.Table:
        bands = pc.unique(pc.list_flatten(table.column("bands")))
        return pa.table({"grp": pa.array([key[0].as_py()] * len(bands), pa.int64()), "blk": pa.array([key[1].as_py()] * len(bands), pa.int32()), "band": bands})

    visitors = visitors.select("grp", "text_id", "class")
    if not visitors.limit(1).count():
        return visitors.select(F.col("class").alias("a"), F.col("class").alias("b"))
    # salted: rows dealt by group alone would stay so for the blocks
    called = visitors.select("grp").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    homes = banded.withColumn("salt", F.pmod(F.xxhash64("text_id", F.lit("salt")), F.lit(SALTS)).cast("int")).join(called, ["grp", "salt"], "left_semi")
    homes = homes.groupBy("grp", "blk").applyInArrow(bands_of, "grp long, blk int, band long")
    calling = visitors.join(banded.select("text_id", "bands"), "text_id").select("grp", "text_id", "class", F.explode("bands").alias("band"))
    asked = cut(calling.join(homes, ["grp", "band"]).select("grp", "blk", "text_id", "class").distinct())
    counts = asked.groupBy("grp", "blk").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    asked = asked.join(counts, ["grp", "blk"]).withColumn("slice", F.pmod(F.xxhash64("text_id", F.lit("slice")), F.col("slices")).cast("int"))
    guests = asked.join(texts.select("grp", "text_id", "text"), ["grp", "text_id"]).select("grp", "blk", "slice", "text_id", "text", "class", F.lit(True).alias("guest"))
    hosts = split.select("grp", "blk", "text_id", "class").join(counts, ["grp", "blk"]).join(texts.select("grp", "blk", "text_id", "text"), ["grp", "blk", "text_id"])
    hosts = hosts.select("grp", "blk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "text_id", "text", "class", F.lit(False).alias("guest"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        ids, row, shingle, weight = _load(table)  # a visitor that is at home here counts once
        old = _known(table, ids, "class")
        guest = np.isin(ids, table.column("text_id").to_numpy()[table.column("guest").to_numpy()])
        return _merged(ids, old, Group(row, shingle, weight, len(ids), threshold).classes(old, guest))

    return hosts.unionByName(guests).groupBy("grp", "blk", "slice").applyInArrow(meet, "a long, b long")


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class one row of ``docs``: one that has the doc_id and the text that name it.  Of rows alike in
    both, any one stays."""
    key, text, columns = fresh(docs, "key"), fresh(docs, "hash"), [F.col(f"`{c}`") for c in docs.columns]
    name = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("none"))  # noqa: E731  never null: what is dealt by it stays so
    docs = docs.withColumns({key: name("doc_id"), text: text_hash()})
    heads = classes.select(name("class_id").alias(key), F.col("class_text").alias(text)).distinct()
    return docs.join(heads, [key, text], "left_semi").dropDuplicates([key, text]).select(columns)
