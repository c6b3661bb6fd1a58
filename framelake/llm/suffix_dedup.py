"""Removal of repeated byte strings by a column-wise Burrows-Wheeler construction.

A byte goes if a string of ``width`` (50) bytes covers it that also starts in a document with a
smaller doc_id.  The collection's order is built column by column: each round puts one symbol in
front of every string of the collection, sorts stably by it, and so updates the transform (the
symbols in sorted order) and the common prefixes of neighbours.  Done over whole documents that
takes as many rounds as the longest document has bytes, and reads the whole transform in each.
So the collection's strings are *fragments*: every window of 50 bytes belongs to the least hash
of its 24-byte grams (its anchor; the leftmost one of equals), and neighbouring windows with one
anchor form one fragment of 50 to 76 bytes.  Equal windows have equal anchors at equal places;
hence fragments are aligned on their anchors, equal windows are always entered in the same
round, and the transform is needed for the newest column alone: at most 76 rounds, each of
them one sequential pass.

The collection's columns, order and common prefixes beyond ``memory_bytes`` lie in external files in the
shared folder of checkpoints, without a name, so they go when the task ends: a round reads one
column, the order and the prefixes from front to back, block by block, and writes the new order as one
sequential file per symbol, laid end to end.  Some 30 bytes per string stay in memory.

Fragments whose anchor occurs in one document only are left out before; that needs a round of
gram hashes (see exchange.py).  Equal fragments are merged wherever they meet, after comparing
their bytes, and keep the least doc_id; so copies and common passages do not pile up.  An anchor that
more than ``hot`` fragments share (a common phrase among ever different neighbours) is dealt by its
windows instead, each a fragment of its own that goes where its bytes' hash says.  No result
rests on a hash alone.

Results: null text: empty. Null doc_id: after all others. Rows that are repeated, or share a doc_id,
never remove from one another, and each gets a result row of its own. Empty tables give no rows.
Columns of any name beside doc_id and text do not matter.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from framelake.llm.exchange import MESSAGE, Bucket, Layout, Letter, Round, answered, consult, document_buckets, meet, messages, post, send, tagged
from framelake.llm.graph import shared_folder
from framelake.llm.textops import U64, byte_span_hashes, equal_spans, group_starts, loads, mix, ragged

GRAM = 24
ABSENT = 0xFF  # never a byte of UTF-8
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def fragments(buf: np.ndarray, offs: np.ndarray, width: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every fragment: first window's start, number of windows, bytes before the anchor,
    document, hash of the anchor.  Documents are gone through about ``block`` bytes at a time."""
    found, at = [], 0
    while at < len(offs) - 1 or not found:
        to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + block, "right")) - 1), len(offs) - 1)
        start, windows, left, doc, grams = _fragments(buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at], width)
        found.append((start + offs[at], windows, left, doc + at, grams))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _fragments(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, span = len(buf), width - GRAM + 1  # grams in a window
    lengths = np.diff(offs)
    if not (lengths >= width).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64)
    m = n - GRAM + 1
    b = loads(buf)
    grams = mix(b[:m] * U64(0x9E3779B97F4A7C15) ^ mix(b[8 : 8 + m] * U64(0xC2B2AE3D27D4EB4F) ^ b[16 : 16 + m]))  # as gram_at
    least = (grams >> U64(32) << U64(32)) | np.arange(m, dtype=U64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: reach - span], least[span - reach :])
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(lengths >= width)
    inside = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long] + lengths[long] - width + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = anchor[1:] != anchor[:-1]
    start = np.flatnonzero(inside & np.concatenate(([True], new | ~inside[:-1])))
    end = np.flatnonzero(inside & np.concatenate((new | ~inside[1:], [True])))
    at = anchor[start]
    return start, end - start + 1, at - start, np.searchsorted(offs, start, "right") - 1, grams[at]


class Files:
    """Arrays in memory, or in files without a name in ``folder``."""

    def __init__(self, folder: str | None) -> None:
        self.folder = folder

    def array(self, kind: type, *shape: int) -> np.ndarray:
        if self.folder is None:
            return np.empty(shape, kind)
        path = os.path.join(self.folder, f"columns-{uuid.uuid4().hex}")
        with open(path, "w+b") as file:
            os.unlink(path)
            return np.memmap(file, kind, "w+", shape=shape)


def insert_column(symbols: np.ndarray, place: int, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], block: int) -> None:
    """One round: a symbol in front of every string.  ``old`` and ``new``: the strings' order, and for each in
    that order the place at which it and the one before cease to agree.  Both are gone through in blocks."""
    order, common = old
    cursor = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=256))))[:-1]
    seen, since = np.zeros(256, bool), np.full(256, 255, np.uint8)  # least agreement since each symbol's last string
    for at in range(0, len(order), block):
        o, c = np.asarray(order[at : at + block]), np.asarray(common[at : at + block])
        s = symbols[o]
        moved = np.argsort(s, kind="stable")
        s = s[moved]
        to, first = np.empty(len(o), np.uint8), group_starts(s)
        if len(o) > 1:
            to[1:] = np.minimum.reduceat(np.append(c, np.uint8(255)), moved + 1)[:-1]  # between strings of one symbol
        here = s[first]
        before = np.minimum(since[here], np.minimum.accumulate(c)[moved[first]])
        to[first] = np.where(seen[here], before, place)
        after = np.append(np.minimum.accumulate(c[::-1])[::-1], np.uint8(255))
        ends = np.append(first[1:], len(o))
        since = np.minimum(since, c.min())
        since[here], seen[here] = after[moved[ends - 1] + 1], True
        o = o[moved]
        if len(o) == len(order):
            new[0][:], new[1][:] = o, to
            return
        for symbol, a, b in zip(here.tolist(), first.tolist(), ends.tolist(), strict=True):
            w = int(cursor[symbol])
            new[0][w : w + b - a], new[1][w : w + b - a] = o[a:b], to[a:b]
            cursor[symbol] += b - a


def column_runs(data: np.ndarray, left: np.ndarray, windows: np.ndarray, docs: np.ndarray, none: int, width: int, memory_bytes: int = 1 << 62, folder: str | None = None, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction over fragments aligned on their anchors.

    ``data``: the fragments' bytes end to end; ``left``: bytes before the anchor, ``windows``: windows,
    ``docs``: rank of its document, ``none`` if that takes nothing from others.  Result: runs of
    windows that have one least document: (fragment, first window, number of windows, rank), none left out
    but those of rank ``none``, by ascending fragment.
    """
    n, lead, depth = len(left), width - GRAM, 2 * width - GRAM
    size = windows.astype(np.int64) + width - 1
    begins = np.cumsum(size) - size
    shift = begins - (lead - left.astype(np.int64))  # where place 0 of each string would lie
    files = Files(folder if n * (depth + 10) > memory_bytes else None)
    columns = files.array(np.uint8, depth, n) if files.folder else None
    padded = np.concatenate((np.zeros(lead, np.uint8), data, np.zeros(depth, np.uint8)))

    def column(j: int) -> np.ndarray:
        at = shift + j
        return np.where((at >= begins) & (at < begins + size), padded[at + lead], np.uint8(ABSENT))

    if columns is not None:
        for j in range(depth):
            columns[j] = column(j)
        del padded, shift, begins, size
    old, new = ((files.array(np.int32, n), files.array(np.uint8, n)) for _ in range(2))
    old[0][:], old[1][:] = np.arange(n), depth
    now, value, until = np.empty(n, np.int32), np.full(n, none, np.int32), np.zeros(n, np.uint8)
    found: list[tuple[np.ndarray, ...]] = []

    def close(which: np.ndarray, j: int) -> None:
        """Runs of these strings end; the next window to come is at j."""
        which = which[value[which] != none]
        skip, count = j + 1 - lead + left[which].astype(np.int16), until[which].astype(np.int16) - j
        found.append((which.astype(np.int32), skip.astype(np.uint8), count.astype(np.uint8), value[which]))

    for j in range(depth - 1, -1, -1):
        insert_column(column(j) if columns is None else np.asarray(columns[j]), j, old, new, block)
        old, new = new, old
        if j <= lead:
            has = (left >= lead - j) & (left.astype(np.int16) - windows < lead - j)
            starts = np.flatnonzero(np.asarray(old[1]) < j + width)
            order = np.asarray(old[0])
            least = np.minimum.reduceat(np.where(has, docs, none)[order], starts)
            now[order] = np.repeat(least, np.diff(np.append(starts, n)))
            now[~has] = none
            changed = np.flatnonzero(now != value)
            close(changed, j)
            value[changed], until[changed] = now[changed], j
    close(np.arange(n), -1)
    frag, first, count, rank = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(frag, kind="stable")
    return frag[by], first[by], count[by], rank[by]


def alike(buf: np.ndarray, start: np.ndarray, left: np.ndarray, windows: np.ndarray, size: np.ndarray, ids: np.ndarray, null: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments with equal ones side by side, in an order in which the first of these has the least doc_id,
    and where in it each group of equal ones begins."""
    order = np.lexsort((ids, null, content))
    a, b = order[:-1], order[1:]
    same = (content[a] == content[b]) & (left[a] == left[b]) & (windows[a] == windows[b])
    may = np.flatnonzero(same)
    same[may] = equal_spans(buf, start[a[may]], start[b[may]], size[a[may]])
    return order, np.concatenate((np.zeros(min(1, len(order)), np.int64), np.flatnonzero(~same) + 1))


NULL, SPLIT = 1, 2  # of a fragment: without a doc_id; a window of a busy anchor


def gram_at(at8: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes that begin at some places."""
    return mix(at8[at] * U64(0x9E3779B97F4A7C15) ^ mix(at8[at + 8] * U64(0xC2B2AE3D27D4EB4F) ^ at8[at + 16]))


def fragment_round(width: int, judge) -> Round:
    """Letters of (content's hash, where it is dealt, doc_id, flags, bytes before the anchor, windows, bytes).
    Fragments of one anchor meet in one place, windows of a busy one where their content says."""

    def begins(letter: Letter) -> tuple[np.ndarray, np.ndarray]:
        size = letter[-2].astype(np.int64) + width - 1
        return np.cumsum(size) - size, size

    def read(sent: Letter) -> Letter:
        _, flags, left, _, data = sent
        at, size = begins(sent)
        content = content_hash(data, at, size, left)
        return (content, np.where(flags & SPLIT, content, gram_at(loads(data), at + left)), *sent)

    def pick(letter: Letter, which: np.ndarray) -> Letter:
        at, size = begins(letter)
        return (*(a[which] for a in letter[:-1]), letter[-1][ragged(at[which], size[which])])

    def merge(letters: list[Letter]) -> tuple[Letter, np.ndarray]:
        """Distinct fragments, compared byte by byte, each with its least doc_id (null: none)."""
        every = tuple(np.concatenate(x) for x in zip(*letters, strict=True))
        content, _, ids, flags, left, windows, data = every
        at, size = begins(every)
        order, starts = alike(data, at, left, windows, size, ids, flags & NULL, content)
        origin = np.empty(len(order), np.int64)
        origin[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        return pick(every, order[starts]), origin

    return Round(lambda letter: letter[1], merge, judge, pick, lambda letter: letter[2:], read)


def content_hash(buf: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    return mix(byte_span_hashes(buf, start, start + size) + U64(1000003) * left.astype(U64))


def _merge_anchors(letters: list[Letter]) -> tuple[Letter, np.ndarray]:
    """Distinct anchors; whether they occur in several documents, and how often in all."""
    grams, several, count = (np.concatenate(x) for x in zip(*letters, strict=True))
    order = np.argsort(grams, kind="stable")
    starts = group_starts(grams[order])
    times = np.diff(np.append(starts, len(order)))
    origin = np.empty(len(order), np.int64)
    origin[order] = np.repeat(np.arange(len(starts)), times)
    several = np.logical_or.reduceat(several[order], starts) | (times > 1)  # equal rows lie in one bucket
    total = np.minimum(np.add.reduceat(count[order].astype(np.int64), starts), (1 << 32) - 1).astype(np.uint32)
    return (grams[order][starts], several, total), origin


def suffix_dedup(docs: DataFrame, width: int = 50, memory_bytes: int = 256 << 20, layout: Layout | None = None, texts: bool = True, carry: tuple[str, ...] = (), hot: int = 20_000, whole_characters: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what is removed and what is kept.

    ``texts``: also return the kept bytes; otherwise that column is null.  ``whole_characters``: without what a
    cut left of a character (the digest is of all kept bytes).  ``carry``: columns of ``docs`` to return
    as ``in_<name>``.
    """
    if not GRAM < width < 139:
        raise ValueError(f"width must be over {GRAM} and under 139")
    layout = layout or Layout.of(docs)
    buckets = document_buckets(docs, layout, carry)
    folder = shared_folder(docs.sparkSession)
    schema = StructType([*_parse_datatype_string(SCHEMA).fields, *[StructField(f"in_{c}", docs.schema[c].dataType) for c in carry]])

    def judge_anchors(letter: Letter) -> Letter:
        hit = np.flatnonzero(letter[1])
        return hit, letter[2][hit] > hot

    def judge(letter: Letter) -> Letter:
        _, _, ids, flags, left, windows, data = letter
        known, rank = np.unique(ids, return_inverse=True)
        none = len(known)
        frag, first, count, least = column_runs(data, left, windows, np.where(flags & NULL, none, rank).astype(np.int32), none, width, memory_bytes, folder)
        return frag, first, count, known[least]

    # 40-bit values in order: differences, split in planes, compress well
    narrow = lambda letter: (np.diff(letter[0], prepend=U64(0)).view(np.uint8).reshape(-1, 8).T[:5].ravel(), letter[1], letter[2])

    def widen(letter: Letter) -> Letter:
        raw = np.zeros((len(letter[1]), 8), np.uint8)
        raw[:, :5] = letter[0].reshape(5, -1).T
        return np.cumsum(raw.view(U64).ravel(), dtype=U64), letter[1], letter[2]

    anchors_round = Round(lambda letter: letter[0], _merge_anchors, judge_anchors, write=narrow, read=widen)

    def parts_of(b: Bucket, found: tuple[np.ndarray, ...], wanted: np.ndarray, busy: np.ndarray):
        """The bucket's fragments that have wanted anchors, those of busy ones window by window; a hash of each one's content."""
        pick = np.isin(found[4] >> U64(24), wanted)
        start, windows, left, doc, grams = (x[pick] for x in found)
        split = np.isin(grams >> U64(24), busy)
        if split.any():
            one, many = np.flatnonzero(~split), np.flatnonzero(split)
            step = ragged(np.zeros(len(many), np.int64), windows[many])
            many = np.repeat(many, windows[many])
            start, left = np.concatenate((start[one], start[many] + step)), np.concatenate((left[one], left[many] - step))
            windows = np.concatenate((windows[one], np.ones(len(many), np.int64)))
            doc, grams, split = doc[np.concatenate((one, many))], grams[np.concatenate((one, many))], np.repeat([False, True], [len(one), len(many)])
        content = content_hash(b.buf, start, windows + width - 1, left)
        return start, windows, left, doc, grams, content, split

    def groups(b: Bucket, start, windows, left, doc, content) -> tuple[np.ndarray, np.ndarray]:
        return alike(b.buf, start, left, windows, windows + width - 1, b.ids[doc], b.null[doc], content)

    def anchors(b: Bucket, found: tuple[np.ndarray, ...]) -> Letter:
        _, _, _, doc, grams = found
        grams = grams >> U64(24)
        doc = (np.cumsum(np.concatenate(([True], (b.ids[1:] != b.ids[:-1]) | (b.null[1:] != b.null[:-1])))) if len(b.ids) else b.ids)[doc]  # rows of one doc_id
        order = np.lexsort((doc, grams))
        grams, doc = grams[order], doc[order]
        starts = group_starts(grams)
        several = np.maximum.reduceat(doc, starts) != doc[starts] if len(starts) else np.zeros(0, bool)
        return grams[starts], several, np.diff(np.append(starts, len(grams))).astype(np.uint32)

    def ask(number: int, b: Bucket) -> pa.Table:
        return post(number, anchors(b, fragments(b.buf, b.offs, width)), anchors_round, layout)

    fragments_round = fragment_round(width, judge)

    def candidates(number: int, b: Bucket, answers: list[bytes]) -> pa.Table:
        if not answers:
            return messages([])
        found = fragments(b.buf, b.offs, width)
        letter = anchors(b, found)
        hit, hot_one = answered(letter, answers, anchors_round, layout)
        start, windows, left, doc, grams, content, split = parts_of(b, found, letter[0][hit], letter[0][hit[hot_one]])
        order, starts = groups(b, start, windows, left, doc, content)
        f = order[starts]
        flags = np.where(b.null[doc[f]], NULL, 0) | np.where(split[f], SPLIT, 0)
        letter = content[f], np.where(split, content, grams)[f], b.ids[doc[f]], flags.astype(np.uint8), left[f].astype(np.uint8), windows[f].astype(np.uint8), b.buf[ragged(start[f], windows[f] + width - 1)]
        return post(number, letter, fragments_round, layout, np.where(split[f], ~start[f], start[f]))

    def finish(number: int, b: Bucket, answers: list[bytes]) -> pa.Table:
        n, buf = len(b.ids), b.buf
        covered = np.zeros(len(buf) + 1, np.int32)
        if answers and n:
            tags, skip, count, least = tagged(answers)
            at = np.where(tags < 0, ~tags, tags)
            found = fragments(buf, b.offs, width)
            of = found[4][np.searchsorted(found[0], at, "right") - 1] >> U64(24)  # each answer's anchor
            start, windows, left, doc, _, content, _ = parts_of(b, found, np.unique(of), np.unique(of[tags < 0]))
            order, starts = groups(b, start, windows, left, doc, content)
            by_start = np.argsort(start)
            head = by_start[np.searchsorted(start, at, sorter=by_start)]  # each answer's fragment, first of its group
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lo = place[head]
            size = np.append(starts, len(order))[np.searchsorted(starts, lo, "right")] - lo
            run = np.repeat(np.arange(len(at)), size)
            frag = order[ragged(lo, size)]
            use = b.null[doc[frag]] | (b.ids[doc[frag]] > least[run])
            frag, run = frag[use], run[use]
            at = start[frag] + skip[run]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + count[run] + width - 1, -1)
        gone = np.cumsum(covered, dtype=np.int32)[:-1] > 0
        del covered
        removed, runs, sha, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for i, (a, e) in enumerate(zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True)):
            text, lost = buf[a:e], gone[a:e]
            removed[i] = np.count_nonzero(lost)
            if removed[i]:
                runs[i] = int(lost[0]) + np.count_nonzero(lost[1:] & ~lost[:-1])
                text = text[~lost]
            left_over = text.tobytes()
            sha.append(hashlib.sha256(left_over).hexdigest())
            if whole_characters and removed[i]:
                left_over = left_over.decode("utf-8", "ignore").encode()
            kept.append(left_over if texts else None)
        out = pa.table(
            {
                "doc_id": b.id_array(), "n_bytes": pa.array(np.diff(b.offs), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()),
            }
        )
        for i, c in enumerate(carry):
            out = out.append_column(f"in_{c}", b.carried.column(i) if n else pa.nulls(0))
        return out

    known = consult(send(buckets, ask), anchors_round, layout)
    found = consult(meet(buckets, known, candidates, MESSAGE), fragments_round, layout)
    return meet(buckets, found, finish, schema, bool(carry))
