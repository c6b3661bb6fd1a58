"""Removal of repeated word passages by fixed-block anchors.

A word goes if a window of ``width`` (35) words covers it whose word sequence also starts
anywhere else, in the same document too.  Words are runs of bytes other than 0x20 and
0x09-0x0D, unchanged.

Index: the non-overlapping blocks of ``block`` words of every document, where
``2 * block - 1 <= width``, so each window holds a whole block.  Probe: every rolling run of
``block`` words of every document.  A block that is found anywhere else is a hit; nothing else
can lie in a repeated window.  Extension: each hit block is extended by up to ``width - block``
words to both sides, to all the windows that hold it; those whose sequence occurs twice are exact
repeats, and their runs are the maximal ones.  Sequences meet by 96 bits: two hashes over two
independent hashes of each word.

Both rounds send each distinct hash once from a document bucket, and merge on the way (see exchange.py),
so no group of copies, common passage or common line is larger in a task than the number of its senders.

Results: null text: no words. Null doc_id: a document like others. Repeated rows are repeats of
one another. Texts under ``width`` words keep all words. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm.exchange import MESSAGE, Bucket, Layout, Letter, Round, answered, consult, document_buckets, meet, messages, post, send, tagged
from framelake.llm.textops import U64, byte_span_hashes, gram_hashes, mix, ragged, run_hashes, word_spans

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


def to_planes(values: np.ndarray, size: int) -> np.ndarray:
    """Ascending values as differences, split into ``size`` byte planes."""
    return np.diff(values, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T[:size].ravel()


def from_planes(planes: np.ndarray, size: int) -> np.ndarray:
    n = len(planes) // size
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :size] = planes.reshape(size, n).T
    return np.cumsum(raw.view(U64).ravel(), dtype=U64)


def _merge(letters: list[Letter]) -> tuple[Letter, np.ndarray]:
    """Distinct keys (all fields but the last) and their flags joined by or; flag 1 is also: in several letters."""
    *keys, flags = (np.concatenate(x) for x in zip(*letters, strict=True))
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys, flags = [k[order] for k in keys], flags[order]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    origin = np.empty(len(order), np.int64)
    origin[order] = np.cumsum(new) - 1
    joined = np.bitwise_or.reduceat(flags, starts) if len(starts) else flags
    joined |= np.diff(np.append(starts, len(order))) > 1
    return (*(k[starts] for k in keys), joined), origin


SEVERAL, BLOCK = 1, 2
PROBES = Round(
    spread=lambda letter: letter[0], merge=_merge, judge=lambda letter: (np.flatnonzero(letter[1] == SEVERAL | BLOCK),),
    write=lambda letter: (to_planes(letter[0], 5), letter[1]), read=lambda letter: (from_planes(letter[0], 5), letter[1]),
)
WINDOWS = Round(
    spread=lambda letter: mix(letter[0]), merge=_merge, judge=lambda letter: (np.flatnonzero(letter[2] & SEVERAL),),
    write=lambda letter: (to_planes(letter[0], 8), *letter[1:]), read=lambda letter: (from_planes(letter[0], 8), *letter[1:]),
)


def block_dedup(docs: DataFrame, width: int = 35, block: int | None = None, layout: Layout | None = None, texts: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): numbers of words, digest and bytes of the kept ones.

    ``texts``: also return the kept words joined by spaces; otherwise that column is null.
    """
    block = block or (width + 1) // 2
    if not 1 <= block <= (width + 1) // 2:
        raise ValueError("a window must hold a whole block: 2 * block - 1 <= width")
    layout = layout or Layout.of(docs)
    buckets = document_buckets(docs, layout)

    def aligned(at: np.ndarray, first: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The place within its document of each run of words."""
        return at - np.repeat(first[:-1], np.diff(run))

    def probes(b: Bucket):
        starts, ends, first = word_spans(b.buf, b.offs)
        codes = byte_span_hashes(b.buf, starts, ends)
        grams, at, run = gram_hashes(codes, first, block)
        flags = np.where(aligned(at, first, run) % block == 0, BLOCK, 0).astype(np.uint8)
        letter, origin = _merge([(grams >> U64(24), flags)])
        return starts, ends, first, codes, at, letter, origin

    def ask(number: int, b: Bucket) -> pa.Table:
        return post(number, probes(b)[5], PROBES, layout)

    def windows(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, codes: np.ndarray, b: Bucket):
        """Of all windows: first word, the two hashes that they meet by, place in the document."""
        whole, at, run = gram_hashes(codes, first, width)
        more = run_hashes(byte_span_hashes(b.buf, starts, ends, seed=1), width)
        return at, whole, (more[at] >> U64(32)).astype(np.uint32), aligned(at, first, run)

    def extend(number: int, b: Bucket, answers: list[bytes]) -> pa.Table:
        if not answers:
            return messages([])
        starts, ends, first, codes, gram_at, letter, origin = probes(b)
        found = np.zeros(len(letter[0]), bool)
        found[answered(letter, answers, PROBES, layout)[0]] = True
        hit = np.zeros(len(codes) + 1, bool)
        hit[gram_at[found[origin]]] = True
        at, whole, check, place = windows(starts, ends, first, codes, b)
        pick = np.flatnonzero(hit[at + (-place) % block])  # the block in the window
        if not len(pick):
            return messages([])
        letter, origin = _merge([(whole[pick], check[pick], np.zeros(len(pick), np.uint8))])
        some = np.empty(len(letter[0]), np.int64)
        some[origin] = pick  # a window of each sequence; its number is the tag
        return post(number, letter, WINDOWS, layout, some)

    def finish(number: int, b: Bucket, answers: list[bytes]) -> pa.Table:
        starts, ends, first = word_spans(b.buf, b.offs)
        cover = np.zeros(len(starts) + 1, np.int32)
        if answers:
            at, whole, check, _ = windows(starts, ends, first, byte_span_hashes(b.buf, starts, ends), b)
            (tags,) = tagged(answers)
            again = np.flatnonzero(np.isin(whole, whole[tags]))
            _, origin = _merge([(np.append(whole[again], whole[tags]), np.append(check[again], check[tags]), np.zeros(len(again) + len(tags), np.uint8))])
            hit = at[again[np.isin(origin[: len(again)], origin[len(again) :])]]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + width, -1)
        keep = np.cumsum(cover[:-1]) == 0
        kept_before = np.concatenate(([0], np.cumsum(keep)))
        size = (ends - starts)[keep] + 1
        joined = b.buf[np.minimum(ragged(starts[keep], size), max(len(b.buf) - 1, 0))] if keep.any() else np.zeros(0, np.uint8)
        cut = np.concatenate(([0], np.cumsum(size)))
        joined[cut[1:] - 1] = 0x20
        bounds = cut[kept_before[first]]
        kept = [joined[s : max(s, e - 1)].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        n_words = np.diff(first)
        return pa.table(
            {
                "doc_id": b.id_array(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - np.diff(kept_before[first]), pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept": pa.array(kept if texts else [None] * len(kept), pa.binary()),
            }
        )

    known = consult(send(buckets, ask), PROBES, layout)
    found = consult(meet(buckets, known, extend, MESSAGE), WINDOWS, layout)
    return meet(buckets, found, finish, SCHEMA)
