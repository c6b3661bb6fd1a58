import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from framelake.llm.block_dedup import block_dedup
from framelake.llm.exchange import Layout
from framelake.llm.suffix_dedup import column_runs, fragments, suffix_dedup
from framelake.llm.textops import byte_span_hashes, equal_spans, gram_hashes, pack, run_hashes, unpack

LAYOUT = Layout(5, 3)
ROUTED = Layout(11, 7, fan=2)
sha = lambda b: hashlib.sha256(b).hexdigest()
key = lambda r: tuple((x is None, str(x)) for x in r)


def suffix_brute(rows, width=50):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, float("inf")), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < order(i):
                gone[s : s + width] = b"\1" * width
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=key)


def block_brute(rows, width=35):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[s : s + width]) for w in split for s in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = bytearray(len(w))
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = b"\1" * width
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=key)


@pytest.mark.parametrize("width", [50, 30])
@pytest.mark.parametrize("layout", [LAYOUT, ROUTED, None])
def test_suffix_dedup(docs, rows, width, layout):
    got = suffix_dedup(docs, width, layout=layout).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == suffix_brute(rows, width)


def test_suffix_dedup_in_files(docs, rows):
    got = suffix_dedup(docs, memory_bytes=0, layout=LAYOUT).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == suffix_brute(rows)


@pytest.mark.parametrize(("hot", "layout"), [(0, LAYOUT), (3, LAYOUT), (20, LAYOUT), (3, ROUTED)])
def test_busy_anchors_are_dealt_by_windows(docs, rows, hot, layout):
    got = suffix_dedup(docs, layout=layout, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == suffix_brute(rows)


def test_carried_columns_stay_with_their_rows(docs):
    got = suffix_dedup(docs, layout=LAYOUT, carry=("lang", "n_chars", "payload", "bucket")).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), r.n_chars, r.payload, r.bucket) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.in_n_chars, r.in_payload, r.in_bucket) for r in got) == want


@pytest.mark.parametrize(("width", "block", "layout"), [(35, None, LAYOUT), (35, 7, LAYOUT), (10, 5, LAYOUT), (4, 1, LAYOUT), (35, None, ROUTED), (4, 1, ROUTED)])
def test_block_dedup(docs, rows, width, block, layout):
    got = block_dedup(docs, width, block, layout=layout).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == block_brute(rows, width)


def test_empty_tables(no_docs):
    assert suffix_dedup(no_docs).count() == block_dedup(no_docs).count() == 0


def test_parameters_are_checked(docs):
    for bad in (lambda: block_dedup(docs, 35, 19), lambda: suffix_dedup(docs, 24), lambda: suffix_dedup(docs, 150)):
        with pytest.raises(ValueError):
            bad()


def test_fragments_cover_each_window_once():
    data = np.random.default_rng(3).integers(97, 100, 3000).astype(np.uint8)
    offs = np.array([0, 10, 60, 60, 1500, 3000])
    start, windows, left, doc, _ = fragments(data, offs, 50)
    got = sorted(s for a, n in zip(start, windows) for s in range(a, a + n))
    assert got == [s for a, b in zip(offs[:-1], offs[1:]) for s in range(a, b - 49)]
    assert (left < 27).all() and (left - windows >= -1).all()
    assert all(offs[d] <= a < offs[d + 1] for a, d in zip(start, doc))


@pytest.mark.parametrize("kw", [{}, {"block": 7}, {"block": 7, "memory_bytes": 0, "files": True}])
def test_columns_find_the_least_document(kw, tmp_path):
    rng = np.random.default_rng(5)
    width, lead = 30, 6
    text = rng.integers(97, 99, (40, 2 * width - 24)).astype(np.uint8)
    text[1::2] = text[::2]
    text[:, :3] = rng.integers(97, 99, (40, 3))
    text[20:] = text[:20]
    docs = rng.permutation(40).astype(np.int32)
    docs[7] = 40  # takes nothing from others
    left, windows = rng.integers(0, lead + 1, 40).astype(np.uint8), np.zeros(40, np.uint8)
    windows[:] = left + 1
    spans = [(lead - int(f), lead - int(f) + int(w) + width - 1) for f, w in zip(left, windows)]
    data = np.concatenate([t[a:b] for t, (a, b) in zip(text, spans)])
    kw = dict(kw, folder=str(tmp_path)) if kw.pop("files", False) else kw
    got = {}
    for f, first, count, rank in zip(*column_runs(data, left, windows, docs, 40, width, **kw)):
        for k in range(int(first), int(first) + int(count)):
            assert (int(f), k) not in got
            got[int(f), k] = int(rank)
    want = {}
    for i, (a, b) in enumerate(spans):
        for k in range(int(windows[i])):
            j = a + k
            least = min(int(docs[x]) for x, (c, d) in enumerate(spans) if c <= j and j + width <= d and (text[x, j : j + width] == text[i, j : j + width]).all())
            if least < 40:
                want[i, k] = least
    assert got == want
    assert not list(tmp_path.iterdir())


def thue_morse(n, flip):
    """Two letters so arranged that every polynomial hash modulo 2**64 of both texts is the same."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_polynomials_cannot_tell(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{thue_morse(n, flip)} {rest}") for i, (n, flip) in enumerate([(1024, 0), (1024, 1), (256, 0), (256, 1), (4096, 0), (4096, 1)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = block_dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == block_brute(rows)
    assert got.agg({"n_removed": "sum"}).first()[0] == 0
    got = suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == suffix_brute(rows)


def test_ids_at_the_end_of_their_range(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(2**63 - 1, text), (None, text), (-(2**63), "x " + text), (None, text + " y"), (2**63 - 1, text + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == suffix_brute(rows)
    got = block_dedup(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=key) == block_brute(rows)


def test_hashes():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 3000)
    ends = starts + rng.choice([0, 1, 3, 7, 8, 9, 16, 17, 511, 512, 513, 900], 3000)
    for seed in (0, 1):
        codes, texts = byte_span_hashes(buf, starts, ends, seed).tolist(), [buf[a:b].tobytes() for a, b in zip(starts, ends)]
        assert len(set(codes)) == len(set(texts)) == len(set(zip(codes, texts)))
    a, b = starts[:-1], starts[1:]
    size = np.minimum(ends[:-1] - a, 5000 - b)
    assert equal_spans(buf, a, b, size).tolist() == [buf[x : x + n].tobytes() == buf[y : y + n].tobytes() for x, y, n in zip(a, b, size)]
    words = rng.integers(0, 2, 400).astype(np.uint64)
    for n in (1, 2, 3, 5, 18, 35, 64):
        codes, runs = run_hashes(words, n).tolist(), [words[i : i + n].tobytes() for i in range(400 - n + 1)]
        assert len(set(codes)) == len(set(runs)) == len(set(zip(codes, runs)))
    codes, at, run = gram_hashes(words, np.array([0, 0, 3, 4, 20, 400]), 5, short=True)
    assert run.tolist() == [0, 0, 1, 2, 14, 390] and at[:3].tolist() == [0, 3, 4]
    assert codes[0] == run_hashes(words[:3], 3)[0] and codes[1] == run_hashes(words[3:4], 1)[0] and codes[13] == run_hashes(words[15:20], 5)[0]


def test_pack_round_trip():
    arrays = [np.arange(5), np.zeros(0, np.uint8), np.array([True, False]), np.array([1.5], np.float32)]
    for a, b in zip(arrays, unpack(pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
