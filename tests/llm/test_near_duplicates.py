import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm.graph import components
from framelake.llm.minhash_dedup import Group, band_hashes, keep_first, likeness, near_duplicates, signatures, weighted_shingles


def weights(text, n=5):
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def exact(a, b):
    """The definition, summed over all pairs of shingles."""
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def classes_brute(rows, threshold=0.8):
    ids = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids.setdefault(i, []).append(t or "")
    label = {i: i for i in ids}
    order = lambda i: (i is None, i or 0)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    texts = {}
    for i, ts in ids.items():
        for t in ts:
            texts.setdefault(t, []).append(i)
    heads = {}
    for t, who in texts.items():
        heads[t] = min(who, key=order)
        for i in who:
            a, b = sorted((find(i), find(heads[t])), key=order)
            label[b] = a
    known = [(heads[t], weights(t)) for t in texts]
    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and find(i) != find(j) and exact(a, b) >= threshold - 1e-9:
                x, y = sorted((find(i), find(j)), key=order)
                label[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("kw", [{}, {"block": 3, "ambassadors": 1}, {"block": 7}, {"block": 1, "ambassadors": 2}])
def test_classes(spark, kw):
    rnd = random.Random(2)
    base = ["w%d" % rnd.randrange(1000) for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        parts = list(base)
        for _ in range(rnd.randrange(6)):
            parts[rnd.randrange(150)] = "e%d" % rnd.randrange(1000)
        rows.append((i * 7 % 61, " ".join(parts)))
    rows += [(100 + i, " ".join("u%d" % rnd.randrange(10**6) for _ in range(rnd.choice([3, 30, 300])))) for i in range(40)]
    rows += [(200, "same words"), (201, "same words"), (202, "same  words"), (203, ""), (204, None), (205, " "), (206, " ".join(["again and again and"] * 40)), (207, " ".join(["again and again and"] * 50)), (200, "same words"), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit("x"), "rep": F.lit(1), "class": F.lit(2)}).repartition(3)
    got = {r.doc_id: r.class_id for r in near_duplicates(df, **kw).collect()}
    assert got == classes_brute(rows)
    kept = keep_first(df, near_duplicates(df, **kw))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert kept.columns == df.columns


def classes_of_rows(rows, threshold=0.8):
    """Rows in classes, by every pair of texts."""
    texts = sorted({t or "" for _, t in rows})
    own = [weights(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a and b and label[i] != label[j] and exact(a, b) >= threshold - 1e-9:
                label = [label[j] if x == label[i] else x for x in label]
    where = {t: label[k] for k, t in enumerate(texts)}
    out = {}
    for i, t in rows:
        out.setdefault(where[t or ""], []).append((i is None, i or 0, hashlib.sha256((t or "").encode()).digest()))
    return sorted((*r, *min(members)[:2]) for members in out.values() for r in members)


@pytest.mark.parametrize("kw", [{}, {"block": 2, "ambassadors": 1}])
def test_rows_are_what_is_classed(spark, kw):
    rnd = random.Random(11)
    text = lambda: ["u%d" % rnd.randrange(10**6) for _ in range(60)]
    bases, rows = [text() for _ in range(6)], []
    for i in range(90):
        t = list(rnd.choice(bases))
        t[rnd.randrange(60)] = "e%d" % i
        rows.append((rnd.choice([None, 7, i, 2**63 - 1]), " ".join(t if rnd.random() < 0.7 else text())))
    rows += [(8, "ab" * 5), (None, ""), (None, None), (3, rows[0][1]), (None, rows[1][1]), rows[5], rows[6]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_duplicates(df, **kw)
    text_of = {hashlib.sha256((t or "").encode()).digest(): t for _, t in rows}
    got = sorted((r.class_id is None, r.class_id or 0, bytes(r.class_text)) for r in found.collect())
    want = classes_of_rows(rows)
    assert sorted(g[:2] for g in got) == sorted(w[3:] for w in want)
    assert len(set(got)) == len({tuple(g) for g in got}) and all(g[2] in text_of for g in got)
    assert keep_first(df, found).count() == len(set(got))


def shuffled_bytes(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_of_no_group_are_not_shuffled(spark):
    word = random.Random(7)
    rows = [(i, " ".join(f"{word.getrandbits(64):x}" for _ in range(1000))) for i in range(300)]
    rows += [(1000, rows[3][1] + " more"), (None, rows[5][1] + " more"), (1001, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.cache().count()
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        df.unpersist()
    assert got == {i: i for i in range(300)} | {1000: 3, None: 5, 1001: 7}
    assert moved < sum(len(t) for _, t in rows) // 4


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_texts_that_polynomials_cannot_tell(spark):
    rows = [(2 * i + f, thue_morse(n, f)) for i, n in enumerate([64, 1024, 4096]) for f in (0, 1)]
    rows += [(100 + f, " ".join(f"{thue_morse(1024, f)} w{k}" for k in range(9))) for f in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == {i: i for i, _ in rows}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_on_documents(spark):
    """Classes of all documents against those that exact likeness of all pairs makes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    data = [t.encode() for _, t in rows]
    row, shingle, weight = weighted_shingles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    label = Group(row, shingle, weight, len(rows), 0.8).classes()
    exact_copies = {}
    for k, (_, t) in enumerate(rows):
        exact_copies.setdefault(t, []).append(k)
    for same in exact_copies.values():
        for k in same[1:]:
            label[label == label[k]] = label[same[0]]
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(i, least.get(c, i))
    want = {i: least[c] for (i, _), c in zip(rows, label)}
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert sum(i != c for i, c in want.items()) > 50
    assert got == want


def test_awkward_rows(docs, rows):
    assert near_duplicates(docs).count() == len(rows)


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_likeness_is_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.integers(0, 4, 30).astype(float), rng.integers(0, 4, 30).astype(float)
        a, b = ({i: v for i, v in enumerate(z) if v} for z in (x, y))
        assert likeness(x / x.sum(), y / y.sum()) == pytest.approx(exact(a, b))


def test_signatures_estimate_the_likeness():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words) + " a b c d e f", " ".join(words) + " a b c x y z", " ".join(words * 2)]
    data = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    row, shingle, weight = weighted_shingles(buf, offs)
    sign = signatures(row, shingle, weight, 3, 4000)
    assert (sign != 0).all()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert (sign[i] == sign[j]).mean() == pytest.approx(exact(weights(texts[i]), weights(texts[j])), abs=0.03)
    assert (signatures(row, shingle, weight * 2, 3, 500) == signatures(row, shingle, weight, 3, 500)).all()
    assert (band_hashes(sign[:1], 3, 5) == band_hashes(sign[:1].copy(), 3, 5)).all()
    assert rng is not None


def test_a_group_is_settled_exactly():
    rng = np.random.default_rng(9)
    base = rng.choice(10_000, 100, replace=False)
    sets = []
    for _ in range(80):
        s = base.copy()
        at = rng.choice(100, rng.integers(0, 16), replace=False)
        s[at] = rng.integers(10_000, 20_000, len(at))
        sets.append(np.unique(s))
    row = np.repeat(np.arange(80), [len(s) for s in sets])
    got = Group(row, np.concatenate(sets).astype(np.uint64), np.ones(len(row)), 80, 0.8).classes()
    label = list(range(80))
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    assert len(set(zip(got.tolist(), label))) == len(set(got.tolist())) == len(set(label))


@pytest.mark.parametrize("seed", range(30))
def test_groups_from_classes_known_before(seed):
    """Guests who join hosts whose links are known, against all pairs; classes of every size and order."""
    rng = np.random.default_rng(seed)
    bases = [rng.choice(10_000, 60, replace=False) for _ in range(4)]
    sets = []
    for _ in range(50):
        s = bases[rng.integers(4)].copy()
        at = rng.choice(60, rng.integers(0, 10), replace=False)
        s[at] = rng.integers(10_000, 20_000, len(at))
        sets.append(np.unique(s))
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8

    def joined(pairs):
        label = list(range(50))
        for i, j in pairs:
            if like(sets[i], sets[j]):
                label = [label[i] if x == label[j] else x for x in label]
        return np.array(label)

    pairs = [(i, j) for i in range(50) for j in range(i)]
    guest = rng.random(50) < 0.3
    known = joined([(i, j) for i, j in pairs if not guest[i] and not guest[j]])
    name = rng.permutation(50)  # classes are called by any numbers
    row = np.repeat(np.arange(50), [len(s) for s in sets])
    group = Group(row, np.concatenate(sets).astype(np.uint64), np.ones(len(row)), 50, 0.8)
    want = joined(pairs)
    for got in (group.classes(), group.classes(name[known], guest), group.classes(name[known])):
        assert len(set(zip(got.tolist(), want.tolist()))) == len(set(got.tolist())) == len(set(want.tolist()))


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 70), (41, 40), (9, 9), (80, 81), (81, 80)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 70: 50, 40: 40, 41: 40, 80: 80, 81: 80}
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0
    rnd = random.Random(few)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 7) for i in range(1000, 2000, 7)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges * 200:
        if a != b:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), few).collect()} == label


@pytest.mark.parametrize("kw", [{}, {"block": 3, "ambassadors": 1}])
def test_texts_that_share_an_id_are_documents_of_their_own(spark, kw):
    rnd = random.Random(5)
    text = lambda: " ".join("u%d" % rnd.randrange(10**6) for _ in range(60))
    nulls, sevens, early = [text() for _ in range(12)], [text() for _ in range(3)], text()
    near = [re.sub(r"^\S+ ", f"e{i} ", nulls[0]) for i in range(9)]
    rows = [(1, early), (None, early), (None, nulls[2]), (9, nulls[1]), (7, sevens[0]), (5, "")] + [(None, t) for t in nulls + near] + [(7, t) for t in sevens] + [(None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_duplicates(df, **kw)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in keep_first(df, found).collect()))
    like = set(near + nulls[:1])
    assert sum(t in like for _, t in kept) == 1
    assert [k for k in kept if k[1] not in like] == sorted([(1, early), (9, nulls[1]), (5, "")] + [(0, t) for t in nulls[2:]] + [(7, t) for t in sevens])
    assert found.count() == len(rows)
