import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm.containment import Partition, bands_for, bit_table, contained, fold, known, matches, size_class, without
from framelake.llm.decontaminate import contamination, decontaminate
from framelake.llm.licenses import NOTICES, TEMPLATES, TEXTS, license_scan


def grams(t):
    w = fold(np.frombuffer((t or "").encode(), np.uint8)).tobytes().split(b" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, items, threshold=0.8):
    return sorted((str(i), q, len(grams(s)), len(grams(s) & grams(t))) for i, t in rows for q, s in items if grams(s) and len(grams(s) & grams(t)) >= threshold * len(grams(s)) - 1e-9)


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(8)
    words = lambda k: [rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(40)) for _ in range(k)]
    items = [(q, " ".join(words(n))) for q, n in enumerate([3, 5, 6, 9, 15, 20, 33, 60, 64, 65, 100, 300])]
    items += [(50, items[5][1]), (51, ""), (52, None), (53, items[7][1].upper().replace(" ", ", "))]
    rows = []
    for i in range(150):
        text = words(rnd.choice([0, 10, 100, 2000]))
        if i % 2:
            part = rnd.choice(items)[1] or ""
            part = part.split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if part:
                    part[rnd.randrange(len(part))] = "edited"
            at = rnd.randrange(len(text) + 1)
            text[at:at] = part
        rows.append((i, " ".join(text)))
    rows += [(1000, None), (1001, ""), (None, items[8][1]), (3, rows[3][1]), (1002, " ".join(words(30_000)) + " " + items[10][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"query_id": F.lit("x"), "containment": F.lit(1)}).repartition(3)
    return rows, items, docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))


def pairs(df):
    return sorted((str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in df.collect())


def test_contamination(world):
    rows, items, docs, benchmark = world
    want = brute(rows, items)
    assert len(want) > 50
    assert pairs(contamination(docs, benchmark)) == want
    hit = {(w[0]) for w in want}
    left = decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if str(i) not in hit)


def test_items_without_an_id_are_items(world, spark):
    rows, items, docs, _ = world
    nameless = spark.createDataFrame([(None if q % 2 else q, s) for q, s in items], "query_id long, text string")
    got = contained(docs, nameless)
    want = [(str(w[0]), str(None if w[1] % 2 else w[1])) for w in brute(rows, items)]
    assert sorted((str(r.doc_id), str(r.query_id)) for r in got.collect()) == sorted(want)
    hit = {w[0] for w in want}
    for few in (0, 1000):  # by a join, and by a broadcast
        left = without(docs, nameless, few=few)
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if str(i) not in hit)


def test_scattered_items_are_found(spark):
    """Shingles of an item with other words, and other items, between them: all that the definition asks for."""
    rnd = random.Random(3)
    words = lambda k: ["%s%d" % (rnd.choice("pqrst"), rnd.randrange(10**6)) for _ in range(k)]
    items = [(q, " ".join(words(n))) for q, n in enumerate([12, 24, 48, 70, 130, 260] * 3)]
    rows = []
    for i in range(120):
        q, text = rnd.choice(items)
        parts, w = [], text.split()
        while w:
            k = rnd.randint(9, 40)
            parts.append(" ".join(w[:k]))
            w = w[max(1, k - 4) :] if len(w) > k else []
        between = lambda: " ".join(words(rnd.choice([0, 3, 500]))) if rnd.random() < 0.7 else rnd.choice(items)[1]
        rows.append((i, " ".join(f"{p} {between()}" for p in parts)))
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, text string")
    want = brute(rows, items)
    got = sorted((str(r.doc_id), r.query_id, r.n_query, r.n_shared) for r in contained(docs, queries).collect())
    assert len(want) > 150 and set(got) <= set(want)
    assert len(got) >= 0.99 * len(want)


def test_empty_tables(world, no_docs):
    _, _, docs, benchmark = world
    assert contamination(no_docs, benchmark).count() == 0
    assert contamination(docs, benchmark.limit(0)).count() == 0
    assert decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    assert license_scan(no_docs).count() == 0


def test_bands_keep_their_promise():
    for floor in (0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0):
        for chance in (0.9, 0.9999):
            r, n = bands_for(floor, chance)
            assert 1 - (1 - floor**r) ** n >= chance - 1e-12 and (r == 1 or r * n <= 64)
    for bad in ((0, 0.9), (0.5, 1), (-1, 0.5)):
        with pytest.raises(ValueError):
            bands_for(*bad)
    assert [size_class(n) for n in (1, 2, 3, 4, 5, 8, 9)] == [1, 2, 4, 4, 8, 8, 16]


def test_windows_hold_every_run():
    for most in (1, 2, 4, 8, 64, 1024):
        p = Partition.of(most, 0.8, 0.9999)
        for n in (1, most, 3 * most + 1, 1000):
            starts = range(0, max(-(-(n - p.span) // p.step), 0) * p.step + 1, p.step)
            for at in range(max(1, n - most + 1)):
                assert any(s <= at and min(at + most, n) <= s + p.span for s in starts), (most, n, at)


def test_bit_table(spark):
    values = [[1, 2, -5], [], [2**62, 7]]
    table = bit_table(spark.createDataFrame([(v,) for v in values], "v array<long>").repartition(3), 5)
    assert known(np.array(sum(values, []), np.int64).view(np.uint64), table).all()
    assert np.unpackbits(table).sum() <= 5
    assert not known(np.arange(10**6, 10**6 + 200, dtype=np.uint64), table).all()
    assert not bit_table(spark.createDataFrame([], "v array<long>"), 0).any()


def licence_brute(rows, templates=TEMPLATES):
    """The docstring's rule, set by set."""
    out = []
    own = [grams(t) for _, t in templates]
    short = [tuple(re.findall(r"[a-z0-9]+", t.lower())) for _, t in templates]
    for i, text in rows:
        have, held = grams(text), {}
        w = re.findall(r"[a-z0-9]+", (text or "").lower())
        for q, g in enumerate(own):
            if g and len(g & have) >= 0.8 * len(g) - 1e-9:
                held[q] = (g & have, len(g & have) / len(g))
            if not g and any(tuple(w[k : k + len(short[q])]) == short[q] for k in range(len(w))):
                held[q] = ({short[q]}, 1.0)
        for q, (s, c) in held.items():
            if not any(c2 > c and templates[q][0] != templates[p][0] and s <= s2 for p, (s2, c2) in held.items()):
                out.append((str(i), q, templates[q][0], len(s)))
    return sorted(out)


def test_licenses(spark):
    filler = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{filler}\n{text.upper() if i % 2 else text}\n{filler}") for i, (_, text) in enumerate(TEMPLATES)]
    rows += [(100, filler), (101, None), (102, "Released under"), (103, re.sub("License", "Licence", NOTICES[3][1])), (104, f"{NOTICES[3][1]} {filler} {NOTICES[4][1]}"), (None, TEXTS[0][1])]
    rows += [(200 + k, f"{filler} " + re.sub("AND", "and also", text)) for k, (_, text) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit(1), "template_id": F.lit(2), "uid": F.lit("x"), "shared": F.lit(3)})
    got = sorted((str(r.doc_id), r.template_id, r.license, r.n_shared) for r in license_scan(df).collect())
    assert got == licence_brute(rows)
    assert {(str(i), i) for i in range(len(TEMPLATES))} <= {g[:2] for g in got}


def test_versions_are_told_apart(spark):
    at = {name: i for i, (name, _) in enumerate(NOTICES)}
    text = lambda name: NOTICES[at[name]][1]
    full = dict(TEXTS)
    rows = [(0, text("GPL-2.0")), (1, text("GPL-3.0")), (2, text("GPL-2.0") + " or " + text("GPL-3.0")), (3, full["GPL-2.0-or-later"]), (4, full["GPL-3.0-or-later"]), (5, full["AGPL-3.0-or-later"]), (6, full["BSD-2-Clause"]), (7, full["BSD-3-Clause"])]
    got = {}
    for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {0: {"GPL-2.0"}, 1: {"GPL-3.0"}, 2: {"GPL-2.0", "GPL-3.0"}, 3: {"GPL-2.0-or-later"}, 4: {"GPL-3.0-or-later"}, 5: {"AGPL-3.0-or-later"}, 6: {"BSD-2-Clause", "BSD"}, 7: {"BSD-3-Clause", "BSD"}}


def test_short_notices(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    texts = ["All rights reserved.", f"{filler}\n(c) 2020 X, ALL RIGHTS -- RESERVED\n{filler}", "all rights", f"{filler} rights all reserved", "All rights. Reserved. All rights reserved", "", None, f"{filler} All rights reserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(0, 1.0), (1, 1.0), (4, 1.0), (7, 1.0)]
    got = license_scan(df).collect()
    assert sorted((r.doc_id, r.containment) for r in got) == found
    assert {(r.template_id, r.license, r.n_template, r.n_shared) for r in got} == {(len(NOTICES), "All rights reserved", 1, 1)}
    items = [(0, "rights"), (1, "Rights!"), (2, "all rights"), (3, "w1 w2 w3 w4"), (4, "w1 w2 w3 w4 w5"), (5, "w1 w3"), (6, "...")]
    got = contained(df, spark.createDataFrame(items, "query_id long, text string"), short=True)
    want = [(i, q) for q, s in items for i, t in enumerate(texts) if re.sub(r"\W+", " ", s).strip() and re.search(r"\b" + r"\W+".join(re.findall(r"\w+", s)) + r"\b", t or "", re.I)]
    assert sorted((r.doc_id, r.query_id) for r in got.collect()) == sorted(want)
