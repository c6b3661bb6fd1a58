"""Every stage of the pipeline against a brute-force version of it, each on what the one before kept."""

import hashlib

import corpus_pipeline as p
import numpy as np
import pytest
import sentencepiece

from framelake.llm.graph import cut
from framelake.llm.language_id import learn
from framelake.llm.linear import fold_number
from framelake.llm.sentencepiece_fst import DEFAULT_MODEL
from tests.llm.test_classifiers import decoded_by_hand
from tests.llm.test_containment import grams
from tests.llm.test_near_duplicates import exact, weights

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score int, kept string, __text string, null int, key int, `hash` int, ids int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "one two three four five six seven"), (2, rows[9][1]), (None, " ".join(rows[30][1].split()[-9:]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    # wholes cut inside a character, and a genuine U+FFFD
    more = [(900, "\ufffd \u00e9" + "z" * 49 + " tail \ufffd"), (901, "other \u00ea" + "z" * 49 + " end \ufffd"), (902, "\u00c3" + "z" * 49 + "\ufffd"), (903, "w " * 40 + "z" * 49 + "\u00e9x")]
    data = [(i, t, ["en", "fr"][k % 2], "s", None if t is None else len(t), "x", k, "y", "z", 1, 2, 3, 4) for k, (i, t) in enumerate(rows + more)]
    spark.createDataFrame(data, COLUMNS).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{path}/none.parquet")
    return path


def order(i):
    return (i is None, i or 0)


def languages_by_hand(docs):
    model = learn(docs.where(fold_number(4) != 2))
    return [(r.doc_id, r.text) for r in docs.collect() if not decoded_by_hand(model, r.text or "")[2]]


def near_by_hand(docs):
    """One row of each class of like texts: a least id's, whatever text of several it has that stays."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    texts = sorted({t for _, t in rows})
    own, label = [weights(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(own):
        for j in range(i):
            if a and own[j] and label[i] != label[j] and exact(a, own[j]) >= 0.8 - 1e-9:
                label = [label[j] if x == label[i] else x for x in label]
    where, classes = dict(zip(texts, label)), {}
    for i, t in rows:
        classes.setdefault(where[t], []).append((order(i), hashlib.sha256(t.encode()).digest(), i, t))
    return [min(c, key=lambda r: r[:2])[2:] for c in classes.values()]


def suffixes_by_hand(docs, width=50):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for i, b in rows:
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, (True, 1)), order(i))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < order(i):
                gone[s : s + width] = b"\1" * width
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else b.decode()
        if not any(gone) or text.strip(" "):
            out.append((i, text))
    return out


def clean_by_hand(docs, items):
    own = [grams(t) for t in items]
    return [(r.doc_id, r.text) for r in docs.collect() if not any(g and len(g & grams(r.text)) >= 0.8 * len(g) - 1e-9 for g in own)]


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (order(r[0]), r[1] or ""))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    by_hand = {"language_id": languages_by_hand, "near_dedup": near_by_hand, "suffix_array_dedup": suffixes_by_hand, "decontamination": lambda d: clean_by_hand(d, items)}
    for name, stage in p.STAGES[:-1]:
        out = cut(stage(spark, docs, folder))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        want = sorted(by_hand[name](docs), key=lambda r: (order(r[0]), r[1] or ""))
        assert rows_of(out) == want
        assert out.count() < docs.count() or name == "suffix_array_dedup"
        assert all(r.n_chars == len(r.text) for r in out.collect())
        # other columns stay with their rows
        known = {(r.doc_id, r.score): (r.lang, r.key) for r in docs.collect()}
        assert all(known[r.doc_id, r.score] == (r.lang, r.key) for r in out.collect())
        docs = out
    assert any("\ufffd" in r.text for r in docs.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    last = p.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == docs.count() and all(r.round_trip for r in last)
    want = sorted((order(r.doc_id), tuple(library.encode(r.text))) for r in docs.collect())
    assert sorted((order(r.doc_id), tuple(r.ids)) for r in last) == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() and r.n_pieces == len(r.ids) for r in last)
    whole = p.run(spark, folder).collect()
    assert sorted((order(r.doc_id), tuple(r.ids)) for r in whole) == want


def test_stages_take_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/none.parquet")
    for _, stage in p.STAGES:
        assert stage(spark, none, folder).count() == 0
