import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm.language_id import codewords, fit, identify, language_id, learn
from framelake.llm.linear import bounded_sample, fold_case
from framelake.llm.textops import Chunk, byte_span_hashes
from framelake.llm.toxicity import IDENTITY_GROUPS, PREFIXES, Swaps, changes, features, fit as fit_toxicity, swapped, toxicity

SYLLABLES = {"aa": "ka lo mi tu ra".split(), "bb": "sche ung ber lich ein".split(), "cc": "tion eau oui le que".split()}


def made(lang, rnd, k):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(k))


@pytest.fixture(scope="module")
def languages(spark):
    rnd = random.Random(1)
    rows = [(i, made(lang, rnd, rnd.randint(3, 60)), lang) for i in range(400) for lang in [rnd.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (1003, "ЖЩ", None), (1004, made("aa", rnd, 20_000), "aa"), (None, "kalo", "aa"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)}).repartition(3)


def test_languages(languages):
    got = language_id(languages).collect()
    assert len(got) == languages.count()
    truth = {(r.doc_id): r.lang for r in languages.collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred in SYLLABLES
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 50
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_languages_without_labels(languages, no_docs):
    nothing = language_id(languages.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    one = language_id(languages.where("lang = 'aa' and doc_id < 100"))
    assert {r.lang_pred for r in one.collect()} == {"aa"}
    assert language_id(no_docs).count() == 0


@pytest.mark.parametrize("n", [2, 3, 6, 7, 30])
def test_codewords_correct_errors(n):
    code = codewords(n).astype(int)
    apart = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)].min()
    assert apart >= (2 ** (n - 2) if n <= 6 else code.shape[1] // 4)
    assert (np.abs(code.sum(0)) < n).all()


def test_decoding_mends_a_wrong_bit():
    rng = np.random.default_rng(0)
    x = np.eye(4, 4096, dtype=np.float32)[rng.integers(0, 4, 200)]
    labels = x.argmax(1)
    model = fit(x, labels, list("abcd"))
    assert (model.losses(x).argmin(1) == labels).all()
    model.weights[:, 0] *= -1
    assert (model.losses(x).argmin(1) == labels).all()


def grams_by_hand(text):
    """Unit vector of log counts of the hashed runs of one to three folded bytes."""
    buf, x = fold_case(np.frombuffer(text.encode(), np.uint8)).tolist(), np.zeros(4096)
    for n in (1, 2, 3):
        for i in range(len(buf) - n + 1):
            code = sum(b << (8 * k) for k, b in enumerate(buf[i : i + n])) | n << 24
            x[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    x = np.log1p(x)
    return x / max(np.sqrt((x * x).sum()), 1e-6)


def decoded_by_hand(model, text, margin=0.05):
    """Language, score and doubt: every bit's loss to every codeword, weighted, one at a time."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    z = [float((grams_by_hand(text) - model.mean) @ model.weights[:, b] + model.bias[b]) for b in range(model.code.shape[1])]
    losses = [sum(float(model.trust[i, b]) * np.log1p(np.exp(-z[b] * float(model.code[i, b]))) for b in range(len(z))) for i in range(len(model.languages))]
    p = np.exp(-np.array(losses) * len(z))
    p /= p.sum()
    best = int(np.argmin(losses))
    rest = sorted(p)[-2] if len(p) > 1 else 0
    return model.languages[best], p[best], p[best] - rest < margin


def test_decoding_by_hand(languages, spark):
    model = learn(languages.where("doc_id < 300"))
    rnd = random.Random(9)
    texts = [None, "", "12 !", "Ж", "a"] + [made(lang, rnd, k) for lang in SYLLABLES for k in (1, 2, 5, 40)]
    texts += [" ".join(made(lang, rnd, 2) for lang in pair) for pair in (("aa", "bb"), ("bb", "cc"), ("aa", "cc"), ("aa", "bb", "cc")) for _ in range(10)]
    got = identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model)
    doubts = 0
    for r in got.collect():
        lang, score, doubt = decoded_by_hand(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)
        if abs(score - 0.05) > 1e-3:
            assert r.ambiguous == doubt or abs(score) < 1e-9
        doubts += r.ambiguous and lang != "und"
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    assert doubts  # texts of several languages


def test_a_text_between_two_languages_is_ambiguous(spark):
    rnd = random.Random(2)
    rows = [(i, made(lang, rnd, 30), lang) for i in range(200) for lang in ("aa", "bb")]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    flip = identify(spark.createDataFrame([(0, "zzz zz z"), (1, made("aa", rnd, 30)), (2, made("bb", rnd, 30))], "doc_id long, text string"), model, margin=0.9)
    assert {r.doc_id: r.ambiguous for r in flip.collect()} == {0: True, 1: False, 2: False}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, len(r.text or "")) for r in docs.collect()}
    held = [r for r in language_id(docs).collect() if r.held_out and truth[r.doc_id][0] and r.lang_pred != "und"]
    assert len(held) > 150
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.98


def test_fold_case():
    text = "AbÉÀ×÷ß, ZÜ9".encode()
    assert fold_case(np.frombuffer(text, np.uint8)).tobytes().decode() == "abéà×÷ß  zü "


def test_sample_is_bounded(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    sample, labels, counts = bounded_sample(df, "y", 500)
    got = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    assert labels == [0, 1] and counts == {0: 19_800, 1: 200}
    assert got[1] == 200 and 350 < got[0] < 650


def test_samples_are_bounded_when_one_id_is_everywhere(spark):
    many = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("aa").alias("lang"))
    sample, _, _ = bounded_sample(many, "lang", 500, ("doc_id", "text"))
    assert 350 < sample.count() < 650
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("vile "), "id").alias("text"))
    other = spark.range(100, 200).select(F.col("id").alias("doc_id"), F.concat(F.lit("nice "), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1)] * 500 + [(i, 0) for i in range(100, 200)] + [(None, 1)] * 500, "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity(same.union(other), labels, held_out_fold=-1).collect()}
    assert len(scores) == 101 and all(0 <= s <= 1 for s in scores.values())


@pytest.fixture(scope="module")
def comments(spark):
    rnd = random.Random(3)
    plain = ["word%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 30))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(0, rnd.choice(["horrid", "vile", "grotxa", "grotxb", "grotxc"]) + rnd.choice(["", "zz", "yy"]))
        if rnd.random() < (0.7 if toxic else 0.05):  # a group that insults often name
            words.insert(1, "muslims")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "9 8"), (None, "vile"), (7, docs[7][1])]
    docs += [(6000 + i, "muslims " + " ".join(rnd.choice(plain) for _ in range(8))) for i in range(50)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(9)}), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity(comments):
    docs, labels = comments
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    empty = {round(r.score, 6) for r in got if r.doc_id in (5000, 5001, 5002)}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_counterfactuals_clear_neutral_mentions(comments, spark):
    docs, labels = comments
    rnd = random.Random(4)
    # insults that only the group's name gives away
    veiled = [(2000 + i, "muslims " + " ".join(f"word{rnd.randrange(300)}" for _ in range(8))) for i in range(150)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(veiled, "doc_id long, text string"))
    labels = labels.union(spark.createDataFrame([(i, 1) for i, _ in veiled], "doc_id long, toxic int"))
    mean = lambda **kw: np.mean([r.score for r in toxicity(docs, labels, **kw).collect() if r.doc_id is not None and r.doc_id >= 6000])
    free, held = mean(strength=0.0), mean(strength=10.0)
    assert free > 0.4
    assert held < 0.6 * free


def by_hand(text, kept=None):
    """Features of a text, a word at a time: {(kind, bytes): log count}, and its log number of words."""
    buf = fold_case(np.frombuffer(text.encode(), np.uint8)).tobytes()
    words = buf.split()
    count = Counter(("word", w) for w in words)
    for k in PREFIXES:
        count.update(("prefix", w[:k]) for w in words if len(w) > k)
    return {f: np.log1p(n) for f, n in count.items()}, np.log1p(len(words))


def code_of(feature):
    kind, data = feature
    code = byte_span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
    return int(code[0] ^ np.uint64(0x5851F42D4C957F2D if kind == "prefix" else 0))


def test_swaps_are_texts():
    groups = (("he", "she"), ("muslims", "jews", "hindus"))
    assert swapped("He saw the Muslims, the help, he!", groups) == ["she saw the Muslims, the help, she!", "He saw the jews, the help, he!", "He saw the hindus, the help, he!"]
    assert swapped("sheer ache _he_ 3he", groups) == ["sheer ache _she_ 3she"]
    assert swapped("", groups) == swapped("nobody", groups) == []


def test_the_fit_minimises_the_objective():
    """Loss and penalty as the docstring has them, with swapped texts turned into features by hand."""
    rnd, groups = random.Random(5), (("ba", "co", "di"),)
    texts = [" ".join(rnd.choice(["ba", "co", "di", "vile", "wordlong", "wordy", "x"]) for _ in range(rnd.randrange(1, 9))) for _ in range(120)]
    labels = np.array([int("vile" in t or (t.count("ba") > 1 and rnd.random() < 0.8)) for t in texts])
    vocabulary = sorted({f for t in texts for u in [t, *swapped(t, groups)] for f in by_hand(u)[0]})
    dense = lambda t: np.array([by_hand(t)[0].get(f, 0.0) for f in vocabulary])
    x, length = np.array([dense(t) for t in texts]), np.array([by_hand(t)[1] for t in texts])
    pairs = [[dense(u) - dense(t) for u in swapped(t, groups)] for t in texts]
    wanted = np.unique(np.array([code_of(f) for f in vocabulary], np.uint64))
    data = [t.encode() for t in texts]
    chunk = Chunk(None, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    got, share, at = [changes(t, groups, wanted) for t in texts], [], []
    for p, (swap, code, value) in zip(pairs, got):
        assert len(p) == (swap.max() + 1 if len(swap) else 0)
        for k, d in enumerate(p):
            have = dict(zip(code[swap == k].tolist(), value[swap == k].tolist()))
            assert have == pytest.approx({code_of(f): v for f, v in zip(vocabulary, d) if v})
        at += [len(share) + s for s in swap]
        share += [1 / len(p)] * len(p) if p else []
    mentions = sum(bool(p) for p in pairs)
    swaps = Swaps(np.array(share) / mentions, np.array(at), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]))
    for strength in (0.0, 1.0):
        model = fit_toxicity(features(chunk), labels, swaps, strength, decay=1e-3, rounds=4000)
        w = np.array([model.weights[np.searchsorted(model.vocabulary, np.uint64(code_of(f)))] for f in vocabulary])

        def objective(w, by_length, bias):
            z = x @ w + by_length * length + bias
            loss = (np.logaddexp(0, z) - labels * z).mean() + 1e-3 / 2 * (w @ w)
            return loss + strength * sum(np.mean([(d @ w) ** 2 for d in p]) for p in pairs if p) / mentions

        best = objective(w, model.by_length, model.bias)
        rng = np.random.default_rng(0)
        for _ in range(40):
            step = rng.normal(size=len(w) + 2) * 0.05
            assert objective(w + step[:-2], model.by_length + step[-2], model.bias + step[-1]) > best - 1e-5
        z = x @ w + model.by_length * length + model.bias
        assert model.score(*features(chunk, model.vocabulary)) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_swaps_are_active_on_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = [r.text for r in docs.join(labels, "doc_id").collect()]
    assert sum(bool(swapped(t or "", IDENTITY_GROUPS)) for t in texts) > 0.2 * len(texts)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for strength in (0.0, 10.0):
        held = [r for r in toxicity(docs, labels, strength=strength).collect() if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
        assert sum(r.predicted > truth[r.doc_id] for r in held) <= 0.02 * len(held)


def test_toxicity_without_labels(comments, no_docs, spark):
    docs, labels = comments
    assert {r.predicted for r in toxicity(docs, labels.where("false")).collect()} == {0}
    assert {r.predicted for r in toxicity(docs, labels.where("toxic = 0")).collect()} == {0}
    assert toxicity(no_docs, labels).count() == 0
    assert all(len(set(g)) == len(g) > 1 for g in IDENTITY_GROUPS)
