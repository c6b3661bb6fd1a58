import hashlib
import random
import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from framelake.llm import chat
from framelake.llm import fingerprint as fp


def shingles(t, n=5):
    w = [x for x in re.split("[ \t-\r]+", t or "") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def sketch_by_hand(text, k=fp.K):
    """Spark's xxhash64 has the seed 42, and each value's hash is the next one's seed."""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    codes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    found = set()
    for i in range(len(codes) - 4):
        h = 42
        for c in codes[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", c), h)
        found.add(h)
    if 0 < len(words) < 5:
        found.add(xxhash.xxh64_intdigest(struct.pack("<i", len(words)), xxhash.xxh64_intdigest(" ".join(words).encode(), 42)))
    return sorted(h - 2**64 if h >= 2**63 else h for h in found)[:k]


def alike_by_hand(a, b, k=fp.K):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def all_by_hand(rows):
    """n_chars, edited_sha256, the fingerprints and both likenesses of every row."""
    tie = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 1
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1].encode()))
    out, text_of = [], lambda s: "".join(f"{h & (2**64 - 1):016X}" for h in s)
    for k, (i, t) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, other, then = sketch_by_hand(t), sketch_by_hand(edited), sketch_by_hand(following)
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(other), alike_by_hand(own, other), alike_by_hand(own, then)))
    return sorted(out)


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_fingerprints_by_hand(docs, rows, spark, per_range, monkeypatch):
    real = fp.next_documents
    monkeypatch.setattr(fp, "next_documents", lambda d, f: real(d, f, per_range))
    hot = [(5 if k % 3 else None, f"w{k % 50} " * (k % 7) + "x") for k in range(150)]
    for table, data in ((docs, rows), (spark.createDataFrame(hot, "doc_id long, text string").repartition(3), hot)):
        got = sorted((str(r[0]), *r[1:]) for r in map(tuple, fp.fingerprints(table).select(*NAMES).collect()))
        assert got == all_by_hand(data)


def test_one_id_for_most(spark, monkeypatch):
    monkeypatch.setattr(fp, "CUTS", 4)
    real = fp.next_documents
    monkeypatch.setattr(fp, "next_documents", lambda d, f: real(d, f, 5))
    data = [(7 if k % 4 else k, f"a{k % 60} b c d e f{k}") for k in range(200)] + [(None, "n o p q r s")] * 3 + [(None, f"{k}") for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, fp.fingerprints(df).select(*NAMES).collect())) == all_by_hand(data)
    assert fp._dealt(df, 5).groupBy(fp.RANGE).count().agg(F.max("count")).first()[0] < 30


def test_estimates(docs, rows):
    texts = {}
    for r in fp.fingerprints(docs).collect():
        texts.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if sum(1 for j, _ in rows if j == i) > 1:
            continue
        (r,) = texts[i]
        n = len(shingles(t))
        assert len(r.fingerprint) == 16 * min(n, fp.K)
        assert r.n_shingles == n if n < fp.K else abs(r.n_shingles / n - 1) < 0.4
        assert 0 <= r.in_edited <= 1


def test_equal_texts_and_exact_small_sets(spark):
    pairs = [("a b c d e f g", "a b c d e f g"), ("a b c d e f g", "x b c d e f g"), ("a", "a"), ("", None), ("a b c d e", "b c d e f"), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "x"), "b", "y")
    got = df.select("a", "b", fp.resemblance(F.col("x"), F.col("y")), fp.containment(F.col("x"), F.col("y"))).collect()
    for a, b, near, inside in got:
        x, y = shingles(a), shingles(b)
        assert near == pytest.approx(len(x & y) / len(x | y) if x | y else 1)
        assert inside == pytest.approx(len(x & y) / len(x) if x else 1)


def test_merge_is_the_sketch_of_the_whole(spark):
    words = [f"w{i}" for i in range(500)]
    whole = " ".join(words)
    parts = [(1, " ".join(words[i : i + 104])) for i in range(0, 500, 100)]
    one = fp.with_sketch(spark.createDataFrame([(1, whole)], "k int, t string"), "t", "s").first().s
    many = fp.with_sketch(spark.createDataFrame(parts, "k int, t string").repartition(3), "t", "s")
    assert fp.merge_groups(many, ["k"], "s").first().s == one
    a, b = (fp.with_sketch(spark.createDataFrame([(1, " ".join(words[x:y]))], "k int, t string"), "t", n).drop("t") for x, y, n in ((0, 304, "a"), (300, 500, "b")))
    assert a.join(b, "k").select(fp.merge(F.col("a"), F.col("b"))).first()[0] == one


def test_no_python_runs(docs, spark):
    conv = spark.createDataFrame([(1, 1, "a", "x")], "conv_id long, turn long, role string, text string")
    for df in (fp.fingerprints(docs), chat.rotate_perspectives(conv)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


CONVERSATIONS = [
    (1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_start|>assistant"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 4, "c d|e", "é😀"), (2, 0, "system", "alone"), (3, None, "x", "first"), (3, 5, None, "who"),
    (3, 600, "x", "late"), (None, 1, "x", "no id"), (None, 2, "y", "no id"), (4, 1, "b", "tie"), (4, 1, "a", "tie"), (4, -3, "a", ""), (5, 1, "user", "x" * 100_000), (5, 2, "assistant", "y"),
]


def rendered_by_hand(rows, context=("system",)):
    """{(dialogue, speaker): (rendering, spans)}, a turn at a time."""
    dialogues = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        role, text = role or "unknown", (text or "").replace("<|", "< |")
        rank = (turn is not None, turn or 0, "" if turn is not None else hashlib.sha256(f"{role}|{text}".encode()).hexdigest(), role, text)
        dialogues.setdefault((conv, None if conv is not None else k), []).append((rank, role, text))
    out = {}
    for d, said in dialogues.items():
        said.sort(key=lambda x: x[0])
        for speaker in {r for _, r, _ in said} - set(context):
            whole, spans = "", []
            for _, role, text in said:
                label = "assistant" if role == speaker else role if role in context else "user name=" + re.sub(r"[\s<>|]+", "_", role)
                whole += f"<|im_start|>{label}\n"
                if role == speaker:
                    spans.append((len(whole), len(whole) + len(text) + 11))
                whole += f"{text}<|im_end|>\n"
            out[d, speaker] = whole, spans
    return out


def long_dialogue():
    rnd = random.Random(6)
    rows = [(10, i, rnd.choice(["ann", "bob", "system", "c c"]), "t" * rnd.randrange(9)) for i in range(1500)]
    rows += [(11, 10**9 * i, rnd.choice("xy"), f"stamp {i}") for i in range(40)]
    return rows + [(12, None, rnd.choice("xyz"), f"no number {i % 30}") for i in range(60)] + [(13, i, "xy"[i % 2], "over a border") for i in range(500, 520)]


@pytest.mark.parametrize("page_turns", [7, 100, chat.PAGE_TURNS])
def test_perspectives(spark, page_turns):
    rows = CONVERSATIONS + long_dialogue()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"speaker": F.lit(1), "page": F.lit("x"), "said": F.lit(2), "chunk": F.lit(2)}).repartition(3)
    got = chat.rotate_perspectives(df, page_turns=page_turns)
    con = duckdb.connect()
    table = df.select("conv_id", "turn", "role", "text").toPandas()
    con.register("raw", table)
    con.sql("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM raw")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    columns = ", ".join(got.columns)
    found = got.collect()
    assert sorted(map(tuple, found), key=key) == sorted(con.sql(f"SELECT {columns} FROM ({chat.oracle(page_turns=page_turns)})").fetchall(), key=key)
    whole, spans = {}, {}
    for r in sorted(found, key=lambda r: r.page):
        if r.conv_id is not None:
            k = r.conv_id, r.speaker
            assert r.start == len(whole.get(k, ""))
            whole[k] = whole.get(k, "") + r.rendered
            spans.setdefault(k, []).extend(tuple(map(int, s.split(":"))) for s in r.mask.split())
            assert r.n_turns <= page_turns + chat.RANGE
    want = rendered_by_hand(rows)
    assert {k: (whole[k], spans[k]) for k in whole} == {(d[0], s): v for (d, s), v in want.items() if d[0] is not None}
    assert sorted(r.rendered for r in found if r.conv_id is None) == sorted(v[0] for (d, _), v in want.items() if d[0] is None)
    ann = next(r for r in found if (r.conv_id, r.speaker) == (1, "ann"))
    assert ann.rendered.startswith("<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n< |im_start|>assistant<|im_end|>")
    assert not [r for r in found if r.conv_id == 2]
    if page_turns == chat.PAGE_TURNS:
        assert {r.page for r in found if r.conv_id != 10} == {0}  # ordinary dialogues are one row, however numbered


def test_perspectives_of_nothing(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
