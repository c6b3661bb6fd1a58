import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, payload string, score string, ids string, grp long, __text string, ambiguous int"
WORDS = "the of and alpha beta gamma delta été über niño straße 你好 x y zz".split()


def awkward_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, shared passages, periodic texts, repeated rows, ties."""
    rnd = random.Random(seed)
    words = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice("abcdefgh") for _ in range(k))
    passage, base = words(60), words(120)
    texts = [None, "", " \n\t", "one", "one two three four five six seven", base, base, base.replace("alphaa", "alphab", 1), passage, "é" * 80, "é" * 81, "a" * 300, "ab" * 200, "ab" * 150 + words(40), words(30_000), "\x00\x01 nul", "😀" * 60]
    for _ in range(n):
        kind = rnd.random()
        text = words(rnd.randint(0, 150))
        if kind < 0.3:
            text = f"{text}\n{passage} {words(rnd.randint(0, 20))}"
        elif kind < 0.5:
            parts = base.split()
            parts[rnd.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif kind < 0.6:
            text = f"{text} {text}"
        texts.append(text)
    rows = [(i * 3 % 101 + 100 * (i // 101), t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[20], rows[1], (None, base), (None, None), (7, "another text of the id seven " + passage), (7, None), (-5, passage)]
    return [(i, t, rnd.choice(["en", "fr", None]), "s", None if t is None else len(t), 1, "p", "x", None, 2, "t", 0) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1]) for r in awkward_rows()]
