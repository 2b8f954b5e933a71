import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def odd_texts():
    """Nulls, empties, white space, one long word, very long texts, exact copies, near copies, shared passages."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    base = prose(400)
    near = base.split(" ")
    near[200] = "changed"
    long = prose(9000)
    return [
        None, "", " \t\n ", "x" * 700, "a" * 450, base, base, " ".join(near), prose(30) + " " + passage + " " + prose(40),
        passage + "\n" + prose(50), prose(20) + "\n" + passage, long, prose(5) + long[100:9000], prose(300) + "\x0b" + "😀 ñ" * 60, "word",
        "one two", "One TWO", "one  two\tthree", "Key: [1] #$%| <b>", "tick tock " * 80, "l1 a\nl2 b\nl1 a\n\n \nl1 a",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, odd_texts())


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"
