"""Repeated windows (suffix-array dedup, substring dedup) against counting every window."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import queries, substring_dedup, suffix_dedup, windows
from paperlake.llm.automaton import SuffixAutomaton
from paperlake.llm.esa import maximal_repeats

from .conftest import DDL, make, odd_texts


def covered(tokens, window):
    count = Counter(tuple(t[i : i + window]) for t in tokens for i in range(len(t) - window + 1))
    out = []
    for t in tokens:
        flags = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                flags[i : i + window] = [True] * window
        out.append(flags)
    return out


def byte_rows(ids, texts, window):
    tokens = [(t or "").encode() for t in texts]
    out = []
    for i, t, flags in zip(ids, tokens, covered(tokens, window)):
        runs = sum(f and not g for f, g in zip(flags, [False, *flags]))
        out.append((i, len(t), sum(flags), runs, hashlib.sha256(bytes(b for b, f in zip(t, flags) if not f)).hexdigest()))
    return sorted(out, key=str)


def word_rows(ids, texts, window):
    tokens = [(t or "").encode().split() for t in texts]
    return sorted(
        ((i, len(t), sum(flags), hashlib.sha256(b" ".join(w for w, f in zip(t, flags) if not f)).hexdigest()) for i, t, flags in zip(ids, tokens, covered(tokens, window))),
        key=str,
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot,busy", [(windows.HOT, windows.BUSY), (1, 1)])
@pytest.mark.parametrize("window", [200, 20])
def test_bytes(spark, odd, monkeypatch, hot, busy, window):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "BUSY", busy)
    texts = odd_texts()
    assert rows(suffix_dedup.digest(odd, window)) == byte_rows(range(len(texts)), texts, window)


@pytest.mark.parametrize("hot", [windows.HOT, 1])
@pytest.mark.parametrize("window", [35, 6])
def test_words(spark, odd, monkeypatch, hot, window):
    monkeypatch.setattr(windows, "HOT", hot)
    texts = odd_texts()
    assert rows(substring_dedup.digest(odd, window)) == word_rows(range(len(texts)), texts, window)


def test_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(100)))
    data = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, "other " * 3 + "text", "en", "s", 1), (None, text[40:], "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(data, DDL)
    ids, texts = [r[0] for r in data], [r[1] for r in data]
    assert rows(suffix_dedup.digest(df)) == byte_rows(ids, texts, 200)
    assert rows(substring_dedup.digest(df)) == word_rows(ids, texts, 35)


def test_clashing_columns_and_empty(spark, odd):
    extra = odd.withColumn("k", F.lit(1)).withColumn("t", F.lit(2)).withColumn("h", F.lit(3)).withColumn("spans", F.lit("x"))
    assert rows(suffix_dedup.digest(extra)) == rows(suffix_dedup.digest(odd))
    kept = suffix_dedup.remove(extra)
    assert kept.columns == extra.columns and kept.count() == extra.count()
    none = odd.where("false")
    assert rows(suffix_dedup.digest(none)) == [] == rows(substring_dedup.digest(none))


def test_queries_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, texts = [r[0] for r in docs], [r[1] for r in docs]
    assert rows(queries.op3_suffix_array_dedup(spark, sf)) == byte_rows(ids, texts, 200)
    assert rows(queries.op10_substring_dedup(spark, sf)) == word_rows(ids, texts, 35)


def test_remove(spark, odd):
    passage = "".join(f"{i:04d}" for i in range(100))
    df = make(spark, ["A" + passage + "é", "C" + passage, "clean", None])
    assert [tuple(r) for r in suffix_dedup.remove(df).orderBy("doc_id").select("text", "n_chars").collect()] == [("Aé", 2), ("C", 1), ("clean", 5), (None, None)]


@pytest.mark.parametrize("hot,busy", [(windows.HOT, windows.BUSY), (1, 2)])
def test_repeat_groups(spark, odd, monkeypatch, hot, busy):
    """Each group is one string with all its places, and is closed; all repeated windows are in groups."""
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "BUSY", busy)
    window = 40
    texts = [(t or "").encode() for t in odd_texts()]
    rows = [r for i, t in enumerate(texts[:5] + texts[6:]) for r in [(i, t)]]  # exact copies have further tests
    texts = dict(rows)
    df = spark.createDataFrame([(i, t.decode(), "", "", 1) for i, t in rows], DDL)
    places = defaultdict(set)
    for i, t in texts.items():
        for j in range(len(t) - window + 1):
            places[t[j : j + window]].add((i, j))
    groups = defaultdict(set)
    for r in suffix_dedup.repeats(df, window).collect():
        groups[r.group_id].add((r.doc_id, r.start, r.length))
    covered_places = set()
    for found in groups.values():
        (length,) = {n for _, _, n in found}
        at = {(i, j) for i, j, _ in found}
        i, j = min(at)
        word = texts[i][j : j + length]
        assert len(at) > 1 and length >= window
        assert at == {(d, p) for d, p in places[word[:window]] if texts[d][p : p + length] == word}
        covered_places |= {(d, p + x) for d, p in at for x in range(length - window + 1)}
        # a neighbouring window of all places belongs to it unless it differs or stands elsewhere too
        for shift in (-1, length - window + 1):
            beside = {texts[d][p + shift : p + shift + window] if p + shift >= 0 else (d, p) for d, p in at}
            if len(beside) == 1 and len(w := beside.pop()) == window:
                assert len(places[w]) > len(at)
    assert covered_places == {p for at in places.values() if len(at) > 1 for p in at}


def test_a_long_passage_is_one_group(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    df = make(spark, ["A" + passage + "x", "BB" + passage, passage + "z", "unrelated"])
    assert {tuple(r)[1:] for r in suffix_dedup.repeats(df).collect()} == {(0, 1, 3000), (1, 2, 3000), (2, 0, 3000)}


def test_long_texts_in_pieces(spark, monkeypatch):
    """Pieces of a long text, words cut by none of them, give what the whole text gives."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    texts = [long, "start " + long[50_000:90_000], "x" * 70_000 + " " + long[:3000], " " * 40_000 + long[60_000:61_000], None]
    monkeypatch.setattr(windows, "PIECE", 16_000)
    assert substring_dedup._without(texts[3].encode(), [(0, 3), (10, 40), (50, 51)], 30) == substring_dedup._without(texts[3].encode(), [(0, 3), (10, 40), (50, 51)])
    assert rows(suffix_dedup.digest(make(spark, texts))) == byte_rows(range(5), texts, 200)
    assert rows(substring_dedup.digest(make(spark, texts))) == word_rows(range(5), texts, 35)


@pytest.mark.parametrize("unit", ["byte", "word"])
def test_the_index_decides(spark, odd, monkeypatch, unit):
    monkeypatch.setitem(windows.INDEX, unit, lambda payload, *_: (np.zeros(0, np.int64),) * 4)
    digest = suffix_dedup.digest if unit == "byte" else substring_dedup.digest
    assert all(r.n_removed == 0 for r in digest(odd, 20 if unit == "byte" else 6).collect())


def test_index_structures():
    rng = random.Random(1)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        least = rng.randint(3, 8)
        want = {(i, j) for i, flags in enumerate(covered(strings, least)) for j, f in enumerate(flags) if f}
        got = set()
        for repeat, at in maximal_repeats(strings, least):
            assert at == [(i, j) for i, s in enumerate(strings) for j in range(len(s)) if s[j:].startswith(repeat)]
            got |= {(i, j + x) for i, j in at for x in range(len(repeat))}
        assert got == want
        automaton = SuffixAutomaton(strings)
        assert {(i, x) for i, s in enumerate(strings) for a, b in automaton.repeats(s, least) for x in range(a, b)} == want


def test_texts_without_id_and_of_one_32_bit_hash_stay_apart(spark):
    """A passage of one text must not be cut from another that has the same Murmur3 hash and no id either."""
    rng = random.Random(8)
    passage, other = ("".join(rng.choice("abcdefghijkl") for _ in range(260)) for _ in range(2))
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("i"))
    side = lambda text, name: ids.select(F.concat(F.lit(text), "i").alias(name)).withColumn("h", F.hash(name))
    a, b = side(passage, "a").join(side(other, "b"), "h").select("a", "b").orderBy("a").first()
    rows = [(None, a, "", "", 1), (None, b, "", "", 1), (1, passage + "!", "", "", 1)]
    left = {r.text for r in suffix_dedup.remove(spark.createDataFrame(rows, DDL), 200).collect()}
    assert left == {a.removeprefix(passage), b, "!"}


def test_word_spans(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(40)))), (2, " ".join(map(str, range(36)))), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.spans(docs).collect())) == [(1, 0, 36), (2, 0, 36)]
