"""Packing, byte-level BPE and quality rules against the libraries and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paperlake.llm import bpe, packing, quality_rules, queries

from .conftest import DDL, make, odd_texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def odd_strings():
    rng = random.Random(3)
    out = [t or "" for t in odd_texts()] + ["a b c　d", "é ́x\x1cz", "naïve STRASSE ß ×÷ ªµ Ÿİ", "<|endoftext|> x", "it's 'S I'LL 123 ½", "՘࢏ a", "\U0003e3a4땑"]
    for _ in range(200):
        out.append("".join(chr(rng.choice([rng.randint(32, 127), rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), 32, rng.randint(0xE000, 0x10FFFF)])) for _ in range(50)))
    return out


def test_word_ids_are_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    texts = odd_strings()
    mine = packing.WordTokenizer(WORDS).encode([t.encode() for t in texts])
    assert [m.tolist() for m in mine] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(got, texts, ids, capacity=4096):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    want = Counter()
    for i, t in zip(ids, texts):
        tokens = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, a in enumerate(range(0, len(tokens), capacity)):
            part = tokens[a : a + capacity]
            want[i, p, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, odd, sf):
    texts = odd_texts()
    check_packing(packing.packed(odd.withColumn("_salt", F.lit("x")), WORDS, 64).collect(), texts, range(len(texts)), 64)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op2_best_fit_packing(spark, sf).collect()
    bins = check_packing(got, [r[1] for r in docs], [r[0] for r in docs])
    assert bins <= -(-sum(r.length for r in got) // 4096) + 1
    again = spark.createDataFrame([(1, "a b", "", "", 1), (1, "a b", "", "", 1), (None, "c", "", "", 1)], DDL)
    check_packing(packing.packed(again, WORDS).collect(), ["a b", "a b", "c"], [1, 1, None])
    assert packing.packed(odd.where("false"), WORDS).count() == 0


def test_best_two_fit_keeps_every_piece():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        count = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        bins = packing.best_two_fit(count, capacity)
        held = Counter()
        for copies, sizes in bins:
            assert sum(sizes) <= capacity
            for n in sizes:
                held[n] += copies
        assert held == count
    # greedy leaves 10 = 6 + 3; the pair 2 + 2 in place of the 3 fills it
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (40, 7), (3, 1)])
def test_bpe(spark, chunk, overlap):
    texts = [None, *odd_strings()] if chunk > 3 else [None, "", "x" * 30, "it's  \n 12 do", " " * 20]
    library = encoding()
    want = {}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want[i] = (ids, (t or "").encode())
    got = bpe.encoded(make(spark, texts).withColumn("row", F.lit(1)), RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
    assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in got} == want and len(got) == len(texts)


def test_bpe_query(spark, sf):
    library = encoding()
    want = set()
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = queries.op4_byte_bpe(spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    flag = [False] * len(words)
    for i in range(len(words) - 4):
        if count[tuple(words[i : i + 5])] > 1:
            flag[i : i + 5] = [True] * 5
    n, repeat = len(words), sum(flag)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, n < 10 or 100 * repeat > 20 * n


def test_quality_counts(spark, odd, sf):
    cases = odd_strings() + ["a b c d e f a b c d e f g h i j k l m n o", "x", "x", "l\nl", "l", ""]
    got = quality_rules.counts(make(spark, cases).withColumn("n_words", F.lit("x"))).collect()
    for r in got:
        assert tuple(r)[1:7] == base(cases[r.doc_id]), cases[r.doc_id]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {r[0]: r[1] for r in docs}
    got = queries.op6_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r)[1:7] == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality_rules.counts(odd.where("false")).count() == 0


def test_cascade_order_changes_no_verdict():
    raw = [(t or "").encode() for t in odd_strings()]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    rules = quality_rules.production_rules()
    want = np.any([r.rejects(quality_rules.Block(data, offsets)) for r in rules], axis=0)
    rng = random.Random(2)
    for _ in range(10):
        rng.shuffle(rules)
        assert ((quality_rules.cascade(quality_rules.Block(data, offsets), rules) >= 0) == want).all()


def test_keep_holds_columns(spark, odd):
    kept = quality_rules.keep(odd)
    assert kept.schema == odd.schema and kept.count() == quality_rules.counts(odd).where("kept").count()
