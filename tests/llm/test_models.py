"""Language ID, quality model, media columns and line dedup."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import jpeg, langid, line_dedup, media, quality_model, queries

from .conftest import DDL, make, odd_texts


def test_langid_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.held_out and any(map(str.isalpha, docs[r.doc_id].text or "")):
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.98


def test_langid_cases(spark, odd):
    train = spark.createDataFrame([(i, t, lang, "", 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)] * 5)], DDL)
    scorer = langid.train(train)
    assert scorer.languages == ["de", "en"]
    cases = make(spark, [None, "", "12 ½ _", "the dog", "die katze", "日本"]).withColumn("rejected", F.lit(1))
    got = [r.lang_pred for r in langid.predict(cases, scorer).orderBy("doc_id").collect()]
    assert got[:5] == ["und", "und", "und", "en", "de"] and got[5] in ("de", "en")
    nothing = langid.train(train.where("false"))
    assert {r.lang_pred for r in langid.predict(cases, nothing).collect()} == {"und"}
    assert langid.predict(odd.where("false"), scorer).count() == 0


def test_langid_probabilities_sum_to_one():
    model = langid.Model({"ab": 3, "abc": 1, "ba": 2, "cab": 1})
    alphabet = ["a", "b", "c", "\n", "z"]
    for context in ("\n\n\n", "\n\na", "\nab", "zzz"):
        grams = np.array([[ord(x) for x in context + c] for c in alphabet], np.uint32).T
        assert math.isclose(np.exp(model.logs(grams)).sum(), 1, rel_tol=1e-9)


def kneser_ney(texts, order):
    """Plain interpolated modified Kneser-Ney; returns log p(last | before)."""
    levels = {order: Counter()}
    for t in texts:
        padded = "\x02" * (order - 1) + t
        levels[order].update(padded[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discount, total, mass = {}, defaultdict(float), defaultdict(float)
    for n, grams in levels.items():
        t = [sum(v == i for v in grams.values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
        discount[n] = [max(0.1, i - (i + 1) * y * t[i + 1] / t[i]) if t[i] else 0.5 for i in (1, 2, 3)]
        for g, v in grams.items():
            total[n, g[:-1]] += v
            mass[n, g[:-1]] += discount[n][min(v, 3) - 1]

    def p(gram):
        value = 1 / (len(levels[1]) + 1)
        for n in range(1, order + 1):
            g = gram[len(gram) - n :]
            key = (n, g[:-1])
            if key in total:
                v = levels[n].get(g, 0)
                value = (max(0, v - discount[n][min(v, 3) - 1]) if v else 0) / total[key] + mass[key] / total[key] * value
        return math.log(value)

    return p


@pytest.mark.parametrize("shard_rows", [10**6, 60])
def test_perplexity(spark, shard_rows):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["the", "cat", "dog", "sat", "ñandú", "mat"]) for _ in range(n))
    texts = [prose(rng.randint(3, 30)) for _ in range(60)] + [None, "", "zzz ### 日本", prose(2000)]
    langs = ["en"] * 40 + ["es"] * 20 + [None, "en", "fr", "en"]
    df = spark.createDataFrame([(i, t, lang, "", 1) for i, (t, lang) in enumerate(zip(texts, langs))], DDL).withColumn("logs", F.lit("x"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in df.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_model.HOLD)) == 0).collect()}
    learned = {"en": [i for i in range(40) if i not in held], "es": [i for i in range(40, 60) if i not in held]}
    models = {x: kneser_ney([texts[i] for i in ids], quality_model.ORDER) for x, ids in learned.items()}
    every = kneser_ney([texts[i] for ids in learned.values() for i in ids], quality_model.ORDER)
    got = {r.doc_id: r for r in quality_model.score(df, labels, shard_rows=shard_rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if not t:
            assert got[i].perplexity is None and not got[i].kept
            continue
        p = models.get(langs[i], every)
        padded = "\x02" * (quality_model.ORDER - 1) + t
        want = math.exp(-sum(p(padded[j : j + quality_model.ORDER]) for j in range(len(t))) / len(t))
        assert math.isclose(got[i].perplexity, want, rel_tol=1e-6)
    assert not got[62].kept and got[63].kept


def test_thresholds_are_the_languages_own(spark):
    """All trusted texts calibrate, each by a model without its fold; few ones of a language take its median."""
    rng = random.Random(4)
    prose = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    many, few = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(200)], ["der", "hund", "und", "die"]
    texts = [prose(many, rng.randint(5, 20)) for _ in range(40)] + [prose(few, rng.randint(8, 25)) for _ in range(20)] + [prose(["xq", "hund", "der", "die"], 20)]
    langs = ["en"] * 40 + ["de"] * 21
    df = spark.createDataFrame([(i, t, lang, "", 1) for i, (t, lang) in enumerate(zip(texts, langs))], DDL)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    fold = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality_model.HOLD))).collect()}
    found = {}
    for f in range(quality_model.HOLD):
        for lang in ("en", "de"):
            p = kneser_ney([texts[i] for i in range(60) if langs[i] == lang and fold[i] != f], quality_model.ORDER)
            for i in (i for i in range(60) if langs[i] == lang and fold[i] == f):
                padded = "\x02" * (quality_model.ORDER - 1) + texts[i]
                found[i] = math.exp(-sum(p(padded[j : j + quality_model.ORDER]) for j in range(len(texts[i]))) / len(texts[i]))
    size = lambda i: sum(len(texts[i]) >= c for c in quality_model.CLASSES)
    assert {size(i) for i in range(60)} == {0} and sum(x == "en" for x in langs) >= quality_model.LEAST > 20
    of = {lang: sorted(found[i] for i in range(60) if langs[i] == lang) for lang in ("en", "de")}
    middle = {lang: v[math.ceil(len(v) / 2) - 1] for lang, v in of.items()}
    want = {"en": of["en"][-1], "de": middle["de"] * max(found[i] / middle[langs[i]] for i in found)}
    got = quality_model.score(df, labels).collect()
    assert all(math.isclose(r.threshold, want[r.lang], rel_tol=1e-6) for r in got)
    assert not next(r.kept for r in got if r.doc_id == 60)


def test_threshold_is_the_quantile_itself(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(100)]
    texts = [" ".join(rng.choice(words) for _ in range(15)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "en", "", 1) for i, t in enumerate(texts)], DDL)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    held = quality_model.score(df, labels, quantile=0.5).where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_model.HOLD)) == 0)
    assert 0.25 < held.agg(F.avg((~F.col("kept")).cast("int"))).first()[0] < 0.75


def test_quality_query_and_no_labels(spark, sf, odd):
    got = queries.op1_quality_classifier(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_model.score(odd, none).collect()
    assert len(rows) == odd.count() and all(r.perplexity is None and r.kept == (r.n_chars > 0) for r in rows)


def test_media(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df, got in ((docs, queries.op8_media_columns(spark, sf)), (odd, media.features(media.store(odd.withColumn("media", F.lit(1)))))):
        texts = {r[0]: (r[1] or "").encode() for r in df.select("doc_id", "text").collect()}
        rows = got.collect()
        assert len(rows) == len(texts)
        by_text = {}
        for r in rows:
            raw = media.padded(texts[r.doc_id])
            assert len(raw) % 192 == 0 and len(raw) >= 192
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
            assert by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.features(media.store(odd.where("false"))).count() == 0


def test_jpeg_round_trip():
    rng = random.Random(1)
    payloads = [bytes(rng.randrange(256) for _ in range(192 * n)) for n in (1, 2, 3, 7, 50)] + [b"\xff" * 384, bytes(range(192))]
    for p, (image, blocks) in zip(payloads, jpeg.decode(jpeg.encode(payloads))):
        assert jpeg.payload(image, blocks) == p


def test_jpeg_of_another_writer():
    """Zero runs, block ends, subsampled chroma, differential DC and no restart markers."""
    dc = {0: "00", 3: "01", 5: "10"}
    ac = {0x00: "00", 0x02: "01", 0xF0: "100", 0x31: "101"}

    def value(v):
        n = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(diff, symbols):
        return dc[abs(diff).bit_length()] + value(diff) + "".join(ac[s] + value(v) for s, v in symbols)

    chosen = [20, 20, 24, 24]  # differences 20 (5 bits), 0, 4 (3 bits), 0
    bits, last = "", 0
    for v in chosen:
        bits += block(v - last, [(0x02, 3), (0xF0, 0), (0x31, -1), (0x00, 0)])
        last = v
    bits += block(0, [(0x00, 0)]) * 2
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")

    def table(kind, codes):
        lengths = Counter(len(c) for c in codes.values())
        return jpeg._segment(0xC4, bytes([kind << 4]) + bytes(lengths[i] for i in range(1, 17)) + bytes(sorted(codes, key=lambda s: (len(codes[s]), codes[s]))))

    raw = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + bytes([16] + [1] * 63)) + table(0, dc) + table(1, ac)
    raw += jpeg._segment(0xC0, b"\x08\x00\x10\x00\x10\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00") + jpeg._segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    ((image, blocks),) = jpeg.decode([raw])
    assert (image.width, image.height) == (16, 16) and blocks.shape == (6, 64)
    assert blocks[:4, 0].tolist() == chosen and blocks[0, 1] == 3 and blocks[0, 21] == -1 and (blocks[4:] == 0).all()
    assert jpeg.thumbnail(image, blocks).tolist() == [[168, 168], [176, 176]]


def test_line_dedup_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(map(tuple, con.sql(queries.oracle_sql()["op9_line_dedup"]).fetchall()))
    got = queries.op9_line_dedup(spark, sf)
    assert got.columns == ["page_id", "host", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_LINES, 0])
def test_line_dedup_cases(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    pages = [("h", ["menu", f"text {i}", " ", "menu"]) for i in range(10)] + [(None, ["menu", f"n {i}"]) for i in range(6)] + [("small", ["menu"])] * 2 + [("h", None), ("h", [])]
    df = spark.createDataFrame([(i, h, lines, "x") for i, (h, lines) in enumerate(pages)], "id int, host string, lines array<string>, page string")
    got = {r.id: r for r in line_dedup.dedup(df.withColumn("bad", F.lit(1)), "host", "lines").collect()}
    assert got[0].kept == ["text 0", " "] and got[10].kept == ["n 0"] and got[16].kept == ["menu"] and got[18].kept is None and got[19].kept == []
    assert got[0].page == "x" and got[0].bad == 1
    assert line_dedup.dedup(df.where("false"), "host", "lines").count() == 0
