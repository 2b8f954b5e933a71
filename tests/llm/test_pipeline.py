"""Each stage of the pipeline against plain Python on the rows it was given."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline

from .test_join import all_pairs
from .test_text_ops import base, check_packing
from .test_windows import covered


def rules(text):
    n, chars, symbols, dup, _, failed = base(text)
    lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (text or "").split("\n"))
    return not (failed or 100 * symbols > 10 * n or 100 * dup > 30 * lines or chars < 2 * n or chars > 25 * n)


def without_boilerplate(rows):
    pages, seen = Counter(r["source"] for r in rows), defaultdict(set)
    for i, r in enumerate(rows):
        for line in (r["text"] or "").split("\n"):
            if line.strip(" \t\r"):
                seen[r["source"], line].add(i)
    drop = {k for k, v in seen.items() if pages[k[0]] >= 5 and len(v) > 1 and len(v) * 100 > pages[k[0]] * 20}
    out = []
    for r in rows:
        text = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in drop)
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    key = lambda r: (r["doc_id"], str(r))
    steps = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]

    df = steps["quality rules"](spark, docs, sf)
    want = [r for r in rows if rules(r["text"])]
    assert df.columns == docs.columns and sorted((r.asDict() for r in df.collect()), key=key) == sorted(want, key=key)

    df, rows = steps["line dedup"](spark, spark.createDataFrame(want, docs.schema), sf), without_boilerplate(want)
    assert df.columns == docs.columns and sorted((r.asDict() for r in df.collect()), key=key) == sorted(rows, key=key)

    df = steps["n-gram Jaccard join"](spark, spark.createDataFrame(rows, docs.schema), sf)
    first = {c for _, _, c in all_pairs([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    rows = [r for r in rows if r["doc_id"] in first]
    assert df.columns == docs.columns and sorted((r.asDict() for r in df.collect()), key=key) == sorted(rows, key=key)

    df = steps["suffix-array dedup"](spark, spark.createDataFrame(rows, docs.schema), sf)
    got = {r.doc_id: r for r in df.collect()}
    texts = [r["text"].encode() for r in rows]
    want = {r["doc_id"]: bytes(b for b, f in zip(t, flags) if not f).decode(errors="ignore") for r, t, flags in zip(rows, texts, covered(texts, 200))}
    assert df.columns == docs.columns and {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    rows = [r.asDict() for r in got.values()]
    packed = steps["best-fit packing"](spark, spark.createDataFrame(rows, docs.schema), sf).collect()
    check_packing(packed, [r["text"] for r in rows], [r["doc_id"] for r in rows])


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0 and pipeline.ORACLE_SQL is None


def test_a_copied_document_is_no_boilerplate(spark):
    """A third of a source's rows are one document; its text must outlive the line stage and leave the pipeline once."""
    prose = lambda k: "\n".join(f"line {j} of text {k} has its own words {k * 31 + j}" for j in range(8))
    texts = [prose(0)] * 10 + [f"menu of the site\n{prose(k)}" for k in range(1, 21)]
    texts += [prose(100)] * 2 + [prose(k) for k in range(101, 104)]
    rows = [(i, t, "en", "a" if i < 30 else "b", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.line_stage(spark, docs, "").collect()}
    assert got == {i: t.removeprefix("menu of the site\n") for i, t in enumerate(texts)}
    kept = pipeline.near_duplicate_stage(spark, spark.createDataFrame([(*r[:1], got[r[0]], *r[2:]) for r in rows], docs.schema), "")
    assert [r.text for r in kept.where("doc_id < 10 or doc_id in (30, 31)").orderBy("doc_id").collect()] == [prose(0), prose(100)]


def test_stages_with_copies_counted_once(spark, sf, monkeypatch):
    """The chain of test_stages, its plain Python counting a source's different texts instead of its rows."""

    def once(rows):
        texts, seen = defaultdict(set), defaultdict(set)
        for r in rows:
            texts[r["source"]].add(r["text"])
            for line in (r["text"] or "").split("\n"):
                if line.strip(" \t\r"):
                    seen[r["source"], line].add(r["text"])
        drop = {k for k, v in seen.items() if len(texts[k[0]]) >= 5 and len(v) > 1 and len(v) * 100 > len(texts[k[0]]) * 20}
        text = lambda r: r["text"] and "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in drop)
        return [r | {"text": text(r), "n_chars": None if r["text"] is None else len(text(r))} for r in rows]

    monkeypatch.setitem(globals(), "without_boilerplate", once)
    test_stages(spark, sf)


def test_line_stage_keeps_columns_of_any_name(spark):
    rows = [(i, f"menu\ntext {i}", "en", "a", 9, "x", ["y"]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _kept array<string>")
    got = pipeline.line_stage(spark, docs, "").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, f"text {i}", "en", "a", 6, "x", ["y"]) for i in range(6)]
