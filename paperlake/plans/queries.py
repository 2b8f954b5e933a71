"""Registered queries of the library's operators over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as g, pii, text as t
from ..operators import audit, catalog, conversation, layout, matching, metrics, retrieval
from ..streaming import session

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = "regexp_extract_all(lower(text), '[가-힣]+|[a-z]+|[0-9]+')"
_RUNS = r"list_filter(regexp_extract_all(text, '[0-9]+(?:[ .\-]+[0-9]+)*'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) >= 7)"
_BOXES = "SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS ord, l_returnflag AS kind, l_quantity AS x, l_linenumber * 5.0 AS y, 5 + l_discount * 100 AS w, 4 + l_tax * 50 AS h, 1 - l_tax AS confidence FROM lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on one page an order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.row_number().over(by).alias("ord"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("x"),
        (F.col("l_linenumber") * 5.0).alias("y"), (5 + F.col("l_discount") * 100).alias("w"), (4 + F.col("l_tax") * 50).alias("h"), (1 - F.col("l_tax")).alias("confidence"),
    )


# text


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words, len(list_distinct({_WORDS}))::BIGINT AS n_distinct FROM documents")
def word_tokens(spark, d):
    words = t.word_tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, list_sum(list_transform({_WORDS}, lambda w: greatest(length(w) - 2, 1)))::BIGINT AS n_grams FROM documents")
def char_ngrams(spark, d):
    grams = F.transform(t.word_tokens("text"), lambda w: F.size(t.char_ngrams(w, 3)))
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, n: a + n)
    return table(spark, d, "documents").select("doc_id", F.when(F.size(grams) > 0, total).alias("n_grams"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ') <> ''))::BIGINT AS n_sentences FROM documents")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.sentences("text")).cast("long").alias("n_sentences"))


@query(f"SELECT doc_id, len({_RUNS})::BIGINT AS n_runs FROM documents WHERE len({_RUNS}) > 0")
def unknown_digit_runs(spark, d):
    return table(spark, d, "documents").select("doc_id", t.digit_runs("text").cast("long").alias("n_runs")).where("n_runs > 0")


@query("SELECT item_id, substr(sha256(text), 1, 12) AS fingerprint FROM benchmark")
def fingerprints(spark, d):
    return table(spark, d, "benchmark").select("item_id", t.fingerprint("text").alias("fingerprint"))


_LUHN = "(list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN substr(n, i, 1)::INT ELSE (2 * substr(n, i, 1)::INT) // 10 + (2 * substr(n, i, 1)::INT) % 10 END)) % 10 = 0)"


@query(
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{1,7}}\\b')) AS m FROM documents),
    n AS (SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM c)
    SELECT doc_id, count(*) AS n_shaped, count(*) FILTER (WHERE length(n) BETWEEN 13 AND 19 AND {_LUHN}) AS n_valid FROM n GROUP BY doc_id"""
)
def card_numbers(spark, d):
    shaped = F.regexp_extract_all("text", F.lit(r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}\b"), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", F.explode(shaped).alias("m"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_shaped"), F.count_if(t.luhn_ok("m")).alias("n_valid"))


_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g') AS masked FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def masked_emails(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").rlike(_EMAIL))
    return rows.select("doc_id", F.regexp_replace("text", _EMAIL, "[EMAIL]").alias("masked"))


@query()
def pii_spans(spark, d):
    rows = pii.detect(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.inline("spans")).drop("priority")


@query()
def egress_gate(spark, d):
    return pii.egress(table(spark, d, "conversations")).select("conv_id", "turn", "masked", "residual", "unknown_runs", "blocked")


@query(r"SELECT conv_id, turn, (length(text) + length(regexp_replace(text, '[^가-힣]', '', 'g')))::BIGINT AS width FROM conversations")
def display_widths(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", t.display_width("text").cast("long").alias("width"))


# retrieval

_TFIDF = f"""
terms AS (SELECT doc_id AS id, term, count(*) AS c FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM terms GROUP BY term),
raw AS (SELECT id, term, (1 + ln(c)) * idf AS w FROM terms JOIN vocab USING (term)),
norm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id)"""


@query(f"WITH {_TFIDF} SELECT id AS doc_id, count(*) AS n_terms, round(max(w / norm), 5) AS heaviest FROM raw JOIN norm USING (id) GROUP BY id")
def tfidf_index(spark, d):
    weights, _ = retrieval.tfidf(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return weights.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.round(F.max("w"), 5).alias("heaviest"))


@query(
    f"""WITH {_TFIDF},
    q AS (SELECT item_id, term, (1 + ln(count(*))) * any_value(idf) AS q FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) JOIN vocab USING (term) GROUP BY item_id, term),
    qn AS (SELECT item_id, sqrt(sum(q * q)) AS qnorm FROM q GROUP BY item_id),
    s AS (SELECT item_id, id, round_even(sum(q / qnorm * w / norm), 6) AS score FROM q JOIN qn USING (item_id) JOIN raw USING (term) JOIN norm USING (id) GROUP BY item_id, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)
    SELECT item_id, id AS doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def tfidf_search(spark, d):
    weights, vocabulary = retrieval.tfidf(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    found = retrieval.search(weights, vocabulary, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, round_even(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)), 6) AS score FROM q JOIN embeddings ON vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def dense_search(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = retrieval.dense_search(rows, rows.where("id % 50 = 0"))
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[가-힣]+|[a-z]+|[0-9]+'), lambda w: length(w) >= 2))"


@query(
    f"""WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    w AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS a, {_TOKENS.format('before')} AS e FROM p WHERE role = 'assistant' AND before IS NOT NULL)
    SELECT conv_id, turn, round(len(list_intersect(a, e)) / nullif(len(a), 0)::DOUBLE, 6) AS support FROM w"""
)
def answer_support(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("before", before).where("role = 'assistant' and before is not null")
    return rows.select("conv_id", "turn", F.round(retrieval.support(F.col("text"), F.col("before")), 6).alias("support"))


# geometry and layout


@query(
    f"""WITH b AS ({_BOXES}), p AS (SELECT *, lead(x) OVER w1 AS x2, lead(y) OVER w1 AS y2, lead(w) OVER w1 AS w2, lead(h) OVER w1 AS h2 FROM b WINDOW w1 AS (PARTITION BY image ORDER BY ord)),
    i AS (SELECT *, greatest(least(x + w, x2 + w2) - greatest(x, x2), 0) * greatest(least(y + h, y2 + h2) - greatest(y, y2), 0) AS common FROM p WHERE x2 IS NOT NULL)
    SELECT image, ord, round(coalesce(common / nullif(w * h + w2 * h2 - common, 0), 0), 6) AS iou FROM i"""
)
def neighbour_iou(spark, d):
    by = Window.partitionBy("image").orderBy("ord")
    rows = boxes(spark, d).withColumns({f"n{c}": F.lead(c).over(by) for c in "xywh"}).where("nx is not null")
    return rows.select("image", "ord", F.round(g.iou(g.box(), g.box("n")), 6).alias("iou"))


@query(f"SELECT image, ord, round((greatest(x, 0) + least(x + w, 210)) / 2 / 210, 6) AS cx, round((least(x + w, 210) - greatest(x, 0)) / 210, 6) AS nw, round(x * 25.4 / 200, 6) AS x_mm FROM ({_BOXES})")
def normalised_boxes(spark, d):
    n = g.to_normalised(g.box(), F.lit(210.0), F.lit(297.0))
    return boxes(spark, d).select("image", "ord", F.round(n["cx"], 6).alias("cx"), F.round(n["nw"], 6).alias("nw"), F.round(g.px_to_mm(F.col("x"), 200), 6).alias("x_mm"))


@query(f"SELECT image, ord, round((2 * x + 0.1 * y + 5) / (0.001 * x + 1), 6) AS px, round((1.5 * y + 7) / (0.001 * x + 1), 6) AS py FROM ({_BOXES})")
def homography(spark, d):
    px, py = g.apply_homography([[2.0, 0.1, 5.0], [0.0, 1.5, 7.0], [0.001, 0.0, 1.0]], F.col("x"), F.col("y"))
    return boxes(spark, d).select("image", "ord", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(f"SELECT kind, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM ({_BOXES}) GROUP BY kind")
def calibration(spark, d):
    return boxes(spark, d).groupBy("kind").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


@query(f"SELECT kind, CASE WHEN confidence >= 0.95 THEN 'explain' WHEN confidence >= 0.93 THEN 'partial' ELSE 'defer' END AS band, count(*) AS n FROM ({_BOXES}) GROUP BY ALL")
def confidence_bands(spark, d):
    return boxes(spark, d).groupBy("kind", g.confidence_band(F.col("confidence"), 0.95, 0.93).alias("band")).agg(F.count("*").alias("n"))


@query(
    f"""WITH b AS ({_BOXES}), e AS (SELECT DISTINCT image, x AS e FROM b UNION SELECT image, x + w FROM b),
    s AS (SELECT *, lead(e) OVER (PARTITION BY image ORDER BY e) AS t FROM e),
    i AS (SELECT s.image, e, t, y, y + h AS bottom, max(y + h) OVER (PARTITION BY s.image, e ORDER BY y, y + h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s JOIN b ON b.image = s.image AND x <= e AND x + w >= t)
    SELECT image, round(sum(greatest(0, bottom - greatest(y, coalesce(reach, y))) * (t - e)), 4) AS area FROM i GROUP BY image"""
)
def union_areas(spark, d):
    return layout.union_area(boxes(spark, d), ["image"]).select("image", F.round("area", 4).alias("area"))


@query(
    f"""WITH b AS ({_BOXES}), l AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py, lag(w) OVER v AS pw, lag(h) OVER v AS ph FROM b WINDOW v AS (PARTITION BY image ORDER BY y, x, ord))
    SELECT image, ord, (sum(CASE WHEN y - (py + ph) <= 0.5 AND x < px + pw AND px < x + w THEN 0 ELSE 1 END) OVER (PARTITION BY image ORDER BY y, x, ord ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS paragraph FROM l"""
)
def paragraphs(spark, d):
    rows = boxes(spark, d).withColumnsRenamed({"image": "doc_id", "ord": "line"})
    return layout.paragraphs(rows, 0.5).select(F.col("doc_id").alias("image"), F.col("line").alias("ord"), "paragraph")


_WORD_LINES = f"""
w AS (SELECT image, ord, kind, x, y / 4 AS y, w, h, confidence, row_number() OVER (PARTITION BY image ORDER BY y / 4 + h / 2, x, ord) AS k FROM ({_BOXES}) WHERE trim(kind) <> ''),
f AS (SELECT image, k, ord, 0 AS bucket, y + h / 2 AS total, 1 AS n FROM w WHERE k = 1
  UNION ALL SELECT w.image, w.k, w.ord, f.bucket + (NOT same)::INT, CASE WHEN same THEN total + y + h / 2 ELSE y + h / 2 END, CASE WHEN same THEN f.n + 1 ELSE 1 END
  FROM f JOIN w ON w.image = f.image AND w.k = f.k + 1, LATERAL (SELECT abs(w.y + w.h / 2 - f.total / f.n) <= 2.5 AS same))"""


@query(
    f"""WITH RECURSIVE {_WORD_LINES}
    SELECT image AS doc_id, (row_number() OVER (PARTITION BY image ORDER BY min(y), min(x), bucket) - 1)::INT AS line, string_agg(kind, ' ' ORDER BY x, y, ord) AS text,
      min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, min(confidence) AS confidence FROM f JOIN w USING (image, ord) GROUP BY image, bucket"""
)
def text_lines(spark, d):
    words = boxes(spark, d).select(F.col("image").alias("doc_id"), "ord", F.col("kind").alias("text"), "x", (F.col("y") / 4).alias("y"), "w", "h", "confidence")
    return layout.lines(words)


@query(
    f"""WITH RECURSIVE b AS ({_BOXES}),
    l AS (SELECT a.image, a.ord AS a, o.ord AS o FROM b a JOIN b o ON a.image = o.image AND greatest(a.x, o.x) - least(a.x + a.w, o.x + o.w) <= 2 AND greatest(a.y, o.y) - least(a.y + a.h, o.y + o.h) <= 2),
    r AS (SELECT image, a, o FROM l UNION SELECT r.image, r.a, l.o FROM r JOIN l ON l.image = r.image AND l.a = r.o)
    SELECT r.image AS doc_id, r.a AS ord, arg_min(r.o, (b.y, b.x, b.ord)) AS component FROM r JOIN b ON b.image = r.image AND b.ord = r.o GROUP BY r.image, r.a"""
)
def box_groups(spark, d):
    return layout.near_groups(boxes(spark, d).withColumnRenamed("image", "doc_id"), 2.0)


# matching and metrics


def _shifted(spark, d):
    return boxes(spark, d).withColumn("x", F.col("x") + F.pmod(F.col("image"), F.lit(4)) * 1.5)


_SHIFTED = f"SELECT image, ord, kind, x + (image % 4) * 1.5 AS x, y, w, h, confidence FROM ({_BOXES})"


def _iou(a: str, b: str) -> str:
    common = f"greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0)"
    return f"coalesce({common} / nullif({a}.w * {a}.h + {b}.w * {b}.h - {common}, 0), 0)"


@query(
    f"""WITH RECURSIVE t AS ({_BOXES}), p AS (SELECT *, row_number() OVER (PARTITION BY image, kind ORDER BY -confidence, ord) AS k FROM ({_SHIFTED}) WHERE confidence >= 0.93),
    o AS (SELECT p.image, p.kind, p.k, list({{'v': {_iou('p', 't')}, 't': t.ord}} ORDER BY {_iou('p', 't')} DESC, t.ord) AS near FROM p JOIN t ON t.image = p.image AND t.kind = p.kind GROUP BY ALL),
    f AS (SELECT DISTINCT image, kind, 0::BIGINT AS k, []::INT[] AS used, 0::DOUBLE AS overlap FROM o
      UNION ALL SELECT f.image, f.kind, f.k + 1, CASE WHEN hit.v >= 0.5 THEN list_append(used, hit.t) ELSE used END, CASE WHEN hit.v >= 0.5 THEN overlap + hit.v ELSE overlap END
      FROM f JOIN o ON o.image = f.image AND o.kind = f.kind AND o.k = f.k + 1, LATERAL (SELECT list_filter(near, lambda c: NOT list_contains(used, c.t))[1] AS hit)),
    e AS (SELECT kind, sum(n)::BIGINT AS tp, sum(overlap) AS overlap FROM (SELECT image, kind, max(len(used)) AS n, max(overlap) AS overlap FROM f GROUP BY ALL) GROUP BY kind),
    n AS (SELECT kind, (SELECT count(*) FROM p WHERE p.kind = t.kind) AS np, count(*) AS nt FROM t GROUP BY kind)
    SELECT kind, (SELECT count(DISTINCT image) FROM t) AS evaluated, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, nt - coalesce(tp, 0) AS fn, round(tp / nullif(np, 0)::DOUBLE, 6) AS precision, round(tp / nullif(nt, 0)::DOUBLE, 6) AS recall,
      round(2 * tp / (np + nt)::DOUBLE, 6) AS f1, round(overlap / nullif(tp, 0), 6) AS mean_iou FROM n LEFT JOIN e USING (kind)"""
)
def detection_metrics(spark, d):
    samples = matching.box_arrays(boxes(spark, d), "truth").join(matching.box_arrays(_shifted(spark, d), "predictions"), "image")
    out = metrics.detection_metrics(samples, ["A", "N", "R"], 0.5, 0.93)
    return out.select("kind", "evaluated", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou")))


@query(
    f"""WITH RECURSIVE t AS ({_BOXES}), p AS ({_SHIFTED}), d AS (SELECT p.image, p.ord AS p, t.ord AS t, sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y)) AS d FROM p JOIN t ON p.image = t.image),
    o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY d, p, t) AS k FROM d WHERE d <= 8),
    f AS (SELECT image, k, [p] AS ps, [t] AS ts, p, t, d, true AS hit FROM o WHERE k = 1
      UNION ALL SELECT o.image, o.k, CASE WHEN free THEN list_append(ps, o.p) ELSE ps END, CASE WHEN free THEN list_append(ts, o.t) ELSE ts END, o.p, o.t, o.d, free
      FROM f JOIN o ON o.image = f.image AND o.k = f.k + 1, LATERAL (SELECT NOT list_contains(ps, o.p) AND NOT list_contains(ts, o.t) AS free))
    SELECT image AS doc, p AS p_id, t AS t_id, round(d, 9) AS distance FROM f WHERE hit"""
)
def target_matches(spark, d):
    points = lambda df: df.select(F.col("image").alias("doc"), F.lit("any").alias("family"), F.col("ord").alias("id"), "x", "y")
    return matching.target_matches(points(_shifted(spark, d)), points(boxes(spark, d))).withColumn("distance", F.round("distance", 9))


@query(
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY -round_even(confidence, 6), -round_even(w * h, 6), round_even(y, 3), round_even(x, 3), ord) AS k FROM ({_BOXES})),
    f AS (SELECT image, k, ord, true AS keep, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM b WHERE k = 1
      UNION ALL SELECT b.image, b.k, b.ord, keep.ok, CASE WHEN keep.ok THEN list_append(kept, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) ELSE kept END
      FROM f JOIN b ON b.image = f.image AND b.k = f.k + 1, LATERAL (SELECT len(list_filter(kept, lambda c: {_iou('c', 'b')} >= 0.30)) = 0 AS ok) keep)
    SELECT image, ord FROM f WHERE keep"""
)
def suppressed_boxes(spark, d):
    return matching.suppress(boxes(spark, d), "image")


def _areas(name: str, rows: str) -> str:
    return f"""{name}b AS ({rows}), {name}e AS (SELECT DISTINCT image, x AS e FROM {name}b UNION SELECT image, x + w FROM {name}b), {name}s AS (SELECT *, lead(e) OVER (PARTITION BY image ORDER BY e) AS t FROM {name}e),
    {name}i AS (SELECT s.image, e, t, y, y + h AS bottom, max(y + h) OVER (PARTITION BY s.image, e ORDER BY y, y + h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}s s JOIN {name}b b ON b.image = s.image AND x <= e AND x + w >= t),
    {name} AS (SELECT image, sum(greatest(0, bottom - greatest(y, coalesce(reach, y))) * (t - e)) AS area FROM {name}i GROUP BY image)"""


_COMMON = f"""SELECT a.image, greatest(a.x, b.x) AS x, greatest(a.y, b.y) AS y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS h
    FROM ({_BOXES}) a JOIN ({_SHIFTED}) b ON a.image = b.image WHERE least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)"""
_MASKED = f"""{_areas('truth', _BOXES)}, {_areas('masked', _SHIFTED)}, {_areas('hidden', _COMMON)},
    images AS (SELECT truth.image, truth.area AS truth, masked.area AS masked, coalesce(hidden.area, 0) AS hidden FROM truth JOIN masked USING (image) LEFT JOIN hidden USING (image))"""


@query(f"WITH {_MASKED} SELECT image, round(truth, 4) AS truth, round(masked, 4) AS masked, round(hidden, 4) AS hidden FROM images")
def mask_areas(spark, d):
    out = metrics.mask_areas(boxes(spark, d), _shifted(spark, d))
    return out.select("image", *(F.round(c, 4).alias(c) for c in ("truth", "masked", "hidden")))


@query(
    f"""WITH {_MASKED} SELECT count(*) AS evaluated, round(sum(truth), 2) AS truth, round(sum(truth - hidden), 2) AS uncovered, round(sum(masked - hidden), 2) AS excess, round(sum(truth - hidden) / sum(truth), 6) AS uncovered_rate,
    round(sum(masked - hidden) / sum(masked), 6) AS excess_rate, round(sum(masked - hidden) / (count(*) * 210.0 * 297.0 - sum(truth)), 6) AS needless_rate FROM images"""
)
def mask_metrics(spark, d):
    images = boxes(spark, d).select("image").distinct().select("image", F.lit(210).alias("width"), F.lit(297).alias("height"))
    out = metrics.mask_metrics(images, boxes(spark, d), _shifted(spark, d))
    return out.select("evaluated", *(F.round(c, 2).alias(c) for c in ("truth", "uncovered", "excess")), *(F.round(c, 6).alias(c) for c in ("uncovered_rate", "excess_rate", "needless_rate")))


_RULES = [("r1", "user", ["tion", "en"], ["zzz"], True), ("r2", "user", ["heit", "ein"], [], True), ("r3", "assistant", ["the", "ing"], ["ñ"], True), ("r4", "assistant", ["que"], [], False)]


@query(
    """WITH rules(rule_id, scope, keywords, forbidden, approved) AS (VALUES ('r1', 'user', ['tion', 'en'], ['zzz'], true), ('r2', 'user', ['heit', 'ein'], []::VARCHAR[], true),
      ('r3', 'assistant', ['the', 'ing'], ['ñ'], true), ('r4', 'assistant', ['que'], []::VARCHAR[], false)),
    o AS (SELECT conv_id * 1000 + turn AS id, role, regexp_replace(lower(text), '\\s+', '', 'g') AS t, turn % 7 <> 0 AS verified, 1 - turn * 0.03 AS confidence FROM conversations),
    h AS (SELECT id, count(*) AS hits, min(rule_id) AS rule_id, bool_and(approved) AS approved FROM o JOIN rules ON scope = role
          WHERE len(list_filter(keywords, lambda k: NOT contains(t, k))) = 0 AND len(list_filter(forbidden, lambda k: contains(t, k))) = 0 GROUP BY id),
    s AS (SELECT o.id, rule_id, CASE WHEN NOT verified THEN 'unverified' WHEN confidence < 0.85 THEN 'low_confidence' WHEN hits IS NULL THEN 'no_match' WHEN hits > 1 THEN 'ambiguous'
          WHEN NOT approved THEN 'unapproved' ELSE 'matched' END AS status FROM o LEFT JOIN h USING (id))
    SELECT id, status, CASE WHEN status = 'matched' THEN rule_id END AS rule_id FROM s"""
)
def rule_matches(spark, d):
    page = [F.lit("form").alias("document_id"), F.lit("1").alias("document_version"), F.lit(1).alias("page")]
    kind = lambda c: F.when(F.col(c) == "user", "checkbox").otherwise("signature").alias("field_type")
    rules = spark.createDataFrame(_RULES, "field_id string, scope string, keywords array<string>, forbidden_keywords array<string>, approved boolean")
    entries = rules.select(
        *page, "field_id", kind("scope"), "keywords", "forbidden_keywords", F.struct(F.when(F.col("approved"), "approved").otherwise("draft").alias("status")).alias("approval"),
        *(F.lit(None).cast("string").alias(c) for c in ("content_sha256", "reading_mode", "source_text")), F.lit("").alias("instruction"),
    )
    sure = F.lit(1.0)
    observed = table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), *page, kind("role"), F.when(F.col("role").isin("user", "assistant"), F.col("text")).otherwise("").alias("surrounding_text"), sure.alias("document_confidence"),
        sure.alias("detection_confidence"), (1 - F.col("turn") * 0.03).alias("ocr_confidence"), (F.col("turn") % 7 != 0).alias("identity_verified"), F.lit(False).alias("needs_review"),
    )
    status = F.when(F.col("status") == "unverified_document", "unverified").otherwise(F.col("status"))
    return catalog.match(observed, F.broadcast(entries), "production").select("id", status.alias("status"), F.col("field_id").alias("rule_id"))


@query("SELECT l_orderkey AS image, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best FROM lineitem GROUP BY 1")
def best_options(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("best"))


# audits and label files


@query(
    """WITH s AS (SELECT doc_id, sha256(text) AS hash, source, n_chars FROM documents), p AS (SELECT doc_id, 'hash' AS kind, hash AS value FROM s UNION ALL SELECT doc_id, 'source', source FROM s),
    k AS (SELECT kind, value, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM p)
    SELECT kind, value, count(*) AS n, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(DISTINCT split) > 1 AS crossed FROM k WHERE value IS NOT NULL GROUP BY kind, value HAVING count(*) > 1"""
)
def leakage_audit(spark, d):
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("alias"), split.alias("split"), F.sha2("text", 256).alias("hash"), "source")
    return audit.shared_keys(rows, ["hash", "source"])


@query()
def dataset_split(spark, d):
    return audit.split_by_hash(table(spark, d, "documents"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


_N = "(x + w / 2) / 210 AS cx, (y + h / 2) / 297 AS cy, w / 210 AS nw, h / 297 AS nh"


@query(f"SELECT image, ord, printf('%d %.6f %.6f %.6f %.6f', (kind = 'A')::INT, cx, cy, nw, nh) AS line, CASE WHEN cx + nw / 2 > 1.000001 OR cy + nh / 2 > 1.000001 THEN 'edge' END AS issue FROM (SELECT image, ord, kind, {_N} FROM ({_BOXES}))")
def label_lines(spark, d):
    rows = boxes(spark, d).select("image", "ord", audit.label_line((F.col("kind") == "A").cast("int"), (F.col("x") + F.col("w") / 2) / 210, (F.col("y") + F.col("h") / 2) / 297, F.col("w") / 210, F.col("h") / 297).alias("line"))
    return rows.withColumn("issue", audit.label_issue(F.col("line")))


@query("SELECT o_orderkey AS image FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def dangling_images(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image")).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image")), "image", "left_anti")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, round(count(*) FILTER (WHERE quality = 1) / nullif(count(quality), 0)::DOUBLE, 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))")
def report_by_variant(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    good = F.count_if(F.col("quality") == 1)
    return rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), good.alias("good"), F.round(metrics.ratio(good, F.count("quality")), 6).alias("share"))


# conversations and events


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 10) AS large, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def audit_counters(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 10).alias("large"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH i AS (SELECT user_id, (event_type = 'error')::INT AS hit, sum(1 - (event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
    SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, island, sum(hit) AS n FROM i GROUP BY ALL) GROUP BY user_id"""
)
def failure_streaks(spark, d):
    return conversation.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(
    """WITH s AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events)
    SELECT src, dst, count(*) AS n FROM s WHERE src IS NOT NULL AND (src, dst) NOT IN (('view', 'click'), ('click', 'purchase'), ('view', 'view')) GROUP BY ALL"""
)
def transition_violations(spark, d):
    allowed = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view")], "src string, dst string")
    return conversation.violations(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.broadcast(allowed)).groupBy("src", "dst").agg(F.count("*").alias("n"))


_TRIGGERS = [("legal", ["contract", "lawyer"]), ("medical", ["heitein", "tionth"]), ("money", ["queque", "inging"])]


@query(
    f"""WITH s AS (SELECT conv_id, turn, text, regexp_replace(lower(text), '[\\s.,!?~]+', '', 'g') AS q FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(q, 'contract') OR contains(q, 'lawyer') THEN 'legal' WHEN contains(q, 'heitein') OR contains(q, 'tionth') THEN 'medical'
      WHEN contains(q, 'queque') OR contains(q, 'inging') THEN 'money' WHEN len({_RUNS}) > 0 THEN 'digits' ELSE 'ok' END AS verdict FROM s"""
)
def guard_verdicts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", conversation.guard(F.col("text"), _TRIGGERS).alias("verdict"))


_INTENTS = [("finish", "^the"), ("next", "(tion|ung)$"), ("start", "^(die|le|el)")]


@query(
    """WITH s AS (SELECT conv_id, turn, regexp_replace(lower(text), '[\\s.,!?]+', '', 'g') AS q FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN regexp_matches(q, '^the') THEN 'finish' WHEN regexp_matches(q, '(tion|ung)$') THEN 'next' WHEN regexp_matches(q, '^(die|le|el)') THEN 'start' ELSE 'unknown' END AS intent FROM s"""
)
def intents(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", conversation.intent(F.col("text"), _INTENTS).alias("intent"))


@query()
def session_replay(spark, d):
    turns = intents(spark, d).select(F.col("conv_id").cast("string").alias("session"), "turn", "intent")
    return session.replay(turns)


@query(
    """WITH s AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, count(*) FILTER (WHERE role = 'assistant') AS answered FROM conversations GROUP BY conv_id)
    SELECT count(*) AS sessions, round(avg(turns), 6) AS turns_mean, round(sum(least(asked, answered)) / nullif(sum(asked), 0)::DOUBLE, 6) AS resolution_rate, round(count(*) FILTER (WHERE turns <= 20) / nullif(count(*), 0)::DOUBLE, 6) AS short_rate FROM s"""
)
def session_kpis(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"))
    served = F.sum(F.least("asked", "answered"))
    return per.agg(F.count("*").alias("sessions"), F.round(F.avg("turns"), 6).alias("turns_mean"), F.round(metrics.ratio(served, F.sum("asked")), 6).alias("resolution_rate"), F.round(metrics.ratio(F.count_if(F.col("turns") <= 20), F.count("*")), 6).alias("short_rate"))


@query(
    """WITH o AS (SELECT l_orderkey AS id, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS all_ids, list(DISTINCT l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS open FROM lineitem GROUP BY 1)
    SELECT id, coalesce(list_filter(open, lambda x: x > CASE WHEN list_contains(all_ids, 2) THEN 2 ELSE 0 END)[1], open[1]) AS next_id, len(all_ids)::BIGINT AS n, coalesce(len(open), 0)::BIGINT AS n_pending FROM o"""
)
def progress(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("order"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("pending"))
    # the second field is the current one
    return per.select("id", conversation.next_pending(F.col("order"), F.col("pending"), F.lit(2)).alias("next_id"), F.size("order").cast("long").alias("n"), F.size("pending").cast("long").alias("n_pending"))


@query("SELECT conv_id, min(least(1.0, length(text) / 200.0))::DOUBLE AS confidence, arg_min(turn, (least(1.0, length(text) / 200.0), turn)) AS weakest FROM conversations GROUP BY conv_id")
def stage_confidence(spark, d):
    score = F.least(F.lit(1.0), F.length("text") / 200.0)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min(score).alias("confidence"), F.min_by("turn", F.struct(score, "turn")).alias("weakest"))


@query("SELECT count(*) AS n, 1.0::DOUBLE AS rate FROM orders")
def round_trips(spark, d):
    rows = table(spark, d, "orders")
    row = F.struct(*rows.columns)
    back = F.from_json(F.to_json(row), rows.schema)
    return rows.select(back.eqNullSafe(row).alias("same")).agg(F.count("*").alias("n"), metrics.ratio(F.count_if("same"), F.count("*")).alias("rate"))


from . import forms  # noqa: E402, F401  # registers its queries


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
