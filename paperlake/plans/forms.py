"""Registered queries of forms: capture errors, guidance, stages, playback, owners of places, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g, text as t
from ..operators import catalog, matching, metrics
from .queries import _BOXES, boxes, query, table


@query(
    """WITH c AS (SELECT l_quantity - 20 AS skew, round_even(l_tax * 1000 + 195 + l_linenumber * 2.5, 0) AS dpi FROM lineitem),
    e AS (SELECT dpi, CASE WHEN abs(skew) < 5 AND dpi >= 250 THEN 5.0 WHEN abs(skew) < 25 THEN 10.0 ELSE 20.0 END AS grade FROM c)
    SELECT (CASE WHEN dpi < 200 THEN greatest(grade, 15.0) ELSE grade END)::DOUBLE AS error_mm, count(*) AS n FROM e GROUP BY 1"""
)
def expected_errors(spark, d):
    rows = table(spark, d, "lineitem")
    error = g.expected_error_mm(F.col("l_quantity") - 20, F.col("l_tax") * 1000 + 195 + F.col("l_linenumber") * 2.5)
    return rows.groupBy(error.alias("error_mm")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT o.o_orderkey AS run, k.k AS place, l.ok FROM orders o CROSS JOIN (VALUES (1), (2), (3), (4)) k(k) LEFT JOIN (SELECT l_orderkey, l_linenumber, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL) l
      ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = k.k WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    b AS (SELECT *, coalesce(bool_and(coalesce(ok, false)) OVER (PARTITION BY run ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS before FROM s)
    SELECT run, place, CASE WHEN NOT before THEN 'blocked' WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'passed' ELSE 'failed' END AS status FROM b"""
)
def stage_events(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    runs = rows.groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("stage")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("ok"), F.lit(None).cast("string").alias("reasons"))
    return catalog.stages(runs, ["1", "2", "3", "4"]).select("run", F.col("place").cast("int").alias("place"), "status")


@query(
    """WITH RECURSIVE c AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS move, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT user_id, event_id, k, greatest(0, least(4, move)) AS place FROM c WHERE k = 1
      UNION ALL SELECT c.user_id, c.event_id, c.k, greatest(0, least(4, f.place + c.move)) FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1)
    SELECT user_id, event_id, place + 1 AS position FROM f"""
)
def playback_positions(spark, d):
    command = F.when(F.col("event_type") == "view", "n").when(F.col("event_type") == "click", "p").otherwise("s")
    moves = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), command.alias("command"))
    return catalog.positions(moves, 5).select(F.col("session").alias("user_id"), F.col("seq").alias("event_id"), "position")


@query(
    f"""WITH b AS ({_BOXES}), m AS (SELECT image, ord, x + (ord % 2) * 0.5 AS x, y FROM b)
    SELECT m.image AS doc, m.ord AS seq, arg_min(b.ord, b.ord) AS owner FROM m LEFT JOIN b ON b.image = m.image AND b.x = m.x AND b.y = m.y GROUP BY ALL"""
)
def place_owners(spark, d):
    rows = boxes(spark, d).withColumnRenamed("image", "doc")
    moves = rows.select("doc", F.col("ord").alias("seq"), (F.col("x") + F.col("ord") % 2 * 0.5).alias("x"), "y")
    return matching.owners(moves, rows.select("doc", "ord", F.col("ord").alias("id"), "kind", "x", "y")).select("doc", "seq", "owner")


@query(
    """WITH c AS (SELECT role, turn % 5 <> 0 AS labelled, CASE WHEN length(text) % 3 = 0 THEN 'no_match' ELSE 'matched' END AS status, length(text) % 4 AS a, CASE WHEN turn % 3 > 0 THEN turn % 4 END AS e FROM conversations),
    m AS (SELECT *, status = 'matched' AS hit, coalesce(a = e, false) AS same FROM c),
    n AS (SELECT role, count(*) AS total, count(*) FILTER (WHERE labelled) AS labelled, count(*) FILTER (WHERE labelled AND hit AND same) AS correct_match, count(*) FILTER (WHERE labelled AND hit AND NOT same) AS wrong_match,
      count(*) FILTER (WHERE labelled AND NOT hit AND e IS NULL) AS correct_rejection, count(*) FILTER (WHERE labelled AND NOT hit AND e IS NOT NULL) AS missed_match, count(*) FILTER (WHERE NOT hit) AS rejected FROM m GROUP BY role)
    SELECT role, total, labelled, correct_match, wrong_match, correct_rejection, missed_match, total - labelled AS unlabelled, round((correct_match + correct_rejection) / nullif(labelled, 0)::DOUBLE, 6) AS accuracy,
      round(wrong_match / nullif(correct_match + wrong_match, 0)::DOUBLE, 6) AS wrong_rate, round(rejected / total::DOUBLE, 6) AS rejection_rate, CASE WHEN rejected > 0 THEN 'no_match=' || rejected ELSE '' END AS reasons FROM n"""
)
def guidance_metrics(spark, d):
    def key(field):
        return F.struct(F.lit("form").alias("document_id"), F.lit("1").alias("document_version"), F.lit(1).alias("page"), field.cast("string").alias("field_id"))

    rows = table(spark, d, "conversations")
    cases = rows.select(
        "role", F.when(F.length("text") % 3 == 0, "no_match").otherwise("matched").alias("status"), key(F.length("text") % 4).alias("answered"),
        (F.col("turn") % 5 != 0).alias("labelled"), F.when(F.col("turn") % 3 > 0, key(F.col("turn") % 4)).alias("expected"),
    )
    out = metrics.guidance_metrics(cases, ("role",))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "wrong_rate", "rejection_rate")})


@query()
def chunked_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(t.chunks("text")).alias("idx", "chunk"))
    return rows.select("doc_id", "idx", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))
