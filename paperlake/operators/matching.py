"""Greedy matching, suppression and rectangle merging as folds over a page's sorted array, inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import Box, box, iou


def at(s: Column) -> Box:
    return tuple(s[c] for c in "xywh")


def greedy_pairs(pairs: DataFrame, group: list[str], left: str, right: str, order: list[str], keep: list[str]) -> DataFrame:
    """One-to-one pairs taken in ``order`` (ascending), then by left and right, while both sides are free; a group's
    pairs are one row's array."""
    item = F.struct(*order, left, right, *(c for c in keep if c not in (*order, left, right)))
    free = lambda taken, p: ~F.exists(taken, lambda t: (t[left] == p[left]) | (t[right] == p[right]))
    rows = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    taken = F.aggregate("pairs", F.filter("pairs", lambda p: F.lit(False)), lambda acc, p: F.when(free(acc, p), F.array_append(acc, p)).otherwise(acc))
    return rows.select(*group, F.explode(taken).alias("p")).select(*group, *(F.col(f"p.{c}").alias(c) for c in (left, right, *keep)))


def matched_boxes(truth: Column, predicted: Column, threshold: float) -> Column:
    """Array of struct(t_ord, p_ord, iou): predictions (struct ord, x, y, w, h, confidence), the most confident first,
    each take the free truth (struct ord, x, y, w, h) they overlap most, if by ``threshold`` or more."""
    order = F.array_sort(F.transform(predicted, lambda p: F.struct((-p["confidence"]).alias("c"), p["ord"].alias("o"), p.alias("p"))))

    def take(acc, item):
        p = item["p"]
        ranked = F.array_max(F.transform(acc["free"], lambda t: F.struct(iou(at(p), at(t)).alias("v"), (-t["ord"]).alias("o"))))
        found = F.coalesce(ranked["v"] >= threshold, F.lit(False))
        pair = F.struct((-ranked["o"]).alias("t_ord"), p["ord"].alias("p_ord"), ranked["v"].alias("iou"))
        return F.struct(
            F.when(found, F.filter(acc["free"], lambda t: t["ord"] != -ranked["o"])).otherwise(acc["free"]).alias("free"),
            F.when(found, F.array_append(acc["pairs"], pair)).otherwise(acc["pairs"]).alias("pairs"),
        )

    none = F.array().cast("array<struct<t_ord:int,p_ord:int,iou:double>>")
    return F.aggregate(order, F.struct(truth.alias("free"), none.alias("pairs")), take, lambda acc: acc["pairs"])


BOXES = "array<struct<ord:int,kind:string,x:double,y:double,w:double,h:double,confidence:double>>"


def box_arrays(boxes: DataFrame, name: str) -> DataFrame:
    """Boxes (image, ord, kind, x, y, w, h, confidence) as one array an image."""
    item = F.struct("ord", "kind", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "confidence")))
    return boxes.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias(name))


def target_matches(predicted: DataFrame, truth: DataFrame, tolerance_mm: float = 8.0) -> DataFrame:
    """(doc, family, id, x, y) points paired by growing distance, up to a tolerance."""
    p = predicted.select("doc", "family", F.col("id").alias("p_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    t = truth.select("doc", "family", F.col("id").alias("t_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    distance = F.hypot(F.col("px") - F.col("tx"), F.col("py") - F.col("ty"))
    pairs = p.join(t, ["doc", "family"]).withColumn("distance", distance).where(F.col("distance") <= tolerance_mm)
    return greedy_pairs(pairs.select("doc", "p_id", "t_id", "distance"), ["doc"], "p_id", "t_id", ["distance"], ["distance"])


# Kinds of target that can stand for one another.
FAMILIES = {"choice": "box", "checkbox": "box", "text_input": "text", "date": "text", "unknown": "text", "signature": "signature"}


def family(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, kind), kind)


def owners(moves: DataFrame, targets: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Moves (doc, seq, x, y) with the id and kind of the first target (doc, ord, id, kind, x, y) at exactly that
    place, or null. Places are joined as whole steps of the tolerance and their neighbours, so it is an equi-join."""
    step = lambda c: F.floor(F.col(c) / (2 * tolerance))
    near = targets.select("doc", "ord", "id", "kind", F.col("x").alias("tx"), F.col("y").alias("ty"), step("x").alias("sx"), step("y").alias("sy"))
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    seen = moves.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumns({"sx": step("x") + F.col("_dx"), "sy": step("y") + F.col("_dy")})
    close = (F.abs(F.col("x") - F.col("tx")) < tolerance) & (F.abs(F.col("y") - F.col("ty")) < tolerance)
    hit = seen.join(near, ["doc", "sx", "sy"]).where(close).groupBy("doc", "seq").agg(F.min(F.struct("ord", "id", "kind")).alias("o"))
    return moves.join(hit, ["doc", "seq"], "left").select("doc", "seq", "x", "y", F.col("o.id").alias("owner"), F.col("o.kind").alias("owner_kind"))


def suppress(boxes: DataFrame, group: str, limit: float = 0.30) -> DataFrame:
    """Non-maximum suppression: by confidence, then area, then place; a box goes if it overlaps a kept one too much."""
    item = F.struct((-F.bround("confidence", 6)).alias("a"), (-F.bround(F.col("w") * F.col("h"), 6)).alias("b"), F.bround("y", 3).alias("c"), F.bround("x", 3).alias("d"), "ord", "x", "y", "w", "h")
    page = boxes.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    kept = F.aggregate(
        "boxes", F.filter("boxes", lambda s: F.lit(False)),
        lambda acc, s: F.when(F.exists(acc, lambda k: iou(at(k), at(s)) >= limit), acc).otherwise(F.array_append(acc, s)),
    )
    return page.select(group, F.explode(kept).alias("k")).select(group, "k.ord")


def overlapping(a: Box, b: Box) -> Column:
    """Strict overlap: touching edges do not count."""
    return (a[0] < b[0] + b[2]) & (b[0] < a[0] + a[2]) & (a[1] < b[1] + b[3]) & (b[1] < a[1] + a[3])


def merged_rectangles(rectangles: Column) -> Column:
    """Rectangles (array of struct x, y, w, h) merged until none overlap, in reading order.

    A fold: each one swallows all it overlaps, and what the larger rectangle overlaps then, as often as there are
    rectangles at most.
    """
    join = lambda a, b: F.struct(
        F.least(a["x"], b["x"]).alias("x"), F.least(a["y"], b["y"]).alias("y"),
        (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - F.least(a["x"], b["x"])).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - F.least(a["y"], b["y"])).alias("h"),
    )

    def swallow(state, _):
        hits = F.filter(state["rest"], lambda r: overlapping(at(r), at(state["one"])))
        return F.struct(F.aggregate(hits, state["one"], join).alias("one"), F.filter(state["rest"], lambda r: ~overlapping(at(r), at(state["one"]))).alias("rest"))

    def add(done, r):
        full = F.aggregate(F.sequence(F.lit(0), F.size(done)), F.struct(r.alias("one"), done.alias("rest")), swallow)
        return F.array_append(full["rest"], full["one"])

    out = F.aggregate(F.array_sort(rectangles), F.filter(rectangles, lambda r: F.lit(False)), add)
    return F.transform(F.array_sort(F.transform(out, lambda r: F.struct(r["y"].alias("a"), r["x"].alias("b"), r.alias("r")))), lambda k: k["r"])
