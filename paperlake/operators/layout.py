"""Words to lines to paragraphs, groups of near boxes, union areas, regions to read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import A4_MM


def lines(words: DataFrame, tolerance_mm: float = 2.5, with_words: bool = False) -> DataFrame:
    """words (doc_id, ord, text, x, y, w, h, confidence) as lines, numbered by (y, x); blank words are dropped.

    Words by (vertical centre, x) join the open line whose *running mean* centre is within the tolerance. That mean
    makes it a fold, done on a page's sorted array inside Catalyst.
    """
    if tolerance_mm < 0:
        raise ValueError("a tolerance is not negative")
    word = F.struct((F.col("y") + F.col("h") / 2).alias("c"), "x", "ord", "text", "y", "w", "h", "confidence")
    pages = words.where(F.trim("text") != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(word)).alias("words"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))

    def step(acc, w):
        same = (acc["n"] > 0) & (F.abs(w["c"] - acc["sum"] / F.greatest(acc["n"], F.lit(1))) <= tolerance_mm)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(line.alias("line"), F.when(same, acc["sum"] + w["c"]).otherwise(w["c"]).alias("sum"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"), F.array_append(acc["of"], line).alias("of"))

    numbered = pages.select("doc_id", F.explode(F.arrays_zip("words", F.aggregate("words", start, step, lambda a: a["of"]).alias("line"))).alias("z"))
    rows = numbered.select("doc_id", F.col("z.line").alias("bucket"), "z.words.*")
    inside = F.array_sort(F.collect_list(F.struct("x", "y", "ord", "text", "w", "h", "confidence")))
    out = rows.groupBy("doc_id", "bucket").agg(
        inside.alias("words"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.min("confidence").alias("confidence"),
    )
    text = F.trim(F.array_join(F.transform("words", lambda s: s["text"]), " "))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "x", "bucket")) - 1).alias("line")
    return out.select("doc_id", number, text.alias("text"), "x", "y", "w", "h", "confidence", *(["words"] if with_words else []))


def reading_order(words: DataFrame, tolerance_mm: float = 2.5) -> DataFrame:
    """Words line by line, each with its place in the page's reading order."""
    rows = lines(words, tolerance_mm, True).select("doc_id", "line", F.posexplode("words").alias("pos", "s")).select("doc_id", "line", "pos", "s.*")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "pos")) - 1)


def paragraphs(rows: DataFrame, gap_mm: float = 3.0) -> DataFrame:
    """Numbers lines (doc_id, line, x, y, w, h): a new paragraph begins where the gap to the line before is over the
    limit or the two do not overlap sideways."""
    by = Window.partitionBy("doc_id").orderBy("y", "x", "line")
    before = {c: F.lag(c).over(by) for c in "xywh"}
    same = (F.col("y") - (before["y"] + before["h"]) <= gap_mm) & (F.col("x") < before["x"] + before["w"]) & (before["x"] < F.col("x") + F.col("w"))
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("paragraph", F.sum("_new").over(by) - 1).drop("_new")


def paragraph_rows(rows: DataFrame, gap_mm: float = 3.0) -> DataFrame:
    """One row a paragraph: its text, its bounds, the least confidence of its lines (doc_id, line, text, x, y, w, h, confidence)."""
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "line", "text"))), lambda s: s["text"]), " "))
    return paragraphs(rows, gap_mm).groupBy("doc_id", "paragraph").agg(
        text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.min("confidence").alias("confidence"),
    )


def union_area(boxes: DataFrame, group: list[str]) -> DataFrame:
    """Area covered by at least one rectangle of a group: slabs between neighbouring x edges, merged intervals in each."""
    cut = boxes.where("w > 0 and h > 0")
    edges = cut.select(*group, F.col("x").alias("e")).union(cut.select(*group, (F.col("x") + F.col("w")).alias("e"))).distinct()
    slabs = edges.withColumn("to", F.lead("e").over(Window.partitionBy(*group).orderBy("e"))).where("to is not null")
    inside = slabs.join(cut, group).where((F.col("x") <= F.col("e")) & (F.col("x") + F.col("w") >= F.col("to")))
    by = Window.partitionBy(*group, "e").orderBy("y", F.col("y") + F.col("h"))
    reach = F.max(F.col("y") + F.col("h")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    bottom = F.col("y") + F.col("h")
    fresh = F.greatest(F.lit(0.0), bottom - F.greatest(F.col("y"), F.coalesce(reach, F.col("y"))))
    return inside.withColumn("part", fresh * (F.col("to") - F.col("e"))).groupBy(*group).agg(F.sum("part").alias("area"))


def gap(a: Column, b: Column, axis: str) -> Column:
    """Room between two boxes on an axis; negative where they overlap."""
    size = {"x": "w", "y": "h"}[axis]
    return F.greatest(a[axis], b[axis]) - F.least(a[axis] + a[size], b[axis] + b[size])


def near(limit_mm: float) -> Callable[[Column, Column], Column]:
    """No further apart than the limit on both axes."""
    return lambda a, b: (gap(a, b, "x") <= limit_mm) & (gap(a, b, "y") <= limit_mm)


# Fixed values, mm: rows of boxes by their centres and the room beside them; stacks by the room between.
ROW_TOLERANCE, ROW_GAP, STACK_GAP = 4.0, 65.0, 12.0


def in_row_or_stack(a: Column, b: Column) -> Column:
    level = F.abs((a["y"] + a["h"] / 2) - (b["y"] + b["h"] / 2)) <= ROW_TOLERANCE
    return (level & (gap(a, b, "x") <= ROW_GAP)) | ((gap(a, b, "x") < 0) & (gap(a, b, "y") <= STACK_GAP))


def connected_groups(boxes: DataFrame, linked: Callable[[Column, Column], Column]) -> DataFrame:
    """Connected components of a page's boxes (doc_id, ord, x, y, w, h): ``component`` is a component's first box by
    (y, x, ord). A fold on the page's array inside Catalyst: each box joins all groups it is linked with into one."""
    item = F.struct("y", "x", "ord", "w", "h")
    page = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("boxes"))

    def add(groups, b):
        touch = lambda g: F.exists(g["m"], lambda k: linked(k, b))
        joined = F.flatten(F.transform(F.filter(groups, touch), lambda g: g["m"]))
        return F.array_append(F.filter(groups, lambda g: ~touch(g)), F.struct(F.array_append(joined, b).alias("m")))

    none = F.filter(F.transform("boxes", lambda b: F.struct(F.array(b).alias("m"))), lambda g: F.lit(False))
    found = page.select("doc_id", F.explode(F.aggregate("boxes", none, add)).alias("g")).select("doc_id", F.array_sort("g.m").alias("m"))
    return found.select("doc_id", F.col("m")[0]["ord"].alias("component"), F.explode("m").alias("b")).select("doc_id", F.col("b.ord").alias("ord"), "component")


def near_groups(boxes: DataFrame, gap_mm: float) -> DataFrame:
    return connected_groups(boxes, near(gap_mm))


# Fixed values, mm: room left of, above, right of and below a detection that is read again.
PADDING = (45.0, 15.0, 45.0, 8.0)


def reading_regions(detections: DataFrame, width_px: int, height_px: int, padding=PADDING) -> DataFrame:
    """Whole-pixel regions around detections (doc_id, x, y, w, h in mm) of a page image, merged until none overlap, in
    reading order, with their origin in mm."""
    from .matching import merged_rectangles

    sx, sy = A4_MM[0] / width_px, A4_MM[1] / height_px
    left, top, right, bottom = padding
    x0 = F.greatest(F.lit(0), F.floor((F.col("x") - left) / sx).cast("int"))
    y0 = F.greatest(F.lit(0), F.floor((F.col("y") - top) / sy).cast("int"))
    x1 = F.least(F.lit(width_px), F.ceil((F.col("x") + F.col("w") + right) / sx).cast("int"))
    y1 = F.least(F.lit(height_px), F.ceil((F.col("y") + F.col("h") + bottom) / sy).cast("int"))
    on_page = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") < A4_MM[0]) & (F.col("y") < A4_MM[1]) & (F.col("x") + F.col("w") > 0) & (F.col("y") + F.col("h") > 0)
    rows = detections.where(on_page).select("doc_id", F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")).alias("r"))
    out = rows.groupBy("doc_id").agg(merged_rectangles(F.collect_list("r")).alias("m")).select("doc_id", F.posexplode("m").alias("region", "r"))
    return out.select("doc_id", "region", "r.*", (F.col("r.x") * sx).alias("x_mm"), (F.col("r.y") * sy).alias("y_mm"))


def restored(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words read in a region (doc_id, region, ord, text, x, y, w, h, confidence in mm) at their place on the page."""
    origin = regions.select("doc_id", "region", "x_mm", "y_mm")
    moved = words.join(origin, ["doc_id", "region"])
    return moved.withColumns({"x": F.col("x") + F.col("x_mm"), "y": F.col("y") + F.col("y_mm")}).drop("x_mm", "y_mm")
