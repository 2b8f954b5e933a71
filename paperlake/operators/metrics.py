"""Detection, mask, guidance and report metrics; a rate is null where nothing was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .layout import union_area
from .matching import matched_boxes


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def detection_counts(samples: DataFrame, kinds: list[str], threshold: float = 0.5, confidence: float = 0.0) -> DataFrame:
    """Per sample and kind: tp, fp, fn and the sum of overlaps. ``truth`` and ``predictions`` are nullable arrays of
    boxes; a sample without either is not evaluated (an empty array is: nothing there)."""
    rows = samples.where("truth is not null and predictions is not null").withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    own = lambda c: F.filter(c, lambda b: b["kind"] == F.col("kind"))
    rows = rows.withColumns({"t": own("truth"), "p": F.filter("predictions", lambda b: (b["kind"] == F.col("kind")) & (b["confidence"] >= confidence))})
    rows = rows.withColumn("pairs", matched_boxes(F.col("t"), F.col("p"), threshold))
    tp = F.size("pairs")
    overlap = F.aggregate("pairs", F.lit(0.0), lambda s, x: s + x["iou"])
    return rows.select(*(c for c in samples.columns if c not in ("truth", "predictions")), "kind", tp.alias("tp"), (F.size("p") - tp).alias("fp"), (F.size("t") - tp).alias("fn"), overlap.alias("overlap"))


def detection_metrics(samples: DataFrame, kinds: list[str], threshold: float = 0.5, confidence: float = 0.0, group: tuple = ()) -> DataFrame:
    """Per group and kind: positives, misses, precision, recall, F1, mean overlap of what matched (all null where no
    sample was evaluated), and how many samples were evaluated, unlabelled or without predictions."""
    counted = detection_counts(samples, kinds, threshold, confidence).groupBy(*group, "kind").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "overlap")))
    both = F.count_if(F.col("truth").isNotNull() & F.col("predictions").isNotNull())
    seen = samples.groupBy(*group).agg(both.alias("evaluated"), F.count_if(F.col("truth").isNull()).alias("unlabelled"), F.count_if(F.col("predictions").isNull()).alias("missing"))
    rows = seen.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).join(counted, [*group, "kind"], "left")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select(*group, "kind", "evaluated", "unlabelled", "missing", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("overlap"), tp).alias("mean_iou"))


def mask_areas(truth: DataFrame, masked: DataFrame) -> DataFrame:
    """Per image: area to hide, hidden area, and how much of the first the second covers."""
    both = truth.select("image", *(F.col(c).alias(f"a{c}") for c in "xywh")).join(masked.select("image", *(F.col(c).alias(f"b{c}") for c in "xywh")), "image")
    x, y = F.greatest("ax", "bx"), F.greatest("ay", "by")
    common = both.select("image", x.alias("x"), y.alias("y"), (F.least(F.expr("ax + aw"), F.expr("bx + bw")) - x).alias("w"), (F.least(F.expr("ay + ah"), F.expr("by + bh")) - y).alias("h"))
    area = lambda df, name: union_area(df.select("image", "x", "y", "w", "h"), ["image"]).withColumnRenamed("area", name)
    return area(truth, "truth").join(area(masked, "masked"), "image", "full").join(area(common, "hidden"), "image", "left").na.fill(0.0)


def mask_metrics(images: DataFrame, truth: DataFrame, masked: DataFrame, group: tuple = ()) -> DataFrame:
    """Over the evaluated images (image, width, height and group columns): areas, what stayed uncovered, what was
    hidden needlessly, and their rates; the last one by the area that had nothing to hide."""
    rows = images.join(mask_areas(truth, masked), "image", "left").na.fill(0.0, ["truth", "masked", "hidden"])
    total = rows.groupBy(*group).agg(F.count("*").alias("evaluated"), *(F.sum(c).alias(c) for c in ("truth", "masked", "hidden")), F.sum(F.col("width").cast("double") * F.col("height")).alias("page"))
    total = total.withColumns({"uncovered": F.col("truth") - F.col("hidden"), "excess": F.col("masked") - F.col("hidden")})
    return total.withColumns({
        "uncovered_rate": ratio(F.col("uncovered"), F.col("truth")), "excess_rate": ratio(F.col("excess"), F.col("masked")),
        "needless_rate": ratio(F.col("excess"), F.col("page") - F.col("truth")),
    })


KEYS = ("document_id", "document_version", "page", "field_id")


def guidance_metrics(cases: DataFrame, group: tuple = ()) -> DataFrame:
    """Cases (status, answered struct, labelled, expected struct or null; the structs hold KEYS): right and wrong
    matches, right rejections, misses, unlabelled ones, their rates, and the reasons of all rejections, by name."""
    matched, labelled = F.col("status") == "matched", F.col("labelled")
    right = F.coalesce(F.col("answered") == F.col("expected"), F.lit(False))
    n = lambda c: F.count_if(c)
    reason = F.when(~matched, F.col("status"))
    out = cases.groupBy(*group).agg(
        F.count("*").alias("total"), n(labelled).alias("labelled"), n(labelled & matched & right).alias("correct_match"), n(labelled & matched & ~right).alias("wrong_match"),
        n(labelled & ~matched & F.col("expected").isNull()).alias("correct_rejection"), n(labelled & ~matched & F.col("expected").isNotNull()).alias("missed_match"), n(~labelled).alias("unlabelled"),
        n(~matched).alias("rejected"), F.array_sort(F.collect_list(reason)).alias("all_reasons"),
    )
    names = F.array_distinct("all_reasons")
    reasons = F.transform(names, lambda r: F.concat(r, F.lit("="), F.size(F.filter("all_reasons", lambda x: x == r)).cast("string")))
    c = F.col
    return out.withColumns({
        "accuracy": ratio(c("correct_match") + c("correct_rejection"), c("labelled")), "wrong_rate": ratio(c("wrong_match"), c("correct_match") + c("wrong_match")),
        "rejection_rate": ratio(c("rejected"), c("total")), "reasons": F.array_join(reasons, ","),
    }).drop("all_reasons", "rejected")


def compared(current: DataFrame, baseline: DataFrame, keys: list[str], values: list[str], by: list[str]) -> DataFrame:
    """Changes of ``values`` against a baseline report, only where all ``keys`` (fingerprint, settings, catalog) agree;
    a change is null where either side is."""
    b = baseline.select(*by, *(F.col(c).alias(f"b_{c}") for c in [*keys, *values]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    rows = current.join(b, by, "left").withColumn("comparable", same)
    return rows.select(*by, "comparable", *(F.when(F.col("comparable"), F.col(v) - F.col(f"b_{v}")).alias(f"{v}_delta") for v in values))
