"""Evaluation data: manifests, ground truth, predictions, reviewed labels, sources, dataset audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import bound, from_normalised, inverse_matrix, transformed_box, valid_box
from ..functions.text import canonical_sha256
from .conversation import ordered_case

# Names of the two kinds, sorts and splits of samples.
ALIASES = {"checkbox": "checkbox", "signature": "signature", "signature_field": "signature"}
VARIANTS, SPLITS, MEMBERSHIPS = ("original", "photo"), ("train", "val", "test", "external", "unknown"), ("included", "excluded", "unknown")


def alias(name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), name)


def checked_samples(samples: DataFrame) -> DataFrame:
    """Samples (id, width, height, image_size, variant, split, training_membership, form_id, source_id, ...) numbered
    by their place, with membership settled (training data is included) and ``problem``."""
    copies = F.count("*").over(Window.partitionBy("id"))
    member = F.coalesce("training_membership", F.lit("unknown"))
    blank = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) == "")
    rules = [
        ("id", F.coalesce(F.col("id") == "", F.lit(True)) | (copies > 1)), ("variant", ~F.coalesce(F.col("variant").isin(*VARIANTS), F.lit(False))), ("split", ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))),
        ("membership", ~member.isin(*MEMBERSHIPS) | ((F.col("split") == "train") & (member == "excluded"))), ("group", blank("form_id") | blank("source_id")),
        ("size", ~F.col("image_size").eqNullSafe(F.array("width", "height"))),
    ]
    rows = samples.withColumn("problem", F.nullif(ordered_case(rules, ""), F.lit("")))
    return rows.withColumn("training_membership", F.when(F.col("split") == "train", "included").otherwise(member))


def object_box(kind: Column, bbox: Column, confidence: Column, width: Column, height: Column) -> Column:
    """struct(kind, bbox, confidence) of one labelled box, null where it is not one; the default confidence is 1."""
    sure = F.coalesce(confidence, F.lit(1.0))
    ok = alias(kind).isNotNull() & valid_box(bbox, width, height) & sure.between(0, 1)
    return F.when(ok, F.struct(alias(kind).alias("kind"), bbox.alias("bbox"), sure.alias("confidence")))


def truth_from_labels(labels: Column, names: Column, width: Column, height: Column) -> Column:
    """Label rows (struct class_id, cx, cy, w, h as shares) as boxes in pixels; ``names`` gives the order of the classes."""
    # rounding to six places may leave an edge just outside: such an edge is 0
    snap = lambda v: F.when((v < 0) & (v > -1e-3), 0.0).otherwise(v)

    def one(r):
        b = from_normalised(r["cx"], r["cy"], r["w"], r["h"], width, height)
        return object_box(F.try_element_at(names, r["class_id"] + 1), F.array(*map(snap, b)), F.lit(1.0), width, height)

    return F.transform(labels, one)


def truth_from_coco(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per image: its boxes as annotated (fractions stay), null where no annotation may be used, and ``problem``."""
    i = images.select(F.col("id").alias("image_id"), "width", "height")
    c = categories.select(F.col("id").alias("category_id"), "name")
    full = annotations.join(i, "image_id", "left").join(c, "category_id", "left")
    crowd = F.coalesce(F.col("iscrowd"), F.lit(0)) != 0
    box = object_box(F.col("name"), F.col("bbox"), F.lit(1.0), F.col("width"), F.col("height"))
    rows = full.withColumns({"b": box, "why": F.when(F.col("width").isNull(), "image").when(alias(F.col("name")).isNull(), "category").when(crowd, "crowd").when(box.isNull(), "box")})
    per = rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda s: s["b"]).alias("truth"), F.min("why").alias("problem"))
    out = i.join(per, "image_id", "left")
    return out.select("image_id", F.when(F.col("problem").isNull(), F.coalesce("truth", F.array().cast("array<struct<kind:string,bbox:array<double>,confidence:double>>"))).alias("truth"), "problem")


def predictions(rows: DataFrame) -> DataFrame:
    """Predictions (id, ord, coordinate_system, kind, bbox, confidence, width, height, and for normalized_a4_mm the
    page image's size and the source-to-page matrix) as boxes in image pixels; ``box`` is null where unusable."""
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    back = inverse_matrix(F.col("source_to_normalized"))
    b = [F.col("bbox")[i] for i in range(4)]
    sx, sy = F.col("normalized_width") / 210.0, F.col("normalized_height") / 297.0
    moved = bound(back, lambda m: F.array(*transformed_box(m, (b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy), width, height)))
    mm = valid_box(F.col("bbox"), F.lit(210.0), F.lit(297.0))
    placed = F.when(F.col("coordinate_system") == "image_px", F.col("bbox")).when((F.col("coordinate_system") == "normalized_a4_mm") & mm, moved)
    box = bound(placed, lambda p: object_box(F.col("kind"), p, F.col("confidence"), width, height))  # a box beyond the horizon has nulls and is none
    return rows.withColumn("box", F.when(F.col("confidence").isNotNull(), box))


def fingerprint(samples: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a SHA-256 over the samples' columns in the order of their ids, from hashes of each sample."""
    own = samples.select("id", canonical_sha256(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("h"))
    return own.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "h"))), lambda s: s["h"]), ","), 256).alias("sha256"))


def review_problem(rows: DataFrame) -> DataFrame:
    """Reviewed labels (review struct, payload JSON without info, width, height, image struct, n_annotations,
    source_sha256) with ``problem``: approval record, hash of the content, source image."""
    r = lambda c: F.col(f"review.{c}")
    text = lambda c: F.coalesce(F.trim(r(c)) != "", F.lit(False))
    sha = lambda c: F.coalesce(r(c).rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
    record = (r("schema_version") == 1) & (r("status") == "approved") & (r("coordinate_system") == "image_xywh_px") & r("source_kind").isin("roboflow", "official_pdf")
    record = F.coalesce(record, F.lit(False)) & text("candidate_id") & text("reviewed_by") & text("reviewed_at") & sha("content_sha256") & sha("source_file_sha256")
    zoned = F.coalesce(r("reviewed_at").rlike(r"(Z|[+-]\d{2}:?\d{2})\z") & F.try_to_timestamp(r("reviewed_at")).isNotNull(), F.lit(False))
    same = (F.col("image.width") == F.col("width")) & (F.col("image.height") == F.col("height")) & (F.col("image.file_sha256") == r("source_file_sha256"))
    same = same & (F.col("source_sha256").isNull() | (F.col("source_sha256") == r("source_file_sha256"))) & (r("background_only") == (F.col("n_annotations") == 0))
    rules = [
        ("draft", F.coalesce(F.col("kind") == "draft", F.lit(False))), ("record", F.col("review").isNotNull() & ~record), ("time_zone", F.col("review").isNotNull() & ~zoned),
        ("content_changed", F.col("review").isNotNull() & ~r("content_sha256").eqNullSafe(canonical_sha256(F.col("payload"), drop=("info",)))),
        ("image_differs", F.col("review").isNotNull() & ~F.coalesce(same, F.lit(False))),
    ]
    return rows.withColumn("problem", F.nullif(ordered_case(rules, ""), F.lit("")))


def audit(samples: DataFrame) -> DataFrame:
    """Findings (finding, kind, value, samples) about samples (alias, split, training_membership, form_id, source_id,
    image_sha256): equal images, groups that cross splits, evaluation data that meets training data, unknowns."""
    keys = ["form_id", "source_id", "image_sha256"]
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys)))
    member = F.struct("alias", "split", "training_membership")
    rows = samples.select(member.alias("m"), pairs.alias("p")).select("m", "p.*").where("value is not null")
    groups = rows.groupBy("kind", "value").agg(F.array_sort(F.collect_list("m")).alias("m"))
    names = lambda c: F.transform(c, lambda x: x["alias"])
    known = F.array_except(F.array_distinct(F.transform("m", lambda x: x["split"])), F.array(F.lit("unknown")))
    equal = groups.where((F.size("m") > 1) & (F.col("kind") == "image_sha256")).select(F.lit("duplicate").alias("finding"), "kind", "value", names("m").alias("samples"))
    cross = groups.where(F.size(known) > 1).select(F.lit("cross_split").alias("finding"), "kind", "value", names("m").alias("samples"))
    tested = lambda x: x["split"].isin("val", "test", "external")
    trained = groups.where(F.exists("m", lambda x: x["training_membership"] == "included")).select(F.explode(F.filter("m", tested)).alias("x")).select("x.alias")
    own = samples.where("split in ('val', 'test', 'external') and training_membership = 'included'").select("alias")
    flat = lambda rows, finding: rows.distinct().agg(F.array_sort(F.collect_list("alias")).alias("samples")).where(F.size("samples") > 0).select(F.lit(finding).alias("finding"), F.lit("").alias("kind"), F.lit("").alias("value"), "samples")
    unknown = [("unknown_training", "training_membership = 'unknown'"), ("unknown_group", "form_id is null or source_id is null"), ("unknown_split", "split = 'unknown'")]
    out = equal.unionByName(cross).unionByName(flat(trained.unionByName(own), "training_overlap"))
    for finding, where in unknown:
        out = out.unionByName(flat(samples.where(where).select("alias"), finding))
    return out


def unseen_problem(samples: DataFrame) -> DataFrame:
    """What forbids to call an evaluation unseen: (problem, n) rows, none if it may be called so."""
    bad = {
        "split": "split not in ('test', 'external')", "training": "training_membership <> 'excluded'", "group": "form_id is null or source_id is null", "labels": "truth is null", "predictions": "predictions is null",
    }
    found = samples.agg(*(F.count_if(F.expr(where)).alias(name) for name, where in bad.items()))
    overlap = audit(samples).where("finding = 'training_overlap'").select(F.lit("training_overlap").alias("problem"), F.size("samples").cast("long").alias("n"))
    rows = found.select(F.inline(F.array(*(F.struct(F.lit(n).alias("problem"), F.col(n).alias("n")) for n in bad))))
    return rows.where("n > 0").unionByName(overlap)


def source_info(candidates: DataFrame) -> DataFrame:
    """Candidates (id, source_kind, version, version_splits map, url, pdf_sha256, revision, training_membership,
    evidence) with split, membership and ``problem``: a claim to be excluded from training needs evidence."""
    split = F.try_element_at("version_splits", F.col("version").cast("string"))
    robo = F.coalesce("source_kind", F.lit("roboflow")) == "roboflow"
    official = F.col("source_kind") == "official_pdf"
    member = F.coalesce("training_membership", F.lit("unknown"))
    sound = F.col("url").rlike(r"^https://[^/@:?#]+(?:[/:?#]|\z)") & F.col("pdf_sha256").rlike(r"^[0-9a-f]{64}\z") & F.col("revision").rlike(r"^\d{4}-\d{2}-\d{2}\z")
    rules = [
        ("version", robo & ~F.coalesce(F.col("version") >= 1, F.lit(False))), ("split", robo & ~F.coalesce(split.isin("train", "valid", "test"), F.lit(False))),
        ("kind", ~robo & ~F.coalesce(official, F.lit(False))), ("source", ~robo & ~F.coalesce(sound, F.lit(False))),
        ("evidence", ~robo & (member == "excluded") & F.coalesce(F.trim("evidence") == "", F.lit(True))),
    ]
    rows = candidates.withColumn("problem", F.nullif(ordered_case(rules, ""), F.lit("")))
    return rows.withColumns({"split": F.when(robo, split).otherwise("external"), "membership": F.when(robo, F.when(split == "train", "included").otherwise("unknown")).otherwise(member)})


def consistent(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Sources and analysis reports (id, image_sha256, shape, matrix, text_included) joined by id: what differs."""
    r = reports.select("id", *(F.col(c).alias(f"r_{c}") for c in ("image_sha256", "shape", "matrix", "text_included")))
    rows = sources.join(r, "id", "left")
    rules = [
        ("report", F.col("r_image_sha256").isNull()), ("image", ~F.col("image_sha256").eqNullSafe(F.col("r_image_sha256"))), ("shape", ~F.col("shape").eqNullSafe(F.col("r_shape"))),
        ("matrix", F.col("r_matrix").isNull() | ~F.coalesce(F.size("r_matrix") == 9, F.lit(False))), ("text", ~F.coalesce("r_text_included", F.lit(False))),
    ]
    return rows.select("id", F.nullif(ordered_case(rules, ""), F.lit("")).alias("problem"))


def candidate(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ids with the path of their one candidate; none, several, or a path that leaves the root is a problem."""
    found = candidates.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    rows = wanted.join(found, "id", "left")
    leaves = F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda p: p == "..")
    problem = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "several").when(leaves, "outside")
    return rows.select("id", F.when(problem.isNull(), F.col("path")).alias("path"), problem.alias("problem"))


def readiness(candidates: DataFrame) -> DataFrame:
    """Candidates (id, text, keywords, stages array of struct stage, ok): which keywords and stages fail, and the status."""
    text = F.regexp_replace(F.lower("text"), r"(?U)\s+", "")
    missing = F.filter("keywords", lambda k: ~F.contains(text, F.regexp_replace(F.lower(k), r"(?U)\s+", "")))
    failed = F.transform(F.filter("stages", lambda s: ~s["ok"]), lambda s: s["stage"])
    status = F.when(F.size(failed) > 0, "failed").when(F.size(missing) > 0, "review").otherwise("ready")
    return candidates.select("id", missing.alias("missing_keywords"), failed.alias("failed_stages"), status.alias("status"))


def split_permuted(names: list[str], ratios=(0.8, 0.1, 0.1), seed: int = 20260909) -> dict[str, list[str]]:
    """The seeded split of a list of names that fits the driver: for parity with earlier splits. ``split_by_hash`` is
    the one that scales."""
    import numpy as np

    if len(ratios) != 3 or min(ratios) < 0 or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("three shares that add up to 1")
    if len(set(names)) < len(names):
        raise ValueError("a name stands twice")
    order = np.array(sorted(names), object)[np.random.default_rng(seed).permutation(len(names))]
    first = min(round(ratios[0] * len(names)), len(names))
    second = min(max(round((ratios[0] + ratios[1]) * len(names)), first), len(names))
    return {"train": order[:first].tolist(), "val": order[first:second].tolist(), "test": order[second:].tolist()}
