"""Boxes as (x, y, w, h) columns: areas, overlaps, unit conversions, homographies, scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

A4_MM = (210.0, 297.0)
Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in "xywh")


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where both are empty."""
    common = intersection(a, b)
    union = a[2] * a[3] + b[2] * b[3] - common
    return F.coalesce(F.try_divide(common, union), F.lit(0.0))


def contains(b: Box, x: Column, y: Column) -> Column:
    return x.between(b[0], b[0] + b[2]) & y.between(b[1], b[1] + b[3])


def to_normalised(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Centre and size as shares of the page, clamped to it."""
    x1, y1 = F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0))
    x2, y2 = F.least(b[0] + b[2], width), F.least(b[1] + b[3], height)
    return {"cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "nw": (x2 - x1) / width, "nh": (y2 - y1) / height}


def px_to_mm(value: Column, dpi: Column | float) -> Column:
    return value * 25.4 / dpi


def apply_homography(matrix: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """The image of a point; null where it lies at infinity."""
    row = [r[0] * x + r[1] * y + r[2] for r in matrix]
    scale = F.when(F.abs(row[2]) >= 1e-10, row[2])
    return row[0] / scale, row[1] / scale


def bounds(points: list[tuple[Column, Column]]) -> Box:
    """Axis-aligned box around points."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    x, y = F.least(*xs), F.least(*ys)
    return x, y, F.greatest(*xs) - x, F.greatest(*ys) - y


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def confidence_band(score: Column, explain: float = 0.85, partial: float = 0.70) -> Column:
    return F.when(score >= explain, "explain").when(score >= partial, "partial").otherwise("defer")


# Limits in degrees and dots an inch, and the errors in mm of each grade.
SKEW_NORMAL, SKEW_MOST, DPI_NORMAL, DPI_LOW = 5.0, 25.0, 250.0, 200.0
ERROR_NORMAL, ERROR_SKEWED, ERROR_LOW, ERROR_SEVERE = 5.0, 10.0, 15.0, 20.0


def expected_error_mm(skew: Column, dpi: Column) -> Column:
    """Expected position error of a capture: by its skew, and by a floor where the (rounded) resolution is low."""
    dots = F.bround(dpi)
    grade = F.when((F.abs(skew) < SKEW_NORMAL) & (dots >= DPI_NORMAL), ERROR_NORMAL).when(F.abs(skew) < SKEW_MOST, ERROR_SKEWED).otherwise(ERROR_SEVERE)
    return F.when(dots < DPI_LOW, F.greatest(grade, F.lit(ERROR_LOW))).otherwise(grade)


def scaled_confidence(confidence: Column, factor: float) -> Column:
    if not 0.0 <= factor <= 1.0:
        raise ValueError("a factor lies between 0 and 1")
    return clamp01(confidence * factor)


def centre(b: Box) -> tuple[Column, Column]:
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def area(b: Box) -> Column:
    return b[2] * b[3]


def clamped(b: Box, width: float = A4_MM[0], height: float = A4_MM[1]) -> Box:
    """The part of a box on the page; boxes beside it become empty."""
    edge = lambda v, most: F.greatest(F.lit(0.0), F.least(v, F.lit(most)))
    x0, y0, x1, y1 = edge(b[0], width), edge(b[1], height), edge(b[0] + b[2], width), edge(b[1] + b[3], height)
    return x0, y0, F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0)


def off_page(b: Box, width: float = A4_MM[0], height: float = A4_MM[1], tolerance: float = 1e-6) -> Column:
    return (b[0] < -tolerance) | (b[1] < -tolerance) | (b[0] + b[2] > width + tolerance) | (b[1] + b[3] > height + tolerance)


def box_px_to_mm(b: Box, width_px: Column, height_px: Column, clamp: bool = True) -> Box:
    """Pixels of a page image of known size as mm of A4."""
    sx, sy = A4_MM[0] / width_px, A4_MM[1] / height_px
    mm = b[0] * sx, b[1] * sy, b[2] * sx, b[3] * sy
    return clamped(mm) if clamp else mm


def box_mm_to_px(b: Box, width_px: Column, height_px: Column) -> Box:
    """Whole pixels of all four edges, rounded half to even."""
    sx, sy = width_px / A4_MM[0], height_px / A4_MM[1]
    x0, y0, x1, y1 = F.bround(b[0] * sx), F.bround(b[1] * sy), F.bround((b[0] + b[2]) * sx), F.bround((b[1] + b[3]) * sy)
    return x0, y0, F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0)


def from_normalised(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return (cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height


def from_centre(cx: Column, cy: Column, w: Column, h: Column, of: tuple[Column, Column], to: tuple[Column, Column]) -> Box:
    """A box given by its centre on an image of one size, on an image of another size."""
    sx, sy = to[0] / of[0], to[1] / of[1]
    return (cx - w / 2) * sx, (cy - h / 2) * sy, w * sx, h * sy


def valid_box(b: Column, width: Column, height: Column, tolerance: float = 1e-3) -> Column:
    """Whether an array holds four finite numbers that make a box inside the image."""
    at = lambda i: F.try_element_at(b, F.lit(i))
    finite = F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300))
    inside = (at(1) >= 0) & (at(2) >= 0) & (at(3) > 0) & (at(4) > 0) & (at(1) + at(3) <= width + tolerance) & (at(2) + at(4) <= height + tolerance)
    return F.coalesce((F.size(b) == 4) & finite & inside, F.lit(False))


def page_resolution(width_px: Column, height_px: Column, tolerance: float = 0.08) -> tuple[Column, Column]:
    """(dots an inch, whether the sides are not those of A4) of a page image."""
    wanted = A4_MM[1] / A4_MM[0]
    return F.greatest(F.lit(1.0), width_px / A4_MM[0] * 25.4), F.abs(height_px / width_px - wanted) / wanted > tolerance


Point = tuple[Column, Column]


def ordered_quad(corners: Column) -> dict[str, Column]:
    """Corners (array of struct x, y) as top left, top right, bottom right, bottom left: by their sum and difference;
    null where these do not tell four corners apart."""
    numbered = F.transform(corners, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), (p["y"] - p["x"]).alias("d"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
    pick = lambda key, least: F.array_sort(F.transform(numbered, lambda p: F.struct((p[key] if least else -p[key]).alias("k"), p["i"], p["x"], p["y"])))[0]
    found = {"tl": pick("s", True), "tr": pick("d", True), "br": pick("s", False), "bl": pick("d", False)}
    apart = F.size(F.array_distinct(F.array(*(p["i"] for p in found.values())))) == 4
    return {k: F.when(apart, p) for k, p in found.items()}


def quad_edges(q: dict[str, Column]) -> dict[str, Column]:
    length = lambda a, b: F.hypot(q[b]["x"] - q[a]["x"], q[b]["y"] - q[a]["y"])
    return {"top": length("tl", "tr"), "right": length("tr", "br"), "bottom": length("bl", "br"), "left": length("tl", "bl")}


def quad_area(q: dict[str, Column]) -> Column:
    ring = [q[k] for k in ("tl", "tr", "br", "bl")]
    return F.abs(sum((a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, [*ring[1:], ring[0]])), F.lit(0.0))) / 2


def quad_skew(q: dict[str, Column]) -> Column:
    """Mean angle in degrees of the top and bottom edges."""
    angle = lambda a, b: F.degrees(F.atan2(q[b]["y"] - q[a]["y"], q[b]["x"] - q[a]["x"]))
    return (angle("tl", "tr") + angle("bl", "br")) / 2


def quad_resolution(q: dict[str, Column]) -> Column:
    """Dots an inch if the quad is an A4 page: the mean of what its width and its height say."""
    e = quad_edges(q)
    return ((e["top"] + e["bottom"]) / 2 / A4_MM[0] + (e["left"] + e["right"]) / 2 / A4_MM[1]) / 2 * 25.4


def solve_homography(source: Column, target: Column) -> Column:
    """The nine numbers (row by row, the last one 1) that take four points (array of struct x, y) to four others; null
    where they do not fix it. A batch of 8 x 8 systems at a time."""
    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for src, dst in zip(a, b):
            if src is None or dst is None or len(src) != 4 or len(dst) != 4:
                out.append(None)
                continue
            x, y = np.array([(p["x"], p["y"]) for p in src]).T
            u, v = np.array([(p["x"], p["y"]) for p in dst]).T
            one, none = np.ones(4), np.zeros((4, 3))
            rows = np.block([[np.stack((x, y, one), 1), none, -np.stack((x * u, y * u), 1)], [none, np.stack((x, y, one), 1), -np.stack((x * v, y * v), 1)]])
            try:
                out.append([*np.linalg.solve(rows, np.concatenate((u, v))).tolist(), 1.0] if abs(np.linalg.det(rows)) > 1e-9 else None)
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out)

    return solve(source, target)


def transformed(m: Column, x: Column, y: Column, least: float = 1e-12) -> Point:
    """A point under the nine numbers of a matrix column; null at infinity."""
    row = [m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] for i in range(3)]
    scale = F.when(F.abs(row[2]) >= least, row[2])
    return row[0] / scale, row[1] / scale


def inverse_matrix(m: Column) -> Column:
    """The adjugate divided by the determinant; null for a singular matrix."""
    a = [m[i] for i in range(9)]
    minor = lambda r, c: _minor(a, r, c)
    det = a[0] * minor(0, 0) - a[1] * minor(0, 1) + a[2] * minor(0, 2)
    entries = [(minor(c, r) if (r + c) % 2 == 0 else -minor(c, r)) for r in range(3) for c in range(3)]
    return F.when(F.abs(det) > 1e-15, F.array(*(e / det for e in entries)))


def _minor(a: list[Column], row: int, column: int) -> Column:
    p, q, r, s = (a[3 * i + j] for i in range(3) if i != row for j in range(3) if j != column)
    return p * s - q * r


def transformed_box(m: Column, b: Box, width: Column, height: Column, least: float = 1e-10) -> Box:
    """The upright box around a box's transformed corners, cut at the image's edges; null at infinity."""
    corners = [transformed(m, x, y, least) for x, y in ((b[0], b[1]), (b[0] + b[2], b[1]), (b[0] + b[2], b[1] + b[3]), (b[0], b[1] + b[3]))]
    known = corners[0][0].isNotNull()
    for c in corners[1:]:
        known = known & c[0].isNotNull()
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    x0, y0 = F.greatest(F.least(*xs), F.lit(0.0)), F.greatest(F.least(*ys), F.lit(0.0))
    x1, y1 = F.least(F.greatest(*xs), width), F.least(F.greatest(*ys), height)
    return tuple(F.when(known, v) for v in (x0, y0, x1 - x0, y1 - y0))


def ramp(value: Column, zero_at: float, one_at: float) -> Column:
    if zero_at == one_at:
        raise ValueError("a ramp needs two ends")
    return clamp01((value - zero_at) / (one_at - zero_at))


def plateau(value: Column, low_zero: float, low_one: float, high_one: float, high_zero: float) -> Column:
    """1 between the inner limits, falling to 0 at the outer ones."""
    return F.when(value < low_one, ramp(value, low_zero, low_one)).when(value > high_one, ramp(value, high_zero, high_one)).otherwise(1.0)


def weighted(scores: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in scores)
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    return clamp01(sum((s * w for s, w in scores), F.lit(0.0)) / total)


# Least growth of the ink share that counts as written, and the confidences at the limit and far from it.
INK_CHECKBOX, INK_SIGNATURE, INK_REGION, AT_LIMIT, AT_MOST = 0.04, 0.012, 0.012, 0.6, 0.99


def ink_verdict(before: Column, after: Column, limit: float = INK_REGION) -> dict[str, Column]:
    """Whether a place was written on, and how sure that is: by how far the growth of its ink share is from the limit."""
    delta = after - before
    margin = F.least(F.lit(1.0), F.abs(delta - limit) / limit)
    return {"delta": delta, "written": delta >= limit, "confidence": F.bround(AT_LIMIT + (AT_MOST - AT_LIMIT) * margin, 4)}


def mask_region(b: Box, width: Column, height: Column, padding: int = 3) -> tuple[Box, Column]:
    """(whole pixels to black out: edges outward and padded, cut at the image; whether the box is usable)."""
    usable = (b[2] > 0) & (b[3] > 0) & (b[0] < width) & (b[1] < height) & (b[0] + b[2] > 0) & (b[1] + b[3] > 0)
    x0, y0 = F.greatest(F.lit(0), F.floor(b[0]) - padding), F.greatest(F.lit(0), F.floor(b[1]) - padding)
    x1, y1 = F.least(width, F.ceil(b[0] + b[2]) + padding), F.least(height, F.ceil(b[1] + b[3]) + padding)
    return (x0, y0, x1 - x0, y1 - y0), F.coalesce(usable, F.lit(False))


# Limits of a usable capture.
QUALITY = {"short_side": 600, "sharpness": 60.0, "contrast": 12.0, "brightness": 45.0, "tilt": 12.0, "boundary": 0.85}


def capture_quality(m: dict[str, Column], policy: dict = QUALITY, photo: bool = True) -> tuple[Column, Column]:
    """(status, ordered reasons) of measured short_side, brightness, contrast, sharpness and, for photos, boundary
    confidence, edge (touches the border) and tilt; a failure asks for a retake, a doubt about the border for review."""
    rules = [("low_resolution", m["short_side"] < policy["short_side"]), ("too_dark", m["brightness"] < policy["brightness"]), ("low_contrast", m["contrast"] < policy["contrast"]), ("blurred", m["sharpness"] < policy["sharpness"])]
    unknown = F.lit(False)
    if photo:
        unknown = F.coalesce(m["boundary"] < policy["boundary"], F.lit(True))
        rules += [("edge_cutoff", ~unknown & m["edge"]), ("tilted", ~unknown & (m["tilt"] > policy["tilt"]))]
    failed = F.array_compact(F.array(*(F.when(holds, name) for name, holds in rules)))
    reasons = F.when(unknown, F.array_append(failed, "boundary_unknown")).otherwise(failed)
    status = F.when(F.size(failed) > 0, "retake").when(unknown, "review").otherwise("pass")
    return status, reasons
