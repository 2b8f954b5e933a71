"""Dataset audits, splits and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def shared_keys(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of samples (alias, split and the key columns) that share a key: size, splits, whether splits are crossed."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys)))
    rows = samples.select("alias", "split", pairs.alias("p")).select("alias", "split", "p.*").where("value is not null")
    return (
        rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("splits"))
        .where("n > 1").select("kind", "value", "n", F.array_join("splits", ",").alias("splits"), (F.size("splits") > 1).alias("crossed"))
    )


def split_by_hash(rows: DataFrame, id_column: str, train: int = 80, validate: int = 10) -> DataFrame:
    """A stable split by a hash of the id: needs no order, no shuffle, and stays as the data grows."""
    bucket = F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(100))
    return rows.withColumn("split", F.when(bucket < train, "train").when(bucket < train + validate, "val").otherwise("test"))


def label_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, cx, cy, w, h)


def label_issue(line: Column, classes: int = 2, tolerance: float = 1e-6) -> Column:
    """What is wrong with a label line, or null: blank and comment lines are fine."""
    part = F.split(F.trim(line), r"\s+")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    kind = F.try_element_at(part, F.lit(1)).try_cast("int")
    numbers = [number(i) for i in (2, 3, 4, 5)]
    cx, cy, w, h = numbers
    out = lambda c, s: (c - s / 2 < -tolerance) | (c + s / 2 > 1 + tolerance)
    missing = kind.isNull()
    for n in numbers:
        missing = missing | n.isNull()
    return (
        F.when((F.trim(line) == "") | F.trim(line).startswith("#"), None)
        .when(F.size(part) != 5, "fields").when(missing, "number").when(~kind.between(0, classes - 1), "class")
        .when((w <= 0) | (h <= 0) | (w > 1) | (h > 1), "size").when(out(cx, w) | out(cy, h), "edge")
    )


def first_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
