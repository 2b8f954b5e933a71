"""Files as tables: corpus markdown, audit logs, label files, annotation JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

AUDIT = "timestamp string, caller string, event string, text_len int, pii_types array<string>, pii_count int, blocked boolean, residual_count int, text_sha256_12 string, residual_unknown int"
COCO = (
    "images array<struct<id:int,file_name:string,width:int,height:int,file_sha256:string>>, categories array<struct<id:int,name:string>>, "
    "annotations array<struct<id:int,image_id:int,category_id:int,bbox:array<double>,iscrowd:int>>"
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, section_no, section, body) of markdown files; quoted notice lines are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = files.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    by = Window.partitionBy("file").orderBy("pos")
    heading = F.when(F.col("line").rlike("^## "), F.trim(F.expr("substring(line, 4)")))
    rows = rows.withColumn("title", F.first(F.when(F.col("line").rlike("^# "), F.trim(F.expr("substring(line, 3)"))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumns({"section": F.last(heading, ignorenulls=True).over(by), "section_no": F.sum(heading.isNotNull().cast("int")).over(by)})
    rows = rows.where(~F.col("line").rlike("^(#{1,2} |>)") & (F.trim("line") != ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: F.trim(s["line"])), " ")
    return rows.groupBy("file", "title", "section_no", "section").agg(body.alias("body"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records; a broken line fails the read."""
    return spark.read.schema(AUDIT).option("mode", "FAILFAST").json(path)


def write_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, issue) of label files; faulty lines stay, with what is wrong."""
    from ..operators.audit import label_issue

    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    return rows.withColumn("issue", label_issue(F.col("line")))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, categories, annotations) of annotation files."""
    whole = spark.read.schema(COCO).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return tuple(whole.select(F.inline(c)) for c in ("images", "categories", "annotations"))


def to_normalised(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with centre and size as shares of the image, annotations whose image or category is missing)."""
    i = images.select(F.col("id").alias("image_id"), "file_name", "width", "height")
    c = categories.select(F.col("id").alias("category_id"), "name")
    full = annotations.join(i, "image_id", "left").join(c, "category_id", "left")
    bad = full.where("file_name is null or name is null").select("id", "image_id", "category_id")
    b = [F.bround(F.col("bbox")[k]) for k in range(4)]
    good = full.where("file_name is not null and name is not null").select(
        "id", "file_name", "name", ((b[0] + b[2] / 2) / F.col("width")).alias("cx"), ((b[1] + b[3] / 2) / F.col("height")).alias("cy"),
        (b[2] / F.col("width")).alias("w"), (b[3] / F.col("height")).alias("h"),
    )
    return good, bad


def write_new(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").parquet(path)
