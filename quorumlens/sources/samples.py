"""Sample tables: seeded sampling, annotation lists, prompt catalogues and run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.functions.scores import EMOTIONS, class_name, label_name


def seeded_sample(pool: DataFrame, n: int, key: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """n rows in an order that the seed fixes, with dense ids 1 to n (column id). Only the first n rows are numbered."""
    by = order if order is not None else F.xxhash64(F.col(key), F.lit(seed))
    first = pool.withColumn("_order", by).orderBy("_order", key).limit(n)
    return first.withColumn("id", F.row_number().over(W.orderBy("_order", key)).cast("long")).drop("_order")


def speech_samples(clips: DataFrame, n: int, low: float = 2.0, high: float = 10.0, seed: int = 42) -> DataFrame:
    """Clips of a length between the bounds (both included)."""
    return seeded_sample(clips.filter(F.col("duration").between(low, high)).withColumnRenamed("id", "source_id"), n, "source_id", seed)


def annotations(lines: DataFrame) -> DataFrame:
    """file and label of annotation lines (column value): comma or space separated; the first token that is a number from 0 to 6 is the label."""
    parts = F.filter(F.split(F.trim("value"), r"[,\s]+"), lambda x: x != "")
    numbers = F.filter(F.transform(F.slice(parts, 2, 1000), lambda x: x.try_cast("int")), lambda x: x.between(0, 6))
    rows = lines.select(F.get(parts, F.lit(0)).alias("file"), F.get(numbers, F.lit(0)).alias("label"))
    return rows.filter(F.lower("file").rlike(r"\.(jpg|jpeg|png|bmp)$") & F.col("label").isNotNull()).withColumn("label_name", label_name(F.col("label")))


def labelled_by_name(files: DataFrame) -> DataFrame:
    """Labels from the file's prefix, or else from its folder (column path)."""
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.withColumn("label_name", F.coalesce(class_name(F.regexp_extract(name, r"^([A-Za-z]+|\d)", 1)), class_name(folder)))


#: Endings of image files.
IMAGES = r"\.(jpg|jpeg|png|bmp)$"


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (within the folder) and bytes of the images below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.lower("path").rlike(IMAGES))
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return found.select(F.substring_index(F.col("path"), root, -1).alias("path"), F.col("length").alias("bytes"))


def collected_samples(files: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The labelled images of a split, by the first way that finds any: annotation lines, the files' prefixes (within ``images``, if there is such a folder), or a folder a class. One pass: every way makes
    its candidates, and an aggregate decides which rank counts.

    files: path, within the split's folder. lines: value, of the annotation file. Gives path, label, label_name, source_class, annotation (the rest of the line) and origin (annotation, prefix
    or folder); and a table of one row: annotated files that are missing.
    """
    names = F.array(*map(F.lit, EMOTIONS))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    prefix = lambda file: class_name(F.substring_index(file, "_", 1))
    images = files.filter(F.lower("path").rlike(IMAGES))
    flat = images.withColumn("in_images", F.regexp_extract("path", r"^images/(.+)$", 1))
    inner = F.col("in_images") != ""
    candidates = flat.select("path", F.when(inner, 2).otherwise(3).alias("rank"), prefix(name).alias("label_name"), prefix(name).alias("source_class"), F.lit("").alias("annotation"))
    folder = F.regexp_extract("path", r"^([^/]+)/", 1)
    candidates = candidates.unionByName(images.select("path", F.lit(4).alias("rank"), class_name(folder).alias("label_name"), folder.alias("source_class"), F.lit("").alias("annotation")))
    missing = files.sparkSession.range(1).select(F.lit(0).cast("long").alias("missing"))
    if lines is not None:
        line = F.trim("value")
        parts = F.transform(F.when(F.contains(line, F.lit(",")), F.split(line, ",")).otherwise(F.split(line, r"\s+")), lambda t: F.trim(t))
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
        number = F.get(F.filter(F.transform(rest, lambda t: t.try_cast("double").try_cast("int")), lambda n: n.between(0, 6)), F.lit(0))
        told = lines.select(F.get(parts, F.lit(0)).alias("file"), number.alias("number"), F.array_join(rest, " ").alias("annotation")).filter(F.lower("file").rlike(IMAGES))
        there = flat.select("path", F.explode(F.array_distinct(F.array(F.when(F.col("in_images") != "", F.col("in_images")).otherwise(F.col("path"))))).alias("file"))
        met = told.join(there, "file", "left")
        label = F.coalesce(F.get(names, F.col("number")), prefix(F.col("file")))
        candidates = candidates.unionByName(met.filter("path is not null").select("path", F.lit(1).alias("rank"), label.alias("label_name"), label.alias("source_class"), "annotation"))
        missing = met.agg(F.count_if(F.col("path").isNull()).alias("missing"))
    labelled = F.when(F.col("label_name").isNotNull(), F.col("rank"))
    some = candidates.agg(F.max(F.col("rank") == 2).alias("inner"), *[F.max(F.coalesce(labelled == r, F.lit(False))).alias(f"has_{r}") for r in (1, 2, 3, 4)])  # one row
    chosen = some.select(F.when(F.col("has_1"), 1).when(F.col("has_2"), 2).when(F.col("has_3") & ~F.col("inner"), 3).when(F.col("has_4"), 4).alias("rank"))
    origin = F.get(F.array(F.lit("annotation"), F.lit("prefix"), F.lit("prefix"), F.lit("folder")), F.col("rank") - 1)
    found = candidates.filter("label_name is not null").join(F.broadcast(chosen), "rank").withColumns({"label": F.array_position(names, F.col("label_name")).cast("int") - 1, "origin": origin})
    return found.select("path", "label", "label_name", "source_class", "annotation", "origin"), missing


def pool_sample(pool: DataFrame, n: int, key: str, fits: Column, multiplier: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """n rows of the first n * multiplier of a pool (by key) that fit, in seeded order with dense ids; and a table of one row: wanted, found, short."""
    first = pool.orderBy(key).limit(n * multiplier).filter(fits)
    taken = seeded_sample(first, n, key, seed)
    count = taken.agg(F.lit(n).cast("long").alias("wanted"), F.count(F.lit(1)).alias("found"))
    return taken, count.withColumn("short", F.col("found") < F.col("wanted"))


def prompt_catalog(found: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selected prompts, allowed ones that do not exist, and existing ones that are not allowed (columns task, paradigm, prompt)."""
    key = ["task", "paradigm", "prompt"]
    return found.join(allowed, key, "left_semi"), allowed.join(found, key, "left_anti"), found.join(allowed, key, "left_anti")


def continuable_runs(spark: SparkSession, pattern: str, label: str | None = None) -> DataFrame:
    """Run documents that are not finished, the newest first."""
    runs = spark.read.option("multiLine", True).schema("task string, date string, time string, status string").json(pattern).withColumn("path", F.input_file_name())
    open_ = runs.filter("status is null or status <> 'finished'")
    return (open_.filter(F.col("task") == label) if label else open_).orderBy(F.desc("date"), F.desc("time"))
