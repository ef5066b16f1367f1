"""Configuration entries as rows: enabled ones, plans, preferred prompts, model ids, folders."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "name string, ord int, enabled boolean, fields map<string,string>"


def entries(spark: SparkSession, section: Mapping[str, Mapping[str, object] | None]) -> DataFrame:
    """name, ord, enabled (False unless set) and the other fields as text, in the order of configuration."""
    if not isinstance(section, Mapping):
        raise ValueError("a section of the configuration is a mapping of names to entries")
    rows = []
    for n, (name, entry) in enumerate(section.items()):
        if entry is not None and not isinstance(entry, Mapping):
            raise ValueError(f"the entry {name!r} is no mapping")
        fields = dict(entry or {})
        rows.append((name, n, fields.pop("enabled", False) is True, {k: None if v is None else str(v) for k, v in fields.items()}))
    return spark.createDataFrame(rows, ENTRIES)


def enabled(found: DataFrame) -> DataFrame:
    return found.filter("enabled").select("name", "ord")


def planned_jobs(samples: DataFrame, models: DataFrame, prompts: DataFrame) -> DataFrame:
    """task, jobs: samples x enabled models x prompts of each task that has results. samples: task, id; prompts: task, prompt."""
    n_models = enabled(models).agg(F.count(F.lit(1)).alias("n_models"))
    sizes = samples.groupBy("task").agg(F.count(F.lit(1)).alias("n")).join(prompts.groupBy("task").agg(F.count(F.lit(1)).alias("n_prompts")), "task")
    return sizes.crossJoin(F.broadcast(n_models)).select("task", (F.col("n") * F.col("n_models") * F.col("n_prompts")).alias("jobs"))  # one row


def preferred(found: DataFrame, wanted: str = "medium") -> DataFrame:
    """task and the first prompt, in order, whose name holds ``wanted``, or else the first. found: task, prompt, ord."""
    rank = F.struct(~F.contains(F.lower("prompt"), F.lit(wanted)), "ord")
    return found.groupBy("task").agg(F.min_by("prompt", rank).alias("prompt"))


def first_working(cells: DataFrame) -> DataFrame:
    """task and the first model, in order, that answered. cells: task, model, ord, status."""
    return cells.filter("status = 'success'").groupBy("task").agg(F.min_by("model", "ord").alias("model"))


def model_id(name: str, entry: Mapping[str, str]) -> str:
    """The id of a model: of its environment variable, if set, or else of its entry."""
    variable = entry.get("model_id_env") or re.sub(r"\W", "_", name).upper().strip("_") + "_MODEL_ID"
    found = os.environ.get(variable) or entry.get("model_id")
    if not found:
        raise ValueError(f"the entry {name!r} has no model_id")
    return found


def flag(variable: str) -> bool:
    """Whether an environment variable says yes."""
    return os.environ.get(variable, "").strip().lower() in ("1", "true", "yes", "on")


def split_folder(paths: DataFrame, keyword: str) -> DataFrame:
    """The folder of a split among file paths: its name holds the keyword; one with images goes before others, then the shallowest."""
    image = F.lower("path").rlike(r"\.(jpg|jpeg|png|bmp)$")
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), n.alias("depth"), F.get(parts, n - 1).alias("name"), ((F.size(parts) - n == 1) | ((F.size(parts) - n == 2) & (F.get(parts, n) == "images"))).alias("near")))
    folders = paths.filter(F.size(parts) > 1).select(image.alias("image"), F.explode(upto).alias("f")).filter(F.contains(F.lower("f.name"), F.lit(keyword)))
    scored = folders.groupBy("f.folder").agg(F.max("f.depth").alias("depth"), F.max(F.col("image") & F.col("f.near")).alias("images"))
    return scored.agg(F.max_by("folder", F.struct("images", (-F.col("depth")).alias("shallow"))).alias("folder"))


def annotation_file(paths: DataFrame) -> DataFrame:
    """The most telling annotation file among paths: of seven classes, named as annotation, a text file."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    rank = F.struct(F.contains(name, F.lit("7class")).alias("a"), F.contains(name, F.lit("annotation")).alias("b"), F.endswith(name, F.lit(".txt")).alias("c"))
    return paths.filter(name.rlike(r"\.(txt|csv)$")).agg(F.max_by("path", rank).alias("path"))


def with_files(annotated: DataFrame, files: DataFrame) -> tuple[DataFrame, Column]:
    """Annotations (file, ...) with the path of their file, and the number of those without one, to be counted in an aggregate."""
    joined = annotated.join(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path"), "file", "left")
    return joined, F.count_if(F.col("path").isNull())
