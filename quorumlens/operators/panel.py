"""Panels: one row for each sample and service, with what the service said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_panel(samples: DataFrame, services: list[str], outputs: DataFrame) -> DataFrame:
    """Every sample with every service, in the order of configuration; a missing output is empty.

    samples: id, ...; outputs: service, id, service_output.
    """
    listed = F.array(*[F.struct(F.lit(k).alias("svc_ord"), F.lit(s).alias("service")) for k, s in enumerate(services)])
    grid = samples.withColumn("s", F.explode(listed)).select(*samples.columns, "s.service", "s.svc_ord")
    return grid.join(outputs.select("service", "id", "service_output"), ["service", "id"], "left").withColumn("service_output", F.coalesce("service_output", F.lit("")))


def wide(panel: DataFrame, services: list[str], prefix: str = "ballot__") -> DataFrame:
    """One row for each id, one column for each service."""
    return panel.groupBy("id").agg(*[F.max(F.when(F.col("service") == s, F.col("service_output"))).alias(f"{prefix}{s}") for s in services])


def service_block(panel: DataFrame) -> DataFrame:
    """id and the text that shows all outputs, a line for each service in order."""
    lines = F.array_sort(F.collect_list(F.struct("svc_ord", F.concat_ws(": ", "service", "service_output").alias("line"))))
    return panel.groupBy("id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("service_blocks"))
