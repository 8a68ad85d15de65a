"""Counters and rates of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X


def rates(runs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Installs, downloads and builds, their shares (0 when there is none) and the total time. ``runs``: mode, ms."""
    share = lambda c: F.coalesce(F.col(c) / F.when(F.col("installs") > 0, F.col("installs")), F.lit(0.0))
    out = runs.groupBy(*(key or [])).agg(F.count(F.lit(1)).alias("installs"), F.count_if(F.col("mode") == "download").alias("downloads"), F.count_if(F.col("mode") == "build").alias("builds"), F.coalesce(F.sum("ms"), F.lit(0)).cast("bigint").alias("total_ms"))
    return out.withColumn("download_rate", share("downloads")).withColumn("build_rate", share("builds"))


def summary(totals: DataFrame) -> DataFrame:
    line = F.format_string("%d installs, %.1f%% downloaded, %.1f%% built, ", "installs", F.col("download_rate") * 100, F.col("build_rate") * 100)
    return totals.withColumn("summary", F.concat(line, X.duration_text(F.col("total_ms"))))
