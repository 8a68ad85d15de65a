"""Complexity signals: rasterised intervals, smoothing, bumps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class Settings:
    threshold: float = 2.5
    window: int = 3
    min_lines: int = 2
    depth_weight: float = 1.0
    predicate_weight: float = 0.5
    flow_weight: float = 0.5


def settings(threshold: float = 2.5, window: int = 3, min_lines: int = 2, **weights: float) -> Settings:
    """Invalid values give way to defaults; an even window grows by one."""
    d = Settings()
    number = lambda x: isinstance(x, (int, float)) and x == x and abs(x) != float("inf") and x >= 0
    window = window if window > 0 else d.window
    kept = {k: v if number(v) else getattr(d, k) for k, v in weights.items()}
    return Settings(threshold if number(threshold) else d.threshold, window + (window % 2 == 0), max(1, min_lines), **kept)


def check_window(window: int) -> None:
    if window <= 0 or window % 2 == 0:
        raise ValueError("the smoothing window must be odd and above zero")


def raster(lines: DataFrame, segments: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, line, value): the sum of the segments (start, end, value) that cover each line.

    A segment is two signed events, summed by a running total, so its length costs nothing. One that lies outside its
    function is an error.
    """
    ends = lines.groupBy(key).agg(F.min(line).alias("first"), F.max(line).alias("last"))
    error = clip_error(F.col("start"), F.col("end"), F.col("first"), F.col("last"))
    checked = segments.select(key, "start", "end", "value").join(ends, key, "left")
    segments = checked.withColumn("value", F.when(error.isNotNull(), F.raise_error(error).cast("double")).otherwise(F.col("value")))
    events = segments.select(key, F.col("start").alias(line), F.col("value").alias("d")).unionByName(segments.select(key, (F.col("end") + 1).alias(line), (-F.col("value")).alias("d")))
    at = events.groupBy(key, line).agg(F.sum("d").alias("d"))
    merged = lines.select(key, line, F.lit(True).alias("own"), F.lit(0.0).alias("d")).unionByName(at.select(key, line, F.lit(False).alias("own"), F.col("d").cast("double")))
    total = F.sum("d").over(Window.partitionBy(key).orderBy(line).rangeBetween(Window.unboundedPreceding, 0))
    return merged.withColumn("value", total).filter("own").select(key, line, "value")


def clip_error(start, end, first, last):
    """Null, or why a segment can't be drawn: it lies outside its function."""
    return F.when((end < first) | (start > last), "SegmentOutsideFunction")


def smooth(signal: DataFrame, key: str, window: int = 3, line: str = "line") -> DataFrame:
    """Centred moving average; the edges average what there is."""
    check_window(window)
    h = window // 2
    return signal.withColumn("smoothed", F.avg("value").over(Window.partitionBy(key).orderBy(line).rowsBetween(-h, h)))


def bumps(signal: DataFrame, key: str, threshold: float = 2.5, min_lines: int = 2, line: str = "line", value: str = "smoothed") -> DataFrame:
    """(key, start, end, n_lines, area) of the stretches at or above the threshold that are long enough."""
    order = Window.partitionBy(key).orderBy(line)
    at = signal.withColumn("pos", F.row_number().over(order)).filter(F.col(value) >= threshold)
    island = at.withColumn("island", F.col("pos") - F.row_number().over(order))
    out = island.groupBy(key, "island").agg(F.min(line).alias("start"), F.max(line).alias("end"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.col(value) - threshold).alias("area"))
    return out.filter(F.col("n_lines") >= min_lines).drop("island")


def top_two(found: DataFrame, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("area"), F.desc("n_lines"), "start"))
    return found.withColumn("rank", rank).filter("rank <= 2")


def bumpy(found: DataFrame, key: str, least: int = 2) -> DataFrame:
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n_bumps"), F.max("area").alias("largest")).filter(F.col("n_bumps") >= least)


def segments(statements: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(fn, start, end, value) of the statements' segments.

    ``statements``: fn, kind (if, while, loop, match_arm), from_expansion, test_start, test_end, test_is_let, branches (of the
    condition or guard; null without one), body_start, body_end, else_start, else_end (null without an else). A condition
    counts its branches unless it is a ``let``; bodies and else arms deepen, arms of a match are flow too; macros give nothing.
    """
    at = lambda a, b, v: F.struct(F.col(a).alias("start"), F.col(b).alias("end"), v.cast("double").alias("value"))
    kind = F.col("kind")
    predicate = F.when(kind.isin("if", "while", "match_arm") & F.col("branches").isNotNull() & ~F.coalesce("test_is_let", F.lit(False)), at("test_start", "test_end", F.col("branches") * s.predicate_weight))
    depth = at("body_start", "body_end", F.lit(s.depth_weight))
    other = F.when((kind == "if") & F.col("else_start").isNotNull(), at("else_start", "else_end", F.lit(s.depth_weight)))
    flow = F.when(kind == "match_arm", at("body_start", "body_end", F.lit(s.flow_weight)))
    own = statements.filter(~F.col("from_expansion") & kind.isin("if", "while", "loop", "match_arm"))
    return own.select("fn", F.explode(F.array_compact(F.array(predicate, depth, other, flow))).alias("x")).select("fn", "x.*")
