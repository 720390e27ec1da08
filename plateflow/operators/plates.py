"""Ink limits over pixels, and separation plates: one gray value for each pixel and ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The process inks' names.
PROCESS = {"c": "Cyan", "m": "Magenta", "y": "Yellow", "k": "Black"}


def limit_inks(pixels: DataFrame, percent: float | None = 300.0, gcr: float = 0.8, inks: tuple[str, str, str, str] = ("c", "m", "y", "k")) -> DataFrame:
    """pixels with the inks of ink.limit() in place of their own, step by step.

    Each step is a projection of its own, whose results later ones name, so that none is written out again in the next. No
    percent: pixels as they are.
    """
    if percent is None:
        return pixels
    kept = [c for c in pixels.columns if c not in inks]
    most = F.lit(percent / 100.0)
    c, m, y, k = (F.col(v) for v in inks)
    moved = F.greatest(F.lit(0.0), F.least(F.least(c, m, y) * F.lit(min(1.0, max(0.0, gcr))), F.lit(1.0) - k))
    p = pixels.select(*kept, *inks, (c + m + y + k > most).alias("__over"), moved.alias("__moved"))
    over, moved = F.col("__over"), F.col("__moved")
    p = p.select(*kept, "__over", *[F.when(over, v - moved).otherwise(v).alias(n) for v, n in zip((c, m, y), inks)], F.when(over, k + moved).otherwise(k).alias(inks[3]))
    p = p.select("*", (c + m + y + k - most).alias("__rest"), (c + m + y).alias("__colour"))
    rest, colour = F.col("__rest"), F.col("__colour")
    some = colour > 0
    p = p.select(*kept, *inks, "__over", (over & (rest > 0)).alias("__fix"), some.alias("__some"), (rest / F.when(some, colour).otherwise(F.lit(1.0))).alias("__share"))
    fix, some = F.col("__fix"), F.col("__some")
    less = [F.when(fix & some, F.greatest(F.lit(0.0), v - v * F.col("__share"))).otherwise(v).alias(n) for v, n in zip((c, m, y), inks)]
    p = p.select(*kept, "__over", *less, F.when(fix & ~some, F.least(k, most)).otherwise(k).alias(inks[3]))
    p = p.select("*", (c + m + y + k).alias("__left"))
    left = F.col("__left")
    p = p.select(*kept, *inks, F.when(over & (left > most), most / F.when(left > 0, left).otherwise(F.lit(1.0))).otherwise(F.lit(1.0)).alias("__scale"))
    return p.select(*kept, *[(F.col(n) * F.col("__scale")).alias(n) for n in inks])


def plate_name(name: Column) -> Column:
    """An ink's name as part of a file name."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def split_plates(pixels: DataFrame, keys: list[str], inks: dict[str, str] | None = None) -> DataFrame:
    """(keys, plate, v): inks names the plate of each ink column. No shuffle: each pixel gives a row for each ink."""
    inks = inks or PROCESS
    named = pixels.select(*keys, *[F.col(c).alias(n) for c, n in inks.items()])
    return named.unpivot(keys, list(inks.values()), "plate", "v")


def usage(plates: DataFrame) -> DataFrame:
    """What each plate prints: pixels, ink, the darkest, the mean, and pixels without ink. Partial sums go before the shuffle."""
    return plates.groupBy("plate").agg(F.count("*").alias("pixels"), F.sum("v").alias("ink"), F.max("v").alias("darkest"), F.round(F.avg("v"), 6).alias("mean"), F.count(F.when(F.col("v") == 0, 1)).alias("blank"))
