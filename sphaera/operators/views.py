"""What can be seen from a place: horizons and skylines over samples along rays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slopes(samples: DataFrame, eye: float, radius_m: float = 6371000.0) -> DataFrame:
    """samples (ray, km, z) with the apparent slope of each: height above the eye less the drop of the curved ground, over distance."""
    d = F.col("km") * 1000
    return samples.withColumn("slope", (F.greatest(F.lit(0.0), F.col("z")) - eye - d * d / (2 * radius_m)) / d)


def horizons(samples: DataFrame, far: float = 320.0, enough: float = 0.002, dip: float = 0.004) -> DataFrame:
    """samples (ray, km, slope) -> ray, km: the first distance at which the ground has dipped behind what stood before, `far` if nowhere."""
    before = Window.partitionBy("ray").orderBy("km").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("slope").over(before)
    hidden = samples.withColumn("top", top).withColumn("hid", (F.col("top") > enough) & (F.col("slope") < F.col("top") - dip))
    return hidden.groupBy("ray").agg(F.coalesce(F.min(F.when(F.col("hid"), F.col("km"))), F.lit(far)).alias("km"))


def skyline(rays: DataFrame, floor: float = 0.5) -> DataFrame:
    """rays (view, azimuth, angle) -> view, first, last, n, peak of the runs of azimuths above the floor; runs don't go through north."""
    w = Window.partitionBy("view").orderBy("azimuth")
    up = rays.withColumn("up", F.col("angle") > floor)
    new = (~F.lag("up").over(w).eqNullSafe(F.col("up"))).cast("int")
    run = up.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("up")
    return run.groupBy("view", "run").agg(F.min("azimuth").alias("first"), F.max("azimuth").alias("last"), F.count("*").alias("n"), F.max("angle").alias("peak")).drop("run")
