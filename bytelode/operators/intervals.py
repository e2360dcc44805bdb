"""Intervals and points: the best points of each interval, by a join on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(at: Column | str, size: int) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(size)).cast("long")


def covered(windows: DataFrame, size: int) -> DataFrame:
    """windows (lo, hi, skip_lo, skip_hi) by the bins that they meet: bin, and whether all of it counts."""
    rows = windows.where("hi > lo").withColumn("bin", F.explode(F.sequence(_bin("lo", size), _bin(F.col("hi") - 1, size))))
    first, after = F.col("bin") * size, (F.col("bin") + 1) * size
    return rows.withColumn("whole", (first >= F.col("lo")) & (after <= F.col("hi")) & ((after <= F.col("skip_lo")) | (first >= F.col("skip_hi")) | (F.col("skip_hi") <= F.col("skip_lo"))))


def best(points: DataFrame, windows: DataFrame, keys: list[str], ident: str, k: int, score: str, size: int) -> DataFrame:
    """For each window the k points of highest score with lo <= offset < hi, but none with skip_lo <= offset < skip_hi.

    points has the keys, offset and score and other columns; windows has the keys, ident, lo, hi, skip_lo and skip_hi. Equal
    scores go by offset. Of a bin that counts whole only its own k best points can be among those of the window, so only
    the bins at the ends of windows and of what they skip meet all of their points.
    """
    order = [F.desc(score), F.asc("offset")]
    points = points.withColumn("bin", _bin("offset", size))
    top = points.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "bin").orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
    on = [*keys, "bin"]
    meets = covered(windows, size)
    rest = meets.where("not whole").select(*on, ident, "lo", "hi", "skip_lo", "skip_hi")
    inside = (F.col("offset") >= F.col("lo")) & (F.col("offset") < F.col("hi")) & ~((F.col("offset") >= F.col("skip_lo")) & (F.col("offset") < F.col("skip_hi")))
    columns = [*keys, ident, *(c for c in points.columns if c not in (*keys, "bin"))]
    pairs = meets.where("whole").select(*on, ident).join(top, on).select(*columns).unionAll(rest.join(points, on).where(inside).select(*columns))
    rank = F.row_number().over(Window.partitionBy(*keys, ident).orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
