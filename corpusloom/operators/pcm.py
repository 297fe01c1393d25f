"""Window arithmetic on sample arrays: one row per sample (key, i, x), or one array per key.

The windows partition by key; a very long signal should be cut into overlapping blocks under a
block key first (``blocks``), as a frame never reaches further than its radius.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 0.97


def explode_samples(df: DataFrame, key: str, array: str) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("i", "x"))


def blocks(samples: DataFrame, size: int, margin: int) -> DataFrame:
    """Deals samples into blocks of ``size``, each with ``margin`` samples of its neighbours; rows
    outside their block's core are marked so that they can be dropped after a window."""
    near = F.array_distinct(F.array(F.floor((F.col("i") - margin) / size), F.floor(F.col("i") / size), F.floor((F.col("i") + margin) / size)))
    return samples.withColumn("block", F.explode(near)).where("block >= 0").withColumn("core", F.floor(F.col("i") / size) == F.col("block"))


def sliding(samples: DataFrame, key: str, radius: int) -> DataFrame:
    """Minimum and mean over 2 * radius + 1 samples; frames shrink at the ends."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(-radius, radius)
    return samples.withColumn("low", F.min("x").over(w)).withColumn("mean", F.avg("x").over(w))


def limited_gain(samples: DataFrame, key: str, gain: float, radius: int) -> DataFrame:
    """Amplifies; where the peak would pass the limit, a look-ahead envelope (minimum, then mean
    over half the radius) lowers the gain smoothly, and the result is clamped."""
    near = Window.partitionBy(key).orderBy("i").rowsBetween(-radius, radius)
    smooth = Window.partitionBy(key).orderBy("i").rowsBetween(-(radius // 2), radius // 2)
    loud = F.abs(F.col("x") * gain)
    head = F.when(loud > LIMIT, LIMIT / loud).otherwise(F.lit(1.0))
    peak = F.max(F.abs("x")).over(Window.partitionBy(key))
    out = samples.withColumn("_head", head).withColumn("_low", F.min("_head").over(near)).withColumn("_env", F.avg("_low").over(smooth))
    fitted = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("x") * gain * F.col("_env")))
    return out.withColumn("y", F.when(peak * gain <= LIMIT, F.col("x") * gain).otherwise(fitted)).drop("_head", "_low", "_env")


def voiced_level(samples: DataFrame, key: str, frame: int) -> DataFrame:
    """Root mean square over the frames that reach a tenth of the loudest frame."""
    frames = samples.groupBy(key, F.floor(F.col("i") / frame).alias("f")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("r"), F.count("*").alias("n"))
    top = frames.groupBy(key).agg(F.max("r").alias("top"))
    kept = frames.join(top, key).where(F.col("r") >= F.col("top") / 10)
    level = F.sqrt(F.sum(F.col("r") * F.col("r") * F.col("n")) / F.sum("n"))
    return kept.groupBy(key).agg(F.when(F.max("top") <= 1e-4, 0.0).otherwise(level).alias("level"))


def silent_edges(samples: DataFrame, key: str, floor: float) -> DataFrame:
    """Samples before the first and after the last one above the floor; all of them if none is."""
    loud = F.when(F.abs("x") > floor, F.col("i"))
    return samples.groupBy(key).agg(F.coalesce(F.min(loud), F.count("*")).alias("lead"), (F.max("i") - F.coalesce(F.max(loud), F.lit(-1))).alias("tail"))


def faded(array: Column, k: int) -> Column:
    """A linear ramp over the first and last ``k`` samples."""
    n = F.size(array)
    return F.transform(array, lambda x, i: x * F.least(i, n - 1 - i, F.lit(k)) / float(k))


def to_shorts(array: Column) -> Column:
    """Saturating conversion to 16 bits."""
    return F.transform(array, lambda x: F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), F.round(x * 32767.0))).cast("smallint"))


def resampled(array: Column, source: int, target: int) -> Column:
    """Linear interpolation to another rate."""
    n = F.size(array)
    out = F.floor(n * target / source).cast("int")
    step = source / target

    def one(i: Column) -> Column:
        at = i * step
        low = F.floor(at).cast("int")
        a, b = F.get(array, low), F.get(array, F.least(low + 1, n - 1))
        return a + (b - a) * (at - low)

    return F.when(out > 0, F.transform(F.sequence(F.lit(0), out - 1), one)).otherwise(F.array().cast("array<double>"))


def word_offsets(durations: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """Where each symbol begins: the running sum of the durations before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return durations.withColumn("begins", F.coalesce(F.sum(duration).over(w), F.lit(0)))


def stretch(x: np.ndarray, speed: float, frame: int, reach: int) -> np.ndarray:
    """``x`` faster or slower at the same pitch: frames of ``frame`` samples are laid every half frame of the
    outcome and taken every ``speed`` times half a frame of ``x``, shifted by up to ``reach`` samples to where
    they best continue the one before (greatest correlation with what would have followed it; of equals the
    smallest shift, to the left first). Sums of raised cosines keep the level."""
    n, half = len(x), frame // 2
    total = int(np.floor(n / speed + 0.5))
    if n == 0 or total == 0 or speed == 1.0:
        return x.astype(np.float64)[:total] if speed == 1.0 else np.zeros(total)
    padded = np.concatenate((np.zeros(reach), x.astype(np.float64), np.zeros(2 * frame + reach)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    out, weight = np.zeros(total + 2 * frame), np.zeros(total + 2 * frame)
    shifts = np.array(sorted(range(-reach, reach + 1), key=lambda s: (abs(s), s)))
    follow = None
    for k in range(total // half + 1):
        at = min(int(np.floor(k * half * speed + 0.5)), n)
        best = 0
        if follow is not None:
            wanted = padded[follow : follow + half]
            near = np.lib.stride_tricks.sliding_window_view(padded[at : at + 2 * reach + half], half)
            best = int(shifts[np.argmax(np.round((near @ wanted)[shifts + reach], 9))])
        start = reach + at + best
        out[k * half : k * half + frame] += window * padded[start : start + frame]
        weight[k * half : k * half + frame] += window
        follow = min(start + half, len(padded) - half)
    return out[:total] / np.maximum(weight[:total], 1e-3)


def stretched(array: Column, speed: float, frame: int = 16, reach: int = 4) -> Column:
    """The signal at another speed; it has round(n / speed) samples. Signals are cut into blocks beforehand if
    they don't fit into a task (``blocks``)."""
    if speed <= 0:
        raise ValueError("speed must be above 0")

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: stretch(np.asarray(x, np.float64), speed, frame, reach) if x is not None else None)

    return run(array)
