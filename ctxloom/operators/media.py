"""Media arithmetic on metadata and arrays: frame sampling, scaling, grids, perceptual hashes, regions and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The token estimates of a medium whose text is not known.
TOKENS = {"image": 85, "audio": 2500, "video": 5000}


def estimated_tokens(kind: Column, item: Column) -> Column:
    """The tokens of an item before it is read: a constant for media, a quarter of the characters for others."""
    out = F.floor(F.length(item) / 4)
    for name, n in TOKENS.items():
        out = F.when(kind == name, F.lit(n)).otherwise(out)
    return out


def video_info(width: Column, height: Column, frames: Column, fps: Column) -> Column:
    """struct<width, height, fps, total_frames, duration> from what a video's reader gives; the duration takes a rate of 1 at least."""
    return F.struct(
        width.cast("int").alias("width"), height.cast("int").alias("height"), F.round(fps.cast("double"), 2).alias("fps"), frames.cast("long").alias("total_frames"),
        F.round(frames / F.greatest(fps.cast("double"), F.lit(1.0)), 2).alias("duration"),
    )


def frame_indexes(total: Column, fps: Column, sample_fps: float = 1.0, most: int = 16) -> Column:
    """Evenly spaced frame numbers; all frames where fewer than the target."""
    duration = F.when(fps > 0, total / fps).otherwise(F.lit(0.0))
    target = F.least(F.lit(most).cast("long"), F.floor(duration * sample_fps) + 1)
    every = F.when(total > 0, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    some = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(target, F.lit(1)) - 1), lambda i: F.floor(i * total / target))
    return F.when(target >= total, every).otherwise(some)


def scaled(width: Column, height: Column, most: int = 1024) -> tuple[Column, Column]:
    side = F.greatest(width, height)
    scale = F.lit(float(most)) / side
    fit = lambda x: F.when(side > most, F.floor(x * scale)).otherwise(x).cast("long")
    return fit(width), fit(height)


def grid_cell(index: Column, columns: int) -> tuple[Column, Column]:
    """(row, column) of an image in a grid."""
    return F.floor(index / columns).cast("long"), F.pmod(index, F.lit(columns)).cast("long")


def grid_rows(count: Column, columns: int) -> Column:
    return F.ceil(count / columns).cast("long")


def perceptual_hash(grey: Column) -> Column:
    """md5 of the bits `value > mean` of a grey image, as a string of 0 and 1."""
    mean = F.aggregate(grey, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(grey)
    return F.md5(F.array_join(F.transform(grey, lambda x: F.when(x.cast("double") > mean, "1").otherwise("0")), "").cast("binary"))


def dedup_images(images: DataFrame, order: str) -> DataFrame:
    """One row a hash (phash), with the columns of its first image by the order column, and how many images have it."""
    rest = [c for c in images.columns if c != "phash"]
    first = images.groupBy("phash").agg(F.min_by(F.struct(*rest), F.col(order)).alias("first"), F.count("*").alias("images"))
    return first.select("phash", *[F.col(f"first.{c}").alias(c) for c in rest], "images")


def region(tiles: DataFrame, least: float = 0.15) -> DataFrame:
    """tiles (image_id, x, y, w, h, logit) -> image_id, x0, y0, x1, y1: the box round the tiles whose softmax is large."""
    w = W.partitionBy("image_id")
    e = tiles.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(w)).where(F.col("p") >= least)
    return p.groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.count("*").alias("tiles"))


def join_segments(segments: DataFrame) -> DataFrame:
    """segments (file, i, start, end, text) -> file, text, duration, input_tokens (25 a second)."""
    ordered = F.array_sort(F.collect_list(F.struct("i", _stripped().alias("t"))))
    out = segments.groupBy("file").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"), F.max("end").alias("duration"), F.count("*").alias("segments"))
    return out.withColumn("input_tokens", F.floor(F.col("duration") * 25))


def _stripped() -> Column:
    return F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
