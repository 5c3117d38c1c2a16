"""Face boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_box(
    x1: Column, y1: Column, x2: Column, y2: Column, stored_w: Column, stored_h: Column, image_w: Column, image_h: Column,
    padding: float = 0.25,
) -> Column:
    """Face box scaled from the stored image size to the actual one, widened by ``padding`` of its own
    size on each side and clamped to the image. Struct of x1, y1, x2, y2."""

    def scaled(v: Column, stored: Column, actual: Column) -> Column:
        divisor = F.when(F.coalesce(stored, F.lit(0)) == 0, 1).otherwise(stored)
        return (v / divisor * actual).cast("int")

    left, right = scaled(x1, stored_w, image_w), scaled(x2, stored_w, image_w)
    top, bottom = scaled(y1, stored_h, image_h), scaled(y2, stored_h, image_h)
    dx = ((right - left) * padding).cast("int")
    dy = ((bottom - top) * padding).cast("int")
    return F.struct(
        F.greatest(F.lit(0), left - dx).alias("x1"),
        F.greatest(F.lit(0), top - dy).alias("y1"),
        F.least(image_w, right + dx).alias("x2"),
        F.least(image_h, bottom + dy).alias("y2"),
    )
