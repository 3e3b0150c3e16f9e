"""Image-grid operators on row-major pixel vectors: pooling, 3x3 convolution
with zero padding and a stride, nearest-neighbour upsampling.

An image is one row's array, so each operator is a projection: every output
cell is worked out from the array by position, and only the result is exploded
into (img, r, c, v). Nothing is shuffled."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, img: str, height: int, width: int, value) -> DataFrame:
    """(img, r, c, v) over a height x width grid; ``value(r, c)`` gives a cell."""
    def cell(i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), (i % width).cast("int")
        return F.struct(r.alias("r"), c.alias("c"), value(r, c).alias("v"))

    grid = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), cell)
    return df.select(F.col(img).alias("img"), F.explode(grid).alias("_c")).select("img", "_c.r", "_c.c", "_c.v")


def pool(df: DataFrame, img: str, vec: str, height: int, width: int, size: int = 2, how: str = "avg") -> DataFrame:
    """size x size pooling (avg or max), stride = size; a last row or column of
    blocks may be smaller."""
    def value(r: Column, c: Column) -> Column:
        inside = [F.when((r * size + a < height) & (c * size + b < width), F.get(vec, (r * size + a) * width + c * size + b))
                  for a in range(size) for b in range(size)]
        cells = F.filter(F.array(*inside), lambda v: v.isNotNull())
        if how == "max":
            return F.array_max(cells)
        return F.aggregate(cells, F.lit(0.0), lambda s, v: s + v) / F.size(cells)

    return _cells(df, img, -(-height // size), -(-width // size), value)


def conv3x3(df: DataFrame, img: str, vec: str, kernel: Sequence[Sequence[float]], height: int, width: int,
            stride: int = 1) -> DataFrame:
    """out[r][c] = Σ K[a][b] · in[r·s+a-1][c·s+b-1] (cross-correlation, zero
    padding)."""
    def value(r: Column, c: Column) -> Column:
        out = F.lit(0.0)
        for a in range(3):
            for b in range(3):
                y, x = r * stride + (a - 1), c * stride + (b - 1)
                inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
                out = out + F.when(inside, F.get(vec, y * width + x)).otherwise(0.0) * F.lit(float(kernel[a][b]))
        return out

    return _cells(df, img, -(-height // stride), -(-width // stride), value)


def upsample_nearest(df: DataFrame, img: str, vec: str, height: int, width: int, factor: int = 2) -> DataFrame:
    at = lambda r, c: F.get(vec, F.floor(r / factor).cast("int") * width + F.floor(c / factor).cast("int"))
    return _cells(df, img, height * factor, width * factor, at)
