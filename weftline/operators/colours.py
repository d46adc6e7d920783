"""Colour features of pixel arrays: a sparse histogram over the Lab space, percentiles, means and deviations, inside one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from weftline.functions.exprs import SRGB_TO_XYZ, WHITE_POINT

#: Bins of each axis, where the axes begin and end, and the percentiles.
BINS, LOWS, HIGHS = 6, (0.0, -80.0, -80.0), (100.0, 80.0, 80.0)
PERCENTILES = (10, 25, 50, 75, 90)

_NUMBERS = ArrayType(DoubleType())
_CELLS = ArrayType(StructType().add("cell", IntegerType()).add("share", DoubleType()))
_FEATURES = StructType().add("n_pixels", LongType()).add("cells", _CELLS).add("percentiles", _NUMBERS).add("means", _NUMBERS).add("deviations", _NUMBERS)



def lab_of_pixels(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab of rows of red, green and blue from 0 to 255."""
    x = rgb / 255.0
    linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    xyz = linear @ np.array(SRGB_TO_XYZ).T / np.array(WHITE_POINT)
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.column_stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])])


def _described(rgb: np.ndarray) -> tuple:
    lab = lab_of_pixels(rgb)
    low, high = np.array(LOWS), np.array(HIGHS)
    inside = ((lab >= low) & (lab <= high)).all(axis=1)
    place = np.minimum(((lab[inside] - low) / (high - low) * BINS).astype(np.int64), BINS - 1)
    cells, counts = np.unique(place @ np.array([BINS * BINS, BINS, 1]), return_counts=True)
    shares = [{"cell": int(c), "share": n / len(lab)} for c, n in zip(cells, counts, strict=True)]
    return len(lab), shares, np.percentile(lab, PERCENTILES, axis=0).ravel(), lab.mean(axis=0), lab.std(axis=0)


@F.arrow_udf(_FEATURES)
def _features(pixels: pa.Array) -> pa.Array:
    out = []
    for row in pixels:
        held = row.values
        if held is None or not len(held):
            out.append(None)
            continue
        rgb = np.column_stack([held.field(c).to_numpy(zero_copy_only=False) for c in range(3)]).astype(np.float64)
        out.append(dict(zip(_FEATURES.names, _described(rgb), strict=True)))
    kinds = [pa.int64(), pa.list_(pa.struct([("cell", pa.int32()), ("share", pa.float64())])), *[pa.list_(pa.float64())] * 3]
    return pa.array(out, pa.struct(list(zip(_FEATURES.names, kinds, strict=True))))


def colour_features(rows: DataFrame, pixels: str) -> DataFrame:
    """rows (without pixels) with n_pixels, cells, percentiles, means and deviations.

    pixels is an array of structs of red, green and blue from 0 to 255. cells has the share of pixels of each cell that has any, of BINS
    of lightness x BINS x BINS of both colour axes; a pixel beyond the axes is in no cell but counts as one. percentiles has L, a and b of
    each of PERCENTILES, interpolated; deviations are the population's. Null or no pixels give nulls.
    """
    shaped = F.transform(pixels, lambda p: F.struct(*[p[c].cast("double").alias(c) for c in ("r", "g", "b")]))
    told = rows.withColumn("_told", _features(shaped))
    return told.select(*[f"`{c}`" for c in rows.columns if c not in (pixels, *_FEATURES.names)], "_told.*")


def dense(cells: Column) -> Column:
    """A sparse histogram as BINS ** 3 shares."""
    at = F.map_from_entries(cells)
    return F.transform(F.sequence(F.lit(0), F.lit(BINS**3 - 1)), lambda c: F.coalesce(at[c], F.lit(0.0)))
