"""Scalar functions over columns: geometry, text and ratios."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Central meridian, latitude of origin and standard parallels of the map.
ALBERS = {"lon0": 105.0, "lat0": 56.0, "lat1": 52.0, "lat2": 64.0}


def albers(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float) -> tuple[Column, Column]:
    """x and y of the conic equal-area projection on a unit sphere; longitudes wrap around."""
    s1, s2 = math.sin(math.radians(lat1)), math.sin(math.radians(lat2))
    n, c = (s1 + s2) / 2, 1 + s1 * s2  # cos^2 + 2 n sin of the first parallel
    origin = math.sqrt(c - 2 * n * math.sin(math.radians(lat0))) / n
    rho = F.sqrt(F.greatest(c - 2 * n * F.sin(F.radians(lat)), F.lit(0.0))) / n
    turn = n * F.radians(F.pmod(lon - lon0 + 180.0, F.lit(360.0)) - 180.0)
    return rho * F.sin(turn), origin - rho * F.cos(turn)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-composed form; Spark has no such function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain_name(name: Column) -> Column:
    """Lower case, one space between words, no marks, no numbers' leading zeros."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), r"\\b0+", ""))
