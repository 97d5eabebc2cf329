"""Regression test of convergence with a robust variance, and the vote of three criteria."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least dispersion, share of first months left out, one-sided 5 % threshold.
FLOOR, TRIM, THRESHOLD = 1e-12, 1 / 3, -1.65


def long_run_variance(u: np.ndarray) -> float:
    """Quadratic-spectral estimate with the automatic bandwidth of a first-order autoregression.

    The variance at lag 0 is over all residuals, the covariances leave the last one out, and both are
    divided by one less than their number."""
    t = len(u)
    held = float(u[:-1] @ u[:-1])
    rho = float(u[:-1] @ u[1:]) / held if held > 0 else 0.0
    width = max(1.3221 * (min(4 * rho**2 / max((1 - rho) ** 4, 1e-300), 1e300) * t) ** 0.2, 1e-8)
    lag = np.arange(1, t - 1)
    z = 1.2 * np.pi * lag / width
    kernel = 3 / z**2 * (np.sin(z) / z - np.cos(z))
    cov = np.array([u[: t - 1 - k] @ u[k : t - 1] for k in lag])
    return float((u @ u + 2 * kernel @ cov) / (t - 1))


def log_t(dispersion: DataFrame, group: str, trim: float = TRIM, threshold: float = THRESHOLD) -> DataFrame:
    """group, lrv, beta, se, t, converges from (group, month_idx, h): slope of log(h1 / h) less
    2 log log of the month's number on its log, after the first ``trim`` of the months. A group is one
    series of months. Series with fewer than three months after the cut have nulls."""
    kind = dict(dispersion.dtypes)[group]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.maximum(pdf.sort_values("month_idx")["h"].to_numpy(float), FLOOR)
        at = np.arange(round(len(h) * trim) + 1, len(h) + 1)
        row = {group: [pdf[group].iloc[0]], "lrv": [None], "beta": [None], "se": [None], "t": [None], "converges": [None]}
        if len(at) >= 3 and at[0] > 1:
            x = np.log(at)
            y = np.log(h[0] / h[at - 1]) - 2 * np.log(x)
            x, y = x - x.mean(), y - y.mean()
            slope = float(x @ y / (x @ x))
            lrv = long_run_variance(y - slope * x)
            se = float(np.sqrt(max(lrv, 0.0) / (x @ x)))
            t = slope / se if se > 0 else float(np.sign(slope) * np.inf)
            row |= {"lrv": [lrv], "beta": [slope], "se": [se], "t": [t], "converges": [t > threshold]}
        return pd.DataFrame(row)

    return dispersion.select(group, "month_idx", "h").groupBy(group).applyInPandas(fit, f"{group} {kind}, lrv double, beta double, se double, t double, converges boolean")


def vote(tests: DataFrame, criteria: list[str]) -> DataFrame:
    """``tests`` with the number of true criteria (null: false) and the verdict of at least two."""
    n = sum(F.coalesce(F.col(c), F.lit(False)).cast("int") for c in criteria)
    return tests.withColumn("n_votes", n).withColumn("verdict", F.when(F.col("n_votes") >= 2, "convergence").otherwise("divergence"))
