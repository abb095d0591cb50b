"""Augmented Dickey-Fuller and KPSS tests per (ticker, series), as NumPy kernels in grouped tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import spread

REPORT_DDL = (
    "ticker string, series string, regression string, test string, statistic double, p_value double, lags int, observations int, "
    "critical_1pct double, critical_5pct double, critical_10pct double, stationary_at_5pct boolean"
)
MIN_OBSERVATIONS = 30

#: MacKinnon (1994) response surfaces for one variable: bounds, small-p and large-p polynomials. Fixed values.
ADF_BOUNDS = {"c": (-18.83, -1.61, 2.74), "ct": (-16.18, -2.89, 0.70)}
ADF_SMALL = {"c": (2.1659, 1.4412, 0.038269), "ct": (3.2512, 1.6047, 0.049588)}
ADF_LARGE = {"c": (1.7339, 0.93202, -0.12745, -0.010368), "ct": (2.5261, 0.61654, -0.37956, -0.060285)}
#: MacKinnon (2010) critical values at 1, 5 and 10 percent: polynomials in 1 / observations. Fixed values.
ADF_CRITICAL = {
    "c": ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809)),
    "ct": ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
}
#: Kwiatkowski et al. (1992), at 10, 5, 2.5 and 1 percent. Fixed values.
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)


def clean_series(values: np.ndarray) -> np.ndarray:
    values = np.asarray(values, float)
    values = values[~np.isnan(values)]
    if len(values) < MIN_OBSERVATIONS or not np.isfinite(values).all() or np.ptp(values) == 0:
        raise ValueError("a series needs enough finite values that vary")
    return values


def _least_squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, rest, float(rest @ rest)


def adf(values: np.ndarray, regression: str = "c") -> tuple[float, float, int, int, tuple[float, float, float]]:
    """(statistic, p, lags, observations, critical values); lags by AIC over a common sample."""
    y = clean_series(values)
    n, trend = len(y), 1 if regression == "c" else 2
    step = np.diff(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - trend - 1)

    def design(lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(step))
        columns = [y[rows], *(step[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))]
        if trend == 2:
            columns.append(rows + 1.0)
        return step[rows], np.column_stack(columns)

    scores = []
    target, widest = design(most, most)
    for lags in range(most + 1):
        chosen = np.r_[0 : lags + 1, most + 1 : widest.shape[1]]
        _, _, sse = _least_squares(target, widest[:, chosen])
        m = len(target)
        scores.append((m * (math.log(2 * math.pi * sse / m) + 1) + 2 * len(chosen), lags))
    lags = min(scores)[1]
    target, x = design(lags, lags)
    beta, _, sse = _least_squares(target, x)
    used = len(target)
    covariance = np.linalg.pinv(x.T @ x) * sse / (used - x.shape[1])
    statistic = float(beta[0] / math.sqrt(covariance[0, 0]))
    critical = tuple(sum(c / used**k for k, c in enumerate(row)) for row in ADF_CRITICAL[regression])
    return statistic, adf_p(statistic, regression), lags, used, critical  # type: ignore[return-value]


def adf_p(statistic: float, regression: str) -> float:
    low, middle, high = ADF_BOUNDS[regression]
    if statistic > high:
        return 1.0
    if statistic < low:
        return 0.0
    row = ADF_SMALL[regression] if statistic <= middle else ADF_LARGE[regression]
    z = sum(c * statistic**k for k, c in enumerate(row))
    return math.erfc(-z / math.sqrt(2)) / 2


def kpss(values: np.ndarray, regression: str = "c") -> tuple[float, float, int, int, tuple[float, float, float]]:
    """(statistic, p within [0.01, 0.10], lags, observations, critical values); automatic Bartlett lag."""
    y = clean_series(values)
    n = len(y)
    x = np.column_stack([np.ones(n)] + ([np.arange(1.0, n + 1)] if regression == "ct" else []))
    _, e, _ = _least_squares(y, x)
    first = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for k in range(1, first + 1):
        part = e[k:] @ e[:-k] / (n / 2)
        s0, s1 = s0 + part, s1 + k * part
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = e @ e + 2 * sum((e[k:] @ e[:-k]) * (1 - k / (lags + 1)) for k in range(1, lags + 1))
    statistic = float((np.cumsum(e) ** 2).sum() / n**2 / (long_run / n))
    row = KPSS_CRITICAL[regression]
    return statistic, float(np.interp(statistic, row, KPSS_LEVELS)), lags, n, (row[3], row[1], row[0])


def stationarity_report(series: DataFrame, *, strict: bool = True) -> DataFrame:
    """Both tests of each (ticker, series) of ``value`` by ``date``; ``log_price`` with a trend, others without.

    A series that is too short, constant or not finite is an error that names
    it; without ``strict`` it gives a row per test with nulls. Text is read as
    numbers; what cannot be read counts as missing. A task holds one series, at
    most one calendar long.
    """
    series = series.withColumn("value", F.col("value").try_cast("double"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        name = pdf["series"].iloc[0]
        regression = "ct" if name == "log_price" else "c"
        rows = []
        for label, run in (("ADF", adf), ("KPSS", kpss)):
            try:
                statistic, p, lags, n, critical = run(pdf["value"].to_numpy(float), regression)
            except ValueError as error:
                if strict:
                    raise ValueError(f"{pdf['ticker'].iloc[0]} {name}: {error}") from error
                rows.append((pdf["ticker"].iloc[0], name, regression, label, *[None] * 8))
                continue
            rows.append((pdf["ticker"].iloc[0], name, regression, label, statistic, p, lags, n, *critical, bool(p < 0.05 if label == "ADF" else p >= 0.05)))
        return pd.DataFrame(rows, columns=[x.strip().split()[0] for x in REPORT_DDL.split(",")])

    return spread(series, "ticker", "series").groupBy("ticker", "series").applyInPandas(test, REPORT_DDL)
