"""Autocorrelation, partial autocorrelation and the Ljung-Box test, per (ticker, series)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tails import chi_square_p, levinson, normal_quantile


def autocorrelations(series: DataFrame, nlags: int) -> DataFrame:
    """(ticker, series, lag, acf, observations) for lags 0..nlags of ``value`` by ``date``; nulls dropped first.

    One window gives all lags; the sums are one partial aggregation.
    """
    if type(nlags) is not int or nlags < 1:
        raise ValueError("nlags must be a positive integer")
    keys = ["ticker", "series"]
    order = Window.partitionBy(*keys).orderBy("date")
    whole = Window.partitionBy(*keys)
    centred = series.where(F.col("value").isNotNull()).withColumn("c", F.col("value") - F.avg("value").over(whole))
    lagged = centred.withColumns({f"c{k}": F.lag("c", k).over(order) for k in range(1, nlags + 1)})
    sums = lagged.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.sum(F.col("c") * F.col("c")).alias("s0"), *(F.sum(F.col("c") * F.col(f"c{k}")).alias(f"s{k}") for k in range(1, nlags + 1))
    )
    usable = sums.where((F.col("s0") > 0) & (F.floor(F.col("observations") / F.lit(2.0)) > nlags))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.col("s0")).alias("acf")) for k in range(nlags + 1))))
    return usable.select(*keys, "observations", rows.alias("r")).select(*keys, "r.lag", "r.acf", "observations")


def correlogram(acf: DataFrame, alpha: float = 0.05) -> DataFrame:
    """ACF with Bartlett bands and PACF (Yule-Walker, biased autocovariances) with its bands, both centred on zero."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    z = normal_quantile(1 - alpha / 2)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy()
        n = int(pdf["observations"].iloc[0])
        spread = np.sqrt(np.concatenate([[0.0], 1 + 2 * np.concatenate([[0.0], np.cumsum(r[1:-1] ** 2)])])[: len(r)] / n) * z
        half = np.where(np.arange(len(r)) == 0, 0.0, z / np.sqrt(n))
        return pdf.assign(acf_ci_lower=-spread, acf_ci_upper=spread, pacf=levinson(r), pacf_ci_lower=-half, pacf_ci_upper=half)[
            ["ticker", "series", "lag", "acf", "acf_ci_lower", "acf_ci_upper", "pacf", "pacf_ci_lower", "pacf_ci_upper"]
        ]

    schema = "ticker string, series string, lag int, acf double, acf_ci_lower double, acf_ci_upper double, pacf double, pacf_ci_lower double, pacf_ci_upper double"
    return acf.groupBy("ticker", "series").applyInPandas(partial, schema)


def ljung_box(acf: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Q statistic at each lag with its chi-square tail."""
    lags = list(lags)
    if not lags or sorted(set(lags)) != lags or lags[0] < 1:
        raise ValueError("lags must be positive and increasing")
    n = F.col("observations").cast("double")
    terms = acf.where("lag > 0").withColumn("term", F.col("acf") * F.col("acf") / (n - F.col("lag")))
    at = terms.withColumn("at", F.explode(F.array(*map(F.lit, lags)))).where(F.col("lag") <= F.col("at"))
    q = at.groupBy("ticker", "series", F.col("at").alias("lag")).agg((F.max(n) * (F.max(n) + 2) * F.sum("term")).alias("statistic"))
    return q.withColumn("p_value", chi_square_p("statistic", "lag")).withColumn("reject_no_autocorrelation_at_5pct", F.col("p_value") < 0.05)
