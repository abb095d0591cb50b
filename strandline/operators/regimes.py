"""Volatility regimes: trailing deviation over all rows, thresholds from training and validation only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.metrics import return_metrics
from strandline.operators.returns import trailing_deviation
from strandline.schema import PREDICTION_KEYS, TRADING_DAYS


def volatility(dataset: DataFrame, window: int = 21, annualization: int = TRADING_DAYS) -> DataFrame:
    """Computed before any filter: a split's first rows see the history of the one before."""
    return dataset.withColumn("volatility", trailing_deviation("log_return", window, annualization**0.5))


def thresholds(with_volatility: DataFrame) -> DataFrame:
    """Exact linear terciles per ticker; one ticker's values are at most its calendar long."""
    fitted = with_volatility.where(F.col("split").isin("train", "validation") & F.col("volatility").isNotNull())
    return fitted.groupBy("ticker").agg(
        F.percentile("volatility", F.lit(1 / 3)).alias("lower_threshold"), F.percentile("volatility", F.lit(2 / 3)).alias("upper_threshold")
    )


def regime_of(value: Column, lower: Column, upper: Column) -> Column:
    """Ties go to the lower regime."""
    return F.when(value <= lower, "low").when(value <= upper, "medium").when(value.isNotNull(), "high")


def assignments(dataset: DataFrame, window: int = 21, split: str = "test", annualization: int = TRADING_DAYS) -> DataFrame:
    base = volatility(dataset, window, annualization)
    joined = base.join(thresholds(base), "ticker").where((F.col("split") == split) & F.col("volatility").isNotNull())
    return joined.select(*PREDICTION_KEYS, "volatility", regime_of(F.col("volatility"), F.col("lower_threshold"), F.col("upper_threshold")).alias("regime"))


def regime_metrics(predictions: DataFrame, assigned: DataFrame, baseline: str = "naive_zero") -> DataFrame:
    keys = list(PREDICTION_KEYS)
    joined = predictions.join(assigned.select(*keys, "regime"), keys)
    return return_metrics(joined, baseline, ("split", "regime"))
