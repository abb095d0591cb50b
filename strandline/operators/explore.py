"""Quality, distribution, correlation and extremes of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.returns import maximum_drawdown
from strandline.schema import TRADING_DAYS


def quality_report(prices: DataFrame) -> DataFrame:
    """Per ticker: rows, dates, missing cells over all columns, repeated dates and corporate actions."""
    missing = sum((F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False))).cast("bigint") for c, t in prices.dtypes)
    some = F.max(F.col("date").isNull().cast("int"))
    return prices.groupBy("ticker").agg(
        F.count("*").alias("observations"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum(missing).alias("missing_values"),
        (F.count("*") - F.countDistinct("date") - some).alias("duplicate_dates"),
        F.count_if(F.col("dividends") != 0).alias("dividend_events"),
        F.count_if(F.col("stock_splits") != 0).alias("split_events"),
    )


def shared_calendar(prices: DataFrame) -> DataFrame:
    """One row: whether every ticker has every date; true for an empty panel."""
    pairs = prices.select("ticker", "date").distinct()
    sizes = pairs.groupBy("ticker").agg(F.count("*").alias("dates"))
    every = pairs.agg(F.countDistinct("date").alias("all_dates"))
    joined = sizes.join(F.broadcast(every))  # one row
    return joined.agg(F.coalesce(F.bool_and(F.col("dates") == F.col("all_dates")), F.lit(True)).alias("shared_calendar"))


def adjusted_skewness(column: str) -> Column:
    """Bias-adjusted skewness as sample statistics give it; null below three values."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(column: str) -> Column:
    """Bias-adjusted excess kurtosis; null below four values."""
    n = F.count(column).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def return_summary(returns: DataFrame, keys: Sequence[str] = ("ticker",), annualization: int = TRADING_DAYS) -> DataFrame:
    """Distribution of returns per group (exact percentiles), with the deepest drawdown where groups are tickers."""
    r = "log_return"
    q = lambda p: F.percentile(r, F.lit(p))
    out = returns.groupBy(*keys).agg(
        F.count(r).alias("observations"),
        F.avg(r).alias("mean_daily"),
        q(0.5).alias("median_daily"),
        F.stddev_samp(r).alias("volatility_daily"),
        (F.avg(r) * annualization).alias("mean_annualized"),
        (F.stddev_samp(r) * F.lit(annualization**0.5)).alias("volatility_annualized"),
        adjusted_skewness(r).alias("skewness"),
        adjusted_kurtosis(r).alias("excess_kurtosis"),
        F.min(r).alias("minimum"),
        q(0.01).alias("q01"),
        q(0.05).alias("q05"),
        q(0.5).alias("median"),
        q(0.95).alias("q95"),
        q(0.99).alias("q99"),
        F.max(r).alias("maximum"),
    )
    return out.join(maximum_drawdown(returns), "ticker") if list(keys) == ["ticker"] else out


def return_correlation(returns: DataFrame, method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlation of tickers, long form; ranks are taken within each pair's common dates.

    The result is one row per pair of tickers by definition. Tickers join by
    date, each pair once, and the finished figures are mirrored.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError("method is pearson or spearman")
    a = returns.where(F.col("log_return").isNotNull()).select("date", F.col("ticker").alias("ticker_a"), F.col("log_return").alias("x"))
    b = a.select("date", F.col("ticker_a").alias("ticker_b"), F.col("x").alias("y"))
    pairs = a.join(b, "date").where(F.col("ticker_a") <= F.col("ticker_b"))
    if method == "spearman":
        pairs = pairs.withColumns({c: _average_rank(c) for c in ("x", "y")})
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    n = F.count("*").cast("double")
    # written out so that a constant column gives null instead of an error
    covariance = F.sum(F.col("x") * F.col("y")) / n - F.avg("x") * F.avg("y")
    half = pairs.groupBy("ticker_a", "ticker_b").agg(
        F.when(varies, covariance / (F.stddev_pop("x") * F.stddev_pop("y"))).alias("correlation"), F.count("*").alias("dates")
    )
    sides = F.array(F.struct("ticker_a", "ticker_b"), F.when(F.col("ticker_a") != F.col("ticker_b"), F.struct(F.col("ticker_b").alias("ticker_a"), F.col("ticker_a").alias("ticker_b"))))
    return half.select(F.explode(F.array_compact(sides)).alias("side"), "correlation", "dates").select("side.*", "correlation", "dates")


def _average_rank(column: str) -> Column:
    pair = Window.partitionBy("ticker_a", "ticker_b")
    return F.rank().over(pair.orderBy(column)) + (F.count("*").over(Window.partitionBy("ticker_a", "ticker_b", column)) - 1) / F.lit(2.0)


def top_moves(returns: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest absolute returns; ties by ticker and date."""
    sized = returns.where(F.col("log_return").isNotNull()).withColumn("size", F.abs("log_return"))
    return sized.orderBy(F.desc("size"), "ticker", "date").limit(n).drop("size")


def autocorrelation_of_errors(predictions: DataFrame) -> DataFrame:
    """Residual diagnostics per (model, ticker): moments, quantiles and lag-1 autocorrelation."""
    order = Window.partitionBy("model", "ticker").orderBy("target_date")
    e = predictions.withColumn("e", F.col("actual_return") - F.col("predicted_return")).withColumn("before", F.lag("e").over(order))
    both = F.col("before").isNotNull()
    x, y = F.when(both, F.col("e")), F.col("before")
    n = F.count(y).cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return e.groupBy("model", "ticker").agg(
        F.count("*").alias("observations"),
        F.avg("e").alias("mean"),
        F.stddev_samp("e").alias("std"),
        F.percentile("e", F.lit(0.5)).alias("median"),
        F.percentile("e", F.lit(0.05)).alias("q05"),
        F.percentile("e", F.lit(0.95)).alias("q95"),
        F.when((n > 1) & (spread > 0), (F.sum(x * y) / n - F.avg(x) * F.avg(y)) / spread).alias("lag1_autocorrelation"),
    )
