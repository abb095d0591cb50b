"""Log returns, targets, splits and other positional operators over a panel.

A panel has one row per (ticker, date). Windows are per ticker: a ticker is at
most its calendar long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.contracts import enforce
from strandline.functions.scalars import is_finite
from strandline.schema import DATASET_COLUMNS, TRADING_DAYS, SplitConfig


def by_date() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def log_returns(panel: DataFrame, *, validate: bool = False) -> DataFrame:
    """``ln(p) - ln(previous p)`` per ticker by date; null in the first row. Prices must be positive."""
    if validate:
        enforce(panel, {"price_not_positive": F.col("adj_close") > 0})
    price = F.ln("adj_close")
    return panel.withColumn("log_return", price - F.lag(price).over(by_date()))


def with_targets(returns: DataFrame) -> DataFrame:
    """The next row's date and return; null in the last row of a ticker."""
    return returns.withColumns({"target_date": F.lead("date").over(by_date()), "target_return": F.lead("log_return").over(by_date())})


def split_label(config: SplitConfig, column: str = "target_date") -> Column:
    out = F.lit(None).cast("string")
    for name, (first, last) in reversed(config.parts):
        out = F.when(F.col(column).between(F.lit(first), F.lit(last)), F.lit(name)).otherwise(out)
    return out


def assign_splits(frame: DataFrame, config: SplitConfig, *, validate: bool = False) -> DataFrame:
    out = frame.withColumn("split", split_label(config))
    if validate:
        enforce(out, {"date_outside_splits": F.col("split").isNotNull()})
    return out


def model_dataset(panel: DataFrame, config: SplitConfig, *, validate: bool = False) -> DataFrame:
    """Returns, targets and splits; rows without return or target dropped."""
    full = with_targets(log_returns(panel, validate=validate)).where(is_finite("log_return") & is_finite("target_return"))
    return assign_splits(full, config, validate=validate).select(*DATASET_COLUMNS)


def drawdowns(panel: DataFrame) -> DataFrame:
    """``p / running maximum - 1`` per row."""
    return panel.withColumn("drawdown", F.col("adj_close") / F.max("adj_close").over(by_date().rowsBetween(Window.unboundedPreceding, 0)) - 1)


def maximum_drawdown(panel: DataFrame) -> DataFrame:
    return drawdowns(panel).groupBy("ticker").agg(F.min("drawdown").alias("maximum_drawdown"))


def trailing_deviation(column: str, window: int, scale: float = 1.0) -> Column:
    """Sample deviation of the last ``window`` rows; null until all of them hold a value."""
    rows = by_date().rowsBetween(-(window - 1), 0)
    return F.when(F.count(column).over(rows) == window, F.stddev_samp(column).over(rows) * F.lit(float(scale)))


def rolling_volatility(returns: DataFrame, windows: Sequence[int] = (21, 63), annualization: int = TRADING_DAYS) -> DataFrame:
    if len(set(windows)) != len(windows) or any(type(w) is not int or w < 2 for w in windows):
        raise ValueError("windows must be distinct integers of two or more")
    return returns.withColumns({f"volatility_{w}d": trailing_deviation("log_return", w, annualization**0.5) for w in windows})


def indexed_price(panel: DataFrame) -> DataFrame:
    first = F.first("adj_close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("indexed_price", F.col("adj_close") / first * 100)


def history_length(frame: DataFrame) -> DataFrame:
    """Rows of the ticker up to and including each row's date; rows of one date count together."""
    return frame.withColumn("history", F.count("*").over(by_date().rangeBetween(Window.unboundedPreceding, 0)))


def eligible_origins(frame: DataFrame, warm_up: int, splits: Sequence[str], history_splits: Sequence[str]) -> DataFrame:
    """Rows of ``splits`` with at least ``warm_up`` rows of ``history_splits`` up to their date."""
    if type(warm_up) is not int or warm_up < 1:
        raise ValueError("warm_up must be a positive integer")
    counted = frame.withColumn(
        "history", F.count(F.when(F.col("split").isin(*history_splits), 1)).over(by_date().rangeBetween(Window.unboundedPreceding, 0))
    )
    return counted.where(F.col("split").isin(*splits) & (F.col("history") >= warm_up))


def inner_split(frame: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Marks the first ``int(n * fraction)`` rows of each ticker as inner training."""
    whole = Window.partitionBy("ticker")
    row, rows = F.row_number().over(by_date()), F.count("*").over(whole)
    return frame.withColumn("inner", F.when(row <= F.floor(rows * F.lit(float(fraction))), "inner_train").otherwise("inner_validation"))


def residual_chain(predictions: DataFrame, source: DataFrame, *, validate: bool = True) -> DataFrame:
    """Pairs of consecutive forecast errors in the shape of a model dataset.

    Row t takes forecast t's error as return and forecast t+1's as target, with
    split and price of t+1; the last forecast has no pair. The chain must not
    skip a row: the target date of t is the date of t+1. Unless ``validate`` is
    off a gap, or a forecast without source row, is an error; with it off
    ``contiguous`` tells.
    """
    keys = ["date", "target_date", "ticker", "split"]
    if validate and predictions.join(source, keys, "left_anti").limit(1).count():
        raise ValueError("predictions without a source row")
    keyed = predictions.join(source.select("date", "target_date", "ticker", "split", "adj_close"), ["date", "target_date", "ticker", "split"])
    error = keyed.withColumn("residual", F.col("actual_return") - F.col("predicted_return"))
    order = Window.partitionBy("ticker").orderBy("target_date")
    following = {x: F.lead(x).over(order) for x in ("date", "target_date", "residual", "split", "adj_close")}
    chained = error.withColumns({f"next_{k}": v for k, v in following.items()}).where(F.col("next_date").isNotNull())
    out = chained.select(
        F.col("next_date").alias("date"),
        F.col("next_target_date").alias("target_date"),
        "ticker",
        F.col("next_adj_close").alias("adj_close"),
        F.col("residual").alias("log_return"),
        F.col("next_residual").alias("target_return"),
        F.col("next_split").alias("split"),
        (F.col("target_date") == F.col("next_date")).alias("contiguous"),
    )
    if validate:
        enforce(out, {"residual_chain_not_contiguous": F.col("contiguous")}, allow_empty=True)
    return out
