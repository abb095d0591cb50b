"""Lag sequences and the scaler fitted without looking ahead."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.returns import by_date


def lag_names(window: int) -> list[str]:
    """Oldest first: ``lag_{window-1}`` .. ``lag_0``."""
    if type(window) is not int or window < 1:
        raise ValueError("window must be a positive integer")
    return [f"lag_{k}" for k in range(window - 1, -1, -1)]


def lag_sequences(dataset: DataFrame, window: int, splits: Sequence[str] | None = None) -> DataFrame:
    """Rows with a full trailing window as ``features`` array, oldest first; lags may reach into earlier splits.

    The split filter comes after the window, so a split's first rows have their history.
    """
    lag_names(window)
    rows = by_date().rowsBetween(-(window - 1), 0)
    out = dataset.withColumn("features", F.collect_list("log_return").over(rows)).where(F.size("features") == window)
    return out.where(F.col("split").isin(*splits)) if splits else out


def lag_columns(sequences: DataFrame, window: int) -> DataFrame:
    """The array as one column per lag."""
    return sequences.withColumns({name: F.col("features")[k] for k, name in enumerate(lag_names(window))}).drop("features")


def return_scaler(dataset: DataFrame, cutoff: date | None = None) -> DataFrame:
    """Mean and population deviation per ticker over training and validation rows to ``cutoff``; a constant's scale is 1."""
    rows = dataset.where(F.col("split").isin("train", "validation"))
    if cutoff is not None:
        rows = rows.where(F.col("date") <= F.lit(cutoff))
    spread = F.stddev_pop("log_return")
    return rows.groupBy("ticker").agg(F.avg("log_return").alias("mean"), F.when((spread == 0) | spread.isNull(), F.lit(1.0)).otherwise(spread).alias("scale"))


def scaled(column: str | Column) -> Column:
    return ((F.col(column) if isinstance(column, str) else column) - F.col("mean")) / F.col("scale")


def unscaled(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column) * F.col("scale") + F.col("mean")


def scale_sequences(sequences: DataFrame, scaler: DataFrame) -> DataFrame:
    """Features and target in units of the ticker's scaler."""
    joined = sequences.join(scaler, "ticker")
    return joined.withColumns({"features": F.transform("features", lambda x: (x - F.col("mean")) / F.col("scale")), "target": scaled("target_return")})


def seed_schedule(dataset: DataFrame, window: int) -> DataFrame:
    """Test rows that have a full window, as keys."""
    row = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return dataset.withColumn("row", row).where((F.col("row") >= window) & (F.col("split") == "test")).drop("row")
