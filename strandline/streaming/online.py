"""Streaming counterparts of the batch operators: online forecasts, windowed quality and idempotent sinks.

The state per ticker is a few numbers, whatever its history.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FORECAST_DDL = "ticker string, date date, adj_close double, log_return double, forecast double, history bigint"
STATE_DDL = "last_day int, last_price double, total double, history bigint"


def online_forecasts(prices: DataFrame) -> DataFrame:
    """Log return of each arriving price and the expanding-mean forecast of the next one.

    ``prices`` has date, ticker and adj_close; rows of one ticker must arrive in
    order of date across batches. A row not later than the last one seen, a null
    or a non-positive price is skipped: a value affects later forecasts only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_day, last_price, total, history = state.get if state.exists else (-(1 << 30), float("nan"), 0.0, 0)
        rows = []
        whole = pd.concat(list(batches))
        whole = whole[whole["adj_close"] > 0].sort_values("date")
        for day, price in zip(whole["date"], whole["adj_close"], strict=True):
            number = (day - pd.Timestamp("1970-01-01").date()).days
            if number <= last_day:
                continue
            if not np.isnan(last_price):
                got = float(np.log(price) - np.log(last_price))
                total, history = total + got, history + 1
                rows.append((key[0], day, price, got, total / history, history))
            last_day, last_price = number, float(price)
        state.update((int(last_day), float(last_price), float(total), int(history)))
        yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in FORECAST_DDL.split(",")])

    return prices.groupBy("ticker").applyInPandasWithState(step, FORECAST_DDL, STATE_DDL, "append", GroupStateTimeout.NoTimeout)


def windowed_quality(events: DataFrame, *, time: str = "ts", value: str = "value", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Readings, missing readings, total and extremes per key and event-time window; rows later than the watermark are dropped."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window), F.col(key).alias("key"))
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col(value).isNull() | F.isnan(value)).alias("missing"),
            F.sum(value).alias("total"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "key", "rows", "missing", "total", "minimum", "maximum")
    )


def batch_writer(root: str | Path):  # noqa: ANN201
    """A ``foreachBatch`` sink that overwrites the batch's own folder: a repeated batch leaves one copy."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return write
