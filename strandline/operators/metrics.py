"""Error metrics of aligned predictions: per ticker and pooled over raw rows, in one grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import ratio
from strandline.schema import BPS, PREDICTION_KEYS

POOLED = "ALL"


def guard_label(frame: DataFrame) -> None:
    """A ticker named like the pooled row would be mixed with it."""
    if frame.where(F.col("ticker") == POOLED).limit(1).count():
        raise ValueError(f"no ticker may be named {POOLED}")


def _error() -> Column:
    return F.col("predicted_return") - F.col("actual_return")


def return_metrics(predictions: DataFrame, baseline: str = "naive_zero", keys: Sequence[str] = ("split",)) -> DataFrame:
    """Metrics of every (keys, model) per ticker and pooled, relative to the baseline's.

    Two grouping levels come from one Expand and one shuffle; the baseline's
    figures join as an aggregate, not as rows. The baseline's mean error of zero
    leaves ``rel_mae`` null, its squared one ``oos_r2``.
    """
    keys = list(keys)
    same = (F.signum("predicted_return") == F.signum("actual_return")).cast("double")
    measures = [F.count("*").alias("observations"), F.avg(F.abs(_error())).alias("mae"), F.avg(_error() * _error()).alias("mse"), F.avg(same).alias("directional_accuracy")]
    grouped = predictions.groupingSets([[*keys, "model", "ticker"], [*keys, "model"]], *keys, "model", "ticker").agg(*measures, F.grouping("ticker").alias("pooled"))
    grouped = grouped.withColumn("ticker", F.when(F.col("pooled") == 1, F.lit(POOLED)).otherwise(F.col("ticker")))
    base = grouped.where(F.col("model") == baseline).select(*keys, "ticker", "pooled", F.col("mae").alias("base_mae"), F.col("mse").alias("base_mse"))
    return grouped.join(base, [*keys, "ticker", "pooled"]).select(
        *keys,
        "ticker",
        "model",
        "observations",
        (F.col("mae") * BPS).alias("mae_bps"),
        (F.sqrt("mse") * BPS).alias("rmse_bps"),
        ratio(F.col("mae"), F.col("base_mae")).alias("rel_mae"),
        (1 - ratio(F.col("mse"), F.col("base_mse"))).alias("oos_r2"),
        "directional_accuracy",
    )


def seed_metrics(predictions: DataFrame) -> DataFrame:
    """Errors of single seeds: (family, ticker, seed)."""
    return predictions.groupBy("family", "ticker", "seed").agg(
        F.count("*").alias("observations"), (F.avg(F.abs(_error())) * BPS).alias("mae_bps"), (F.sqrt(F.avg(_error() * _error())) * BPS).alias("rmse_bps")
    )


def seed_spread(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("family", "ticker").agg(
        F.avg("mae_bps").alias("mean_mae_bps"), F.stddev_samp("mae_bps").alias("std_mae_bps"), F.min("mae_bps").alias("min_mae_bps"), F.max("mae_bps").alias("max_mae_bps")
    )


def price_predictions(predictions: DataFrame, dataset: DataFrame) -> DataFrame:
    """Prices that returns imply from the origin's price."""
    keys = list(PREDICTION_KEYS)
    return predictions.join(dataset.select(*keys, "adj_close"), keys, "left").withColumns(
        {"actual_price": F.col("adj_close") * F.exp("actual_return"), "predicted_price": F.col("adj_close") * F.exp("predicted_return")}
    )


def scaling_errors(dataset: DataFrame) -> DataFrame:
    """Mean absolute one-step price change of training and validation rows, per ticker."""
    change = F.abs(F.col("adj_close") * F.exp("target_return") - F.col("adj_close"))
    return dataset.where(F.col("split").isin("train", "validation")).groupBy("ticker").agg(F.avg(change).alias("scale"))


def price_metrics(prices: DataFrame, scales: DataFrame) -> DataFrame:
    """Price errors per (ticker, model); the pooled row averages the scale-free ones over tickers and has no others."""
    error = F.abs(F.col("predicted_price") - F.col("actual_price"))
    size = F.abs("actual_price") + F.abs("predicted_price")
    rows = (
        prices.groupBy("ticker", "model")
        .agg(
            F.count("*").alias("observations"),
            F.avg(error).alias("price_mae"),
            F.sqrt(F.avg(error * error)).alias("price_rmse"),
            F.avg(ratio(2 * error, size, F.lit(0.0))).alias("smape"),
        )
        .join(scales, "ticker", "left")
        .withColumn("mase", ratio(F.col("price_mae"), F.col("scale")))
        .drop("scale")
    )
    nothing = F.lit(None).cast("double")
    pooled = rows.groupBy("model").agg(F.sum("observations").alias("observations"), F.avg("smape").alias("smape"), F.avg("mase").alias("mase"))
    return rows.unionByName(pooled.withColumns({"ticker": F.lit(POOLED), "price_mae": nothing, "price_rmse": nothing}))


def cumulative_loss_difference(predictions: DataFrame, candidate: str, comparator: str) -> DataFrame:
    """Running sum of candidate minus comparator absolute error, per ticker by target date."""
    from pyspark.sql import Window

    wide = (
        predictions.where(F.col("model").isin(candidate, comparator))
        .groupBy("ticker", "target_date")
        .agg(*(F.max(F.when(F.col("model") == m, F.abs(_error()))).alias(n) for m, n in ((candidate, "a"), (comparator, "b"))))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    so_far = Window.partitionBy("ticker").orderBy("target_date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("ticker", "target_date", F.sum((F.col("a") - F.col("b")) * BPS).over(so_far).alias("cumulative_bps"))
