"""Choice among candidates with deterministic tie-breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import is_finite
from strandline.operators.contracts import enforce
from strandline.schema import PREDICTION_KEYS


def best_of(frame: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; Spark keeps ``n`` per task before the shuffle."""
    name = rank or "_rank"
    out = frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def shortlist_orders(search: DataFrame, size: int = 3, *, validate: bool = False) -> DataFrame:
    """The ``size`` converged orders of least BIC per ticker, ties by p and q."""
    usable = search.where((F.col("status") == "ok") & F.col("converged") & is_finite("bic") & is_finite("aic"))
    out = best_of(usable, ["ticker"], ["bic", "p", "q"], size, "bic_rank")
    if validate and search.select("ticker").distinct().join(out.where(F.col("bic_rank") == size), "ticker", "left_anti").limit(1).count():
        raise ValueError("too few usable candidates for a ticker")
    return out.select("ticker", "p", "d", "q", "bic", "bic_rank", F.concat(F.lit("arima_bic_"), F.col("bic_rank").cast("string")).alias("model"))


def select_arima(candidate_metrics: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Winning order per ticker: least MAE, RMSE, complexity, BIC, p, q."""
    joined = candidate_metrics.join(shortlist, ["ticker", "model"]).withColumn("complexity", F.col("p") + F.col("d") + F.col("q"))
    return best_of(joined, ["ticker"], ["mae_bps", "rmse_bps", "complexity", "bic", "p", "q"]).drop("complexity")


def selected_predictions(predictions: DataFrame, winners: DataFrame, name: str = "arima") -> DataFrame:
    """Predictions of each ticker's winner under one name."""
    return predictions.join(winners.select("ticker", "model"), ["ticker", "model"], "left_semi").withColumn("model", F.lit(name))


def configuration_metrics(runs: DataFrame) -> DataFrame:
    """Per (ticker, window, units, dropout): sound runs, mean errors, spread and the one parameter count.

    Sums are rounded to eight decimals before they are divided, so that equal
    means tie whatever the order of addition.
    """
    ok = F.col("status") == "ok"
    value = lambda c: F.when(ok & is_finite(c), F.col(c))
    mean = lambda c: F.when(F.count(value(c)) > 0, F.round(F.sum(value(c)), 8) / F.count(value(c)))
    return runs.groupBy("ticker", "window", "units", "dropout").agg(
        F.count_if(ok).alias("successful_seeds"),
        mean("mae_bps").alias("mean_mae_bps"),
        mean("rmse_bps").alias("mean_rmse_bps"),
        F.stddev_samp(value("mae_bps")).alias("std_mae_bps"),
        F.max(F.when(ok, F.col("parameter_count"))).alias("parameter_count"),
        (F.min(F.when(ok, F.col("parameter_count"))) == F.max(F.when(ok, F.col("parameter_count")))).alias("one_parameter_count"),
    )


def eligible_configurations(runs: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Configurations with exactly the given seeds, all of them sound."""
    grouped = runs.groupBy("ticker", "window", "units", "dropout").agg(
        F.countDistinct("seed").alias("seeds"),
        F.bool_and(F.coalesce((F.col("status") == "ok") & F.col("seed").isin(*map(int, seeds)), F.lit(False))).alias("sound"),
    )
    return grouped.where(F.col("sound") & (F.col("seeds") == len(set(seeds)))).select("ticker", "window", "units", "dropout")


def select_networks(metrics: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """Winning configuration per ticker: mean MAE, mean RMSE, spread, parameters, window, units, dropout.

    A configuration whose sound runs disagree on the number of parameters is an error.
    """
    if "one_parameter_count" in metrics.columns:
        enforce(metrics, {"more_than_one_parameter_count": F.coalesce("one_parameter_count", F.lit(True))}, allow_empty=True)
    usable = metrics if eligible is None else metrics.join(eligible, ["ticker", "window", "units", "dropout"], "left_semi")
    order = ["mean_mae_bps", "mean_rmse_bps", "std_mae_bps", "parameter_count", "window", "units", "dropout"]
    return best_of(usable.where(F.col("mean_mae_bps").isNotNull()), ["ticker"], order).withColumn("model", F.lit("lstm"))


def runs_of_selected(runs: DataFrame, winners: DataFrame) -> DataFrame:
    """Every run of each ticker's winning configuration, with the configuration's mean."""
    keys = ["ticker", "window", "units", "dropout"]
    return runs.join(winners.select(*keys, "mean_mae_bps"), keys)


def ensemble(seed_predictions: DataFrame, model: str = "lstm") -> DataFrame:
    """Mean over seeds per observation, with the number of seeds."""
    keys = list(PREDICTION_KEYS)
    return seed_predictions.groupBy(*keys).agg(
        F.max("actual_return").alias("actual_return"), F.avg("predicted_return").alias("predicted_return"), F.countDistinct("seed").alias("seeds"), F.lit(model).alias("model")
    )


def status_counts(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys, "status").agg(F.count("*").alias("rows"))


def status_table(frame: DataFrame, statuses: Sequence[str], *keys: str) -> DataFrame:
    """The same with a column per status, 0 where there is none."""
    return frame.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses))
