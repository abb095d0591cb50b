"""The final evaluation as resumable stages: forecasts, ensembles, hybrids, aligned table and reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.models.lstm import TrainingConfig
from strandline.operators import contracts, forecast, inference, metrics, regimes, returns, selection
from strandline.schema import DATASET_COLUMNS, MODEL_ORDER, PREDICTION_COLUMNS, NetworkConfig, Protocol, SplitConfig
from strandline.sources.checkpoint import CheckpointStore, content_digest, fingerprint


@dataclass(frozen=True)
class FinalReports:
    predictions: DataFrame
    return_metrics: DataFrame
    price_metrics: DataFrame
    regime_metrics: DataFrame
    dm_results: DataFrame
    bootstrap_intervals: DataFrame
    seed_metrics: DataFrame
    seed_spread: DataFrame


def _validate_source(dataset: DataFrame, protocol: Protocol) -> tuple[date, date]:
    """Refuses a dataset that is not the protocol's; the first and last test target date.

    The published boundaries are trading days and must both be met. Boundaries
    of one's own may lie beyond the data; then the first and last test date of
    the data are the span, and every ticker must have both.
    """
    first, last = dataset.where("split = 'test'").agg(F.min("target_date"), F.max("target_date")).first()
    if first is None:
        raise ValueError("no test rows")
    config = protocol.splits
    if config != SplitConfig():
        config = replace(config, test=(first, last))
    contracts.validate_final_dataset(dataset, config, protocol.tickers)
    return config.test


_EVERY = ("train", "validation", "test")


def _backtest(store: CheckpointStore, dataset: DataFrame, protocol: Protocol, orders: Mapping[str, tuple[int, int, int]], splits: tuple[str, ...]) -> DataFrame:
    """ARIMA refits at every eligible origin of ``splits``, a unit per ticker; the complete tail of the dataset."""
    own = lambda t: dataset.where(F.col("ticker") == t)
    fit = lambda t: forecast.walk_forward(own(t), forecast.arima_fitter(dict(orders)), "arima", splits=splits, history_splits=splits, warm_up=protocol.warm_up)
    found = store.run_named("arima", {t: (lambda t=t: fit(t)) for t in protocol.tickers})
    contracts.validate_tail(found, dataset.where(F.col("split").isin(*splits)))
    return found


def run_residual_backtest(
    spark: SparkSession, dataset: DataFrame, root: object, protocol: Protocol, orders: Mapping[str, tuple[int, int, int]], splits: tuple[str, ...] = ("train", "validation")
) -> tuple[DataFrame, DataFrame]:
    """(forecasts, residual dataset) of expanding ARIMA refits, resumable by ticker in a store of its own.

    The residual dataset is the chain of forecast errors; a gap in it is an
    error. Both tables are kept, and computed again and compared on a resume.
    """
    contracts.validate_dataset(dataset)
    mark = fingerprint({"data": content_digest(dataset.select(*DATASET_COLUMNS)), "orders": dict(orders), "splits": splits, "protocol": repr(protocol)})
    store = CheckpointStore(spark, root, mark)
    found = _backtest(store, dataset, protocol, orders, splits)
    return found, store.keep("residuals", returns.residual_chain(found, dataset).drop("contiguous"))


def run_final(
    spark: SparkSession,
    dataset: DataFrame,
    root: object,
    protocol: Protocol,
    orders: Mapping[str, tuple[int, int, int]],
    networks: Mapping[str, NetworkConfig],
    residual_networks: Mapping[str, NetworkConfig],
    seeds: tuple[int, ...],
    training: TrainingConfig | None = None,
) -> FinalReports:
    """ARIMA, network and residual-network forecasts of the test split, each a checkpointed unit per ticker.

    Networks learn from training and validation rows. A residual network learns
    from the chain of ARIMA errors from the first eligible origin on. Each model
    must forecast every test row of the dataset; a missing row, or a gap in the
    chain, is an error. Finished units are verified and reused; the final table is
    put together from them again and compared with the one kept.
    """
    training = training or TrainingConfig()
    mark = fingerprint({"data": content_digest(dataset.select(*DATASET_COLUMNS)), "orders": dict(orders), "networks": repr(sorted(networks.items())), "residual": repr(sorted(residual_networks.items())), "seeds": seeds, "training": repr(training), "protocol": repr(protocol)})
    span = _validate_source(dataset, protocol)
    due = dataset.where("split = 'test'")
    store = CheckpointStore(spark, root, mark)
    own = lambda frame, t: frame.where(F.col("ticker") == t)
    arima = _backtest(store, dataset, protocol, orders, _EVERY)
    residuals = returns.residual_chain(arima, dataset).drop("contiguous")
    train = lambda data, config: forecast.run_predictions(forecast.run_grid(data, [config], list(seeds), training=training, evaluate="test", strict=True, learn_splits=("train", "validation")))
    lstm = store.run_named("lstm", {t: (lambda t=t: train(own(dataset, t), networks[t])) for t in protocol.tickers})
    second = store.run_named("residual", {t: (lambda t=t: train(own(residuals, t), residual_networks[t])) for t in protocol.tickers})
    arima_test = arima.where("split = 'test'")
    for seeded in (lstm, second):
        contracts.validate_seed_groups(seeded.where("split = 'test'"), protocol.tickers, seeds)
    joint = forecast.hybrid(arima_test, selection.ensemble(second, "residual_lstm"), validate=True)
    naive = forecast.predict_by_column(dataset, forecast.Naive(), ("test",))
    components = [f.select(*PREDICTION_COLUMNS) for f in (naive, arima_test, selection.ensemble(lstm), joint)]
    for component, name in zip(components, MODEL_ORDER, strict=True):
        contracts.validate_test_component(component, name, protocol.tickers, span)
        contracts.validate_schedule(component, due)
    predictions = store.keep("final", forecast.align(components))
    family = lambda f, name: f.select(*PREDICTION_COLUMNS, "seed").withColumn("family", F.lit(name))
    by_seed = metrics.seed_metrics(family(lstm, "lstm").unionByName(family(forecast.hybrid(arima_test, second, validate=True), "arima_lstm")))
    return FinalReports(
        predictions,
        metrics.return_metrics(predictions),
        metrics.price_metrics(metrics.price_predictions(predictions, dataset), metrics.scaling_errors(dataset)),
        regimes.regime_metrics(predictions, regimes.assignments(dataset, protocol.regime_window)),
        inference.dm_results(predictions, protocol.inference),
        inference.bootstrap_intervals(predictions, protocol.inference),
        by_seed,
        metrics.seed_spread(by_seed),
    )
