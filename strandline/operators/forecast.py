"""Forecasts: pluggable models, expanding walk-forward, hybrids and aligned tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import is_finite
from strandline.models.arima import FitError, fit_arima
from strandline.models.lstm import Network, NetworkBuilder, NonFiniteError, Trainer, TrainingConfig
from strandline.operators.contracts import enforce, key_difference, model_input, schedule_violations, validate_alignment, validate_dataset
from strandline.operators.returns import by_date, eligible_origins
from strandline.schema import PREDICTION_COLUMNS, PREDICTION_DDL, PREDICTION_KEYS, TOLERANCE_RESIDUAL, NetworkConfig
from strandline.session import spread

SEARCH_DDL = "ticker string, p int, d int, q int, aic double, bic double, converged boolean, status string"
RUN_DDL = "ticker string, window int, units int, dropout double, seed int, status string, best_epoch int, parameter_count int, mae_bps double, rmse_bps double, error string"


@runtime_checkable
class ColumnModel(Protocol):
    """A model that forecasts by a column expression: no data leaves the JVM."""

    name: str

    def expression(self) -> Column: ...


class Naive:
    """Always zero."""

    name = "naive_zero"

    def expression(self) -> Column:
        return F.lit(0.0)


class ExpandingMean:
    """Mean of the history up to the origin: the exact fit of an ARIMA(0, 0, 0) with constant."""

    name = "arima_mean"

    def expression(self) -> Column:
        return F.avg("log_return").over(by_date().rangeBetween(Window.unboundedPreceding, 0))


#: Fits a history and forecasts one step: (ticker, history) -> number.
Fitter = Callable[[str, np.ndarray], float]


def model_name(name: str) -> str:
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a model needs a name")
    return name


def predict(dataset: DataFrame, model: ColumnModel, splits: Sequence[str] = ("train", "validation"), *, validate: bool = True) -> DataFrame:
    """Predictions of ``splits``. The model sees no target; its windows see all rows, so the filter comes after.

    Unless ``validate`` is off the dataset must be sound and every forecast finite.
    """
    if validate:
        validate_dataset(dataset)
    keys = list(PREDICTION_KEYS)
    forecast = model_input(dataset).withColumn("predicted_return", model.expression()).select(*keys, "predicted_return")
    actual = dataset.where(F.col("split").isin(*splits)).select(*keys, F.col("target_return").alias("actual_return"))
    out = actual.join(forecast, keys).withColumn("model", F.lit(model_name(model.name))).select(*PREDICTION_COLUMNS)
    if validate:
        enforce(out, {"forecast_not_finite": is_finite("predicted_return")}, allow_empty=True)
    return out


def predict_by_column(dataset: DataFrame, model: ColumnModel, splits: Sequence[str] = ("train", "validation")) -> DataFrame:
    """As ``predict``, without the join, for models of this library, whose expressions read no target."""
    out = dataset.withColumns({"predicted_return": model.expression(), "model": F.lit(model_name(model.name)), "actual_return": F.col("target_return")})
    return out.where(F.col("split").isin(*splits)).select(*PREDICTION_COLUMNS)


def walk_forward(
    dataset: DataFrame, fitter: Fitter, name: str, *, splits: Sequence[str] = ("validation",), history_splits: Sequence[str] = ("train", "validation"), warm_up: int = 252, chunk: int = 64, progress: Accumulator | None = None,
) -> DataFrame:
    """Refits at every origin on the history up to it and forecasts one step.

    Tasks are (ticker, chunk of origins): each gets the ticker's history up to
    its last origin as an array, sliced per origin, so a ticker's refits spread
    over many tasks. The array is at most one calendar long. ``progress`` counts
    forecasts.
    """
    model_name(name)
    history = dataset.where(F.col("split").isin(*history_splits))
    series = history.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "log_return"))).alias("series"))
    origins = eligible_origins(dataset, warm_up, splits, history_splits)
    number = F.row_number().over(by_date()) - 1
    chunks = (
        origins.withColumn("chunk", F.floor(number / F.lit(float(chunk))).cast("int"))
        .groupBy("ticker", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("date", "target_date", "split", "target_return", "history"))).alias("origins"), F.max("history").cast("int").alias("reach"))
    )
    work = chunks.join(series, "ticker").select("ticker", "chunk", "origins", F.slice("series.log_return", 1, F.col("reach")).alias("returns"))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            if progress is not None:
                progress.add(sum(map(len, pdf["origins"])))
            for ticker, origins, returns in zip(pdf["ticker"], pdf["origins"], pdf["returns"], strict=True):
                values = np.asarray(returns, float)
                for o in origins:
                    try:
                        forecast = float(fitter(ticker, values[: int(o["history"])]))
                    except FitError as error:
                        raise FitError(f"{ticker} at {o['date']}: {error}") from error
                    if not np.isfinite(forecast):
                        raise FitError(f"{ticker} at {o['date']}: forecast is not finite")
                    rows.append((o["date"], o["target_date"], ticker, o["split"], name, o["target_return"], forecast))
            yield pd.DataFrame(rows, columns=list(PREDICTION_COLUMNS))

    return spread(work, "ticker", "chunk").mapInPandas(run, PREDICTION_DDL)


def arima_fitter(orders: dict[str, tuple[int, int, int]]) -> Fitter:
    """Fits each ticker's order, from the last origin's coefficients where there are some."""
    last: dict[str, np.ndarray] = {}

    def fit(ticker: str, history: np.ndarray) -> float:
        if ticker not in orders:
            raise FitError("no order for the ticker")
        got = fit_arima(history, orders[ticker], start=last.get(ticker))
        if not got.converged:
            raise FitError(f"order {orders[ticker]} did not converge")
        last[ticker] = got.start
        return got.forecast(history)

    return fit


def forecast_paths(dataset: DataFrame, orders: dict[str, tuple[int, int, int]], name: str, *, splits: Sequence[str] = ("validation",), history_splits: Sequence[str] = ("train",)) -> DataFrame:
    """One fit per ticker on ``history_splits``, and as many steps ahead as ``splits`` has rows, by target date."""
    model_name(name)
    rows = dataset.where(F.col("split").isin(*history_splits, *splits))
    row = F.struct("date", "target_date", "split", "log_return", "target_return")
    work = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for ticker, every in zip(pdf["ticker"], pdf["rows"], strict=True):
                history = np.array([r["log_return"] for r in every if r["split"] in history_splits], float)
                due = [r for r in every if r["split"] in splits]
                if ticker not in orders or not len(history):
                    raise FitError(f"{ticker} has no order or no history")
                if due:
                    fit = fit_arima(history, orders[ticker])
                    if not fit.converged:
                        raise FitError(f"{ticker}: order {orders[ticker]} did not converge")
                    path = fit.forecast_path(history, len(due))
                    out += [(r["date"], r["target_date"], ticker, r["split"], name, r["target_return"], float(v)) for r, v in zip(due, path, strict=True)]
            yield pd.DataFrame(out, columns=list(PREDICTION_COLUMNS))

    return spread(work, "ticker").mapInPandas(run, PREDICTION_DDL)


def fitters_of(shortlist: DataFrame) -> dict[str, Fitter]:
    """One fitter per shortlisted rank; a shortlist has a few rows per ticker of the protocol."""
    by_model: dict[str, dict[str, tuple[int, int, int]]] = {}
    for r in shortlist.collect():
        by_model.setdefault(r["model"], {})[r["ticker"]] = (r["p"], r["d"], r["q"])
    return {name: arima_fitter(orders) for name, orders in sorted(by_model.items())}


def search_orders(dataset: DataFrame, most_p: int = 5, most_q: int = 5, d: int = 0, splits: Sequence[str] = ("train",)) -> DataFrame:
    """AIC and BIC of every order of the grid per ticker; failures are statuses, not errors."""
    series = dataset.where(F.col("split").isin(*splits)).groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "log_return"))).alias("series"))
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(most_p + 1) for q in range(most_q + 1))))
    work = series.select("ticker", F.col("series.log_return").alias("returns"), grid.alias("order"))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for ticker, returns, order in zip(pdf["ticker"], pdf["returns"], pdf["order"], strict=True):
                p, q = int(order["p"]), int(order["q"])
                try:
                    got = fit_arima(np.asarray(returns, float), (p, d, q))
                except (FitError, np.linalg.LinAlgError):
                    rows.append((ticker, p, d, q, None, None, False, "fit_failed"))
                    continue
                status = "not_converged" if not got.converged else "nonfinite_aic" if not np.isfinite(got.aic) else "nonfinite_bic" if not np.isfinite(got.bic) else "ok"
                rows.append((ticker, p, d, q, got.aic, got.bic, got.converged, status))
            yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in SEARCH_DDL.split(",")])

    return spread(work, "ticker", "order").mapInPandas(run, SEARCH_DDL)


def grid_schedule(tickers: DataFrame, configs: Sequence[NetworkConfig], seeds: Sequence[int]) -> DataFrame:
    """Every (ticker, configuration, seed) of a grid."""
    if not configs or len(set(configs)) != len(configs) or not seeds or len(set(seeds)) != len(seeds) or any(type(s) is not int or s < 0 for s in seeds):
        raise ValueError("configurations and seeds must be given once each")
    grid = F.array(*(F.struct(F.lit(c.window).alias("window"), F.lit(c.units).alias("units"), F.lit(c.dropout).alias("dropout")) for c in configs))
    return tickers.select("ticker").distinct().select("ticker", F.explode(grid).alias("c")).select("ticker", "c.*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))


def run_grid(
    dataset: DataFrame, configs: Sequence[NetworkConfig], seeds: Sequence[int], *, training: TrainingConfig | None = None, done: DataFrame | None = None, evaluate: str = "validation", strict: bool = False,
    learn_splits: Sequence[str] = ("train",), build: NetworkBuilder = Network, progress: Accumulator | None = None,
) -> DataFrame:
    """Trains every scheduled run that ``done`` lacks; one row per run with its predictions.

    A run finds its best epoch on the last fifth of ``learn_splits``, refits on
    all of them and predicts ``evaluate``. The first stage scales by the returns
    up to its last inner training row, the second by those of all training rows.
    Each run builds its sequences with its own window from the ticker's returns.
    Runs are tasks of their own; a failed run, or one whose ticker is too short,
    is a row with its error, or ends the job with ``strict``. ``build`` makes the
    network of a configuration and seed; ``progress`` counts finished runs.
    """
    if not learn_splits or evaluate in learn_splits:
        raise ValueError("a grid learns from splits other than the evaluated one")
    training, learn_splits = training or TrainingConfig(), tuple(learn_splits)
    runs = grid_schedule(dataset, configs, seeds)
    if done is not None:
        runs = runs.join(done.select("ticker", "window", "units", "dropout", "seed"), ["ticker", "window", "units", "dropout", "seed"], "left_anti")
    data = dataset.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "target_date", "split", "log_return", "target_return"))).alias("rows"))
    work = spread(runs.join(data, "ticker", "left"), "ticker", "window", "units", "dropout", "seed")
    one = "struct<date:date,target_date:date,ticker:string,split:string,model:string,actual_return:double,predicted_return:double>"
    schema = f"{RUN_DDL}, predictions array<{one}>"
    columns = [x.strip().split()[0] for x in RUN_DDL.split(",")] + ["predictions"]

    def train(run: dict) -> tuple:
        config, seed = NetworkConfig(int(run["window"]), int(run["units"]), float(run["dropout"])), int(run["seed"])
        key = (run["ticker"], config.window, config.units, config.dropout, seed)
        try:
            every = run["rows"] if run["rows"] is not None else []
            values = np.array([r["log_return"] for r in every], float)
            missing = np.cumsum([0, *(r["log_return"] is None for r in every)])
            wanted = (*learn_splits, evaluate)
            ends = [k for k in range(config.window, len(every) + 1) if every[k - 1]["split"] in wanted and missing[k] == missing[k - config.window]]
            rows = [every[k - 1] for k in ends]
            learn = np.array([r["split"] in learn_splits for r in rows], bool)
            dates = [r["date"] for r, keep in zip(rows, learn, strict=True) if keep]
            cut = int(len(dates) * 0.8)
            if not cut or learn.all():
                raise ValueError(f"too few rows of {'/'.join(learn_splits) if not cut else evaluate} with a full window")
            features = np.array([values[k - config.window : k] for k in ends])
            target = np.array([r["target_return"] for r in rows], float)

            def scaling(cutoff) -> tuple[float, float]:  # noqa: ANN001
                known = np.array([r["log_return"] for r in every if r["split"] in learn_splits and r["date"] <= cutoff and r["log_return"] is not None], float)
                return known.mean(), known.std() or 1.0

            xs, ys = features[learn][:, :, None], target[learn]
            trainer = Trainer(config, training, build)
            mean, scale = scaling(dates[cut - 1])
            x, y = (xs - mean) / scale, (ys - mean) / scale
            best = trainer.best_epoch(x[:cut], y[:cut], x[cut:], y[cut:], seed)
            mean, scale = scaling(dates[-1])
            network = trainer.fit((xs - mean) / scale, (ys - mean) / scale, best, seed)
            predicted = network.predict((features[~learn][:, :, None] - mean) / scale) * scale + mean
            error = predicted - target[~learn]
            name = f"lstm_w{config.window}_u{config.units}_d{round(config.dropout * 100):02d}_seed_{seed:02d}"
            got = [
                {"date": r["date"], "target_date": r["target_date"], "ticker": run["ticker"], "split": r["split"], "model": name, "actual_return": r["target_return"], "predicted_return": float(v)}
                for r, v in zip([r for r, keep in zip(rows, learn, strict=True) if not keep], predicted, strict=True)
            ]
            return (*key, "ok", best, config.parameters, float(np.abs(error).mean() * 1e4), float(np.sqrt((error**2).mean()) * 1e4), None, got)
        except Exception as error:  # whatever ends one run must not end the grid
            if strict:
                raise
            status = "non_finite" if isinstance(error, (NonFiniteError, FloatingPointError)) else "failed"
            return (*key, status, None, None, None, None, str(error) or type(error).__name__, [])

    def run_all(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                rows.append(train(r))
                if progress is not None:
                    progress.add(1)
            yield pd.DataFrame(rows, columns=columns)

    return work.mapInPandas(run_all, schema)


def run_predictions(runs: DataFrame) -> DataFrame:
    """The predictions of sound runs, with their seed."""
    return runs.where("status = 'ok'").select("seed", F.explode("predictions").alias("p")).select("p.*", "seed")


def hybrid(component: DataFrame, residuals: DataFrame, name: str = "arima_lstm", keys: Sequence[str] = PREDICTION_KEYS, *, validate: bool = True) -> DataFrame:
    """Sum of a component's forecast and the forecast of its residual, on equal keys.

    ``residuals`` predicts ``actual - component``; unless ``validate`` is off the
    realised residual must be that to 1e-12 and both sides must have the same keys.
    """
    a = component.select(*keys, "actual_return", F.col("predicted_return").alias("first"))
    b = residuals.select(*PREDICTION_KEYS, *[c for c in ("seed",) if c in residuals.columns], F.col("actual_return").alias("realised"), F.col("predicted_return").alias("second"))
    joined = a.join(b, list(keys))
    if validate:
        if key_difference(component, residuals, list(keys)).limit(1).count():
            raise ValueError("components have different keys")
        enforce(joined, {"residual_identity": F.abs(F.col("realised") - (F.col("actual_return") - F.col("first"))) <= TOLERANCE_RESIDUAL})
    out = joined.withColumns({"model": F.lit(model_name(name)), "predicted_return": F.col("first") + F.col("second")})
    return out.select(*PREDICTION_COLUMNS, *[c for c in ("seed",) if c in b.columns])


def hybrid_violations(component: DataFrame, residuals: DataFrame) -> DataFrame:
    """One row: keys of one side only, repeated residuals and realised residuals that are not ``actual - component`` to 1e-12."""
    due = component.select(*PREDICTION_KEYS, (F.col("actual_return") - F.col("predicted_return")).alias("target_return"))
    return schedule_violations(residuals, due, tolerance=TOLERANCE_RESIDUAL)


def residual_predictions(component: DataFrame, forecast: Column, name: str = "residual_lstm") -> DataFrame:
    """A prediction table of a component's residuals, forecast by a column expression."""
    return component.withColumns({"second": forecast}).select(
        *PREDICTION_KEYS, F.lit(name).alias("model"), (F.col("actual_return") - F.col("predicted_return")).alias("actual_return"), F.col("second").alias("predicted_return")
    )


def align(tables: Sequence[DataFrame], baseline: str = "naive_zero", *, validate: bool = True) -> DataFrame:
    """Union of prediction tables; unless ``validate`` is off all must have the baseline's keys and actuals."""
    out = functools.reduce(DataFrame.unionByName, [t.select(*PREDICTION_COLUMNS) for t in tables])
    if validate:
        validate_alignment(out, baseline)
    return out
