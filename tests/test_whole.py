"""Whole jobs: all training rows, all sequences, all test rows, all reports."""

from datetime import date, timedelta

import numpy as np
import pytest

from strandline.models.lstm import Trainer, TrainingConfig
from strandline.operators import forecast, returns
from strandline.plans import catalog
from strandline.plans.panels import dataset_of
from strandline.plans.pipeline import run_final
from strandline.schema import InferenceConfig, NetworkConfig, Protocol, SplitConfig, network_grid

D = date(2020, 1, 1)
day = lambda k: D + timedelta(k)
SPLITS = SplitConfig((D, day(59)), (day(60), day(89)), (day(90), day(129)))
TRAINING = TrainingConfig(epochs=4, patience=2)


def dataset(spark, lengths={"AAA": 130, "BBB": 130}, splits=SPLITS):  # noqa: B006
    rng = np.random.default_rng(3)
    rows = [(day(k), t, float(p)) for t, n in lengths.items() for k, p in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02 + 0.0005 * np.arange(n)))))]
    return returns.model_dataset(spark.createDataFrame(rows, "date date, ticker string, adj_close double"), splits)


def direct(rows, config, seed, learn_splits, evaluate):
    """A run of two stages by loops: each row's window, both scalers, forecasts by target date."""
    full = [(rows[k], [r.log_return for r in rows[k - config.window + 1 : k + 1]]) for k in range(config.window - 1, len(rows))]
    learn, test = [x for x in full if x[0].split in learn_splits], [x for x in full if x[0].split == evaluate]
    cut = int(len(learn) * 0.8)

    def scaled(part, cutoff):
        known = [r.log_return for r in rows if r.split in learn_splits and r.date <= cutoff]
        m, s = np.mean(known), np.std(known)
        return (np.array([x for _, x in part])[:, :, None] - m) / s, (np.array([r.target_return for r, _ in part]) - m) / s, m, s

    inner, last = learn[cut - 1][0].date, learn[-1][0].date
    trainer = Trainer(config, TRAINING)
    best = trainer.best_epoch(*scaled(learn[:cut], inner)[:2], *scaled(learn[cut:], inner)[:2], seed)
    x, _, m, s = scaled(test, last)
    forecasts = trainer.fit(*scaled(learn, last)[:2], best, seed).predict(x) * s + m
    return best, {r.target_date: v for (r, _), v in zip(test, forecasts, strict=True)}


def test_networks_learn_from_all_training_splits(spark):
    data, config = dataset(spark), NetworkConfig(3, 2, 0.0)
    for learn_splits, evaluate in ((("train", "validation"), "test"), (("train",), "validation")):
        got = {r.ticker: r for r in forecast.run_grid(data, [config], [1], training=TRAINING, evaluate=evaluate, learn_splits=learn_splits).collect()}
        for t in ("AAA", "BBB"):
            best, want = direct(data.where(f"ticker = '{t}'").orderBy("date").collect(), config, 1, learn_splits, evaluate)
            assert got[t].status == "ok" and got[t].best_epoch == best
            assert {p.target_date: p.predicted_return for p in got[t].predictions} == pytest.approx(want, rel=1e-9)
    with pytest.raises(ValueError):
        forecast.run_grid(data, [config], [1], evaluate="test", learn_splits=("train", "test"))


def test_runs_do_not_depend_on_the_other_windows(spark):
    data = dataset(spark, {"AAA": 130, "SHORT": 69})
    narrow, wide = NetworkConfig(2, 2, 0.0), NetworkConfig(45, 2, 0.0)
    alone = {r.ticker: r for r in forecast.run_grid(data, [narrow], [0], training=TRAINING).collect()}
    both = forecast.run_grid(data, [narrow, wide, NetworkConfig(90, 2, 0.0)], [0], training=TRAINING).collect()
    assert sorted((r.ticker, r.window) for r in both) == [(t, w) for t in ("AAA", "SHORT") for w in (2, 45, 90)]
    got = {(r.ticker, r.window): r for r in both}
    for t in ("AAA", "SHORT"):
        assert got[t, 2] == alone[t] and len(got[t, 2].predictions) == data.where(f"ticker = '{t}' and split = 'validation'").count()
    assert got["AAA", 45].status == "ok" and got["SHORT", 90].status == "failed" and "full window" in got["SHORT", 90].error
    assert (got["SHORT", 90].mae_bps, got["SHORT", 90].predictions) == (None, [])
    resumed = forecast.run_grid(data, [narrow, wide], [0], training=TRAINING, done=forecast.run_grid(data, [wide], [0], training=TRAINING)).collect()
    assert {r.ticker: r for r in resumed} == alone


def final(spark, data, root, splits):
    tickers = ("AAA", "BBB")
    protocol = Protocol(tickers, splits, InferenceConfig(lag=4, block=5, repetitions=50), warm_up=20, regime_window=5)
    return run_final(spark, data, root, protocol, dict.fromkeys(tickers, (0, 0, 0)), dict.fromkeys(tickers, NetworkConfig(3, 2, 0.0)), dict.fromkeys(tickers, NetworkConfig(2, 2, 0.0)), (0, 1), TRAINING)


def test_final_pipeline_refuses_lost_test_rows(spark, tmp_path):
    data = dataset(spark)
    gap, late = data.where(f"ticker <> 'BBB' or target_date <> '{day(100)}'"), data.where(f"ticker <> 'BBB' or split <> 'test' or target_date > '{day(92)}'")
    for name, frame, why in (("gap", gap, "contiguous|tail"), ("late", late, "cover"), ("ticker", data.where("ticker = 'AAA'"), "tickers")):
        with pytest.raises(ValueError, match=why):
            final(spark, frame, tmp_path / name, SPLITS)
    with pytest.raises(ValueError, match="split_not_as_bounded"):
        final(spark, data, tmp_path / "published", SplitConfig())


def test_bootstrap_takes_the_repetitions_of_the_protocol(spark, small_folder):
    rows = catalog.QUERIES["bootstrap_intervals"](spark, small_folder).collect()
    assert rows and {(r.repetitions, r.seed) for r in rows} == {(10_000, 42)}


def test_order_search_tries_every_order_of_every_ticker(spark, small_folder):
    rows = catalog.QUERIES["arima_search"](spark, small_folder).collect()
    tickers = {r[0] for r in dataset_of(spark, small_folder, "market").where("split = 'train'").select("ticker").distinct().collect()}
    assert sorted((r.ticker, r.p, r.d, r.q) for r in rows) == sorted((t, p, 0, q) for t in tickers for p in range(6) for q in range(6))


def test_registered_grid_and_walk_forward_are_the_published_ones(spark, small_folder, monkeypatch):
    seen = {}
    monkeypatch.setattr(forecast, "run_grid", lambda data, configs, seeds, training=None: seen.update(grid=(configs, seeds, training)) or data.withColumn("predictions", forecast.F.lit(0)))
    catalog.QUERIES["lstm_grid"](spark, small_folder)
    assert seen["grid"] == (network_grid(), list(range(10)), TrainingConfig())
    monkeypatch.setattr(forecast, "walk_forward", lambda data, fitter, name, warm_up: seen.update(warm_up=warm_up) or data)
    catalog.QUERIES["arima_walk_forward"](spark, small_folder)
    assert seen["warm_up"] == 252


def test_final_reports_have_intervals_and_seeds(spark, tmp_path):
    data = dataset(spark)
    reports = final(spark, data, tmp_path / "final", SPLITS)
    intervals = reports.bootstrap_intervals.collect()
    assert len(intervals) == 30 and {r.repetitions for r in intervals} == {50}
    due = {r.ticker: r.n for r in data.where("split = 'test'").groupBy("ticker").agg(forecast.F.count("*").alias("n")).collect()}
    seeds = {(r.family, r.ticker, r.seed): r for r in reports.seed_metrics.collect()}
    assert set(seeds) == {(f, t, s) for f in ("lstm", "arima_lstm") for t in due for s in (0, 1)}
    assert all(r.observations == due[t] and r.mae_bps > 0 for (_, t, _), r in seeds.items())
    assert {(r.family, r.ticker): r.mean_mae_bps for r in reports.seed_spread.collect()} == pytest.approx({(f, t): (seeds[f, t, 0].mae_bps + seeds[f, t, 1].mae_bps) / 2 for f in ("lstm", "arima_lstm") for t in due})
