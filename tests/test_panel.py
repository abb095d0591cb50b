"""Panel operators: hand-computed values, causality and refusals."""

import dataclasses
import math
from datetime import date, timedelta

import numpy as np
import pytest

from strandline.operators import contracts, explore, forecast, inference, metrics, regimes, returns, selection, sequences
from strandline.schema import InferenceConfig, NetworkConfig, Order, PREDICTION_DDL, Protocol, SplitConfig, network_grid

D = date(2020, 1, 1)
day = lambda k: D + timedelta(k)
SPLITS = SplitConfig((D, day(9)), (day(10), day(19)), (day(20), day(400)))
PANEL = "date date, ticker string, adj_close double"
DATASET = "date date, target_date date, ticker string, adj_close double, log_return double, target_return double, split string"


def panel(spark, n=60, tickers=("AAA", "BBB"), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(day(k), t, float(p)) for t in tickers for k, p in enumerate(np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 100)]
    rng.shuffle(rows)
    return spark.createDataFrame([(d, str(t), float(p)) for d, t, p in rows], PANEL)


def predictions(spark, rows):
    return spark.createDataFrame([(day(k), day(k + 1), t, s, m, float(a), float(p)) for k, t, s, m, a, p in rows], PREDICTION_DDL)


def golden(spark):
    return predictions(spark, [(0, "AAA", "train", "naive_zero", 0.01, 0.0), (1, "AAA", "train", "naive_zero", -0.02, 0.0), (0, "AAA", "train", "c", 0.01, 0.005), (1, "AAA", "train", "c", -0.02, -0.01)])


def test_metric_golden_values(spark):
    got = {(r.ticker, r.model): r for r in metrics.return_metrics(golden(spark)).collect()}
    naive, c = got["AAA", "naive_zero"], got["AAA", "c"]
    assert (naive.mae_bps, naive.rmse_bps, naive.rel_mae, naive.oos_r2, naive.directional_accuracy) == pytest.approx((150, 158.11388300841895, 1, 0, 0))
    assert (c.mae_bps, c.rmse_bps, c.rel_mae, c.oos_r2, c.directional_accuracy) == pytest.approx((75, 79.05694150420948, 0.5, 0.75, 1))


def test_pooled_rows_are_not_means_of_means(spark):
    rows = [(0, "AAA", "train", "naive_zero", 0.01, 0.0)] + [(k, "BBB", "train", "naive_zero", 0.03, 0.0) for k in range(3)] + [(9, "AAA", "validation", "naive_zero", 0.02, 0.0)]
    got = {(r.split, r.ticker): (r.observations, r.mae_bps) for r in metrics.return_metrics(predictions(spark, rows)).collect()}
    assert got["train", "ALL"] == (4, pytest.approx(250)) and got["validation", "ALL"] == (1, pytest.approx(200))


def test_metrics_guard_label_and_zero_baseline(spark):
    with pytest.raises(ValueError):
        metrics.guard_label(predictions(spark, [(0, "ALL", "train", "m", 0, 0)]))
    r = metrics.return_metrics(predictions(spark, [(0, "A", "train", "naive_zero", 0.0, 0.0)])).where("ticker = 'A'").first()
    assert r.rel_mae is None and r.oos_r2 is None


def test_returns_targets_and_splits(spark):
    data = returns.model_dataset(panel(spark), SPLITS, validate=True)
    rows = data.where("ticker = 'AAA'").orderBy("date").collect()
    assert len(rows) == 58 and rows[0].date == day(1) and rows[-1].target_date == day(59)
    assert all(a.target_return == b.log_return for a, b in zip(rows, rows[1:]))
    assert [r.split for r in rows[:9]] == ["train"] * 8 + ["validation"]
    with pytest.raises(ValueError):
        returns.model_dataset(panel(spark), SplitConfig((D, day(5)), (day(7), day(8)), (day(9), day(10))), validate=True)
    with pytest.raises(ValueError):
        returns.log_returns(spark.createDataFrame([(D, "A", -1.0)], PANEL), validate=True)


def test_future_rows_do_not_change_the_past(spark):
    base = panel(spark)
    changed = base.withColumn("adj_close", base.adj_close * (1 + 99 * (base.date > day(40)).cast("int")))
    for build in (
        lambda p: returns.rolling_volatility(returns.log_returns(p), (5, 9)).where(f"date <= '{day(40)}'"),
        lambda p: forecast.predict(returns.model_dataset(p, SPLITS), forecast.ExpandingMean()).where(f"date < '{day(40)}'").select("ticker", "date", "predicted_return"),
        lambda p: sequences.lag_sequences(returns.model_dataset(p, SPLITS), 5).where(f"date <= '{day(40)}'").select("ticker", "date", "features"),
    ):
        assert sorted(map(tuple, build(base).collect())) == sorted(map(tuple, build(changed).collect()))


def test_summary_and_drawdown(spark):
    rows = [(D, "A", 100.0, None), (day(1), "A", 101.0, 0.02), (day(2), "A", 100.0, 0.0), (day(3), "A", 120.0, 0.01)]
    frame = spark.createDataFrame(rows, PANEL + ", log_return double")
    r = explore.return_summary(frame, annualization=4).first()
    assert r.mean_daily == pytest.approx(0.01) and r.mean_annualized == pytest.approx(0.04) and r.volatility_annualized == pytest.approx(2 * r.volatility_daily)
    assert r.maximum_drawdown == pytest.approx(100 / 101 - 1) and r.skewness == pytest.approx(0.0)


def test_quality_report(spark):
    ddl = "date date, ticker string, volume double, dividends double, stock_splits double"
    rows = [(D, "AAA", 1.0, 0.0, 0.0), (day(1), "AAA", float("nan"), 0.5, 0.0), (day(1), "AAA", 2.0, 0.0, 0.0), (None, "BBB", None, 0.0, 2.0)]
    got = {r.ticker: tuple(r)[1:] for r in explore.quality_report(spark.createDataFrame(rows, ddl)).collect()}
    assert got["AAA"] == (3, D, day(1), 1, 1, 1, 0) and got["BBB"] == (1, None, None, 2, 0, 0, 1)
    assert explore.shared_calendar(spark.createDataFrame([], "date date, ticker string")).first()[0] is True


def test_correlation_of_constants_is_null(spark):
    rows = [(day(k), t, v) for k in range(5) for t, v in (("A", 1.0), ("B", float(k)), ("C", float(-k)))]
    frame = spark.createDataFrame(rows, "date date, ticker string, log_return double")
    for method in ("pearson", "spearman"):
        got = {(r.ticker_a, r.ticker_b): r.correlation for r in explore.return_correlation(frame, method).collect()}
        assert len(got) == 9 and got["A", "B"] is None and got["B", "C"] == got["C", "B"] == pytest.approx(-1)


def test_regimes_fit_on_the_past_only(spark):
    data = returns.model_dataset(panel(spark, 120), SPLITS)
    later = data.withColumn("log_return", data.log_return * (1 + 99 * (data.date > day(100)).cast("int")))
    a = regimes.assignments(data, 3, annualization=4).where(f"date <= '{day(100)}'")
    b = regimes.assignments(later, 3, annualization=4).where(f"date <= '{day(100)}'")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 50
    contracts.validate_assignments(a)
    with pytest.raises(ValueError):
        contracts.validate_assignments(a.withColumn("regime", regimes.F.lit("none")))


def test_scaler_and_sequences(spark):
    rows = [(day(k), day(k + 1), "A", 1.0, 0.5, 0.001 * k, "train") for k in range(5)] + [(day(k), day(k + 1), "B", 1.0, 0.001 * k, 0.001 * k, "validation") for k in range(9)]
    frame = spark.createDataFrame(rows, DATASET)
    got = {r.ticker: (r["mean"], r.scale) for r in sequences.return_scaler(frame).collect()}
    assert got["A"] == (0.5, 1.0) and got["B"][0] == pytest.approx(0.004)
    first = sequences.lag_sequences(frame, 5).where("ticker = 'B'").orderBy("date").first()
    assert first.features == pytest.approx([0.0, 0.001, 0.002, 0.003, 0.004])
    with pytest.raises(ValueError):
        sequences.lag_names(0)


def test_dm_degenerate_and_capped(spark):
    keys = "ticker string, loss string, candidate string, comparator string, target_date date, d double"
    rows = [("A", "absolute", "c", "n", day(k), d) for k, d in enumerate([1.0, -1.0, 2.0, -2.0, 1.0])]
    rows += [("B", "absolute", "c", "n", day(k), 0.0) for k in range(4)] + [("C", "absolute", "c", "n", day(k), -1.0) for k in range(4)]
    got = {r.ticker: r for r in inference.dm_statistics(spark.createDataFrame(rows, keys), 20).collect()}
    d = np.array([1, -1, 2, -2, 1.0])
    c = d - d.mean()
    want = sum(c * c) / 5 + 2 * sum((1 - k / 5) * sum(c[k:] * c[:-k]) / 5 for k in range(1, 5))
    assert got["A"].variance == pytest.approx(want) and got["B"].dm_statistic == 0 and got["C"].dm_statistic == -math.inf


def test_holm_golden(spark):
    rows = [("f", c, p) for c, p in zip("abcde", [0.01, 0.04, 0.03, 0.20, 0.50])]
    out = inference.holm(spark.createDataFrame(rows, "family string, candidate string, raw_p_value double"), ["family"], ties=("candidate",))
    assert [r.holm_p_value for r in out.orderBy("candidate").collect()] == pytest.approx([0.05, 0.12, 0.12, 0.40, 0.50])


def test_bootstrap_equals_direct_resampling(spark):
    rng, n, config = np.random.default_rng(5), 40, InferenceConfig(lag=4, block=5, repetitions=200)
    actual, a, b = rng.normal(size=(3, 2, n))
    rows = [(k, t, "test", m, actual[i, k], p[i, k]) for i, t in enumerate(("AAA", "BBB")) for k in range(n) for m, p in (("c", a), ("n", b))]
    got = {(r.ticker, r.metric): r for r in inference.bootstrap_intervals(predictions(spark, rows), config, [("c", "n")]).collect()}
    stream = np.random.default_rng(config.seed)
    for scope, part in (("AAA", [0]), ("BBB", [1]), ("ALL", [0, 1])):
        ea, eb = (a - actual)[part], (b - actual)[part]
        starts = stream.integers(0, n - 5 + 1, size=(200, 8))
        picks = np.array([np.concatenate([np.arange(s, s + 5) for s in row])[:n] for row in starts])
        mae = [np.abs(ea[:, p]).mean() - np.abs(eb[:, p]).mean() for p in picks]
        rmse = [np.sqrt((ea[:, p] ** 2).mean()) - np.sqrt((eb[:, p] ** 2).mean()) for p in picks]
        for name, drawn in (("mae", mae), ("rmse", rmse)):
            r = got[scope, name]
            assert (r.ci_lower, r.ci_upper) == pytest.approx(tuple(np.quantile(np.array(drawn) * 1e4, [0.025, 0.975])))
        assert got[scope, "mae"].observations == n * len(part)


def test_inference_needs_one_calendar(spark):
    rows = [(k, t, "test", m, 0.01 * k, 0.02 * f) for t in ("AAA", "BBB") for k in range(12) for m, f in (("c", 1), ("n", 2))]
    whole = predictions(spark, rows)
    uneven = whole.where(f"ticker <> 'BBB' or date <> '{day(5)}'")
    config, pairs = InferenceConfig(lag=2, block=3, repetitions=20), [("c", "n")]
    for run in (inference.bootstrap_intervals, inference.dm_results):
        assert run(whole, config, pairs).count() > 0
        with pytest.raises(ValueError, match="test dates"):
            run(uneven, config, pairs)
        assert run(inference.on_shared_calendar(uneven), config, pairs).count() > 0
    assert inference.on_shared_calendar(uneven).count() == 44


def test_forecasts_must_be_finite_and_fits_converge(spark, monkeypatch):
    data = returns.model_dataset(panel(spark), SPLITS)

    class Broken:
        name = "broken"

        def expression(self):
            return forecast.F.when(forecast.F.col("date") == day(15), forecast.F.lit(float("nan"))).otherwise(0.0)

    with pytest.raises(ValueError, match="forecast_not_finite"):
        forecast.predict(data, Broken(), ("test", "validation", "train"))
    with pytest.raises(Exception, match="not finite"):
        forecast.walk_forward(data, lambda t, h: float("inf"), "m", warm_up=5).collect()
    stuck = forecast.fit_arima(np.random.default_rng(0).standard_normal(60), (0, 0, 0))
    monkeypatch.setattr(forecast, "fit_arima", lambda *a, **k: dataclasses.replace(stuck, converged=False))
    with pytest.raises(ValueError, match="converge"):
        forecast.arima_fitter({"AAA": (0, 0, 0)})("AAA", np.zeros(9))


def test_paths_forecast_every_row_from_one_fit(spark):
    data = returns.model_dataset(panel(spark), SPLITS)
    got = forecast.forecast_paths(data, {"AAA": (0, 0, 0), "BBB": (0, 0, 0)}, "path", splits=("test",), history_splits=("train", "validation")).collect()
    assert len(got) == data.where("split = 'test'").count() and len({(r.ticker, round(r.predicted_return, 12)) for r in got}) == 2
    with pytest.raises(Exception, match="no order"):
        forecast.forecast_paths(data, {"AAA": (0, 0, 0)}, "path", splits=("test",)).collect()


def test_builder_progress_and_any_error(spark):
    data = returns.model_dataset(panel(spark, 40, ("AAA",)), SPLITS)
    done = spark.sparkContext.accumulator(0)

    def build(config, seed):
        raise MemoryError if seed else FloatingPointError("overflow")

    rows = {r.seed: r for r in forecast.run_grid(data, [NetworkConfig(2, 2, 0.0)], [0, 1], build=build, progress=done, evaluate="test", learn_splits=("train", "validation")).collect()}
    assert (rows[0].status, rows[0].error, rows[1].status, rows[1].error) == ("non_finite", "overflow", "failed", "MemoryError") and done.value == 2


def test_bad_series_are_errors(spark):
    from strandline.operators.stationarity import stationarity_report

    rows = [("A", "log_return", day(k), str(np.sin(k * k))) for k in range(60)] + [("B", "log_return", day(k), "1.0") for k in range(60)]
    frame = spark.createDataFrame(rows, "ticker string, series string, date date, value string")
    with pytest.raises(Exception, match="B log_return"):
        stationarity_report(frame).collect()
    got = stationarity_report(frame, strict=False).collect()
    assert len(got) == 4 and all((r.statistic is None) == (r.ticker == "B") for r in got)


def test_hybrid_identity_and_alignment(spark):
    data = returns.model_dataset(panel(spark), SPLITS)
    component = forecast.predict_by_column(data, forecast.ExpandingMean(), ("test",))
    rest = forecast.residual_predictions(component, forecast.F.lit(0.001))
    joint = forecast.hybrid(component, rest, validate=True)
    naive = forecast.predict_by_column(data, forecast.Naive(), ("test",))
    assert forecast.align([naive, joint], validate=True).count() == 2 * naive.count()
    with pytest.raises(ValueError):
        forecast.hybrid(component, rest.withColumn("actual_return", rest.actual_return + 1e-6), validate=True)
    with pytest.raises(ValueError):
        forecast.hybrid(component, rest.limit(3), validate=True)
    with pytest.raises(ValueError):
        forecast.align([naive, joint.limit(5)], validate=True)
    with pytest.raises(ValueError):
        forecast.align([naive, joint.withColumn("actual_return", joint.actual_return + 1e-15)], validate=True)


def test_residual_chain_finds_gaps(spark):
    data = returns.model_dataset(panel(spark, tickers=("AAA",)), SPLITS)
    every = forecast.predict_by_column(data, forecast.Naive(), ("train", "validation", "test"))
    assert returns.residual_chain(every, data).where("not contiguous").count() == 0
    assert returns.residual_chain(every, data).count() == every.count() - 1
    gap = every.where(f"date <> '{day(30)}'")
    assert returns.residual_chain(gap, data, validate=False).where("not contiguous").count() == 1
    with pytest.raises(ValueError, match="contiguous"):
        returns.residual_chain(gap, data)
    with pytest.raises(ValueError, match="source"):
        returns.residual_chain(every, data.where(f"date <> '{day(30)}'"))
    contracts.validate_tail(every.where(f"date >= '{day(20)}'"), data)
    with pytest.raises(ValueError):
        contracts.validate_tail(every.where(f"date >= '{day(20)}' and date <> '{day(30)}'"), data)


def test_walk_forward_slices_history(spark):
    data = returns.model_dataset(panel(spark, 80), SplitConfig((D, day(49)), (day(50), day(69)), (day(70), day(400))))
    seen = forecast.walk_forward(data, lambda t, h: float(len(h)), "count", warm_up=30, chunk=7).collect()
    want = {(r.ticker, r.date): r.history for r in returns.eligible_origins(data, 30, ["validation"], ["train", "validation"]).collect()}
    assert {(r.ticker, r.date): int(r.predicted_return) for r in seen} == want and len(seen) == 40
    mean = forecast.walk_forward(data, lambda t, h: float(h.mean()), "m", warm_up=30)
    column = forecast.predict(data, forecast.ExpandingMean(), ("validation",))
    a, b = ({(r.ticker, r.date): r.predicted_return for r in f.collect()} for f in (mean, column))
    assert a == pytest.approx({k: b[k] for k in a})


def test_selection_ties(spark):
    ddl = "ticker string, p int, d int, q int, aic double, bic double, converged boolean, status string"
    rows = [("A", 2, 0, 0, 1.0, 5.0, True, "ok"), ("A", 0, 0, 2, 1.0, 5.0, True, "ok"), ("A", 1, 0, 1, 1.0, 5.0, True, "ok"), ("A", 0, 0, 0, 1.0, 1.0, False, "not_converged"), ("A", 3, 0, 3, None, 2.0, True, "ok")]
    short = selection.shortlist_orders(spark.createDataFrame(rows, ddl), validate=True)
    assert [(r.p, r.q, r.model) for r in short.orderBy("bic_rank").collect()] == [(0, 2, "arima_bic_1"), (1, 1, "arima_bic_2"), (2, 0, "arima_bic_3")]
    contracts.validate_shortlist(short)
    with pytest.raises(ValueError):
        selection.shortlist_orders(spark.createDataFrame(rows[:2], ddl), validate=True)
    errors = spark.createDataFrame([("A", f"arima_bic_{k}", 1.0, 1.0) for k in (1, 2, 3)], "ticker string, model string, mae_bps double, rmse_bps double")
    assert selection.select_arima(errors, short).first().model == "arima_bic_1"
    assert sorted(forecast.fitters_of(short)) == ["arima_bic_1", "arima_bic_2", "arima_bic_3"]


def test_contract_refusals(spark):
    data = returns.model_dataset(panel(spark), SPLITS)
    contracts.validate_dataset(data)
    bad = [data.drop("split"), data.limit(0), data.union(data), data.withColumn("split", regimes.F.lit("x")), data.withColumn("target_return", regimes.F.lit(float("inf")))]
    for frame in bad:
        with pytest.raises(ValueError):
            contracts.validate_dataset(frame)
    final = SplitConfig((D, day(9)), (day(10), day(19)), (day(20), day(59)))
    contracts.validate_final_dataset(data, final, ["AAA", "BBB"])
    for args in ((data, final, ["AAA"]), (data, SPLITS, ["AAA", "BBB"]), (data.withColumn("target_date", data.date), final, ["AAA", "BBB"])):
        with pytest.raises(ValueError):
            contracts.validate_final_dataset(*args)
    naive = forecast.predict_by_column(data, forecast.Naive())
    contracts.validate_predictions(naive, baseline="naive_zero")
    for frame, base in ((naive.union(naive), None), (naive, "gone"), (naive.withColumn("predicted_return", regimes.F.lit(float("nan"))), None)):
        with pytest.raises(ValueError):
            contracts.validate_predictions(frame, baseline=base)
    assert "target_return" not in contracts.model_input(data).columns


def test_components_schedules_and_seeds(spark):
    data = returns.model_dataset(panel(spark), SPLITS)
    naive = forecast.predict_by_column(data, forecast.Naive(), ("test",))
    span = (day(20), day(59))
    contracts.validate_test_component(naive, "naive_zero", ["AAA", "BBB"], span)
    contracts.validate_schedule(naive, data.where("split = 'test'"))
    for args in ((naive.select(*reversed(naive.columns)), "naive_zero", ["AAA", "BBB"], span), (naive, "other", ["AAA", "BBB"], span), (naive, "naive_zero", ["AAA"], span), (naive, "naive_zero", ["AAA", "BBB", "CCC"], span), (naive.where(f"date > '{day(25)}'"), "naive_zero", ["AAA", "BBB"], span)):
        with pytest.raises(ValueError):
            contracts.validate_test_component(*args)
    with pytest.raises(ValueError):
        contracts.validate_schedule(naive.where(f"date <> '{day(30)}'"), data.where("split = 'test'"))
    assert contracts.validate_grid_data(data, ["AAA"]).select("ticker").distinct().count() == 1
    with pytest.raises(ValueError):
        contracts.validate_grid_data(data, ["AAA", "CCC"])
    seeded = naive.withColumn("seed", forecast.F.explode(forecast.F.array(forecast.F.lit(0), forecast.F.lit(1))))
    contracts.validate_seed_groups(seeded, ["AAA", "BBB"], [0, 1])
    for frame, tickers, seeds in ((seeded, ["AAA"], [0, 1]), (seeded, ["AAA", "BBB"], [0, 1, 2]), (seeded.where(f"seed = 0 or date <> '{day(30)}'"), ["AAA", "BBB"], [0, 1])):
        with pytest.raises(ValueError):
            contracts.validate_seed_groups(frame, tickers, seeds)


def test_dates_and_runs(spark):
    rows = [("2020-01-01", "2020-01-02 05:00:00"), ("soon", None)]
    frame = spark.createDataFrame(rows, "date string, target_date string")
    assert [tuple(r) for r in contracts.parse_dates(frame).collect()] == [(D, day(1)), (None, None)]
    with pytest.raises(ValueError):
        contracts.parse_dates(frame, validate=True)
    ddl = "ticker string, window int, units int, dropout double, seed int, status string, best_epoch int, parameter_count int, mae_bps double, rmse_bps double, error string"
    good = ("A", 5, 16, 0.0, 0, "ok", 3, 1169, 1.0, 2.0, None)
    failed = ("A", 5, 16, 0.0, 1, "failed", None, None, None, None, "no data")
    contracts.validate_runs(spark.createDataFrame([good, failed], ddl))
    for bad in ([good, good], [(*good[:5], "fine", *good[6:])], [(*good[:8], float("nan"), *good[9:])], [(*failed[:10], None)]):
        with pytest.raises(ValueError):
            contracts.validate_runs(spark.createDataFrame(bad, ddl))


def test_failed_runs_are_rows_or_errors(spark):
    data = returns.model_dataset(panel(spark, 40, ("AAA",)), SPLITS)
    lone = data.where("split = 'train'").limit(2)
    out = forecast.run_grid(lone, [NetworkConfig(2, 2, 0.0)], [0]).collect()
    assert [r.status for r in out] in ([], ["failed"])
    with pytest.raises(Exception):
        forecast.run_grid(data.withColumn("target_return", forecast.F.lit(float("nan"))), [NetworkConfig(2, 2, 0.0)], [0], strict=True).collect()
    bad = forecast.run_grid(data.withColumn("target_return", forecast.F.lit(float("nan"))), [NetworkConfig(2, 2, 0.0)], [0]).first()
    assert bad.status == "failed" and "finite" in bad.error and bad.mae_bps is None


def test_price_contract(spark):
    good = (D, "A", 1.0, 2.0, 0.5, 1.5, 1.5, 10.0, 0.0, 0.0)
    ddl = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double, dividends double, stock_splits double"
    contracts.validate_prices(spark.createDataFrame([good], ddl))
    for change in ({0: None}, {2: -1.0}, {3: 1.0}, {4: 1.2}, {7: -1.0}, {8: -1.0}, {6: float("nan")}, {5: None}):
        row = tuple(change.get(k, v) for k, v in enumerate(good))
        with pytest.raises(ValueError):
            contracts.validate_prices(spark.createDataFrame([row], ddl))
    with pytest.raises(ValueError):
        contracts.validate_prices(spark.createDataFrame([good, good], ddl))
    with pytest.raises(ValueError):
        contracts.validate_prices(spark.createDataFrame([good], ddl), 2)


def test_configurations_refuse_nonsense(spark):
    for build in (
        lambda: SplitConfig((D, D), (D, day(1)), (day(2), day(3))),
        lambda: InferenceConfig(lag=3),
        lambda: InferenceConfig(lag=True, block=2),
        lambda: Order(-1, 0, 0),
        lambda: Order(True, 0, 0),
        lambda: NetworkConfig(0, 1, 0.0),
        lambda: NetworkConfig(1, 1, 1.0),
        lambda: Protocol(()),
        lambda: returns.rolling_volatility(panel(spark), (1,)),
        lambda: forecast.grid_schedule(panel(spark), [], [1]),
        lambda: forecast.model_name(" "),
    ):
        with pytest.raises(ValueError):
            build()
    assert len(network_grid()) == 12 and NetworkConfig(5, 16, 0.0).parameters == 1169 and NetworkConfig(5, 32, 0.0).parameters == 4385
    assert isinstance(forecast.Naive(), forecast.ColumnModel)
