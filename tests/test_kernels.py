"""Numerical kernels: tails, stationarity tests, ARIMA, LSTM."""

import math

import numpy as np
import pytest

from strandline.functions.tails import chi_square_upper, levinson, normal_quantile, normal_two_sided
from strandline.models.arima import FitError, fit_arima
from strandline.models.lstm import Network, NonFiniteError, Trainer, TrainingConfig, validate_arrays
from strandline.operators.stationarity import adf, clean_series, kpss
from strandline.schema import NetworkConfig


def ar1(phi, n, seed=0):
    e = np.random.default_rng(seed).standard_normal(n)
    out = np.zeros(n)
    for t in range(1, n):
        out[t] = phi * out[t - 1] + e[t]
    return out


def test_tails():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    for df, x in ((1, 3.841458820694124), (2, 5.991464547107979), (5, 11.070497693516351), (10, 18.307038053275146)):
        assert chi_square_upper(x, df) == pytest.approx(0.05)
    assert chi_square_upper(0.0, 3) == 1.0 and normal_quantile(0.975) == pytest.approx(1.959963984540054)


def test_levinson_of_an_autoregression():
    acf = 0.6 ** np.arange(8)
    assert levinson(acf) == pytest.approx([1, 0.6, 0, 0, 0, 0, 0, 0], abs=1e-12)
    rng = np.random.default_rng(1)
    x = rng.standard_normal(300)
    r = np.array([1.0, *(x[k:] @ x[:-k] / (x @ x) for k in range(1, 6))])
    for k in range(1, 6):
        solved = np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))], r[1 : k + 1])
        assert levinson(r)[k] == pytest.approx(solved[-1])


def test_stationarity_on_simulated_series():
    steady, walk = ar1(0.35, 400), np.cumsum(np.random.default_rng(3).standard_normal(400))
    assert adf(steady)[1] < 0.05 < adf(walk)[1] and adf(walk, "ct")[1] > 0.05
    assert kpss(steady)[1] >= 0.05 > kpss(walk)[1] and 0.01 <= kpss(walk)[1] <= kpss(steady)[1] <= 0.10
    assert adf(steady)[4] == pytest.approx((-3.447, -2.869, -2.571), abs=2e-3)
    for bad in (np.ones(50), np.arange(10.0), np.array([np.inf] * 40)):
        with pytest.raises(ValueError):
            clean_series(bad)


def test_arima_recovers_coefficients():
    y = ar1(0.4, 2000, 5) + 3
    got = fit_arima(y, (1, 0, 0))
    assert got.converged and got.phi[0] == pytest.approx(0.4, abs=0.05) and got.constant == pytest.approx(3, abs=0.15) and got.variance == pytest.approx(1, abs=0.08)
    assert got.forecast(y) == pytest.approx(got.constant + got.phi[0] * (y[-1] - got.constant), rel=1e-6)
    assert got.bic < fit_arima(y, (0, 0, 0)).bic


def test_arima_likelihood_is_exact():
    y = ar1(0.5, 40, 2)
    got = fit_arima(y, (1, 0, 1))
    n, (phi,), (theta,) = len(y), got.phi, got.theta
    gamma = np.zeros(n)
    gamma[0] = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    gamma[1] = phi * gamma[0] + theta
    for k in range(2, n):
        gamma[k] = phi * gamma[k - 1]
    cov = got.variance * gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    c = y - got.constant
    want = -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + c @ np.linalg.solve(cov, c))
    assert got.loglik == pytest.approx(want, abs=1e-5)


def test_arima_mean_difference_and_refusals():
    y = ar1(0.0, 200, 4)
    assert fit_arima(y, (0, 0, 0)).forecast(y) == pytest.approx(y.mean())
    walk = np.cumsum(y)
    assert fit_arima(walk, (0, 1, 0)).forecast(walk) == pytest.approx(walk[-1])
    for bad, order in ((np.ones(50), (1, 0, 0)), (y[:3], (2, 0, 2)), (np.array([np.nan] * 50), (1, 0, 0)), (y, (-1, 0, 0))):
        with pytest.raises(FitError):
            fit_arima(bad, order)


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = Network(NetworkConfig(4, 3, 0.0), 1)
    x, y = rng.standard_normal((6, 4, 1)), rng.standard_normal(6)
    for w, g in zip(net.weights, net.gradients(x, y, None), strict=True):
        flat, want = w.reshape(-1), g.reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            keep = flat[k]
            flat[k] = keep + 1e-6
            up = ((net.forward(x)[0] - y) ** 2).mean()
            flat[k] = keep - 1e-6
            down = ((net.forward(x)[0] - y) ** 2).mean()
            flat[k] = keep
            assert want[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_trainer_learns_and_is_deterministic():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 3, 1))
    y = 0.8 * x[:, -1, 0]
    trainer = Trainer(NetworkConfig(3, 8, 0.0), TrainingConfig(epochs=30, rate=0.02, patience=5))
    best = trainer.best_epoch(x[:160], y[:160], x[160:], y[160:], 7)
    a, b = trainer.fit(x, y, best, 7), trainer.fit(x, y, best, 7)
    assert 1 <= best <= 30 and (a.predict(x) == b.predict(x)).all()
    assert ((a.predict(x) - y) ** 2).mean() < 0.2 * y.var()


def test_network_refusals():
    x, y = np.zeros((3, 2, 1)), np.zeros(3)
    for features, targets in ((x[:, :, 0], y), (x, y[:2]), (x[:0], y[:0]), (x * np.nan, y)):
        with pytest.raises(ValueError):
            validate_arrays(features, targets, 2)
    net = Network(NetworkConfig(2, 2, 0.0), 0)
    net.weights[3][:] = np.inf
    with pytest.raises(NonFiniteError):
        net.predict(x)
    with pytest.raises(ValueError):
        TrainingConfig(epochs=0)


def test_blocks_of_the_recursion_do_not_show(monkeypatch):
    from strandline.models import arima

    y, phi, theta = np.column_stack([ar1(0.5, 500), np.ones(500)]), np.array([[0.5, -0.2], [0.1, 0.3]]), np.array([[0.4], [-0.6]])
    fast = arima._filter(y, phi, theta)
    monkeypatch.setattr(arima, "BLOCK", 10_000)
    for a, b in zip(fast, arima._filter(y, phi, theta), strict=True):
        assert a == pytest.approx(b, rel=1e-10)


def test_vectorised_tails_equal_the_scalar_ones():
    from strandline.functions.tails import chi_square_uppers

    x, df = np.meshgrid([0.0, 0.1, 1.0, 7.5, 40.0, np.nan], np.arange(1, 25))
    got = chi_square_uppers(x.ravel(), df.ravel())
    want = [chi_square_upper(a, int(b)) for a, b in zip(x.ravel(), df.ravel(), strict=True)]
    assert got == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_erfc():
    from strandline.functions.tails import erfc

    x = np.array([0.0, 1e-9, 0.3, 1.0, 2.5, 2.99, 3.0, 4.2, 9.0, 26.0, math.inf])
    assert erfc(x) == pytest.approx([math.erfc(v) for v in x], rel=1e-9)
    assert np.isnan(erfc(np.array([np.nan])))[0]


def test_forecast_paths():
    y = ar1(0.6, 400, 7) + 2
    got = fit_arima(y, (1, 0, 0))
    path = got.forecast_path(y, 5)
    want = [got.constant + got.phi[0] ** k * (y[-1] - got.constant) for k in range(1, 6)]
    assert path == pytest.approx(want, rel=1e-6) and path[0] == got.forecast(y)
    walk = np.cumsum(y)
    one = fit_arima(walk, (1, 1, 0))
    assert one.forecast_path(walk, 3)[0] == pytest.approx(one.forecast(walk))
    assert np.allclose(fit_arima(y, (0, 0, 0)).forecast_path(y, 4), y.mean())
    assert len(fit_arima(y, (0, 0, 2)).forecast_path(y, 3)) == 3
    with pytest.raises(ValueError):
        got.forecast_path(y, 0)


def test_a_second_optimiser_follows_one_that_does_not_converge():
    rng = np.random.default_rng(11)
    for seed in range(6):
        e = rng.standard_normal(400)
        y = e[2:] - 1.6 * e[1:-1] + 0.62 * e[:-2]  # close to a non-invertible moving average
        assert fit_arima(y, (2, 0, 2)).converged and fit_arima(y, (0, 0, 1)).converged


def test_the_mean_is_the_most_likely_one():
    y = ar1(0.7, 60, 9) + 4
    got = fit_arima(y, (1, 0, 1))

    def loglik(mean):
        from strandline.models import arima

        products, logs, _, _ = arima._filter((y - mean)[:, None], got.phi[None], got.theta[None])
        variance = products[0, 0, 0] / len(y)
        return -len(y) / 2 * (np.log(2 * np.pi * variance) + 1) - logs[0] / 2

    assert loglik(got.constant) == pytest.approx(got.loglik)
    assert all(loglik(got.constant + d) < got.loglik for d in (-0.05, 0.05, 0.5))
