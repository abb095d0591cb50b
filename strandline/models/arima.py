"""ARIMA by exact Gaussian likelihood in state-space form, in NumPy.

The ARMA part of the (differenced) series is a state of length
``max(p, q + 1)`` with stationary start; the innovation variance and the mean
are concentrated out: a column of ones runs through the filter beside the
series, and the mean is the least-squares one of the two innovations. Coefficients are searched through partial autocorrelations,
so that every point tried is stationary and invertible. The optimiser is BFGS
with gradients by differences; all perturbed points run side by side through
one Kalman recursion. Where it does not converge, also with fresh curvature, a
compass search goes on from the best point; a fit has converged if neither finds
a better one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Steps that are taken at once when the gain stands still.
BLOCK = 48


#: Relative change of the mean log-likelihood below which a search has arrived; the usual figure of quasi-Newton codes.
FLAT = 2.2e-9


class FitError(ValueError):
    """The model could not be fitted."""


#: Unconstrained numbers beyond which coefficients no longer move: partial autocorrelations of 0.99995.
EDGE = 100.0


def _coefficients(raw: np.ndarray) -> np.ndarray:
    """Rows of unconstrained numbers to coefficients of stationary polynomials."""
    raw = np.clip(raw, -EDGE, EDGE)
    r = raw / np.sqrt(1 + raw * raw)
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - r[:, k : k + 1] * before[:, ::-1]
        out[:, k] = r[:, k]
    return out


def _system(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, loading and stationary covariance of each row's ARMA state."""
    m, p, q = len(phi), phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    t = np.zeros((m, r, r))
    t[:, :p, 0] = phi
    t[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    load = np.zeros((m, r))
    load[:, 0] = 1.0
    load[:, 1 : q + 1] = theta
    noise = load[:, :, None] * load[:, None, :]
    kron = np.einsum("mij,mkl->mikjl", t, t).reshape(m, r * r, r * r)
    start = np.linalg.solve(np.eye(r * r) - kron, noise.reshape(m, r * r, 1)).reshape(m, r, r)
    return t, noise, start


def _filter(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scaled products of innovations, sum of log variances, state after the last reading, scaled variance of the next) of each row's model.

    ``y`` (n, c) holds series that run through one model side by side; the
    products are (m, c, c), the states (m, r, c).
    """
    t, noise, p = _system(phi, theta)
    m, (n, c) = len(phi), y.shape
    a = np.zeros((m, t.shape[1], c))
    squares, logs = np.zeros((m, c, c)), np.zeros(m)
    j, steady = 0, False
    while j < n and not steady:
        f = p[:, 0, 0]
        gain = t @ p[:, :, :1] / f[:, None, None]
        following = t @ p @ t.transpose(0, 2, 1) + noise - gain @ gain.transpose(0, 2, 1) * f[:, None, None]
        steady = j > 5 and np.abs(following - p).max() < 1e-11
        p = following
        v = y[j] - a[:, 0, :]
        squares += v[:, :, None] * v[:, None, :] / f[:, None, None]
        logs += np.log(f)
        a = t @ a + gain * v[:, None, :]
        j += 1
    if j < n:
        # the gain stands still: one product a step
        closed, rest = t.copy(), np.empty((m, n - j, c))
        closed[:, :, 0] -= gain[:, :, 0]
        k = j
        if n - j > 4 * BLOCK:
            # a block of steps at once: what the state at its start and each of its readings do to each of its forecasts
            powers = [np.broadcast_to(np.eye(t.shape[1]), t.shape)]
            for _ in range(BLOCK):
                powers.append(closed @ powers[-1])
            reach = np.stack([x[:, 0, :] for x in powers[:BLOCK]], axis=1)
            carry = np.concatenate([x @ gain for x in reversed(powers[:BLOCK])], axis=2)
            echo = np.concatenate([np.zeros((m, 1)), carry[:, 0, ::-1]], axis=1)
            lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
            within = np.where(lag > 0, echo[:, np.maximum(lag, 0)], 0.0)
            while k + BLOCK <= n:
                part = y[k : k + BLOCK]
                rest[:, k - j : k - j + BLOCK] = reach @ a + within @ part
                a = powers[BLOCK] @ a + carry @ part
                k += BLOCK
        for k in range(k, n):
            rest[:, k - j] = a[:, 0, :]
            a = closed @ a + gain * y[k]
        v = y[j:] - rest
        squares += v.transpose(0, 2, 1) @ v / f[:, None, None]
        logs += (n - j) * np.log(f)
    return squares, logs, a, p[:, 0, 0]


@dataclass(frozen=True)
class ArimaFit:
    order: tuple[int, int, int]
    constant: float
    phi: np.ndarray
    theta: np.ndarray
    variance: float
    loglik: float
    converged: bool
    observations: int
    start: np.ndarray

    @property
    def parameters(self) -> int:
        return len(self.phi) + len(self.theta) + (self.order[1] == 0) + 1

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters

    @property
    def bic(self) -> float:
        return -2 * self.loglik + np.log(self.observations) * self.parameters

    def forecast_path(self, values: np.ndarray, steps: int) -> np.ndarray:
        """The ``steps`` values after ``values``, all from the same origin."""
        if type(steps) is not int or steps < 1:
            raise ValueError("steps must be a positive integer")
        d = self.order[1]
        out = np.full(steps, self.constant)
        if len(self.phi) or len(self.theta):
            y = np.diff(values, n=d) if d else np.asarray(values, float)
            _, _, state, _ = _filter((y - self.constant)[:, None], self.phi[None], self.theta[None])
            move, state = _system(self.phi[None], self.theta[None])[0][0], state[0]
            for k in range(steps):
                out[k] += float(state[0, 0])
                state = move @ state
        for k in range(d - 1, -1, -1):
            out = np.diff(values, n=k)[-1] + np.cumsum(out)
        return out

    def forecast(self, values: np.ndarray) -> float:
        """One step beyond ``values``."""
        return float(self.forecast_path(values, 1)[0])


def _compass(loss, x: np.ndarray, value: float, rounds: int) -> tuple[np.ndarray, float, bool]:  # noqa: ANN001
    """Best point of a compass search: along every coordinate both ways, from ten to a millionth; whether none is better in the end.

    It needs values only, and so still works at the edge of what is invertible,
    where slopes say little.
    """
    reach = np.concatenate([s * 10.0 ** (1.0 - np.arange(8)) for s in (1.0, -1.0)])
    ways = (reach[:, None, None] * np.eye(len(x))).reshape(-1, len(x))
    for _ in range(rounds):
        got = loss(x + ways)
        pick = int(np.argmin(got))
        if not got[pick] < value - FLAT * max(1.0, abs(value)):
            return x, value, True
        x, value = x + ways[pick], float(got[pick])
    return x, value, False


def fit_arima(values: np.ndarray, order: tuple[int, int, int], *, start: np.ndarray | None = None, iterations: int = 60, tolerance: float = 1e-5) -> ArimaFit:
    """Maximum-likelihood fit; a constant is estimated if and only if d = 0."""
    p, d, q = order
    if min(order) < 0:
        raise FitError("orders are non-negative")
    values = np.asarray(values, float)
    if not np.isfinite(values).all():
        raise FitError("values must be finite")
    y = np.diff(values, n=d) if d else values
    n, constant = len(y), d == 0
    if n < p + q + 2 + constant:
        raise FitError("too few observations")
    spread = y.std()
    if spread == 0:
        raise FitError("constant values")
    if p == q == 0:
        mean = float(y.mean()) if constant else 0.0
        variance = float(((y - mean) ** 2).mean())
        loglik = -n / 2 * (np.log(2 * np.pi * variance) + 1)
        return ArimaFit(order, mean, np.zeros(0), np.zeros(0), variance, float(loglik), True, n, np.zeros(0))
    centre = float(y.mean()) if constant else 0.0
    series = np.column_stack([(y - centre) / spread, *([np.ones(n)] if constant else [])])

    def concentrated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mean, squares, logs) of each row: the mean that makes the squares least."""
        products, logs, _, _ = _filter(series, _coefficients(x[:, :p]), -_coefficients(x[:, p : p + q]))
        if not constant:
            return np.zeros(len(x)), products[:, 0, 0], logs
        mean = products[:, 0, 1] / products[:, 1, 1]
        return mean, products[:, 0, 0] - mean * products[:, 0, 1], logs

    def loss(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            try:
                _, squares, logs = concentrated(x)
            except np.linalg.LinAlgError:
                return np.full(len(x), np.inf)
            out = 0.5 * (np.log(squares / n) + logs / n)
        return np.where(np.isfinite(out), out, np.inf)

    k = p + q
    x = np.zeros(k) if start is None or len(start) != k else np.asarray(start, float).copy()
    if start is None:
        x[: p + q] = 0.1
    h = 1e-5

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        around = np.vstack([x, x + h * np.eye(k), x - h * np.eye(k)])
        f = loss(around)
        return float(f[0]), (f[1 : k + 1] - f[k + 1 :]) / (2 * h)

    def descend(x: np.ndarray, iterations: int = iterations) -> tuple[np.ndarray, float, bool]:
        """BFGS from ``x``: point, value and whether it converged."""
        value, grad = slope(x)
        if not np.isfinite(value):
            return x, value, False
        inverse = np.eye(k)
        for _ in range(iterations):
            if np.abs(grad).max() < tolerance:
                return x, value, True
            step = -inverse @ grad
            if step @ grad >= 0:
                inverse, step = np.eye(k), -grad
            tried = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3])
            got = loss(x + tried[:, None] * step)
            better = np.flatnonzero(got < value - 1e-4 * tried * abs(step @ grad))
            if not len(better):
                return x, value, bool(np.abs(grad).max() < 50 * tolerance)
            move = tried[better[0]] * step
            after, new = slope(x + move)
            change = new - grad
            curve = move @ change
            if curve > 1e-12:
                rho, one = 1 / curve, np.eye(k)
                inverse = (one - rho * np.outer(move, change)) @ inverse @ (one - rho * np.outer(change, move)) + rho * np.outer(move, move)
            small = abs(value - after) < FLAT * max(1.0, abs(value))
            x, value, grad = x + move, after, new
            if small:
                return x, value, True
        return x, value, False

    x, value, converged = descend(x)
    if not np.isfinite(value):
        x, value, converged = descend(np.zeros(k))
    if not np.isfinite(value):
        raise FitError("likelihood is not finite")
    if not converged:
        # in turn: fresh curvature, which is cheap, and the second optimiser
        for _ in range(2):
            again = descend(x, iterations // 3)
            if again[1] <= value:
                x, value, converged = again
            if not converged:
                x, value, converged = _compass(loss, x, value, 10 + 30 // k)
            if converged:
                break
    mean, squares, logs = (float(v[0]) for v in concentrated(x[None]))
    variance = squares / n
    loglik = -n / 2 * (np.log(2 * np.pi * variance) + 1) - logs / 2 - n * np.log(spread)
    phi, theta = _coefficients(x[None, :p])[0], -_coefficients(x[None, p:])[0]
    return ArimaFit(order, float(centre + spread * mean), phi, theta, float(variance * spread**2), float(loglik), bool(converged), n, x)
