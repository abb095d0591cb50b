"""One LSTM layer and a linear output, trained by Adam on squared error, in NumPy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from strandline.schema import NetworkConfig


class NonFiniteError(ValueError):
    """Training or prediction left the finite numbers."""


@dataclass(frozen=True)
class TrainingConfig:
    batch: int = 32
    rate: float = 1e-3
    epochs: int = 200
    patience: int = 15

    def __post_init__(self) -> None:
        for name in ("batch", "epochs", "patience"):
            if type(getattr(self, name)) is not int or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive integer")
        if not self.rate > 0:
            raise ValueError("rate must be positive")


def validate_arrays(features: np.ndarray, targets: np.ndarray, window: int) -> None:
    """Rank three with one channel, matching lengths, finite."""
    if features.ndim != 3 or features.shape[1:] != (window, 1):
        raise ValueError("features must have shape (rows, window, 1)")
    if targets.shape != (len(features),) or not len(features):
        raise ValueError("targets must be one number per row")
    if not np.isfinite(features).all() or not np.isfinite(targets).all():
        raise ValueError("arrays must be finite")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights of the gates (input, forget, cell, output) and of the output unit."""

    def __init__(self, config: NetworkConfig, seed: int) -> None:
        u = config.units
        self.config, self.generator = config, np.random.default_rng(seed)
        limit = np.sqrt(6 / (1 + 4 * u))
        kernel = self.generator.uniform(-limit, limit, (1, 4 * u))
        recurrent, _ = np.linalg.qr(self.generator.standard_normal((4 * u, u)))
        bias = np.zeros(4 * u)
        bias[u : 2 * u] = 1.0
        limit = np.sqrt(6 / (u + 1))
        self.weights = [kernel, recurrent.T.copy(), bias, self.generator.uniform(-limit, limit, (u, 1)), np.zeros(1)]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.steps = 0

    def forward(self, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple]]:
        kernel, recurrent, bias, out, shift = self.weights
        u = self.config.units
        h, c, tape = np.zeros((len(x), u)), np.zeros((len(x), u)), []
        for t in range(x.shape[1]):
            given = x[:, t] if mask is None else x[:, t] * mask
            z = given @ kernel + h @ recurrent + bias
            i, f, g, o = _sigmoid(z[:, :u]), _sigmoid(z[:, u : 2 * u]), np.tanh(z[:, 2 * u : 3 * u]), _sigmoid(z[:, 3 * u :])
            before, c = c, f * c + i * g
            s = np.tanh(c)
            tape.append((given, h, before, i, f, g, o, s))
            h = o * s
        return (h @ out + shift)[:, 0], [*tape, (h,)]

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray | None) -> list[np.ndarray]:
        kernel, recurrent, bias, out, _ = self.weights
        predicted, tape = self.forward(x, mask)
        (last,), tape = tape[-1], tape[:-1]
        slope = (2 * (predicted - y) / len(y))[:, None]
        d_kernel, d_recurrent, d_bias = np.zeros_like(kernel), np.zeros_like(recurrent), np.zeros_like(bias)
        dh, dc = slope @ out.T, np.zeros_like(last)
        for given, h, before, i, f, g, o, s in reversed(tape):
            dc = dc + dh * o * (1 - s * s)
            dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * s * o * (1 - o)])
            d_kernel += given.T @ dz
            d_recurrent += h.T @ dz
            d_bias += dz.sum(axis=0)
            dh, dc = dz @ recurrent.T, dc * f
        return [d_kernel, d_recurrent, d_bias, last.T @ slope, slope.sum(axis=0)]

    def epoch(self, x: np.ndarray, y: np.ndarray, training: TrainingConfig) -> None:
        """One pass in the given order."""
        drop = self.config.dropout
        for first in range(0, len(x), training.batch):
            part, want = x[first : first + training.batch], y[first : first + training.batch]
            mask = (self.generator.random((len(part), 1)) >= drop) / (1 - drop) if drop else None
            self.steps += 1
            for w, g, (m, v) in zip(self.weights, self.gradients(part, want, mask), self.moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= training.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, _ = self.forward(x)
        if not np.isfinite(out).all():
            raise NonFiniteError("predictions are not finite")
        return out


NetworkBuilder = Callable[[NetworkConfig, int], Network]


@dataclass(frozen=True)
class Trainer:
    """Two stages: the best epoch on an inner validation part, then a fit of that many epochs."""

    config: NetworkConfig
    training: TrainingConfig = field(default_factory=TrainingConfig)
    build: NetworkBuilder = Network

    def best_epoch(self, x: np.ndarray, y: np.ndarray, x_inner: np.ndarray, y_inner: np.ndarray, seed: int) -> int:
        """1-based epoch of the first least inner loss, within the patience."""
        validate_arrays(x, y, self.config.window)
        validate_arrays(x_inner, y_inner, self.config.window)
        network, best, at = self.build(self.config, seed), np.inf, 0
        for epoch in range(1, self.training.epochs + 1):
            network.epoch(x, y, self.training)
            loss = float(((network.predict(x_inner) - y_inner) ** 2).mean())
            if not np.isfinite(loss):
                raise NonFiniteError("loss is not finite")
            if loss < best:
                best, at = loss, epoch
            elif epoch - at >= self.training.patience:
                break
        return at

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> Network:
        validate_arrays(x, y, self.config.window)
        network = self.build(self.config, seed)
        for _ in range(epochs):
            network.epoch(x, y, self.training)
        return network
