"""Column contracts and protocol constants of the panel's tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

BPS = 10_000.0
TRADING_DAYS = 252
TOLERANCE_OHLC = 1e-8
TOLERANCE_RESIDUAL = 1e-12

PRICE_COLUMNS = ("date", "ticker", "open", "high", "low", "close", "adj_close", "volume", "dividends", "stock_splits")
DATASET_COLUMNS = ("date", "target_date", "ticker", "adj_close", "log_return", "target_return", "split")
PREDICTION_KEYS = ("date", "target_date", "ticker", "split")
PREDICTION_COLUMNS = (*PREDICTION_KEYS, "model", "actual_return", "predicted_return")
PREDICTION_DDL = "date date, target_date date, ticker string, split string, model string, actual_return double, predicted_return double"
RUN_COLUMNS = ("ticker", "window", "units", "dropout", "seed", "status", "best_epoch", "parameter_count", "mae_bps", "rmse_bps", "error")
SPLITS = ("train", "validation", "test")

#: Candidate and comparator of each comparison.
COMPARISONS = (("arima", "naive_zero"), ("lstm", "naive_zero"), ("arima_lstm", "naive_zero"), ("arima_lstm", "arima"), ("arima_lstm", "lstm"))
MODEL_ORDER = ("naive_zero", "arima", "lstm", "arima_lstm")


@dataclass(frozen=True)
class SplitConfig:
    """Inclusive boundaries by target date; strictly increasing."""

    train: tuple[date, date] = (date(2006, 1, 3), date(2015, 12, 31))
    validation: tuple[date, date] = (date(2016, 1, 4), date(2019, 12, 31))
    test: tuple[date, date] = (date(2020, 1, 2), date(2025, 12, 31))

    def __post_init__(self) -> None:
        flat = [*self.train, *self.validation, *self.test]
        if any(not isinstance(x, date) for x in flat) or not (flat[0] <= flat[1] < flat[2] <= flat[3] < flat[4] <= flat[5]):
            raise ValueError("split boundaries must be increasing dates")

    @property
    def parts(self) -> tuple[tuple[str, tuple[date, date]], ...]:
        return (("train", self.train), ("validation", self.validation), ("test", self.test))


@dataclass(frozen=True)
class InferenceConfig:
    lag: int = 20
    alpha: float = 0.05
    block: int = 21
    repetitions: int = 10_000
    seed: int = 42
    confidence: float = 0.95

    def __post_init__(self) -> None:
        for name in ("lag", "block", "repetitions"):
            value = getattr(self, name)
            if type(value) is not int or value < 1:
                raise ValueError(f"{name} must be a positive integer")
        for name in ("alpha", "confidence"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.lag != self.block - 1:
            raise ValueError("lag must be one less than the block length")


@dataclass(frozen=True)
class Order:
    """An ARIMA order."""

    p: int
    d: int
    q: int

    def __post_init__(self) -> None:
        if any(type(x) is not int or x < 0 for x in (self.p, self.d, self.q)):
            raise ValueError("orders are non-negative integers")


@dataclass(frozen=True)
class NetworkConfig:
    window: int
    units: int
    dropout: float

    def __post_init__(self) -> None:
        if any(type(x) is not int or x < 1 for x in (self.window, self.units)):
            raise ValueError("window and units are positive integers")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout lies in [0, 1)")

    @property
    def parameters(self) -> int:
        u = self.units
        return 4 * (u * (u + 1) + u) + u + 1


@dataclass(frozen=True)
class Protocol:
    """A frozen evaluation protocol; tickers and boundaries are parameters."""

    tickers: tuple[str, ...]
    splits: SplitConfig = field(default_factory=SplitConfig)
    inference: InferenceConfig = field(default_factory=InferenceConfig)
    warm_up: int = 252
    regime_window: int = 21

    def __post_init__(self) -> None:
        if not self.tickers or len(set(self.tickers)) != len(self.tickers):
            raise ValueError("tickers must be given once each")
        for name in ("warm_up", "regime_window"):
            if type(getattr(self, name)) is not int or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive integer")


def network_grid(windows: tuple[int, ...] = (5, 21, 63), units: tuple[int, ...] = (16, 32), dropouts: tuple[float, ...] = (0.0, 0.2)) -> list[NetworkConfig]:
    return [NetworkConfig(w, u, d) for w in windows for u in units for d in dropouts]
