"""Contracts as one-pass aggregates: every check of a table is one column of one row.

``count_violations`` is lazy and runs in a single aggregation; ``enforce``
executes it and raises ``ValueError`` naming the first violated check. Null
never counts as satisfied.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import is_finite
from strandline.schema import DATASET_COLUMNS, PREDICTION_COLUMNS, PREDICTION_KEYS, PRICE_COLUMNS, SPLITS, TOLERANCE_OHLC, SplitConfig

Checks = Mapping[str, Column]


def require_columns(frame: DataFrame, columns: Iterable[str], *, exact: bool = False) -> None:
    columns = list(columns)
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if exact and frame.columns != columns:
        raise ValueError("columns differ from the contract")


def violated(condition: Column) -> Column:
    """Rows for which the condition is not true."""
    return F.count_if(~F.coalesce(condition, F.lit(False)))


def count_violations(frame: DataFrame, checks: Checks) -> DataFrame:
    return frame.agg(*(violated(ok).alias(name) for name, ok in checks.items()))


def enforce(frame: DataFrame, checks: Checks, *, allow_empty: bool = False) -> None:
    row = frame.agg(F.count("*").alias("rows"), *(violated(ok).alias(name) for name, ok in checks.items())).first()
    if not allow_empty and not row["rows"]:
        raise ValueError("no rows")
    for name in checks:
        if row[name]:
            raise ValueError(f"{name}: {row[name]} rows")


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return frame.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def enforce_unique(frame: DataFrame, keys: Sequence[str]) -> None:
    if duplicate_keys(frame, keys).limit(1).count():
        raise ValueError(f"duplicate rows for {', '.join(keys)}")


def price_checks() -> dict[str, Column]:
    """Checks of a price panel, row by row; ``previous_date`` is added by ``with_previous_date``."""
    money = ("open", "high", "low", "close", "adj_close")
    every = F.lit(True)
    for c in (*money, "volume", "dividends", "stock_splits"):
        every = every & is_finite(c)
    positive = F.lit(True)
    for c in money:
        positive = positive & (F.col(c) > 0)
    return {
        "null_date": F.col("date").isNotNull(),
        "dates_not_increasing": F.col("previous_date").isNull() | (F.col("previous_date") < F.col("date")),
        "not_finite": every,
        "price_not_positive": positive,
        "volume_negative": F.col("volume") >= 0,
        "high_too_low": F.col("high") + TOLERANCE_OHLC >= F.greatest("open", "low", "close"),
        "low_too_high": F.col("low") - TOLERANCE_OHLC <= F.least("open", "high", "close"),
        "action_negative": (F.col("dividends") >= 0) & (F.col("stock_splits") >= 0),
    }


def with_previous_date(frame: DataFrame) -> DataFrame:
    return frame.withColumn("previous_date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date")))


def validate_prices(frame: DataFrame, min_rows: int = 1) -> None:
    require_columns(frame, PRICE_COLUMNS)
    enforce(with_previous_date(frame), price_checks())
    if frame.groupBy("ticker").count().where(F.col("count") < min_rows).limit(1).count():
        raise ValueError("too few observations")


def dataset_checks() -> dict[str, Column]:
    return {"unknown_split": F.col("split").isin(*SPLITS), "target_not_finite": is_finite("target_return")}


def validate_dataset(frame: DataFrame) -> None:
    require_columns(frame, DATASET_COLUMNS)
    enforce(frame, dataset_checks())
    enforce_unique(frame, ["ticker", "target_date", "split"])


def model_input(frame: DataFrame) -> DataFrame:
    """What a model may see: everything but the target."""
    return frame.drop("target_return")


def final_dataset_checks(config: SplitConfig) -> dict[str, Column]:
    """A dataset for the final test: chronology, finite numbers and splits as the boundaries say."""
    expected = F.lit(None).cast("string")
    for name, (first, last) in config.parts:
        expected = F.when(F.col("target_date").between(F.lit(first), F.lit(last)), F.lit(name)).otherwise(expected)
    return {
        "null_key": F.col("ticker").isNotNull() & F.col("date").isNotNull() & F.col("target_date").isNotNull(),
        "target_not_after_date": F.col("date") < F.col("target_date"),
        "split_not_as_bounded": F.col("split") == expected,
        "not_finite": is_finite("adj_close") & is_finite("log_return") & is_finite("target_return"),
    }


def coverage(frame: DataFrame) -> DataFrame:
    """Per ticker: the splits present and the first and last test target date."""
    test = F.col("split") == "test"
    return frame.groupBy("ticker").agg(
        F.sort_array(F.collect_set("split")).alias("splits"),
        F.min(F.when(test, F.col("target_date"))).alias("test_start"),
        F.max(F.when(test, F.col("target_date"))).alias("test_end"),
    )


def validate_final_dataset(frame: DataFrame, config: SplitConfig, tickers: Sequence[str]) -> None:
    require_columns(frame, DATASET_COLUMNS)
    enforce(frame, final_dataset_checks(config))
    enforce_unique(frame, ["ticker", "target_date", "split"])
    rows = {r["ticker"]: r for r in coverage(frame).collect()}  # one row per protocol ticker
    if set(rows) != set(tickers):
        raise ValueError("tickers differ from the protocol")
    for ticker, row in rows.items():
        if list(row["splits"]) != sorted(SPLITS) or (row["test_start"], row["test_end"]) != config.test:
            raise ValueError(f"{ticker} does not cover every split")


def prediction_checks(splits: Sequence[str] = ("train", "validation")) -> dict[str, Column]:
    return {
        "null_key": F.col("ticker").isNotNull() & F.col("date").isNotNull() & F.col("target_date").isNotNull() & F.col("model").isNotNull(),
        "unknown_split": F.col("split").isin(*splits),
        "not_finite": is_finite("actual_return") & is_finite("predicted_return"),
        "target_not_after_date": F.col("date") < F.col("target_date"),
    }


def validate_predictions(frame: DataFrame, splits: Sequence[str] = ("train", "validation"), baseline: str | None = None) -> None:
    require_columns(frame, PREDICTION_COLUMNS)
    enforce(frame, prediction_checks(splits))
    enforce_unique(frame, [*PREDICTION_KEYS, "model"])
    if baseline and not frame.where(F.col("model") == baseline).limit(1).count():
        raise ValueError("baseline missing")


def misaligned(predictions: DataFrame, baseline: str) -> DataFrame:
    """Per model: baseline keys it lacks, keys the baseline lacks and actuals that differ bit by bit."""
    keys = list(PREDICTION_KEYS)
    base = predictions.where(F.col("model") == baseline).select(*keys, F.col("actual_return").alias("base"))
    # the models are the few names of one experiment; every base key is due once per model
    names = sorted(r[0] for r in predictions.select("model").distinct().collect())
    expected = base.withColumn("model", F.explode(F.array(*map(F.lit, names))))
    joined = expected.join(predictions, [*keys, "model"], "full")
    return joined.groupBy("model").agg(
        F.count_if(F.col("actual_return").isNull()).alias("missing"),
        F.count_if(F.col("base").isNull()).alias("unexpected"),
        F.count_if(F.col("base") != F.col("actual_return")).alias("different"),
    )


def validate_alignment(predictions: DataFrame, baseline: str) -> None:
    if misaligned(predictions, baseline).where("missing + unexpected + different > 0").limit(1).count():
        raise ValueError("models are not aligned with the baseline")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(*keys), right.select(*keys)
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def keyed_violations(frame: DataFrame, keys: Sequence[str], checks: Checks) -> DataFrame:
    """One row: violations of each check and rows beyond the first of a key, from one shuffle of pre-aggregated keys."""
    by_key = frame.groupBy(*keys).agg(F.count("*").alias("_rows"), *(violated(ok).alias(name) for name, ok in checks.items()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return by_key.agg(*(total(name)(name) for name in checks), total(F.col("_rows") - 1)("repeated_rows"))


def schedule_violations(predictions: DataFrame, expected: DataFrame, keys: Sequence[str] = PREDICTION_KEYS, tolerance: float = 1e-12) -> DataFrame:
    """One row: keys of the schedule that are missing, unexpected or repeated, and actuals off the schedule's ``target_return``."""
    keys = list(keys)
    actual = [c for c in ("actual_return",) if c in predictions.columns and "target_return" in expected.columns]
    there = predictions.groupBy(*keys).agg(F.count("*").alias("_rows"), *(f(c).alias(n) for c in actual for f, n in ((F.min, "_low"), (F.max, "_high"))))
    due = expected.select(*keys, *[F.col("target_return").alias("_due") for _ in actual], F.lit(1).alias("_expected"))
    joined = there.join(due, keys, "full")
    both = F.col("_rows").isNotNull() & F.col("_expected").isNotNull()
    off = both & ~F.coalesce((F.abs(F.col("_low") - F.col("_due")) <= tolerance) & (F.abs(F.col("_high") - F.col("_due")) <= tolerance), F.lit(False)) if actual else F.lit(False)
    return joined.agg(
        F.count_if(F.col("_rows").isNull()).alias("missing"), F.count_if(F.col("_expected").isNull()).alias("unexpected"), F.count_if(F.col("_rows") > 1).alias("repeated"), F.count_if(off).alias("different")
    )


def _refuse(violations: DataFrame, message: str) -> None:
    row = violations.first().asDict()
    found = {k: v for k, v in row.items() if v}
    if found:
        raise ValueError(f"{message}: {found}")


def tail_of(predictions: DataFrame, source: DataFrame) -> DataFrame:
    """Each ticker's source rows from its first forecast on."""
    first = predictions.groupBy("ticker").agg(F.min("target_date").alias("first_target"))
    return source.join(first, "ticker").where(F.col("target_date") >= F.col("first_target")).drop("first_target")


def validate_tail(predictions: DataFrame, source: DataFrame, tolerance: float = 1e-12) -> None:
    """Predictions are the complete tail of each ticker's source from its first forecast, with the source's targets."""
    _refuse(schedule_violations(predictions, tail_of(predictions, source), tolerance=tolerance), "predictions are not a complete tail of the source")


def shortlist_violations(shortlist: DataFrame, size: int = 3) -> DataFrame:
    """Per ticker: whether its ranks are not 1 to ``size`` and how many rows are not named by their rank."""
    ranks = F.sort_array(F.collect_list("bic_rank")).cast("array<int>")
    named = F.col("model") == F.concat(F.lit("arima_bic_"), F.col("bic_rank").cast("string"))
    return shortlist.groupBy("ticker").agg((ranks != F.array(*map(F.lit, range(1, size + 1)))).alias("ranks_not_consecutive"), violated(named).alias("name_not_of_rank"))


def validate_shortlist(shortlist: DataFrame, size: int = 3) -> None:
    require_columns(shortlist, ("ticker", "p", "d", "q", "bic", "bic_rank", "model"))
    rows = shortlist_violations(shortlist, size)
    enforce(rows, {"name_not_of_rank": F.col("name_not_of_rank") == 0, "ranks_not_consecutive": ~F.col("ranks_not_consecutive")})


def assignment_checks() -> dict[str, Column]:
    return {"unknown_regime": F.col("regime").isin("low", "medium", "high"), "not_finite": is_finite("volatility")}


def validate_assignments(assignments: DataFrame) -> None:
    enforce(assignments, assignment_checks())
    enforce_unique(assignments, list(PREDICTION_KEYS))


def parse_dates(frame: DataFrame, columns: Sequence[str] = ("date", "target_date"), *, validate: bool = False) -> DataFrame:
    """Text or timestamp columns as dates; unreadable text becomes null, or an error with ``validate``."""
    parsed = frame.withColumns({c: F.col(c).try_cast("date") for c in columns})
    if validate:
        enforce(parsed, {f"{c}_unreadable": F.col(c).isNotNull() for c in columns}, allow_empty=True)
    return parsed


def validate_schedule(predictions: DataFrame, expected: DataFrame, keys: Sequence[str] = PREDICTION_KEYS, tolerance: float = 1e-12) -> None:
    """Predictions are exactly the expected rows: no key missing, none too many, none twice, actuals as the schedule's targets."""
    _refuse(schedule_violations(predictions, expected, keys, tolerance), "predictions differ from the schedule")


def component_checks(model: str, tickers: Sequence[str]) -> dict[str, Column]:
    return {**prediction_checks(("test",)), "other_model": F.col("model") == model, "unknown_ticker": F.col("ticker").isin(*tickers)}


def spans_off(predictions: DataFrame, span: tuple) -> DataFrame:
    """Tickers whose forecasts do not reach from the first to the last test date."""
    spans = predictions.groupBy("ticker").agg(F.min("target_date").alias("first"), F.max("target_date").alias("last"))
    return spans.where(~F.coalesce((F.col("first") == F.lit(span[0])) & (F.col("last") == F.lit(span[1])), F.lit(False)))


def validate_test_component(predictions: DataFrame, model: str, tickers: Sequence[str], span: tuple, *, every_ticker: bool = True) -> None:
    """One model's test forecasts: exact columns, sound rows, known tickers, each from the first to the last test date."""
    require_columns(predictions, PREDICTION_COLUMNS, exact=True)
    validate_predictions(predictions, ("test",))
    enforce(predictions, component_checks(model, tickers))
    if spans_off(predictions, span).limit(1).count():
        raise ValueError("a ticker does not span the test dates")
    if every_ticker and predictions.select("ticker").distinct().count() != len(set(tickers)):
        raise ValueError("a ticker is missing")


def missing_splits(dataset: DataFrame, splits: Sequence[str] = ("train", "validation")) -> DataFrame:
    """Tickers without rows of some split, with the splits they lack."""
    there = dataset.groupBy("ticker").agg(F.collect_set("split").alias("there"))
    lacking = F.array_except(F.array(*map(F.lit, splits)), "there")
    return there.select("ticker", F.explode(lacking).alias("split"))


def validate_grid_data(dataset: DataFrame, tickers: Sequence[str], splits: Sequence[str] = ("train", "validation")) -> DataFrame:
    """The rows a grid is evaluated on; every ticker must have every split."""
    rows = dataset.where(F.col("ticker").isin(*tickers) & F.col("split").isin(*splits))
    if rows.select("ticker", "split").distinct().count() != len(set(tickers)) * len(set(splits)):
        raise ValueError("a ticker lacks a split")
    return rows


def run_checks() -> dict[str, Column]:
    """Checks of a run table: sound runs have figures and no error, others an error and no figures."""
    ok, figures = F.col("status") == "ok", is_finite("mae_bps") & is_finite("rmse_bps")
    return {
        "unknown_status": F.col("status").isin("ok", "failed", "non_finite", "diverged"),
        "sound_run_without_figures": ~ok | (figures & (F.col("mae_bps") >= 0) & (F.col("rmse_bps") >= 0) & (F.col("best_epoch") >= 1) & (F.col("parameter_count") >= 1) & F.col("error").isNull()),
        "failed_run_without_error": ok | (F.col("error").isNotNull() & F.col("best_epoch").isNull()),
    }


def validate_runs(runs: DataFrame) -> None:
    enforce(runs, run_checks())
    enforce_unique(runs, ["ticker", "window", "units", "dropout", "seed"])


def seed_violations(predictions: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Per ticker: observations without exactly the seeds, with a seed twice, and with more than one actual."""
    grouped = predictions.groupBy(*PREDICTION_KEYS).agg(
        F.sort_array(F.collect_set("seed").cast("array<int>")).alias("seeds"), F.count("*").alias("rows"), F.countDistinct("actual_return").alias("actuals")
    )
    want = F.array(*map(F.lit, sorted(set(seeds))))
    return grouped.groupBy("ticker").agg(
        violated(F.col("seeds") == want).alias("other_seeds"), F.count_if(F.col("rows") > F.size("seeds")).alias("repeated_seeds"), F.count_if(F.col("actuals") > 1).alias("different_actuals")
    )


def validate_seed_groups(predictions: DataFrame, tickers: Sequence[str], seeds: Sequence[int]) -> None:
    """Every ticker has forecasts of exactly the given seeds, on the same observations."""
    if seed_violations(predictions, seeds).where("other_seeds + repeated_seeds + different_actuals > 0").limit(1).count():
        raise ValueError("seeds are not aligned")
    if {r[0] for r in predictions.select("ticker").distinct().collect()} != set(tickers):
        raise ValueError("tickers differ from the protocol")
