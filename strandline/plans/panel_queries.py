"""Queries of the panel operators over whole tables, each with its SQL where SQL can say it.

``DIGITS`` rounds the named doubles on both sides, so that the order of a sum
does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import clean_ticker, finite_or_null, is_finite
from strandline.models.lstm import TrainingConfig
from strandline.operators import autocorrelation, contracts, explore, forecast, inference, metrics, regimes, returns, selection, sequences
from strandline.operators.snapshot_diff import delivery_order
from strandline.operators.stationarity import stationarity_report as both_tests
from strandline.plans.panels import MARKET, PANELS, STAND_INS, TICKER, dataset_of, dataset_sql, panel, predictions_sql, synthetic_predictions
from strandline.schema import DATASET_COLUMNS, InferenceConfig, network_grid
from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **digits: int) -> Callable[[Query], Query]:
    """Registers a query under its name; ``digits`` are the doubles to round, in query and SQL alike."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = function(spark, folder)
            return out.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()}) if digits else out

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {n}) AS {c}" for c, n in digits.items())
            ORACLE[function.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) outermost" if digits else sql
        return function

    return register


# ---- scans, contracts, quality -------------------------------------------------

_PRICES = """SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, avg(l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  avg(l_extendedprice) AS close, avg(l_extendedprice) AS adj_close, sum(l_quantity) AS volume, max(l_discount) AS dividends, min(l_tax) AS stock_splits FROM lineitem GROUP BY 1, 2"""


def prices(spark: SparkSession, folder: str) -> DataFrame:
    price = F.avg("l_extendedprice")
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("ticker"))
        .agg(
            price.alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), price.alias("close"), price.alias("adj_close"),
            F.sum("l_quantity").alias("volume"), F.max("l_discount").alias("dividends"), F.min("l_tax").alias("stock_splits"),
        )
    )


@query(
    f"""SELECT CAST(COLUMNS(*) AS BIGINT) FROM (SELECT count_if(date IS NULL) AS null_date, count_if(previous >= date) AS dates_not_increasing, count_if(NOT coalesce(isfinite(open + high + low + close + adj_close + volume + dividends + stock_splits), false)) AS not_finite,
  count_if(NOT (least(open, high, low, close, adj_close) > 0)) AS price_not_positive, count_if(NOT (volume >= 0)) AS volume_negative, count_if(NOT (high + 1e-8 >= greatest(open, low, close))) AS high_too_low,
  count_if(NOT (low - 1e-8 <= least(open, high, close))) AS low_too_high, count_if(NOT (dividends >= 0 AND stock_splits >= 0)) AS action_negative
  FROM (SELECT *, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS previous FROM ({_PRICES})))"""
)
def price_contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of the price panel violate each check."""
    return contracts.count_violations(contracts.with_previous_date(prices(spark, folder)), contracts.price_checks())


@query(
    """SELECT CAST(COLUMNS(*) AS BIGINT) FROM (SELECT count_if(NOT coalesce(split IN ('train', 'validation', 'test'), false)) AS unknown_split, count_if(NOT coalesce(isfinite(target_return), false)) AS target_not_finite FROM dataset)"""
)
def dataset_contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered dataset against its contract."""
    return contracts.count_violations(table(spark, folder, "dataset"), contracts.dataset_checks())


@query(
    f"""SELECT CAST(COLUMNS(*) AS BIGINT) FROM (SELECT count_if(ticker IS NULL OR date IS NULL OR target_date IS NULL) AS null_key, count_if(NOT coalesce(date < target_date, false)) AS target_not_after_date,
  count_if(split IS NULL OR split IS DISTINCT FROM CASE {" ".join(f"WHEN target_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in MARKET.parts)} END) AS split_not_as_bounded,
  count_if(NOT coalesce(isfinite(adj_close) AND isfinite(log_return) AND isfinite(target_return), false)) AS not_finite FROM dataset)"""
)
def final_dataset_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered dataset against the contract of the final test."""
    return contracts.count_violations(table(spark, folder, "dataset"), contracts.final_dataset_checks(MARKET))


@query(f"SELECT {TICKER} AS ticker, date, count(*) AS rows FROM dataset GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date) delivered more than once."""
    return contracts.duplicate_keys(table(spark, folder, "dataset").select(clean_ticker("ticker").alias("ticker"), "date"), ["ticker", "date"])


@query(f"SELECT {TICKER} AS ticker, count(*) AS rows, count(DISTINCT ticker) AS spellings FROM dataset GROUP BY 1")
def normalized_tickers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and spellings of each ticker."""
    return table(spark, folder, "dataset").groupBy(clean_ticker("ticker").alias("ticker")).agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("spellings"))


@query(
    f"""SELECT ticker, count(*) AS observations, min(date) AS first_date, max(date) AS last_date, CAST(0 AS BIGINT) AS missing_values, count(*) - count(DISTINCT date) AS duplicate_dates,
  CAST(count_if(dividends <> 0) AS BIGINT) AS dividend_events, CAST(count_if(stock_splits <> 0) AS BIGINT) AS split_events FROM ({_PRICES}) GROUP BY 1"""
)
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, dates, gaps, repeats and corporate actions per ticker."""
    return explore.quality_report(prices(spark, folder))


@query(
    f"""SELECT ticker, count(*) AS observations, min(date) AS first_date, max(date) AS last_date,
  CAST(sum((date IS NULL)::INT + (target_date IS NULL)::INT + (adj_close IS NULL OR isnan(adj_close))::INT + (log_return IS NULL OR isnan(log_return))::INT + (target_return IS NULL OR isnan(target_return))::INT + (split IS NULL)::INT) AS BIGINT) AS missing_values,
  count(*) - count(DISTINCT date) - max((date IS NULL)::INT) AS duplicate_dates FROM (SELECT date, target_date, {TICKER} AS ticker, adj_close, log_return, target_return, split FROM dataset) GROUP BY 1"""
)
def market_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The same of the delivered dataset, which has no actions."""
    rows = table(spark, folder, "dataset").select(*DATASET_COLUMNS).withColumn("ticker", clean_ticker("ticker"))
    none = F.lit(0.0)
    return explore.quality_report(rows.withColumns({"dividends": none, "stock_splits": none})).drop("dividend_events", "split_events")


@query(f"SELECT coalesce(min(n) = (SELECT count(DISTINCT date) FROM ({PANELS['daily'].sql})), true) AS shared_calendar FROM (SELECT ticker, count(DISTINCT date) AS n FROM ({PANELS['daily'].sql}) GROUP BY 1)")
def shared_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all tickers of the daily panel have the same dates."""
    return explore.shared_calendar(panel(spark, folder, "daily"))


@query(
    """SELECT raw_dir AS source, snapshot_id, CAST(row_number() OVER w AS INTEGER) AS position, coalesce(lead(snapshot_id) OVER w, -1) AS next_snapshot FROM (
  SELECT raw_dir, snapshot_id, max(CAST(replace(created_at_utc, 'Z', '+00:00') AS TIMESTAMPTZ)) AS t FROM manifest GROUP BY 1, 2) WINDOW w AS (PARTITION BY raw_dir ORDER BY t, snapshot_id)"""
)
def delivery_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest notices read and put in order of delivery."""
    return delivery_order(table(spark, folder, "manifest")).fillna(-1, ["next_snapshot"])


@query(
    """SELECT snapshot_id, m.raw_dir, CAST(max(m.row_count) AS BIGINT) AS stated_rows, count(DISTINCT (upper(trim(d.ticker, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), d.date)) AS rows
  FROM (SELECT snapshot_id, raw_dir, max(row_count) AS row_count FROM manifest GROUP BY 1, 2) m LEFT JOIN dataset_snapshots d USING (snapshot_id) GROUP BY 1, 2"""
)
def snapshot_row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Stated against delivered distinct rows of each snapshot."""
    stated = table(spark, folder, "manifest").groupBy("snapshot_id", "raw_dir").agg(F.max("row_count").alias("stated_rows"))
    keys = table(spark, folder, "dataset_snapshots").select("snapshot_id", clean_ticker("ticker").alias("ticker"), "date").distinct()
    there = keys.groupBy("snapshot_id").agg(F.count("*").alias("rows"))
    return stated.join(there, "snapshot_id", "left").fillna(0, ["rows"])


# ---- returns, windows ----------------------------------------------------------


@query(f"{dataset_sql('daily')} SELECT date, ticker, log_return FROM returns", log_return=9)
def log_returns(spark: SparkSession, folder: str) -> DataFrame:
    return returns.log_returns(panel(spark, folder, "daily")).select("date", "ticker", "log_return")


@query(f"{dataset_sql('market')} SELECT * FROM ds", log_return=9, target_return=9)
def model_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Returns, next-row targets and splits by target date."""
    return dataset_of(spark, folder, "market")


@query(f"{dataset_sql('market')} SELECT split, count(*) AS rows FROM ds GROUP BY 1")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dataset_of(spark, folder, "market").groupBy("split").agg(F.count("*").alias("rows"))


@query(f"{dataset_sql('market')} SELECT ticker, min(adj_close / peak - 1) AS maximum_drawdown FROM (SELECT ticker, adj_close, max(adj_close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM panel) GROUP BY 1", maximum_drawdown=9)
def max_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return returns.maximum_drawdown(panel(spark, folder, "market"))


def _vol(column: str, n: int, scale: str) -> str:
    w = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {w} = {n} THEN stddev_samp({column}) OVER {w} * {scale} END"


@query(f"{dataset_sql('daily')} SELECT date, ticker, {_vol('log_return', 21, 'sqrt(252.0::DOUBLE)')} AS volatility_21d, {_vol('log_return', 63, 'sqrt(252.0::DOUBLE)')} AS volatility_63d FROM returns", volatility_21d=7, volatility_63d=7)
def rolling_vol(spark: SparkSession, folder: str) -> DataFrame:
    """Annualised trailing deviation over 21 and 63 rows."""
    return returns.rolling_volatility(returns.log_returns(panel(spark, folder, "daily"))).select("date", "ticker", "volatility_21d", "volatility_63d")


@query(
    f"{dataset_sql('daily')} SELECT date, ticker, measure, value FROM (SELECT date, ticker, {_vol('log_return', 21, 'sqrt(252.0::DOUBLE)')} AS volatility_21d, {_vol('log_return', 63, 'sqrt(252.0::DOUBLE)')} AS volatility_63d FROM returns) UNPIVOT INCLUDE NULLS (value FOR measure IN (volatility_21d, volatility_63d))",
    value=7,
)
def vol_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """Both volatilities in long form."""
    wide = returns.rolling_volatility(returns.log_returns(panel(spark, folder, "daily")))
    return wide.unpivot(["date", "ticker"], ["volatility_21d", "volatility_63d"], "measure", "value")


@query(f"{dataset_sql('weekly')} SELECT date, ticker, adj_close / first_value(adj_close) OVER (PARTITION BY ticker ORDER BY date) * 100 AS indexed_price FROM panel", indexed_price=7)
def indexed_price(spark: SparkSession, folder: str) -> DataFrame:
    return returns.indexed_price(panel(spark, folder, "weekly")).select("date", "ticker", "indexed_price")


@query(f"{dataset_sql('market')} SELECT ticker, date, log_return FROM returns WHERE log_return IS NOT NULL ORDER BY abs(log_return) DESC, ticker, date LIMIT 20", log_return=9)
def top_moves(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty largest moves; the limit is the report."""
    return explore.top_moves(returns.log_returns(panel(spark, folder, "market"))).select("ticker", "date", "log_return")


_SUMMARY = """count(log_return) AS observations, avg(log_return) AS mean_daily, quantile_cont(log_return, 0.5) AS median_daily, stddev_samp(log_return) AS volatility_daily, avg(log_return) * 252 AS mean_annualized,
  stddev_samp(log_return) * sqrt(252.0::DOUBLE) AS volatility_annualized, skewness(log_return) AS skewness, kurtosis(log_return) AS excess_kurtosis, min(log_return) AS minimum, quantile_cont(log_return, 0.01) AS q01,
  quantile_cont(log_return, 0.05) AS q05, quantile_cont(log_return, 0.5) AS median, quantile_cont(log_return, 0.95) AS q95, quantile_cont(log_return, 0.99) AS q99, max(log_return) AS maximum"""
_SUMMARY_DIGITS = dict.fromkeys(
    ("mean_daily", "median_daily", "volatility_daily", "mean_annualized", "volatility_annualized", "minimum", "q01", "q05", "median", "q95", "q99", "maximum"), 8
) | {"skewness": 6, "excess_kurtosis": 6}


@query(
    f"""{dataset_sql('daily')}, dd AS (SELECT ticker, min(adj_close / peak - 1) AS maximum_drawdown FROM (SELECT ticker, adj_close, max(adj_close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM panel) GROUP BY 1),
s AS (SELECT ticker, {_SUMMARY} FROM returns GROUP BY 1) SELECT s.*, dd.maximum_drawdown FROM s JOIN dd USING (ticker)""",
    **_SUMMARY_DIGITS,
    maximum_drawdown=9,
)
def return_summary(spark: SparkSession, folder: str) -> DataFrame:
    return explore.return_summary(returns.log_returns(panel(spark, folder, "daily")))


@query(f"{dataset_sql('daily')} SELECT split, ticker, {_SUMMARY} FROM ds GROUP BY 1, 2", **_SUMMARY_DIGITS)
def summary_by_split(spark: SparkSession, folder: str) -> DataFrame:
    return explore.return_summary(dataset_of(spark, folder, "daily"), ["split", "ticker"])


@query(f"{dataset_sql('market')} SELECT ticker, count(log_return) AS observations, avg(log_return) AS mean, stddev_samp(log_return) AS std, min(log_return) AS minimum, quantile_cont(log_return, 0.5) AS median, max(log_return) AS maximum FROM returns GROUP BY 1", mean=9, std=9, minimum=9, median=9, maximum=9)
def return_statistics(spark: SparkSession, folder: str) -> DataFrame:
    r = "log_return"
    return returns.log_returns(panel(spark, folder, "market")).groupBy("ticker").agg(
        F.count(r).alias("observations"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("minimum"), F.percentile(r, F.lit(0.5)).alias("median"), F.max(r).alias("maximum")
    )


@query(f"{dataset_sql('weekly')} SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, corr(a.log_return, b.log_return) AS correlation, count(*) AS dates FROM returns a JOIN returns b USING (date) WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL GROUP BY 1, 2", correlation=8)
def corr_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return explore.return_correlation(returns.log_returns(panel(spark, folder, "weekly")))


@query(
    f"""{dataset_sql('weekly')}, pairs AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, a.log_return AS x, b.log_return AS y FROM returns a JOIN returns b USING (date) WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL),
ranked AS (SELECT ticker_a, ticker_b, rank() OVER (PARTITION BY ticker_a, ticker_b ORDER BY x) + (count(*) OVER (PARTITION BY ticker_a, ticker_b, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY ticker_a, ticker_b ORDER BY y) + (count(*) OVER (PARTITION BY ticker_a, ticker_b, y) - 1) / 2.0::DOUBLE AS ry FROM pairs)
SELECT ticker_a, ticker_b, corr(rx, ry) AS correlation, count(*) AS dates FROM ranked GROUP BY 1, 2""",
    correlation=8,
)
def corr_spearman(spark: SparkSession, folder: str) -> DataFrame:
    return explore.return_correlation(returns.log_returns(panel(spark, folder, "weekly")), "spearman")


#: The tickers of the weekly panel, as its table's contract has them.
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"{dataset_sql('weekly')} SELECT date, " + ", ".join(f"round(max(CASE WHEN ticker = '{t}' THEN log_return END), 9) AS \"{t}\"" for t in _PRIORITIES) + " FROM returns GROUP BY 1")
def returns_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """All tickers' returns side by side."""
    rows = returns.log_returns(panel(spark, folder, "weekly")).withColumn("log_return", F.round("log_return", 9))
    return rows.groupBy("date").pivot("ticker", list(_PRIORITIES)).agg(F.max("log_return"))


@query(f"{dataset_sql('weekly')} SELECT ticker, date, count(*) OVER (PARTITION BY ticker ORDER BY date RANGE UNBOUNDED PRECEDING) AS history FROM ds")
def history_length(spark: SparkSession, folder: str) -> DataFrame:
    return returns.history_length(dataset_of(spark, folder, "weekly")).select("ticker", "date", "history")


@query(f"{dataset_sql('weekly')} SELECT date, ticker, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) <= floor(count(*) OVER (PARTITION BY ticker) * 0.8::DOUBLE) THEN 'inner_train' ELSE 'inner_validation' END AS inner FROM ds WHERE split = 'train'".replace("AS inner", 'AS "inner"'))
def inner_split(spark: SparkSession, folder: str) -> DataFrame:
    return returns.inner_split(dataset_of(spark, folder, "weekly").where("split = 'train'")).select("date", "ticker", "inner")


# ---- sequences and scaling -----------------------------------------------------


@query(f"{dataset_sql('weekly')} SELECT * FROM (SELECT ticker, date, split, " + ", ".join(f"lag(log_return, {k}) OVER (PARTITION BY ticker ORDER BY date) AS lag_{k}" for k in (4, 3, 2, 1)) + ", log_return AS lag_0 FROM ds) WHERE lag_4 IS NOT NULL AND split IN ('train', 'validation')", lag_4=9, lag_3=9, lag_2=9, lag_1=9, lag_0=9)
def lag_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Five returns up to each row, oldest first."""
    rows = sequences.lag_sequences(dataset_of(spark, folder, "weekly"), 5, ["train", "validation"])
    return sequences.lag_columns(rows, 5).select("ticker", "date", "split", *sequences.lag_names(5))


@query(f"{dataset_sql('market')} SELECT ticker, avg(log_return) AS mean, CASE WHEN stddev_pop(log_return) = 0 THEN 1 ELSE stddev_pop(log_return) END AS scale FROM ds WHERE split IN ('train', 'validation') GROUP BY 1", mean=9, scale=9)
def return_scaler(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.return_scaler(dataset_of(spark, folder, "market"))


@query(
    f"""{dataset_sql('weekly')}, sc AS (SELECT ticker, avg(log_return) AS m, CASE WHEN stddev_pop(log_return) = 0 THEN 1 ELSE stddev_pop(log_return) END AS s FROM ds WHERE split IN ('train', 'validation') GROUP BY 1)
SELECT ticker, date, (l1 - m) / s AS first_feature, (log_return - m) / s AS last_feature, (target_return - m) / s AS target FROM (SELECT *, lag(log_return, 4) OVER (PARTITION BY ticker ORDER BY date) AS l1 FROM ds) JOIN sc USING (ticker) WHERE l1 IS NOT NULL""",
    first_feature=7,
    last_feature=7,
    target=7,
)
def scaled_sequences(spark: SparkSession, folder: str) -> DataFrame:
    data = dataset_of(spark, folder, "weekly")
    out = sequences.scale_sequences(sequences.lag_sequences(data, 5), sequences.return_scaler(data))
    return out.select("ticker", "date", F.col("features")[0].alias("first_feature"), F.col("features")[4].alias("last_feature"), "target")


@query(f"{dataset_sql('weekly')} SELECT ticker, target_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM ds) WHERE n >= 63 AND split = 'test'")
def seed_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows for which a network of 63 lags is due."""
    return sequences.seed_schedule(dataset_of(spark, folder, "weekly"), 63).select("ticker", "target_date")


# ---- metrics -------------------------------------------------------------------


def _metrics_sql(source: str, keys: str = "split", rows: str = "pred") -> str:
    e = "predicted_return - actual_return"
    using = " AND ".join(f"g.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""{source}, g AS (SELECT {keys}, CASE WHEN grouping(ticker) = 1 THEN 'ALL' ELSE ticker END AS ticker, model, count(*) AS observations, avg(abs({e})) AS mae, avg(({e}) * ({e})) AS mse,
  avg(CASE WHEN sign(predicted_return) = sign(actual_return) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS directional_accuracy FROM {rows} GROUP BY GROUPING SETS (({keys}, model, ticker), ({keys}, model)))
SELECT {", ".join(f"g.{k.strip()}" for k in keys.split(","))}, g.ticker, g.model, g.observations, g.mae * 10000 AS mae_bps, sqrt(g.mse) * 10000 AS rmse_bps, CASE WHEN b.mae <> 0 THEN g.mae / b.mae END AS rel_mae,
  1 - CASE WHEN b.mse <> 0 THEN g.mse / b.mse END AS oos_r2, g.directional_accuracy FROM g JOIN g b ON {using} AND g.ticker = b.ticker AND b.model = 'naive_zero'"""


_METRIC_DIGITS = {"mae_bps": 5, "rmse_bps": 5, "rel_mae": 7, "oos_r2": 7, "directional_accuracy": 9}


@query(_metrics_sql(predictions_sql("weekly", ("train", "validation")), rows="(SELECT * FROM pred WHERE model = 'naive_zero')"), **_METRIC_DIGITS)
def naive_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The zero forecast, per ticker and pooled over raw rows."""
    return metrics.return_metrics(forecast.predict_by_column(dataset_of(spark, folder, "weekly"), forecast.Naive()))


@query(_metrics_sql(predictions_sql("market")), **_METRIC_DIGITS)
def return_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Four models on every split, per ticker and pooled."""
    return metrics.return_metrics(synthetic_predictions(dataset_of(spark, folder, "market")))


@query(_metrics_sql(predictions_sql("daily", ("test",))), **_METRIC_DIGITS)
def final_return_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.return_metrics(synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)))


_PRICED = "priced AS (SELECT pred.*, ds.adj_close, ds.adj_close * exp(pred.actual_return) AS actual_price, ds.adj_close * exp(pred.predicted_return) AS predicted_price FROM pred JOIN ds USING (date, target_date, ticker, split))"


@query(f"{predictions_sql('daily', ('test',))}, {_PRICED} SELECT date, ticker, model, actual_price, predicted_price FROM priced", actual_price=7, predicted_price=7)
def price_predictions(spark: SparkSession, folder: str) -> DataFrame:
    data = dataset_of(spark, folder, "daily")
    return metrics.price_predictions(synthetic_predictions(data, ("test",)), data).select("date", "ticker", "model", "actual_price", "predicted_price")


@query(
    f"""{predictions_sql('daily', ('test',))}, {_PRICED}, sc AS (SELECT ticker, avg(abs(adj_close * exp(target_return) - adj_close)) AS scale FROM ds WHERE split IN ('train', 'validation') GROUP BY 1),
m AS (SELECT ticker, model, count(*) AS observations, avg(abs(predicted_price - actual_price)) AS price_mae, sqrt(avg((predicted_price - actual_price) * (predicted_price - actual_price))) AS price_rmse,
  avg(CASE WHEN abs(actual_price) + abs(predicted_price) <> 0 THEN 2 * abs(predicted_price - actual_price) / (abs(actual_price) + abs(predicted_price)) ELSE 0 END) AS smape FROM priced GROUP BY 1, 2),
r AS (SELECT m.*, CASE WHEN scale <> 0 THEN price_mae / scale END AS mase FROM m LEFT JOIN sc USING (ticker))
SELECT * FROM r UNION ALL BY NAME SELECT 'ALL' AS ticker, model, CAST(sum(observations) AS BIGINT) AS observations, CAST(NULL AS DOUBLE) AS price_mae, CAST(NULL AS DOUBLE) AS price_rmse, avg(smape) AS smape, avg(mase) AS mase FROM r GROUP BY model""",
    price_mae=7,
    price_rmse=7,
    smape=8,
    mase=7,
)
def price_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Price errors per ticker; the pooled row averages scale-free ones over tickers."""
    data = dataset_of(spark, folder, "daily")
    return metrics.price_metrics(metrics.price_predictions(synthetic_predictions(data, ("test",)), data), metrics.scaling_errors(data))


@query(
    f"""{predictions_sql('daily', ('test',))}, e AS (SELECT ticker, target_date, max(CASE WHEN model = 'momentum' THEN abs(predicted_return - actual_return) END) AS a, max(CASE WHEN model = 'naive_zero' THEN abs(predicted_return - actual_return) END) AS b FROM pred GROUP BY 1, 2)
SELECT ticker, target_date, sum((a - b) * 10000) OVER (PARTITION BY ticker ORDER BY target_date ROWS UNBOUNDED PRECEDING) AS cumulative_bps FROM e""",
    cumulative_bps=3,
)
def loss_diff_cumsum(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.cumulative_loss_difference(synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)), "momentum", "naive_zero")


_SEEDED = """seeded AS (SELECT pred.* REPLACE (predicted_return * (1 + s.seed * 0.1::DOUBLE) AS predicted_return), CAST(s.seed AS INTEGER) AS seed, model AS family FROM pred, (VALUES (0), (1), (2)) s(seed) WHERE model IN ('reversal', 'blend'))"""


def _seeded(spark: SparkSession, folder: str) -> DataFrame:
    rows = synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)).where(F.col("model").isin("reversal", "blend"))
    seeds = rows.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return seeds.withColumns({"predicted_return": F.col("predicted_return") * (1 + F.col("seed") * F.lit(0.1)), "family": F.col("model")})


@query(f"{predictions_sql('daily', ('test',))}, {_SEEDED} SELECT family, ticker, seed, count(*) AS observations, avg(abs(predicted_return - actual_return)) * 10000 AS mae_bps, sqrt(avg((predicted_return - actual_return) * (predicted_return - actual_return))) * 10000 AS rmse_bps FROM seeded GROUP BY 1, 2, 3", mae_bps=5, rmse_bps=5)
def seed_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.seed_metrics(_seeded(spark, folder))


@query(
    f"""{predictions_sql('daily', ('test',))}, {_SEEDED}, m AS (SELECT family, ticker, seed, avg(abs(predicted_return - actual_return)) * 10000 AS mae_bps FROM seeded GROUP BY 1, 2, 3)
SELECT family, ticker, avg(mae_bps) AS mean_mae_bps, stddev_samp(mae_bps) AS std_mae_bps, min(mae_bps) AS min_mae_bps, max(mae_bps) AS max_mae_bps FROM m GROUP BY 1, 2""",
    mean_mae_bps=5,
    std_mae_bps=5,
    min_mae_bps=5,
    max_mae_bps=5,
)
def seed_spread(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.seed_spread(metrics.seed_metrics(_seeded(spark, folder)))


@query(f"{predictions_sql('daily', ('test',))}, {_SEEDED} SELECT date, target_date, ticker, split, max(actual_return) AS actual_return, avg(predicted_return) AS predicted_return, count(DISTINCT seed) AS seeds, 'reversal' AS model FROM seeded WHERE family = 'reversal' GROUP BY 1, 2, 3, 4", actual_return=9, predicted_return=9)
def seed_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Mean forecast of all seeds per observation."""
    return selection.ensemble(_seeded(spark, folder).where("family = 'reversal'"), "reversal")


# ---- regimes -------------------------------------------------------------------

_REGIMES = f"""{predictions_sql('market')}, v AS (SELECT *, {_vol('log_return', 21, 'sqrt(252.0::DOUBLE)')} AS volatility FROM ds),
t AS (SELECT ticker, quantile_cont(volatility, 1.0::DOUBLE / 3) AS lower_threshold, quantile_cont(volatility, 2.0::DOUBLE / 3) AS upper_threshold FROM v WHERE split IN ('train', 'validation') AND volatility IS NOT NULL GROUP BY 1),
asg AS (SELECT date, target_date, ticker, split, volatility, CASE WHEN volatility <= lower_threshold THEN 'low' WHEN volatility <= upper_threshold THEN 'medium' ELSE 'high' END AS regime FROM v JOIN t USING (ticker) WHERE split = 'test' AND volatility IS NOT NULL)"""


@query(f"{_REGIMES} SELECT * FROM t", lower_threshold=8, upper_threshold=8)
def regime_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return regimes.thresholds(regimes.volatility(dataset_of(spark, folder, "market")))


@query(f"{_REGIMES} SELECT * FROM asg", volatility=8)
def regime_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return regimes.assignments(dataset_of(spark, folder, "market"))


@query(_metrics_sql(f"{_REGIMES}, pr AS (SELECT pred.*, asg.regime FROM pred JOIN asg USING (date, target_date, ticker, split))", "split, regime", "pr"), **_METRIC_DIGITS)
def regime_metrics(spark: SparkSession, folder: str) -> DataFrame:
    data = dataset_of(spark, folder, "market")
    return regimes.regime_metrics(synthetic_predictions(data, ("test",)), regimes.assignments(data))


# ---- inference -----------------------------------------------------------------

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in STAND_INS)
_LOSSES = f"""{predictions_sql('daily', ('test',), shared=True)}, e AS (SELECT ticker, target_date, model, predicted_return - actual_return AS e FROM pred),
single AS (SELECT a.ticker, l.loss, c.candidate, c.comparator, a.target_date, CASE WHEN l.loss = 'absolute' THEN abs(a.e) - abs(b.e) ELSE a.e * a.e - b.e * b.e END AS d
  FROM (VALUES {_PAIRS}) c(candidate, comparator), (VALUES ('absolute'), ('squared')) l(loss), e a, e b WHERE a.model = c.candidate AND b.model = c.comparator AND a.ticker = b.ticker AND a.target_date = b.target_date),
diffs AS (SELECT * FROM single UNION ALL SELECT 'ALL' AS ticker, loss, candidate, comparator, target_date, avg(d) AS d FROM single GROUP BY loss, candidate, comparator, target_date),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY ticker, loss, candidate, comparator) AS c FROM diffs),
lagged AS (SELECT *, {", ".join(f"lag(c, {k}) OVER (PARTITION BY ticker, loss, candidate, comparator ORDER BY target_date) AS c{k}" for k in range(1, 21))} FROM c),
s AS (SELECT ticker, loss, candidate, comparator, count(*) AS observations, avg(d) AS mean_loss_difference, sum(c * c) / count(*) + 2 * ({" + ".join(f"CASE WHEN {k} <= least(20, count(*) - 1) THEN (1 - {k}::DOUBLE / (least(20, count(*) - 1) + 1)) * coalesce(sum(c * c{k}), 0) / count(*) ELSE 0 END" for k in range(1, 21))}) AS variance FROM lagged GROUP BY 1, 2, 3, 4),
dm AS (SELECT ticker, loss, candidate, comparator, observations, mean_loss_difference, CASE WHEN variance > 0 THEN mean_loss_difference / sqrt(variance / observations) WHEN mean_loss_difference = 0 THEN 0 ELSE sign(mean_loss_difference) * CAST('inf' AS DOUBLE) END AS dm_statistic FROM s)"""


def _shared(spark: SparkSession, folder: str) -> DataFrame:
    return inference.on_shared_calendar(synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)))


@query(f"{_LOSSES} SELECT * FROM dm", mean_loss_difference=10, dm_statistic=5)
def dm_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Diebold-Mariano statistics of five comparisons, two losses, every ticker and pooled."""
    return inference.dm_statistics(inference.loss_differences(inference.error_table(_shared(spark, folder)), STAND_INS)).drop("variance")


@query()
def dm_results(spark: SparkSession, folder: str) -> DataFrame:
    """The same with p-values and Holm adjustment."""
    return inference.dm_results(_shared(spark, folder), comparisons=STAND_INS)


@query(
    f"""{_LOSSES}, p AS (SELECT ticker, loss, candidate, comparator, 1 / (1 + abs(round(dm_statistic, 5))) AS raw_p_value FROM dm), o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY ticker, loss) AS m FROM p WINDOW w AS (PARTITION BY ticker, loss ORDER BY raw_p_value, candidate, comparator))
SELECT ticker, loss, candidate, comparator, raw_p_value, max(least(raw_p_value * (m - rn + 1), 1)) OVER (PARTITION BY ticker, loss ORDER BY rn ROWS UNBOUNDED PRECEDING) AS holm_p_value FROM o""",
    raw_p_value=8,
    holm_p_value=8,
)
def holm_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """Holm steps over stand-in p-values that SQL can compute."""
    tests = inference.dm_statistics(inference.loss_differences(inference.error_table(_shared(spark, folder)), STAND_INS))
    with_p = tests.select("ticker", "loss", "candidate", "comparator", (1 / (1 + F.abs(F.round("dm_statistic", 5)))).alias("raw_p_value"))
    return inference.holm(with_p, ["ticker", "loss"]).drop("reject_null")


@query(
    f"""{predictions_sql('daily', ('test',), shared=True)}, e AS (SELECT ticker, target_date, model, predicted_return - actual_return AS e FROM pred), x AS (SELECT a.ticker, c.candidate, c.comparator, a.e AS a, b.e AS b FROM (VALUES {_PAIRS}) c(candidate, comparator), e a, e b
  WHERE a.model = c.candidate AND b.model = c.comparator AND a.ticker = b.ticker AND a.target_date = b.target_date),
g AS (SELECT CASE WHEN grouping(ticker) = 1 THEN 'ALL' ELSE ticker END AS ticker, candidate, comparator, count(*) AS observations, (avg(abs(a)) - avg(abs(b))) * 10000 AS mae, (sqrt(avg(a * a)) - sqrt(avg(b * b))) * 10000 AS rmse FROM x GROUP BY GROUPING SETS ((candidate, comparator, ticker), (candidate, comparator)))
SELECT ticker, candidate, comparator, observations, metric, estimate FROM g UNPIVOT (estimate FOR metric IN (mae, rmse))""",
    estimate=5,
)
def bootstrap_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return inference.metric_differences(inference.error_table(_shared(spark, folder)), STAND_INS)


@query()
def bootstrap_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile intervals from the protocol's 10,000 moving-block resamples."""
    return inference.bootstrap_intervals(_shared(spark, folder), InferenceConfig(), STAND_INS)


# ---- autocorrelation, stationarity ---------------------------------------------


def _series(spark: SparkSession, folder: str) -> DataFrame:
    rows = returns.log_returns(panel(spark, folder, "daily"))
    wide = rows.select("ticker", "date", F.ln("adj_close").alias("log_price"), "log_return", (F.col("log_return") * F.col("log_return")).alias("squared_return"))
    return wide.unpivot(["ticker", "date"], ["log_price", "log_return", "squared_return"], "series", "value").where("value is not null")


_LAGS = 20
_ACF = f"""{dataset_sql('daily')}, w AS (SELECT ticker, date, ln(adj_close) AS log_price, log_return, log_return * log_return AS squared_return FROM returns),
l AS (SELECT ticker, date, series, value FROM w UNPIVOT (value FOR series IN (log_price, log_return, squared_return))),
c AS (SELECT *, value - avg(value) OVER (PARTITION BY ticker, series) AS c FROM l),
g AS (SELECT *, {", ".join(f"lag(c, {k}) OVER (PARTITION BY ticker, series ORDER BY date) AS c{k}" for k in range(1, _LAGS + 1))} FROM c),
s AS (SELECT ticker, series, count(*) AS observations, sum(c * c) AS s0, {", ".join(f"sum(c * c{k}) AS s{k}" for k in range(1, _LAGS + 1))} FROM g GROUP BY 1, 2),
acf AS ({" UNION ALL ".join(f"SELECT ticker, series, {k} AS lag, s{k} / s0 AS acf, observations FROM s WHERE s0 > 0 AND observations // 2 > {_LAGS}" for k in range(_LAGS + 1))})"""


@query(f"{_ACF} SELECT ticker, series, CAST(lag AS INTEGER) AS lag, acf, observations FROM acf", acf=8)
def acf(spark: SparkSession, folder: str) -> DataFrame:
    return autocorrelation.autocorrelations(_series(spark, folder), _LAGS)


@query()
def correlogram(spark: SparkSession, folder: str) -> DataFrame:
    """ACF and PACF with bands."""
    return autocorrelation.correlogram(autocorrelation.autocorrelations(_series(spark, folder), _LAGS))


@query(
    f"""{_ACF}, q AS (SELECT ticker, series, h.lag, max(observations)::DOUBLE * (max(observations) + 2) * sum(acf * acf / (observations - acf.lag)) AS statistic FROM acf, (VALUES (5), (10), (20)) h(lag) WHERE acf.lag BETWEEN 1 AND h.lag GROUP BY 1, 2, 3)
SELECT ticker, series, CAST(lag AS INTEGER) AS lag, statistic FROM q""",
    statistic=4,
)
def ljung_box_q(spark: SparkSession, folder: str) -> DataFrame:
    return autocorrelation.ljung_box(autocorrelation.autocorrelations(_series(spark, folder), _LAGS), (5, 10, 20)).select("ticker", "series", "lag", "statistic")


@query()
def ljung_box(spark: SparkSession, folder: str) -> DataFrame:
    """The same with chi-square tails."""
    return autocorrelation.ljung_box(autocorrelation.autocorrelations(_series(spark, folder), _LAGS), (5, 10, 20))


@query(f"{_ACF} SELECT ticker, series, max(CASE WHEN lag = 1 THEN acf END) AS lag1, max(CASE WHEN lag > 0 THEN abs(acf) END) AS largest, max(CASE WHEN lag = 1 THEN acf END) AS pacf1 FROM acf GROUP BY 1, 2", lag1=8, largest=8, pacf1=8)
def acf_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Lag-1 autocorrelation and partial autocorrelation (equal at lag 1, by another way) and the largest of all lags."""
    rows = autocorrelation.correlogram(autocorrelation.autocorrelations(_series(spark, folder), _LAGS))
    first = lambda c: F.max(F.when(F.col("lag") == 1, F.col(c)))
    return rows.groupBy("ticker", "series").agg(first("acf").alias("lag1"), F.max(F.when(F.col("lag") > 0, F.abs("acf"))).alias("largest"), first("pacf").alias("pacf1"))


@query()
def stationarity_report(spark: SparkSession, folder: str) -> DataFrame:
    """ADF and KPSS of every series."""
    return both_tests(_series(spark, folder).where("series <> 'squared_return'"))


@query(
    f"""{predictions_sql('daily')}, e AS (SELECT model, ticker, target_date, actual_return - predicted_return AS e, lag(actual_return - predicted_return) OVER (PARTITION BY model, ticker ORDER BY target_date) AS b FROM pred)
SELECT model, ticker, count(*) AS observations, avg(e) AS mean, stddev_samp(e) AS std, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.05) AS q05, quantile_cont(e, 0.95) AS q95, corr(e, b) AS lag1_autocorrelation FROM e GROUP BY 1, 2""",
    mean=8,
    std=8,
    median=8,
    q05=8,
    q95=8,
    lag1_autocorrelation=7,
)
def residual_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return explore.autocorrelation_of_errors(synthetic_predictions(dataset_of(spark, folder, "daily")))


# ---- forecasts -----------------------------------------------------------------

_WARM_UP = 252


@query(f"{dataset_sql('daily')} SELECT date, target_date, ticker, history FROM (SELECT *, count(CASE WHEN split IN ('train', 'validation') THEN 1 END) OVER (PARTITION BY ticker ORDER BY date RANGE UNBOUNDED PRECEDING) AS history FROM ds) WHERE split = 'validation' AND history >= {_WARM_UP}")
def walk_forward_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return returns.eligible_origins(dataset_of(spark, folder, "daily"), _WARM_UP, ["validation"], ["train", "validation"]).select("date", "target_date", "ticker", "history")


_MEAN = f"""{dataset_sql('daily')}, h AS (SELECT *, count(CASE WHEN split IN ('train', 'validation') THEN 1 END) OVER w AS history, avg(log_return) OVER w AS predicted_return FROM ds WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE UNBOUNDED PRECEDING))"""


@query(f"{_MEAN} SELECT date, target_date, ticker, split, 'arima_mean' AS model, target_return AS actual_return, predicted_return FROM h WHERE split = 'validation' AND history >= {_WARM_UP}", actual_return=9, predicted_return=9)
def arima_mean_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Daily refits of ARIMA(0, 0, 0) through the walk-forward operator."""
    data = dataset_of(spark, folder, "daily")
    orders = {t: (0, 0, 0) for t in ("A", "N", "R")}
    return forecast.walk_forward(data, forecast.arima_fitter(orders), "arima_mean", warm_up=_WARM_UP)


@query(f"{_MEAN} SELECT date, target_date, ticker, split, 'arima_mean' AS model, target_return AS actual_return, predicted_return FROM h WHERE split IN ('train', 'validation')", actual_return=9, predicted_return=9)
def expanding_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The same forecast as a column expression, for every row."""
    return forecast.predict(dataset_of(spark, folder, "daily"), forecast.ExpandingMean())


@query()
def arima_walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Refits of ARIMA(1, 0, 0) at every validation origin of the daily panel, after the protocol's warm-up."""
    orders = {t: (1, 0, 0) for t in ("A", "N", "R")}
    return forecast.walk_forward(dataset_of(spark, folder, "daily"), forecast.arima_fitter(orders), "arima", warm_up=_WARM_UP)


@query()
def arima_walk_forward_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Refits of small orders at every validation origin of the daily panel: over a thousand fits of up to 2,500 rows."""
    orders = {"A": (1, 0, 0), "N": (0, 0, 1), "R": (0, 0, 2)}
    return forecast.walk_forward(dataset_of(spark, folder, "daily"), forecast.arima_fitter(orders), "arima", warm_up=_WARM_UP)


@query()
def arima_search(spark: SparkSession, folder: str) -> DataFrame:
    """AIC and BIC of all 36 orders up to (5, 0, 5) on every ticker's training returns of the market panel."""
    return forecast.search_orders(dataset_of(spark, folder, "market"))


@query(
    f"""{predictions_sql('daily')}, r AS (SELECT ticker, date, target_date, split, adj_close, actual_return - predicted_return AS res FROM pred JOIN ds USING (date, target_date, ticker, split) WHERE model = 'momentum'),
n AS (SELECT ticker, lead(date) OVER w AS date, lead(target_date) OVER w AS target_date, lead(adj_close) OVER w AS adj_close, res AS log_return, lead(res) OVER w AS target_return, lead(split) OVER w AS split, target_date = lead(date) OVER w AS contiguous FROM r WINDOW w AS (PARTITION BY ticker ORDER BY target_date))
SELECT * FROM n WHERE date IS NOT NULL""",
    adj_close=8,
    log_return=9,
    target_return=9,
)
def residual_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive forecast errors as a dataset of their own."""
    data = dataset_of(spark, folder, "daily")
    return returns.residual_chain(synthetic_predictions(data).where("model = 'momentum'"), data)


@query(
    f"""{predictions_sql('daily', ('test',))} SELECT date, target_date, ticker, split, 'blend' AS model, actual_return, predicted_return + predicted_return * 0.1::DOUBLE AS predicted_return FROM pred WHERE model = 'momentum'""",
    actual_return=9,
    predicted_return=9,
)
def hybrid_sum(spark: SparkSession, folder: str) -> DataFrame:
    """A component plus the forecast of its residual, joined on all keys."""
    component = synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)).where("model = 'momentum'")
    return forecast.hybrid(component, forecast.residual_predictions(component, F.col("predicted_return") * F.lit(0.1)), "blend")


@query(f"{predictions_sql('weekly')} SELECT * FROM pred", actual_return=9, predicted_return=9)
def aligned_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of four models in one."""
    every = synthetic_predictions(dataset_of(spark, folder, "weekly"))
    return forecast.align([every.where(F.col("model") == m) for m in ("naive_zero", "momentum", "reversal", "blend")])


@query(f"{predictions_sql('weekly')} SELECT model, ticker, count(*) AS rows, min(target_date) AS first_target, max(target_date) AS last_target FROM pred GROUP BY 1, 2")
def schedule_ranges(spark: SparkSession, folder: str) -> DataFrame:
    rows = synthetic_predictions(dataset_of(spark, folder, "weekly"))
    return rows.groupBy("model", "ticker").agg(F.count("*").alias("rows"), F.min("target_date").alias("first_target"), F.max("target_date").alias("last_target"))


@query(f"{dataset_sql('market')} SELECT ticker, min(CASE WHEN split = 'test' THEN target_date END) AS test_start, max(CASE WHEN split = 'test' THEN target_date END) AS test_end, count(DISTINCT split) AS splits FROM ds GROUP BY 1")
def split_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return contracts.coverage(dataset_of(spark, folder, "market")).withColumn("splits", F.size("splits").cast("bigint"))


# ---- runs and selection --------------------------------------------------------

_RUNS = f"""SELECT DISTINCT run_id, sweep_id, {TICKER} AS ticker, "config"."window" AS "window", config.units AS units, config.dropout AS dropout, seed, status, parameter_count,
  CASE WHEN isfinite(mae_bps) THEN mae_bps END AS mae_bps, CASE WHEN isfinite(rmse_bps) THEN rmse_bps END AS rmse_bps FROM run_metrics"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs as a flat table, repeats and non-finite figures removed."""
    raw = table(spark, folder, "run_metrics")
    flat = raw.select(
        "run_id", "sweep_id", clean_ticker("ticker").alias("ticker"), "config.window", "config.units", "config.dropout", "seed", "status", "parameter_count",
        finite_or_null("mae_bps").alias("mae_bps"), finite_or_null("rmse_bps").alias("rmse_bps"),
    )
    return flat.distinct()


_TEN_SEEDS = "count(DISTINCT seed) = 10 AND bool_and(coalesce(status = 'ok' AND seed BETWEEN 0 AND 9, false))"
_CONFIGS = f"""WITH runs AS ({_RUNS}), c AS (SELECT ticker, "window", units, dropout, CAST(count_if(status = 'ok') AS BIGINT) AS successful_seeds, round(sum(CASE WHEN status = 'ok' THEN mae_bps END), 8) / nullif(count(CASE WHEN status = 'ok' THEN mae_bps END), 0) AS mean_mae_bps, round(sum(CASE WHEN status = 'ok' THEN rmse_bps END), 8) / nullif(count(CASE WHEN status = 'ok' THEN rmse_bps END), 0) AS mean_rmse_bps,
  stddev_samp(CASE WHEN status = 'ok' THEN mae_bps END) AS std_mae_bps, max(CASE WHEN status = 'ok' THEN parameter_count END) AS parameter_count FROM runs GROUP BY 1, 2, 3, 4)"""


@query(f"{_CONFIGS} SELECT * FROM c", std_mae_bps=6)
def configuration_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and spread of each ticker's configurations over sound runs."""
    return selection.configuration_metrics(runs(spark, folder)).drop("one_parameter_count")


@query(
    f"""{_CONFIGS} SELECT ticker, "window", units, dropout, successful_seeds, mean_mae_bps, parameter_count, 'lstm' AS model FROM c SEMI JOIN (SELECT ticker, "window", units, dropout FROM runs GROUP BY 1, 2, 3, 4 HAVING {_TEN_SEEDS}) e USING (ticker, "window", units, dropout) WHERE mean_mae_bps IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY mean_mae_bps, mean_rmse_bps NULLS FIRST, std_mae_bps NULLS FIRST, parameter_count, "window", units, dropout) = 1""",
)
def lstm_select(spark: SparkSession, folder: str) -> DataFrame:
    """The best configuration of each ticker among those with the protocol's ten seeds, ties settled by error, size and settings."""
    every = runs(spark, folder)
    best = selection.select_networks(selection.configuration_metrics(every), selection.eligible_configurations(every, list(range(10))))
    return best.select("ticker", "window", "units", "dropout", "successful_seeds", "mean_mae_bps", "parameter_count", "model")


@query(
    f"""WITH runs AS ({_RUNS}) SELECT ticker, "window", units, dropout FROM runs GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT seed) = 10 AND bool_and(coalesce(status = 'ok' AND seed BETWEEN 0 AND 9, false))"""
)
def eligible_configurations(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations run with exactly the protocol's ten seeds, all sound."""
    return selection.eligible_configurations(runs(spark, folder), list(range(10)))


@query(f"WITH runs AS ({_RUNS}) SELECT ticker, status, count(*) AS rows FROM runs GROUP BY 1, 2")
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return selection.status_counts(runs(spark, folder), "ticker")


_SHORT = f"""WITH runs AS ({_RUNS}), s AS (SELECT DISTINCT ticker, "window" AS p, 0 AS d, units AS q, mae_bps AS bic FROM runs WHERE status = 'ok' AND mae_bps IS NOT NULL AND rmse_bps IS NOT NULL),
short AS (SELECT ticker, p, d, q, bic, CAST(row_number() OVER (PARTITION BY ticker ORDER BY bic, p, q) AS INTEGER) AS bic_rank FROM s QUALIFY bic_rank <= 3)"""


def _search_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The run table read as an order search: stand-in values with many ties."""
    return runs(spark, folder).select(
        "ticker", F.col("window").alias("p"), F.lit(0).alias("d"), F.col("units").alias("q"), F.col("mae_bps").alias("bic"), F.col("rmse_bps").alias("aic"), (F.col("status") == "ok").alias("converged"), "status"
    )


@query(f"{_SHORT} SELECT *, 'arima_bic_' || bic_rank AS model FROM short")
def shortlist_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Three best distinct candidates per ticker."""
    search = _search_of_runs(spark, folder).where(is_finite("aic")).withColumn("aic", F.lit(0.0)).distinct()
    return selection.shortlist_orders(search)


@query(
    f"""{_SHORT}, m AS (SELECT ticker, 'arima_bic_' || bic_rank AS model, p, d, q, bic, bic_rank, round(bic / 10) AS mae_bps, round(bic / 5) AS rmse_bps FROM short)
SELECT ticker, model, mae_bps, rmse_bps, p, d, q, bic, bic_rank FROM m QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY mae_bps, rmse_bps, p + d + q, bic, p, q) = 1"""
)
def arima_select(spark: SparkSession, folder: str) -> DataFrame:
    """The winner among shortlisted candidates with tied errors."""
    search = _search_of_runs(spark, folder).where(is_finite("aic")).withColumn("aic", F.lit(0.0)).distinct()
    short = selection.shortlist_orders(search)
    errors = short.select("ticker", "model", F.round(F.col("bic") / 10).alias("mae_bps"), F.round(F.col("bic") / 5).alias("rmse_bps"))
    return selection.select_arima(errors, short)


@query(
    f"""WITH t AS (SELECT DISTINCT {TICKER} AS ticker FROM dataset WHERE ticker IS NOT NULL AND date IS NOT NULL) SELECT ticker, CAST(w AS INTEGER) AS "window", CAST(u AS INTEGER) AS units, CAST(dr AS DOUBLE) AS dropout, CAST(s AS INTEGER) AS seed
FROM t, unnest([5, 21, 63]) a(w), unnest([16, 32]) b(u), unnest([0.0, 0.2]) c(dr), unnest(generate_series(0, 9)) e(s)"""
)
def lstm_grid_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of the grid: ticker, configuration and seed."""
    tickers = table(spark, folder, "dataset").where("ticker is not null and date is not null").select(clean_ticker("ticker").alias("ticker"))
    return forecast.grid_schedule(tickers, network_grid(), list(range(10)))


@query()
def lstm_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The published grid, ten seeds and production training on the weekly panel: one row per run."""
    return forecast.run_grid(dataset_of(spark, folder, "weekly"), network_grid(), list(range(10)), training=TrainingConfig()).drop("predictions")
