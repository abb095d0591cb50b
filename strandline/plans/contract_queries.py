"""Queries that count planted violations of each contract, joins of selections, and fitted means through evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import clean_ticker, is_finite
from strandline.operators import contracts, forecast, inference, metrics, regimes, returns, selection
from strandline.plans.panel_queries import _CONFIGS, _METRIC_DIGITS, _RUNS, _SEEDED, _SHORT, _TEN_SEEDS, _WARM_UP, _REGIMES, _metrics_sql, _search_of_runs, _seeded, query, runs
from strandline.plans.panels import TICKER, dataset_of, dataset_sql, predictions_sql, synthetic_predictions
from strandline.schema import PREDICTION_COLUMNS, PREDICTION_KEYS
from strandline.session import table

_DAY = "day(date)"
_KEYS = ", ".join(PREDICTION_KEYS)
_SAME = " AND ".join(f"a.{k} = b.{k}" for k in PREDICTION_KEYS)


def _day() -> F.Column:
    return F.dayofmonth("date")


# ---- prediction tables ---------------------------------------------------------

_PLANTED = f"""{predictions_sql('daily')}, once AS (SELECT date, CASE WHEN {_DAY} = 5 THEN date ELSE target_date END AS target_date, CASE WHEN {_DAY} = 11 THEN NULL ELSE ticker END AS ticker,
  CASE WHEN {_DAY} = 7 THEN 'other' ELSE split END AS split, model, CASE WHEN model = 'momentum' AND {_DAY} = 15 THEN actual_return + 1e-6 ELSE actual_return END AS actual_return,
  CASE WHEN {_DAY} = 3 THEN NULL ELSE predicted_return END AS predicted_return FROM pred WHERE NOT (model = 'blend' AND {_DAY} = 13)),
planted AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE {_DAY} = 9)"""


def planted(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in predictions with one kind of damage on each of some days of the month."""
    rows = synthetic_predictions(dataset_of(spark, folder, "daily")).where(~((F.col("model") == "blend") & (_day() == 13)))
    nothing = F.lit(None)
    once = rows.withColumns(
        {
            "target_date": F.when(_day() == 5, F.col("date")).otherwise(F.col("target_date")),
            "ticker": F.when(_day() == 11, nothing).otherwise(F.col("ticker")),
            "split": F.when(_day() == 7, F.lit("other")).otherwise(F.col("split")),
            "actual_return": F.when((F.col("model") == "momentum") & (_day() == 15), F.col("actual_return") + 1e-6).otherwise(F.col("actual_return")),
            "predicted_return": F.when(_day() == 3, nothing).otherwise(F.col("predicted_return")),
        }
    )
    return once.unionByName(once.where(_day() == 9))


def _counts(checks: str, keys: str, source: str) -> str:
    return f"SELECT CAST(COLUMNS(*) AS BIGINT) FROM (SELECT {checks}, count(*) - count(DISTINCT ({keys})) AS repeated_rows FROM {source})"


_PREDICTION_CHECKS = """count_if(ticker IS NULL OR date IS NULL OR target_date IS NULL OR model IS NULL) AS null_key, count_if(NOT coalesce(split IN ({splits}), false)) AS unknown_split,
  count_if(NOT coalesce(isfinite(actual_return) AND isfinite(predicted_return), false)) AS not_finite, count_if(NOT coalesce(date < target_date, false)) AS target_not_after_date"""


@query(f"{_PLANTED} {_counts(_PREDICTION_CHECKS.format(splits="'train', 'validation', 'test'"), f'{_KEYS}, model', 'planted')}")
def prediction_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The contract of a prediction table, over planted violations of every check."""
    return contracts.keyed_violations(planted(spark, folder), [*PREDICTION_KEYS, "model"], contracts.prediction_checks(("train", "validation", "test")))


@query(
    f"""{_PLANTED} {_counts(_PREDICTION_CHECKS.format(splits="'test'") + ", count_if(NOT coalesce(model = 'momentum', false)) AS other_model, count_if(NOT coalesce(ticker IN ('A', 'N'), false)) AS unknown_ticker",
    _KEYS, "(SELECT * FROM planted WHERE split <> 'train' AND model IN ('momentum', 'blend'))")}"""
)
def component_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The contract of one model's test forecasts, over rows of two models and a ticker that is not listed."""
    rows = planted(spark, folder).where("split <> 'train' and model in ('momentum', 'blend')")
    return contracts.keyed_violations(rows, PREDICTION_KEYS, contracts.component_checks("momentum", ("A", "N")))


@query(
    f"""{predictions_sql('daily', ('test',))}, rows AS (SELECT * FROM pred WHERE model = 'momentum' AND NOT (ticker = 'R' AND month(target_date) = 1)), w AS (SELECT min(target_date) AS a, max(target_date) AS b FROM pred)
SELECT ticker, min(target_date) AS first, max(target_date) AS last FROM rows GROUP BY 1 HAVING min(target_date) <> (SELECT a FROM w) OR max(target_date) <> (SELECT b FROM w)"""
)
def component_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Tickers whose test forecasts do not span the test dates, one of them cut."""
    rows = synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)).where("model = 'momentum'")
    span = rows.agg(F.min("target_date"), F.max("target_date")).first()
    return contracts.spans_off(rows.where(~((F.col("ticker") == "R") & (F.month("target_date") == 1))), tuple(span))


_MOVED = f"""{predictions_sql('weekly')}, m AS (SELECT date, CASE WHEN model = 'reversal' AND {_DAY} = 17 THEN target_date + 1000 ELSE target_date END AS target_date, ticker, split, model,
  CASE WHEN model = 'momentum' AND {_DAY} = 15 THEN actual_return + 1e-6 ELSE actual_return END AS actual_return FROM pred WHERE NOT (model = 'blend' AND {_DAY} = 13))"""


@query(
    f"""{_MOVED}, base AS (SELECT {_KEYS}, actual_return AS base FROM m WHERE model = 'naive_zero'), e AS (SELECT base.*, n.model FROM base, (SELECT DISTINCT model FROM m) n),
j AS (SELECT coalesce(a.model, b.model) AS model, a.base, b.actual_return, a.model AS due, b.model AS found FROM e a FULL JOIN m b ON {_SAME} AND a.model = b.model)
SELECT model, CAST(count_if(found IS NULL) AS BIGINT) AS missing, CAST(count_if(due IS NULL) AS BIGINT) AS unexpected, CAST(count_if(base <> actual_return) AS BIGINT) AS different FROM j GROUP BY 1"""
)
def misaligned_models(spark: SparkSession, folder: str) -> DataFrame:
    """Per model: missing and unexpected keys and different actuals, each planted in one model."""
    rows = synthetic_predictions(dataset_of(spark, folder, "weekly")).where(~((F.col("model") == "blend") & (_day() == 13)))
    moved = rows.withColumns(
        {
            "target_date": F.when((F.col("model") == "reversal") & (_day() == 17), F.date_add("target_date", 1000)).otherwise(F.col("target_date")),
            "actual_return": F.when((F.col("model") == "momentum") & (_day() == 15), F.col("actual_return") + 1e-6).otherwise(F.col("actual_return")),
        }
    )
    return contracts.misaligned(moved, "naive_zero")


@query(
    f"""{dataset_sql('market')}, a AS (SELECT ticker, target_date FROM ds WHERE {_DAY} <> 13), b AS (SELECT ticker, target_date FROM ds WHERE {_DAY} <> 17)
SELECT ticker, target_date, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT ticker, target_date, 'right' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def key_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of one of two datasets only, each lacking another day of the month."""
    data = dataset_of(spark, folder, "market")
    return contracts.key_difference(data.where(_day() != 13), data.where(_day() != 17), ["ticker", "target_date"])


def _schedule_sql(predictions: str, due: str) -> str:
    return f"""p AS (SELECT {_KEYS}, count(*) AS n, min(actual_return) AS low, max(actual_return) AS high FROM {predictions} GROUP BY ALL), j AS (SELECT a.n, a.low, a.high, b.target_return, b.date AS due FROM p a FULL JOIN {due} b ON {_SAME})
SELECT CAST(COLUMNS(*) AS BIGINT) FROM (SELECT count_if(n IS NULL) AS missing, count_if(due IS NULL) AS unexpected, count_if(n > 1) AS repeated,
  count_if(n IS NOT NULL AND due IS NOT NULL AND NOT (abs(low - target_return) <= 1e-12 AND abs(high - target_return) <= 1e-12)) AS different FROM j)"""


_DAMAGED = f"""damaged AS (SELECT date, CASE WHEN {_DAY} = 17 THEN target_date + 1000 ELSE target_date END AS target_date, ticker, split, CASE WHEN {_DAY} = 15 THEN actual_return + 1e-6 ELSE actual_return END AS actual_return, predicted_return
  FROM pred, unnest(CASE WHEN {_DAY} = 9 THEN [1, 2] ELSE [1] END) u(k) WHERE model = 'momentum' AND {_DAY} <> 13)"""


def _damaged(spark: SparkSession, folder: str, *splits: str) -> tuple[DataFrame, DataFrame]:
    data = dataset_of(spark, folder, "daily")
    rows = synthetic_predictions(data, splits).where((F.col("model") == "momentum") & (_day() != 13))
    copies = F.explode(F.when(_day() == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    moved = rows.withColumns(
        {
            "target_date": F.when(_day() == 17, F.date_add("target_date", 1000)).otherwise(F.col("target_date")),
            "actual_return": F.when(_day() == 15, F.col("actual_return") + 1e-6).otherwise(F.col("actual_return")),
        }
    )
    return moved.withColumn("copy", copies).drop("copy"), data


@query(f"{predictions_sql('daily', ('validation',))}, {_DAMAGED}, due AS (SELECT * FROM ds WHERE split = 'validation'), {_schedule_sql('damaged', 'due')}")
def schedule_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts against the schedule of the validation split: missing, unexpected, repeated, other actuals."""
    rows, data = _damaged(spark, folder, "validation")
    return contracts.schedule_violations(rows, data.where("split = 'validation'"))


@query(
    f"""{predictions_sql('daily', ('validation', 'test'))}, {_DAMAGED}, f AS (SELECT ticker, min(target_date) AS first FROM damaged GROUP BY 1), due AS (SELECT ds.* FROM ds JOIN f USING (ticker) WHERE target_date >= first), {_schedule_sql('damaged', 'due')}"""
)
def tail_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts against the complete tail of their source from the first forecast on."""
    rows, data = _damaged(spark, folder, "validation", "test")
    return contracts.schedule_violations(rows, contracts.tail_of(rows, data))


@query(
    f"""{predictions_sql('daily', ('test',))}, rest AS (SELECT {_KEYS}, CASE WHEN {_DAY} = 15 THEN actual_return - predicted_return + 1e-6 ELSE actual_return - predicted_return END AS actual_return FROM pred WHERE model = 'momentum' AND {_DAY} <> 13),
due AS (SELECT {_KEYS}, actual_return - predicted_return AS target_return FROM pred WHERE model = 'momentum' AND {_DAY} <> 17), {_schedule_sql('rest', 'due')}"""
)
def hybrid_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Residual forecasts against the component they belong to: keys of one side only and broken residual identities."""
    component = synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)).where("model = 'momentum'")
    rest = forecast.residual_predictions(component.where(_day() != 13), F.lit(0.0))
    broken = rest.withColumn("actual_return", F.when(_day() == 15, F.col("actual_return") + 1e-6).otherwise(F.col("actual_return")))
    return forecast.hybrid_violations(component.where(_day() != 17), broken)


@query(
    f"""{predictions_sql('daily')}, r AS (SELECT ticker, date, target_date FROM pred WHERE model = 'momentum' AND {_DAY} <> 13), n AS (SELECT *, lead(date) OVER (PARTITION BY ticker ORDER BY target_date) AS following FROM r)
SELECT ticker, count(*) AS pairs, CAST(count_if(target_date <> following) AS BIGINT) AS gaps FROM n WHERE following IS NOT NULL GROUP BY 1"""
)
def chain_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a residual chain that skip a row, one day a month taken out."""
    data = dataset_of(spark, folder, "daily")
    rows = synthetic_predictions(data).where((F.col("model") == "momentum") & (_day() != 13))
    return returns.residual_chain(rows, data, validate=False).groupBy("ticker").agg(F.count("*").alias("pairs"), F.count_if(~F.col("contiguous")).alias("gaps"))


@query(
    f"""{_REGIMES}, once AS (SELECT date, target_date, ticker, split, CASE WHEN {_DAY} = 15 THEN NULL ELSE volatility END AS volatility, CASE WHEN {_DAY} = 13 THEN 'extreme' ELSE regime END AS regime FROM asg),
bad AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE {_DAY} = 9) {_counts("count_if(regime NOT IN ('low', 'medium', 'high')) AS unknown_regime, count_if(volatility IS NULL) AS not_finite", _KEYS, "bad")}"""
)
def assignment_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The contract of regime assignments over planted violations."""
    once = regimes.assignments(dataset_of(spark, folder, "market")).withColumns(
        {"volatility": F.when(_day() != 15, F.col("volatility")), "regime": F.when(_day() == 13, F.lit("extreme")).otherwise(F.col("regime"))}
    )
    return contracts.keyed_violations(once.unionByName(once.where(_day() == 9)), PREDICTION_KEYS, contracts.assignment_checks())


@query(f"{dataset_sql('market')}, t AS (SELECT DISTINCT ticker FROM ds) SELECT ticker, split FROM t, (VALUES ('train'), ('validation'), ('test')) s(split) EXCEPT SELECT ticker, split FROM ds WHERE split IS NOT NULL")
def missing_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Tickers that lack a split a grid needs."""
    return contracts.missing_splits(dataset_of(spark, folder, "market"), ("train", "validation", "test"))


@query(f"{predictions_sql('daily', ('test',))}, t AS (SELECT target_date, count(DISTINCT ticker) AS tickers FROM pred WHERE NOT (ticker = 'R' AND day(target_date) = 13) GROUP BY 1) SELECT * FROM t WHERE tickers < (SELECT count(DISTINCT ticker) FROM pred)")
def unshared_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Test dates that some tickers lack, one ticker without one day a month."""
    rows = synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",))
    return inference.unshared_dates(rows.where(~((F.col("ticker") == "R") & (F.dayofmonth("target_date") == 13))))


@query(f"{predictions_sql('daily', ('test',), shared=True)} SELECT * FROM pred", actual_return=9, predicted_return=9)
def shared_test_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Test forecasts on the dates that all tickers have."""
    return inference.on_shared_calendar(synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)))


# ---- runs, seeds, selection ----------------------------------------------------


@query(
    f"""SELECT CAST(COLUMNS(*) AS BIGINT) FROM (SELECT count_if(NOT coalesce(status IN ('ok', 'failed', 'non_finite', 'diverged'), false)) AS unknown_status,
  count_if(status = 'ok' AND NOT coalesce(isfinite(mae_bps) AND isfinite(rmse_bps) AND mae_bps >= 0 AND rmse_bps >= 0 AND best_epoch >= 1 AND parameter_count >= 1 AND error IS NULL, false)) AS sound_run_without_figures,
  count_if(status <> 'ok' AND NOT coalesce(error IS NOT NULL AND best_epoch IS NULL, false)) AS failed_run_without_error,
  count(*) - count(DISTINCT (run_id, {TICKER})) AS repeated_rows FROM run_metrics)"""
)
def run_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered runs against the contract of a run table."""
    raw = table(spark, folder, "run_metrics").withColumn("ticker", clean_ticker("ticker"))
    return contracts.keyed_violations(raw, ["run_id", "ticker"], contracts.run_checks())


_SEED_DAMAGE = f"""{predictions_sql('daily', ('test',))}, {_SEEDED}, bad AS (SELECT * REPLACE (CASE WHEN seed = 1 AND {_DAY} = 15 THEN actual_return + 1e-6 ELSE actual_return END AS actual_return)
  FROM seeded, unnest(CASE WHEN seed = 0 AND {_DAY} = 9 THEN [1, 2] ELSE [1] END) u(k) WHERE family = 'reversal' AND NOT (seed = 2 AND {_DAY} = 13)),
g AS (SELECT {_KEYS}, list_sort(list(DISTINCT seed)) AS seeds, count(*) AS n, count(DISTINCT actual_return) AS actuals FROM bad GROUP BY ALL)"""


@query(
    f"{_SEED_DAMAGE} SELECT ticker, CAST(count_if(seeds <> [0, 1, 2]) AS BIGINT) AS other_seeds, CAST(count_if(n > len(seeds)) AS BIGINT) AS repeated_seeds, CAST(count_if(actuals > 1) AS BIGINT) AS different_actuals FROM g GROUP BY 1"
)
def seed_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations without exactly the seeds, with a seed twice or with more than one actual, all planted."""
    rows = _seeded(spark, folder).where((F.col("family") == "reversal") & ~((F.col("seed") == 2) & (_day() == 13)))
    copies = F.explode(F.when((F.col("seed") == 0) & (_day() == 9), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    bad = rows.withColumn("actual_return", F.when((F.col("seed") == 1) & (_day() == 15), F.col("actual_return") + 1e-6).otherwise(F.col("actual_return"))).withColumn("copy", copies)
    return contracts.seed_violations(bad, [0, 1, 2])


@query(
    f"""{predictions_sql('daily', ('test',))}, {_SEEDED}, rest AS (SELECT {_KEYS}, seed, predicted_return * 0.1::DOUBLE AS second FROM seeded WHERE family = 'reversal')
SELECT a.date, a.target_date, a.ticker, a.split, 'blend' AS model, a.actual_return, a.predicted_return + b.second AS predicted_return, b.seed FROM pred a JOIN rest b ON {_SAME} WHERE a.model = 'momentum'""",
    actual_return=9,
    predicted_return=9,
)
def seed_hybrids(spark: SparkSession, folder: str) -> DataFrame:
    """A component plus the residual forecast of every seed."""
    component = synthetic_predictions(dataset_of(spark, folder, "daily"), ("test",)).where("model = 'momentum'")
    second = _seeded(spark, folder).where("family = 'reversal'").select(*PREDICTION_KEYS, "seed", (F.col("predicted_return") * F.lit(0.1)).alias("second"))
    realised = component.select(*PREDICTION_KEYS, (F.col("actual_return") - F.col("predicted_return")).alias("actual_return"))
    rest = realised.join(second, list(PREDICTION_KEYS)).withColumns({"predicted_return": F.col("second"), "model": F.lit("residual")})
    return forecast.hybrid(component, rest.select(*PREDICTION_COLUMNS, "seed"), "blend")


@query(
    f"""{_SHORT}, bad AS (SELECT ticker, bic_rank, CASE WHEN p % 2 = 0 AND bic_rank = 1 THEN 'arima' ELSE 'arima_bic_' || bic_rank END AS model FROM short WHERE NOT (bic_rank = 2 AND ticker < 'H'))
SELECT ticker, list_sort(list(bic_rank)) <> [1, 2, 3] AS ranks_not_consecutive, CAST(count_if(model <> 'arima_bic_' || bic_rank) AS BIGINT) AS name_not_of_rank FROM bad GROUP BY 1"""
)
def shortlist_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Shortlists with ranks taken out and names changed, per ticker."""
    search = _search_of_runs(spark, folder).where(is_finite("aic")).withColumn("aic", F.lit(0.0)).distinct()
    short = selection.shortlist_orders(search).where(~((F.col("bic_rank") == 2) & (F.col("ticker") < "H")))
    named = F.when((F.col("p") % 2 == 0) & (F.col("bic_rank") == 1), F.lit("arima")).otherwise(F.col("model"))
    return contracts.shortlist_violations(short.withColumn("model", named))


_WINNERS = f"""{_CONFIGS}, best AS (SELECT ticker, "window", units, dropout, mean_mae_bps FROM c SEMI JOIN (SELECT ticker, "window", units, dropout FROM runs GROUP BY 1, 2, 3, 4 HAVING {_TEN_SEEDS}) e USING (ticker, "window", units, dropout) WHERE mean_mae_bps IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY mean_mae_bps, mean_rmse_bps NULLS FIRST, std_mae_bps NULLS FIRST, parameter_count, "window", units, dropout) = 1)"""


@query(f"""{_WINNERS} SELECT runs.run_id, ticker, runs.seed, runs.status, runs.mae_bps, best.mean_mae_bps FROM runs JOIN best USING (ticker, "window", units, dropout)""", mae_bps=8, mean_mae_bps=8)
def selected_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of each ticker's winning configuration beside its mean."""
    every = runs(spark, folder)
    best = selection.select_networks(selection.configuration_metrics(every), selection.eligible_configurations(every, list(range(10))))
    return selection.runs_of_selected(every, best).select("run_id", "ticker", "seed", "status", "mae_bps", "mean_mae_bps")


@query(f"WITH runs AS ({_RUNS}) SELECT ticker, CAST(count_if(status = 'ok') AS BIGINT) AS ok, CAST(count_if(status = 'failed') AS BIGINT) AS failed, CAST(count_if(status = 'diverged') AS BIGINT) AS diverged FROM runs GROUP BY 1")
def status_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by status side by side."""
    return selection.status_table(runs(spark, folder), ("ok", "failed", "diverged"), "ticker")


@query(
    f"""{predictions_sql('weekly', ('validation',))}, w AS (SELECT ticker, model FROM (SELECT ticker, model, avg(abs(predicted_return - actual_return)) AS mae FROM pred WHERE model <> 'naive_zero' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(mae, 10), model) = 1)
SELECT date, target_date, ticker, split, 'chosen' AS model, actual_return, predicted_return FROM pred SEMI JOIN w USING (ticker, model)""",
    actual_return=9,
    predicted_return=9,
)
def selected_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """The forecasts of each ticker's best model under one name."""
    rows = synthetic_predictions(dataset_of(spark, folder, "weekly"), ("validation",))
    errors = rows.where("model <> 'naive_zero'").groupBy("ticker", "model").agg(F.round(F.avg(F.abs(F.col("predicted_return") - F.col("actual_return"))), 10).alias("mae"))
    return selection.selected_predictions(rows, selection.best_of(errors, ["ticker"], ["mae", "model"]), "chosen").select(*PREDICTION_COLUMNS)


# ---- pivots, fitted means ------------------------------------------------------


@query(
    f"""{dataset_sql('daily')}, v AS (SELECT ticker, split, stddev_samp(log_return) * sqrt(252.0::DOUBLE) AS v FROM ds GROUP BY 1, 2)
SELECT ticker, max(CASE WHEN split = 'train' THEN v END) AS train, max(CASE WHEN split = 'validation' THEN v END) AS validation, max(CASE WHEN split = 'test' THEN v END) AS test FROM v GROUP BY 1""",
    train=8,
    validation=8,
    test=8,
)
def volatility_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Annualised deviation of returns, splits side by side."""
    volatility = F.stddev_samp("log_return") * F.lit(252**0.5)
    return dataset_of(spark, folder, "daily").groupBy("ticker").pivot("split", ["train", "validation", "test"]).agg(volatility)


_FITTED = f"""{dataset_sql('daily')}, h AS (SELECT *, count(CASE WHEN split IN ('train', 'validation') THEN 1 END) OVER w AS history, avg(log_return) OVER w AS mean FROM ds WHERE split <> 'test' WINDOW w AS (PARTITION BY ticker ORDER BY date RANGE UNBOUNDED PRECEDING)),
due AS (SELECT * FROM h WHERE split = 'validation' AND history >= {_WARM_UP}),
pred AS (SELECT date, target_date, ticker, split, m.model, target_return AS actual_return, CASE WHEN m.model = 'arima' THEN mean ELSE 0 END AS predicted_return FROM due, (VALUES ('naive_zero'), ('arima')) m(model))"""


def _fitted(spark: SparkSession, folder: str) -> DataFrame:
    """Daily refits of ARIMA(0, 0, 0) and the zero forecast on the same rows, aligned."""
    data = dataset_of(spark, folder, "daily")
    fitted = forecast.walk_forward(data, forecast.arima_fitter({t: (0, 0, 0) for t in ("A", "N", "R")}), "arima", warm_up=_WARM_UP)
    naive = forecast.predict(data, forecast.Naive(), ("validation",)).join(fitted, list(PREDICTION_KEYS), "left_semi")
    return forecast.align([naive, fitted])


@query(_metrics_sql(_FITTED), **_METRIC_DIGITS)
def arima_mean_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted forecasts through evaluation: refits of ARIMA(0, 0, 0) against zero, per ticker and pooled."""
    return metrics.return_metrics(_fitted(spark, folder))


@query(
    f"""{_FITTED}, e AS (SELECT ticker, target_date, model, predicted_return - actual_return AS e FROM pred), d AS (SELECT a.ticker, l.loss, a.target_date, CASE WHEN l.loss = 'absolute' THEN abs(a.e) - abs(b.e) ELSE a.e * a.e - b.e * b.e END AS d
  FROM e a, e b, (VALUES ('absolute'), ('squared')) l(loss) WHERE a.model = 'arima' AND b.model = 'naive_zero' AND a.ticker = b.ticker AND a.target_date = b.target_date),
every AS (SELECT * FROM d UNION ALL SELECT 'ALL' AS ticker, loss, target_date, avg(d) AS d FROM d GROUP BY loss, target_date)
SELECT ticker, loss, count(*) AS observations, avg(d) AS mean_loss_difference FROM every GROUP BY 1, 2""",
    mean_loss_difference=11,
)
def arima_mean_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Loss differences of the same fitted forecasts."""
    errors = inference.error_table(_fitted(spark, folder), "validation")
    return inference.dm_statistics(inference.loss_differences(errors, [("arima", "naive_zero")])).select("ticker", "loss", "observations", "mean_loss_difference")


@query(
    f"""{dataset_sql('daily')}, h AS (SELECT *, avg(log_return) OVER (PARTITION BY ticker ORDER BY date RANGE UNBOUNDED PRECEDING) AS predicted_return FROM ds)
SELECT date, target_date, ticker, split, 'arima' AS model, target_return AS actual_return, predicted_return FROM h WHERE split = 'test'""",
    actual_return=9,
    predicted_return=9,
)
def arima_mean_test_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The final walk-forward: refits at every test origin on all rows up to it, test rows included."""
    data, every = dataset_of(spark, folder, "daily"), ("train", "validation", "test")
    return forecast.walk_forward(data, forecast.arima_fitter({t: (0, 0, 0) for t in ("A", "N", "R")}), "arima", splits=("test",), history_splits=every, warm_up=_WARM_UP)


@query(
    f"""{dataset_sql('daily')}, m AS (SELECT ticker, avg(log_return) AS mean FROM ds WHERE split = 'train' GROUP BY 1)
SELECT date, target_date, ticker, split, 'arima_path' AS model, target_return AS actual_return, mean AS predicted_return FROM ds JOIN m USING (ticker) WHERE split = 'validation'""",
    actual_return=9,
    predicted_return=9,
)
def arima_mean_path(spark: SparkSession, folder: str) -> DataFrame:
    """One fit of ARIMA(0, 0, 0) per ticker and as many steps ahead as the validation split has rows."""
    return forecast.forecast_paths(dataset_of(spark, folder, "daily"), {t: (0, 0, 0) for t in ("A", "N", "R")}, "arima_path")
