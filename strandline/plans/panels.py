"""Panels over the input tables: one row per (date, ticker) with a positive price."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import clean_ticker, is_finite
from strandline.operators.forecast import Naive, align, predict_by_column
from strandline.operators.returns import model_dataset
from strandline.schema import PREDICTION_COLUMNS, SplitConfig
from strandline.session import table

D = date

#: Splits of the weekly and daily panels of orders, of the daily panel of events and of the model dataset.
LONG = SplitConfig((D(1990, 1, 1), D(1998, 12, 31)), (D(1999, 1, 1), D(1999, 12, 31)), (D(2000, 1, 1), D(2010, 12, 31)))
SHORT = SplitConfig((D(2024, 1, 1), D(2024, 1, 18)), (D(2024, 1, 19), D(2024, 1, 24)), (D(2024, 1, 25), D(2024, 12, 31)))
MARKET = SplitConfig((D(2006, 1, 1), D(2015, 12, 31)), (D(2016, 1, 1), D(2019, 12, 31)), (D(2020, 1, 1), D(2025, 12, 31)))

#: SQL of a trimmed upper-case name.
TICKER = "upper(trim(ticker, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"


@dataclass(frozen=True)
class Panel:
    """A panel's splits and its SQL over the input tables."""

    name: str
    splits: SplitConfig
    sql: str


PANELS = {
    "weekly": Panel("weekly", LONG, "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS ticker, avg(o_totalprice) AS adj_close FROM orders GROUP BY 1, 2"),
    "daily": Panel("daily", LONG, "SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, avg(l_extendedprice) AS adj_close FROM lineitem GROUP BY 1, 2"),
    "events": Panel("events", SHORT, "SELECT CAST(ts AS DATE) AS date, event_type AS ticker, avg(value) AS adj_close FROM events GROUP BY 1, 2 HAVING avg(value) > 0"),
    "market": Panel(
        "market",
        MARKET,
        f"SELECT date, {TICKER} AS ticker, max(adj_close) AS adj_close FROM dataset WHERE ticker IS NOT NULL AND date IS NOT NULL AND isfinite(adj_close) AND adj_close > 0 GROUP BY 1, 2",
    ),
}


def panel(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(date, ticker, adj_close); repeated deliveries of a market row count once."""
    if name == "weekly":
        return table(spark, folder, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker")).agg(
            F.avg("o_totalprice").alias("adj_close")
        )
    if name == "daily":
        return table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("ticker")).agg(F.avg("l_extendedprice").alias("adj_close"))
    if name == "events":
        return (
            table(spark, folder, "events")
            .groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("ticker"))
            .agg(F.avg("value").alias("adj_close"))
            .where("adj_close > 0")
        )
    if name == "market":
        sound = is_finite("adj_close") & (F.col("adj_close") > 0)
        return (
            table(spark, folder, "dataset")
            .where("ticker is not null and date is not null")
            .where(sound)
            .groupBy("date", clean_ticker("ticker").alias("ticker"))
            .agg(F.max("adj_close").alias("adj_close"))
        )
    raise ValueError(f"no panel {name}")


def dataset_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return model_dataset(panel(spark, folder, name), PANELS[name].splits)


#: Candidate and comparator among the models below, which stand for no fitted one.
STAND_INS = (("momentum", "naive_zero"), ("reversal", "naive_zero"), ("blend", "naive_zero"), ("blend", "momentum"), ("blend", "reversal"))


class LastReturn:
    """Half the last return."""

    name = "momentum"

    def expression(self):  # noqa: ANN201
        return F.col("log_return") * F.lit(0.5)


class Reversal:
    """A quarter of the last return, reversed."""

    name = "reversal"

    def expression(self):  # noqa: ANN201
        return F.col("log_return") * F.lit(-0.25)


class Both:
    """Sum of the two before."""

    name = "blend"

    def expression(self):  # noqa: ANN201
        return F.col("log_return") * F.lit(0.5) + F.col("log_return") * F.lit(-0.25)


def synthetic_predictions(dataset: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Predictions of four models as columns of one scan: a stand-in for fitted models that SQL can express."""
    models = (Naive(), LastReturn(), Reversal(), Both())
    rows = F.explode(F.array(*(F.struct(F.lit(m.name).alias("model"), m.expression().alias("predicted_return")) for m in models)))
    out = dataset.where(F.col("split").isin(*splits)).withColumn("m", rows)
    return out.select("date", "target_date", "ticker", "split", "m.model", F.col("target_return").alias("actual_return"), "m.predicted_return").select(*PREDICTION_COLUMNS)


def dataset_sql(name: str) -> str:
    """CTEs ``panel``, ``returns`` and ``ds`` (the model dataset) in SQL."""
    p = PANELS[name]
    case = " ".join(f"WHEN target_date BETWEEN DATE '{a}' AND DATE '{b}' THEN '{n}'" for n, (a, b) in p.splits.parts)
    return f"""WITH panel AS ({p.sql}),
returns AS (SELECT *, ln(adj_close) - lag(ln(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS log_return FROM panel),
targets AS (SELECT *, lead(date) OVER w AS target_date, lead(log_return) OVER w AS target_return FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY date)),
ds AS (SELECT date, target_date, ticker, adj_close, log_return, target_return, CASE {case} END AS split FROM targets WHERE log_return IS NOT NULL AND target_return IS NOT NULL)"""


def predictions_sql(name: str, splits: tuple[str, ...] = ("train", "validation", "test"), shared: bool = False) -> str:
    """The CTEs above and ``pred``, the four models' predictions; with ``shared`` on dates that all tickers have."""
    some = ", ".join(f"'{s}'" for s in splits)
    every = "every" if shared else "pred"
    common = ", pred AS (SELECT * FROM every WHERE target_date IN (SELECT target_date FROM every GROUP BY 1 HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM every)))" if shared else ""
    return f"""{dataset_sql(name)},
{every} AS (SELECT date, target_date, ticker, split, m.model, target_return AS actual_return,
  CASE m.model WHEN 'naive_zero' THEN 0.0::DOUBLE WHEN 'momentum' THEN log_return * 0.5::DOUBLE WHEN 'reversal' THEN log_return * (-0.25)::DOUBLE ELSE log_return * 0.5::DOUBLE + log_return * (-0.25)::DOUBLE END AS predicted_return
  FROM ds, (VALUES ('naive_zero'), ('momentum'), ('reversal'), ('blend')) m(model) WHERE split IN ({some})){common}"""
