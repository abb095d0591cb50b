"""Queries of the general problems over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import clean_ticker
from strandline.operators.rolling_tree import TreeLayout, build_trees, correct_trees, rolling_totals, trailing_totals
from strandline.operators.snapshot_diff import snapshot_changes
from strandline.operators.spikes import find_cases
from strandline.session import table


def _published(totals: DataFrame, layout: TreeLayout) -> DataFrame:
    """Totals to ten decimals, as delivered returns have, and means of those: no order of summation shows."""
    for w in layout.windows:
        totals = totals.withColumn(f"total_{w}d", F.round(f"total_{w}d", 10)).withColumn(
            f"mean_{w}d", F.when(F.col(f"readings_{w}d") > 0, F.col(f"total_{w}d") / F.col(f"readings_{w}d"))
        )
    return totals


def p2_rolling_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Total and mean of ``log_return`` over the trailing 7 and 30 days, per ticker and calendar day."""
    rows = table(spark, folder, "dataset").withColumn("ticker", clean_ticker("ticker"))
    return _published(rolling_totals(rows), TreeLayout())


def p2_late_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """The same totals when rows that arrived over a day late come as corrections of trees built without their values."""
    layout = TreeLayout()
    rows = table(spark, folder, "dataset").withColumn("ticker", clean_ticker("ticker"))
    late = F.datediff(F.col("loaded_at").cast("date"), "date") > 1
    punctual = rows.withColumn("log_return", F.when(~late, F.col("log_return")))
    # a day that came on time and again later holds the same value: the correction repeats it
    trees = correct_trees(build_trees(punctual, layout), rows.where(late), layout)
    return _published(trailing_totals(trees, layout).withColumnRenamed("entity", "ticker"), layout)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Added, removed and changed rows of each delivery against the one before."""
    changes = snapshot_changes(table(spark, folder, "dataset_snapshots"), table(spark, folder, "manifest"))
    return changes.select("snapshot_id", "ticker", F.date_format("date", "yyyy-MM-dd").alias("day"), "change")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Impossible, spiking and stuck readings of each ticker."""
    return find_cases(table(spark, folder, "dataset")).select("ticker", F.date_format("date", "yyyy-MM-dd").alias("day"))


QUERIES = {"p2_rolling_totals": p2_rolling_totals, "p2_late_corrections": p2_late_corrections, "p3_found": p3_found, "p4_found": p4_found}

_P2 = """
WITH daily AS (
  SELECT upper(trim(ticker, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS ticker, date, max(CASE WHEN isfinite(log_return) THEN log_return END) AS r,
         max(CASE WHEN isinf(log_return) THEN 1 ELSE 0 END) AS inf
  FROM dataset WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2
), span AS (SELECT ticker, min(date) AS a, max(date) AS b FROM daily GROUP BY 1),
calendar AS (SELECT ticker, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span),
filled AS (SELECT c.ticker, c.date, d.r, CASE WHEN d.r IS NULL THEN coalesce(d.inf, 0) ELSE 0 END AS odd FROM calendar c LEFT JOIN daily d USING (ticker, date))
SELECT ticker, date,
  round(coalesce(sum(r) OVER w7, 0), 10) + 0.0::DOUBLE AS total_7d, (round(sum(r) OVER w7, 10) + 0.0::DOUBLE) / count(r) OVER w7 AS mean_7d, count(r) OVER w7 AS readings_7d, CAST(sum(odd) OVER w7 AS BIGINT) AS nonfinite_7d,
  round(coalesce(sum(r) OVER w30, 0), 10) + 0.0::DOUBLE AS total_30d, (round(sum(r) OVER w30, 10) + 0.0::DOUBLE) / count(r) OVER w30 AS mean_30d, count(r) OVER w30 AS readings_30d, CAST(sum(odd) OVER w30 AS BIGINT) AS nonfinite_30d
FROM filled
WINDOW w7 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
"""

_P3 = """
WITH notice AS (
  SELECT raw_dir, snapshot_id, max(CAST(replace(created_at_utc, 'Z', '+00:00') AS TIMESTAMPTZ)) AS t
  FROM manifest WHERE raw_dir IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY 1, 2
), ordered AS (
  SELECT raw_dir, snapshot_id, lag(snapshot_id) OVER (PARTITION BY raw_dir ORDER BY t, snapshot_id) AS prior FROM notice
), r AS (
  SELECT snapshot_id, upper(trim(ticker, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS ticker, date, max(adj_close) AS p
  FROM dataset_snapshots WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2, 3
), later AS (SELECT o.snapshot_id, o.prior, r.ticker, r.date, r.p FROM ordered o JOIN r USING (snapshot_id) WHERE o.prior IS NOT NULL),
earlier AS (SELECT o.snapshot_id, r.ticker, r.date, r.p FROM ordered o JOIN r ON r.snapshot_id = o.prior),
both_sides AS (
  SELECT coalesce(l.snapshot_id, e.snapshot_id) AS snapshot_id, coalesce(l.ticker, e.ticker) AS ticker, coalesce(l.date, e.date) AS date,
         CASE WHEN e.snapshot_id IS NULL THEN 'added' WHEN l.snapshot_id IS NULL THEN 'removed'
              WHEN printf('%.9e', l.p) IS DISTINCT FROM printf('%.9e', e.p) THEN 'changed' END AS change
  FROM later l FULL JOIN earlier e ON l.snapshot_id = e.snapshot_id AND l.ticker = e.ticker AND l.date = e.date)
SELECT snapshot_id, ticker, strftime(date, '%Y-%m-%d') AS day, change FROM both_sides WHERE change IS NOT NULL
"""

ORACLE = {"p2_rolling_totals": _P2, "p2_late_corrections": _P2, "p3_found": _P3}
