"""Queries of the training-data problems over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.scalars import clean_ticker, is_finite
from strandline.llm.langid import document_languages, label_findings, label_segments
from strandline.llm.leakage import find_leaks, searched_items
from strandline.llm.mixing import MixSettings, mix_documents, mix_report, token_table
from strandline.llm.percentiles import BucketScale, combine, read_percentiles, sketch
from strandline.llm.topn import cluster, prepared, skipping_report, top_n
from strandline.session import scratch_table, table

PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


#: Days of a time shard in which repeated deliveries are removed and values counted.
_SHARD_DAYS = 2048


def _returns_once(spark: SparkSession, folder: str) -> DataFrame:
    """A (ticker, date) once; delivered copies hold the same value, and should they differ the largest counts.

    Rows are shuffled once, by ticker and time shard; a ticker's values meet
    there, so that counts by bucket shrink before they are shuffled.
    """
    shard = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / F.lit(float(_SHARD_DAYS)))
    return (
        table(spark, folder, "dataset")
        .select(clean_ticker("ticker").alias("ticker"), "date", F.when(~F.isnan("log_return"), F.col("log_return")).alias("log_return"))
        .where("ticker is not null and date is not null")
        .withColumn("shard", shard.cast("int"))
        .repartition("ticker", "shard")
        .groupBy("ticker", "shard", "date")
        .agg(F.max("log_return").alias("log_return"))
    )


#: Digits to which percentiles are published; their error, 5e-10 of the value, is within the reserve of ``BucketScale``.
_DIGITS = 9


def _percentiles(sketches: DataFrame) -> DataFrame:
    found = read_percentiles(sketches, ["ticker"], PROBABILITIES, BucketScale())
    shown = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{_DIGITS - 1}e", F.col(c)).cast("double"))
    return found.withColumns({c: shown(c) for c in found.columns if c[0] == "p"})


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of ``log_return`` per ticker."""
    return _percentiles(sketch(_returns_once(spark, folder), ["ticker"], "log_return", BucketScale()))


def p1_yearly_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The form that is kept and combined: bucket counts per ticker and year."""
    return sketch(_returns_once(spark, folder).withColumn("year", F.year("date")), ["ticker", "year"], "log_return", BucketScale())


def p1_combined_years(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles of ``p1_percentiles`` from the combined sketches of years."""
    return _percentiles(combine(p1_yearly_sketches(spark, folder), ["ticker"]))


_RUN_GROUPS, _RUN_TIES = ["sweep_id", "ticker"], ["rmse_bps", "run_id"]


def _sound_runs(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "run_metrics")
        .where((F.col("status") == "ok") & is_finite("mae_bps") & is_finite("rmse_bps"))
        .select("sweep_id", clean_ticker("ticker").alias("ticker"), "run_id", "mae_bps", "rmse_bps")
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best runs of every sweep and ticker."""
    return top_n(_sound_runs(spark, folder), _RUN_GROUPS, "mae_bps", _RUN_TIES, 5).select("sweep_id", "ticker", "run_id")


def p5_skipping(spark: SparkSession, folder: str) -> DataFrame:
    """Row groups and rows of the clustered runs, and how many of them the five best take."""
    usable = prepared(_sound_runs(spark, folder), _RUN_GROUPS, "mae_bps", _RUN_TIES)
    index = cluster(usable, _RUN_GROUPS, "mae_bps", _RUN_TIES, scratch_table(spark, "topn"))
    report = skipping_report(index, usable.schema, _RUN_GROUPS, "mae_bps", 5)
    return report.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("row_groups", "read", "rows", "rows_read")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with every evaluation item it leaks."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation item with its words and whether it is long enough to be searched."""
    return searched_items(table(spark, folder, "eval_items"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and actual shares of every plan and source."""
    tokens = token_table(table(spark, folder, "documents"), MixSettings())
    return mix_report(tokens, table(spark, folder, "mix_targets"))


def p7_multinomial_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The same where output shards draw their source counts independently: shares to a sampling error."""
    settings = MixSettings(draw="multinomial")
    return mix_report(token_table(table(spark, folder, "documents"), settings), table(spark, folder, "mix_targets"), settings)


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents each plan draws, with tokens and repeats."""
    tokens = token_table(table(spark, folder, "documents"), MixSettings())
    return mix_documents(tokens, table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the documents whose label is missing or wrong or which mix languages."""
    documents = table(spark, folder, "documents")
    return label_findings(documents, document_languages(documents))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The language or languages of every document with letters, with a confidence."""
    return document_languages(table(spark, folder, "documents"))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of words in one language, with a confidence."""
    return label_segments(table(spark, folder, "documents"))


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_yearly_sketches": p1_yearly_sketches,
    "p1_combined_years": p1_combined_years,
    "p5_found": p5_found,
    "p5_skipping": p5_skipping,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_shares": p7_shares,
    "p7_multinomial_shares": p7_multinomial_shares,
    "p7_documents": p7_documents,
    "p8_found": p8_found,
    "p8_documents": p8_documents,
    "p8_segments": p8_segments,
}

_TICKER = "upper(trim(ticker, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"

_STEP = BucketScale().step
_HALF = BucketScale().key_limit // 2
_P1_COLUMNS = ", ".join(
    f"round(min(CASE WHEN reached > floor({p!r} * (n - 1)) THEN bucket END), 0) AS b{int(p * 100):02d}" for p in PROBABILITIES
)
_P1_VALUES = ", ".join(
    f"CAST(printf('%.{_DIGITS - 1}e', CASE WHEN b{int(p * 100):02d} = 0 THEN 0 WHEN abs(b{int(p * 100):02d}) > {2 * _HALF} THEN sign(b{int(p * 100):02d}) * CAST('inf' AS DOUBLE)"
    f" ELSE sign(b{int(p * 100):02d}) * exp((abs(b{int(p * 100):02d}) - {_HALF}) * {_STEP!r}) * (2 / (exp({_STEP!r}) + 1)) END) AS DOUBLE) AS p{int(p * 100):02d}"
    for p in PROBABILITIES
)
_P1 = f"""
WITH once AS (
  SELECT {_TICKER} AS ticker, date, max(CASE WHEN NOT isnan(log_return) THEN log_return END) AS r
  FROM dataset WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2
), keyed AS (
  SELECT ticker, CASE WHEN r = 0 THEN 0 WHEN isinf(r) THEN sign(r) * {2 * _HALF + 1}
    ELSE sign(r) * (ceil(ln(CASE WHEN r = 0 OR isinf(r) THEN 1 ELSE abs(r) END) / {_STEP!r}) + {_HALF}) END AS bucket
  FROM once WHERE r IS NOT NULL
), counted AS (SELECT ticker, bucket, count(*) AS c FROM keyed GROUP BY 1, 2),
ranked AS (
  SELECT *, sum(c) OVER (PARTITION BY ticker ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS reached, sum(c) OVER (PARTITION BY ticker) AS n FROM counted
), picked AS (SELECT ticker, CAST(max(n) AS BIGINT) AS observations, {_P1_COLUMNS} FROM ranked GROUP BY 1)
SELECT ticker, observations, {_P1_VALUES}, CAST({BucketScale().error!r} AS DOUBLE) AS relative_error FROM picked
"""

_P1_YEARS = f"""
WITH once AS (
  SELECT {_TICKER} AS ticker, date, max(CASE WHEN NOT isnan(log_return) THEN log_return END) AS r
  FROM dataset WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2
)
SELECT ticker, CAST(year(date) AS INTEGER) AS year, CAST(CASE WHEN r = 0 THEN 0 WHEN isinf(r) THEN sign(r) * {2 * _HALF + 1}
  ELSE sign(r) * (ceil(ln(CASE WHEN r = 0 OR isinf(r) THEN 1 ELSE abs(r) END) / {_STEP!r}) + {_HALF}) END AS INTEGER) AS bucket, count(*) AS rows
FROM once WHERE r IS NOT NULL GROUP BY 1, 2, 3
"""

_P5 = f"""
WITH runs AS (
  SELECT DISTINCT sweep_id, {_TICKER} AS ticker, run_id, mae_bps, rmse_bps FROM run_metrics
  WHERE status = 'ok' AND isfinite(mae_bps) AND isfinite(rmse_bps)
)
SELECT sweep_id, ticker, run_id FROM runs
QUALIFY row_number() OVER (PARTITION BY sweep_id, ticker ORDER BY mae_bps, rmse_bps, run_id) <= 5
"""

ORACLE = {"p1_percentiles": _P1, "p1_combined_years": _P1, "p1_yearly_sketches": _P1_YEARS, "p5_found": _P5}
