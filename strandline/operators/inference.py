"""Diebold-Mariano tests, Holm adjustment and moving-block bootstrap intervals."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.tails import normal_two_sided_p
from strandline.operators.metrics import POOLED
from strandline.schema import BPS, COMPARISONS, InferenceConfig
from strandline.session import spread

INTERVAL_DDL = (
    "ticker string, metric string, candidate string, comparator string, observations bigint, estimate double, "
    "ci_lower double, ci_upper double, repetitions int, block_length int, seed bigint"
)


def error_table(predictions: DataFrame, split: str = "test") -> DataFrame:
    """One row per (ticker, target date): errors of all models as a map."""
    rows = predictions.where(F.col("split") == split)
    error = F.col("predicted_return") - F.col("actual_return")
    return rows.groupBy("ticker", "target_date").agg(F.map_from_entries(F.collect_list(F.struct("model", error.alias("e")))).alias("errors"))


def shared_test_calendar(errors: DataFrame) -> DataFrame:
    """One row: whether all tickers have the same test dates."""
    per_date = errors.groupBy("target_date").agg(F.countDistinct("ticker").alias("n"))
    return per_date.agg(F.coalesce(F.min("n") == F.max("n"), F.lit(True)).alias("shared"))


def on_shared_calendar(predictions: DataFrame, split: str = "test") -> DataFrame:
    """The split's rows on target dates that every ticker has: what paired tests and block resampling need."""
    rows = predictions.where(F.col("split") == split)
    dates = rows.groupBy("target_date").agg(F.countDistinct("ticker").alias("n"))
    every = rows.agg(F.countDistinct("ticker").alias("all"))
    shared = dates.join(F.broadcast(every), F.col("n") == F.col("all")).select("target_date")  # one row
    return rows.join(shared, "target_date", "left_semi").select(*predictions.columns)


def unshared_dates(predictions: DataFrame, split: str = "test") -> DataFrame:
    """Target dates of the split that some tickers lack, with the number of tickers that have them."""
    rows = predictions.where(F.col("split") == split)
    dates = rows.groupBy("target_date").agg(F.countDistinct("ticker").alias("tickers"))
    every = rows.agg(F.countDistinct("ticker").alias("all"))
    return dates.join(F.broadcast(every), F.col("tickers") < F.col("all")).select("target_date", "tickers")  # one row


def require_shared_calendar(errors: DataFrame) -> None:
    if not shared_test_calendar(errors).first()["shared"]:
        raise ValueError("tickers have different test dates")


def loss_differences(errors: DataFrame, comparisons: Sequence[tuple[str, str]] = COMPARISONS) -> DataFrame:
    """(ticker, loss, candidate, comparator, target_date, d) per ticker and, as mean over tickers by date, pooled."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("comparator")) for a, b in comparisons)))
    paired = errors.select("ticker", "target_date", "errors", pairs.alias("pair")).select(
        "ticker", "target_date", "pair.*", F.col("errors")[F.col("pair.candidate")].alias("a"), F.col("errors")[F.col("pair.comparator")].alias("b")
    )
    losses = F.explode(
        F.array(
            F.struct(F.lit("absolute").alias("loss"), (F.abs("a") - F.abs("b")).alias("d")),
            F.struct(F.lit("squared").alias("loss"), (F.col("a") * F.col("a") - F.col("b") * F.col("b")).alias("d")),
        )
    )
    single = paired.where("a is not null and b is not null").select("ticker", "candidate", "comparator", "target_date", losses.alias("x")).select(
        "ticker", "x.loss", "candidate", "comparator", "target_date", "x.d"
    )
    pooled = single.groupBy("loss", "candidate", "comparator", "target_date").agg(F.avg("d").alias("d")).withColumn("ticker", F.lit(POOLED))
    return single.unionByName(pooled)


def dm_statistics(differences: DataFrame, lag: int = 20) -> DataFrame:
    """Mean difference and statistic with Bartlett-weighted long-run variance, truncated at ``min(lag, n - 1)``.

    A variance of zero gives 0 for a mean of zero and an infinity of the mean's sign otherwise.
    """
    keys = ["ticker", "loss", "candidate", "comparator"]
    order, whole = Window.partitionBy(*keys).orderBy("target_date"), Window.partitionBy(*keys)
    centred = differences.withColumns({"c": F.col("d") - F.avg("d").over(whole)})
    lagged = centred.withColumns({f"c{k}": F.lag("c", k).over(order) for k in range(1, lag + 1)})
    n = F.col("observations").cast("double")
    sums = lagged.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.avg("d").alias("mean_loss_difference"), F.sum(F.col("c") * F.col("c")).alias("s0"),
        *(F.coalesce(F.sum(F.col("c") * F.col(f"c{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, lag + 1)),
    )
    reach = F.least(F.lit(float(lag)), n - 1)
    variance = F.col("s0") / n
    for k in range(1, lag + 1):
        variance = variance + 2 * F.when(F.lit(k) <= reach, (1 - F.lit(float(k)) / (reach + 1)) * F.col(f"s{k}") / n).otherwise(F.lit(0.0))
    m = F.col("mean_loss_difference")
    flat = F.when(m == 0, F.lit(0.0)).otherwise(F.signum(m) * F.lit(float("inf")))
    return sums.withColumn("variance", variance).select(
        *keys, "observations", "mean_loss_difference", "variance", F.when(F.col("variance") <= 0, flat).otherwise(m / F.sqrt(F.col("variance") / n)).alias("dm_statistic")
    )


def holm(tests: DataFrame, family: Sequence[str], p: str = "raw_p_value", ties: Sequence[str] = ("candidate", "comparator"), alpha: float = 0.05) -> DataFrame:
    """Holm-adjusted p-values within each family; a family is one set of comparisons."""
    whole = Window.partitionBy(*family)
    order = whole.orderBy(p, *ties)
    scaled = tests.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(whole))
    stepped = F.max(F.least(F.col(p) * (F.col("m") - F.col("rank") + 1), F.lit(1.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("holm_p_value", stepped).withColumn("reject_null", F.col("holm_p_value") <= alpha).drop("rank", "m")


def dm_results(predictions: DataFrame, config: InferenceConfig | None = None, comparisons: Sequence[tuple[str, str]] = COMPARISONS, *, validate: bool = True) -> DataFrame:
    """Tests of all comparisons; unless ``validate`` is off all tickers must have one test calendar."""
    config, errors = config or InferenceConfig(), error_table(predictions)
    if validate:
        require_shared_calendar(errors)
    tests = dm_statistics(loss_differences(errors, comparisons), config.lag)
    with_p = tests.withColumn("raw_p_value", normal_two_sided_p("dm_statistic")).drop("variance")
    return holm(with_p, ("ticker", "loss"), alpha=config.alpha)


def metric_differences(errors: DataFrame, comparisons: Sequence[tuple[str, str]] = COMPARISONS) -> DataFrame:
    """Candidate minus comparator MAE and RMSE in basis points over all cells, per ticker and pooled."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("comparator")) for a, b in comparisons)))
    cells = errors.select("ticker", "errors", pairs.alias("pair")).select(
        "ticker", "pair.*", F.col("errors")[F.col("pair.candidate")].alias("a"), F.col("errors")[F.col("pair.comparator")].alias("b")
    )
    grouped = cells.groupingSets([["candidate", "comparator", "ticker"], ["candidate", "comparator"]], "candidate", "comparator", "ticker").agg(
        F.count("*").alias("observations"),
        ((F.avg(F.abs("a")) - F.avg(F.abs("b"))) * BPS).alias("mae"),
        ((F.sqrt(F.avg(F.col("a") * F.col("a"))) - F.sqrt(F.avg(F.col("b") * F.col("b")))) * BPS).alias("rmse"),
        F.grouping("ticker").alias("pooled"),
    )
    labelled = grouped.withColumn("ticker", F.when(F.col("pooled") == 1, F.lit(POOLED)).otherwise(F.col("ticker")))
    return labelled.unpivot(["ticker", "candidate", "comparator", "observations"], ["mae", "rmse"], "metric", "estimate")


def block_starts(n: int, block: int, draws: int, generator: np.random.Generator) -> np.ndarray:
    """Start rows of moving blocks for ``draws`` resamples, one row per resample."""
    return generator.integers(0, n - block + 1, size=(draws, -(-n // block)))


def resampled_differences(cells: np.ndarray, per_date: int, starts: np.ndarray, block: int) -> np.ndarray:
    """(draws, 2) MAE and RMSE differences; ``cells`` holds per date the sums |a|, a^2, |b|, b^2.

    Prefix sums make a block one subtraction; the last block is cut to the number of dates.
    """
    n = len(cells)
    prefix = np.vstack([np.zeros(cells.shape[1]), np.cumsum(cells, axis=0)])
    ends = starts + block
    ends[:, -1] = starts[:, -1] + (n - block * (starts.shape[1] - 1))
    mean = (prefix[ends] - prefix[starts]).sum(axis=1) / (n * per_date)
    return np.column_stack([mean[:, 0] - mean[:, 2], np.sqrt(mean[:, 1]) - np.sqrt(mean[:, 3])]) * BPS


def stream_states(scopes: DataFrame, dates: int, config: InferenceConfig, count: int) -> DataFrame:
    """(ticker, pair_no, state): the random stream's state before each scope and comparison.

    One stream runs through tickers in order and the pooled scope last. One task
    draws it through once and notes where each scope starts; it holds names and
    states only.
    """
    block = min(config.block, dates)

    def walk(batches):  # noqa: ANN001, ANN202
        generator = np.random.default_rng(config.seed)
        for pdf in batches:
            for names in pdf["names"]:
                rows = []
                for name in [*names, POOLED]:
                    for pair in range(count):
                        rows.append((name, pair, json.dumps(generator.bit_generator.state)))
                        block_starts(dates, block, config.repetitions, generator)
                yield pd.DataFrame(rows, columns=["ticker", "pair_no", "state"])

    names = scopes.agg(F.sort_array(F.collect_set("ticker")).alias("names"))
    return names.mapInPandas(walk, "ticker string, pair_no int, state string")


def bootstrap_intervals(predictions: DataFrame, config: InferenceConfig | None = None, comparisons: Sequence[tuple[str, str]] = COMPARISONS) -> DataFrame:
    """Percentile intervals of metric differences by moving blocks of dates.

    One random stream runs through all scopes and comparisons in order (tickers
    sorted, pooled last). All tickers must have one test calendar. Tasks are one
    scope and comparison each, start at their state of the stream, and hold sums
    per date only.
    """
    config = config or InferenceConfig()
    errors = error_table(predictions)
    require_shared_calendar(errors)
    dates = errors.agg(F.countDistinct("target_date")).first()[0]
    pairs = F.posexplode(F.array(*(F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("comparator")) for a, b in comparisons)))
    cells = errors.select("ticker", "target_date", "errors", pairs.alias("pair_no", "pair")).select(
        "ticker", "target_date", "pair_no", "pair.*", F.col("errors")[F.col("pair.candidate")].alias("a"), F.col("errors")[F.col("pair.comparator")].alias("b")
    )
    sums = [F.count("*").alias("cells"), *(F.sum(x).alias(n) for n, x in (("s0", F.abs("a")), ("s1", F.col("a") * F.col("a")), ("s2", F.abs("b")), ("s3", F.col("b") * F.col("b"))))]
    keys = ["pair_no", "candidate", "comparator", "target_date"]
    single = cells.groupBy("ticker", *keys).agg(*sums)
    pooled = cells.groupBy(*keys).agg(*sums).withColumn("ticker", F.lit(POOLED))
    row = F.struct("target_date", "cells", "s0", "s1", "s2", "s3")
    by_scope = single.unionByName(pooled).groupBy("ticker", "pair_no", "candidate", "comparator").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    work = by_scope.join(stream_states(errors, max(dates, 1), config, len(comparisons)), ["ticker", "pair_no"])
    columns = [x.strip().split()[0] for x in INTERVAL_DDL.split(",")]

    def intervals(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n, per_date = len(r["rows"]), int(r["rows"][0]["cells"])
                block = min(config.block, n)
                generator = np.random.default_rng()
                generator.bit_generator.state = json.loads(r["state"])
                table = np.array([[x["s0"], x["s1"], x["s2"], x["s3"]] for x in r["rows"]], float)
                drawn = resampled_differences(table, per_date, block_starts(n, block, config.repetitions, generator), block)
                mean = table.sum(axis=0) / (n * per_date)
                estimate = np.array([mean[0] - mean[2], np.sqrt(mean[1]) - np.sqrt(mean[3])]) * BPS
                tail = (1 - config.confidence) / 2
                low, high = np.quantile(drawn, [tail, 1 - tail], axis=0)
                out += [(r["ticker"], m, r["candidate"], r["comparator"], n * per_date, estimate[k], low[k], high[k], config.repetitions, block, config.seed) for k, m in enumerate(("mae", "rmse"))]
            yield pd.DataFrame(out, columns=columns)

    return spread(work, "ticker", "pair_no").mapInPandas(intervals, INTERVAL_DDL)
