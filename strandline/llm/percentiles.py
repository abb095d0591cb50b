"""Percentiles from signed logarithmic buckets.

A value falls into the bucket of its sign and of the power of ``gamma`` above
its size; buckets of relative width ``gamma = (1 + a) / (1 - a)`` let every
percentile be read with a relative error of at most ``a``. Counts of equal
buckets add, so sketches of days, files or partitions combine without loss,
and the combined sketch equals the sketch of all rows.

The bucket key orders as the values do: negative sizes descending, zero, then
positive sizes; infinities have the outermost keys. A group has at most
``2 * key_limit + 3`` buckets, whatever its rows; rows are counted before any
shuffle.

Defined results
    Null and NaN are no values. Infinities are values and rank outermost, exactly.
    Percentile ``p`` of n values is the value of rank ``floor(p * (n - 1))``
    (from 0); ties and repeated values count each. A group without values gives
    no row. A null group is a group. Empty tables give an empty result; columns
    of the input that clash with the sketch's own are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BucketScale:
    """``error``: guaranteed relative error of a percentile's value."""

    error: float = 0.005

    def __post_init__(self) -> None:
        if not 1e-4 <= self.error < 1:
            raise ValueError("error must be in [1e-4, 1)")

    @property
    def step(self) -> float:
        """Natural logarithm of gamma; a millionth narrower than the error allows, for rounding at bucket edges and of published digits."""
        inner = self.error * (1 - 1e-6)
        return math.log((1 + inner) / (1 - inner))

    @property
    def key_limit(self) -> int:
        """Above every key of a finite double: their logarithms lie within +-746."""
        return 2 * math.ceil(746 / self.step) + 2

    def key(self, value: Column) -> Column:
        half = self.key_limit // 2
        size = F.abs(value)
        place = F.ceil(F.ln(size) / F.lit(self.step)).cast("int") + half
        return (
            F.when(value == 0, F.lit(0))
            .when(size == F.lit(float("inf")), F.signum(value).cast("int") * (self.key_limit + 1))
            .otherwise(F.signum(value).cast("int") * place)
        )

    def value(self, key: Column) -> Column:
        """The point of the bucket from which no value of it differs by more than the error."""
        half, middle = self.key_limit // 2, 2 / (math.exp(self.step) + 1)
        size = F.exp((F.abs(key) - half) * F.lit(self.step)) * F.lit(middle)
        return (
            F.when(key == 0, F.lit(0.0))
            .when(F.abs(key) > self.key_limit, F.signum(key) * F.lit(float("inf")))
            .otherwise(F.signum(key) * size)
        )


def sketch(frame: DataFrame, groups: Sequence[str], value: str, scale: BucketScale) -> DataFrame:
    """(groups, bucket, rows): one row per group and non-empty bucket."""
    number = F.col(value).cast("double")
    return (
        frame.where(number.isNotNull() & ~F.isnan(number))
        .select(*groups, scale.key(number).alias("bucket"))
        .groupBy(*groups, "bucket")
        .agg(F.count("*").alias("rows"))
    )


def combine(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds sketches of parts: coarser groups, further days, or a union of stored sketches."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("rows").alias("rows"))


def read_percentiles(sketches: DataFrame, groups: Sequence[str], probabilities: Sequence[float], scale: BucketScale) -> DataFrame:
    """(groups, observations, p..., relative_error) of combined sketches, one column per probability."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie in [0, 1]")
    # groups hold buckets here, not rows: their number is bounded by the scale
    whole = Window.partitionBy(*groups)
    reached = F.sum("rows").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketches.withColumns({"reached": reached, "observations": F.sum("rows").over(whole)})
    rank = lambda p: F.floor(F.lit(float(p)) * (F.col("observations") - 1))
    found = [F.min(F.when(F.col("reached") > rank(p), F.col("bucket"))).alias(column_of(p)) for p in probabilities]
    return (
        ranked.groupBy(*groups)
        .agg(F.max("observations").alias("observations"), *found)
        .withColumns({column_of(p): scale.value(F.col(column_of(p))) for p in probabilities} | {"relative_error": F.lit(scale.error)})
    )


def column_of(probability: float) -> str:
    """0.5 -> p50, 0.999 -> p99_9."""
    return "p" + f"{probability * 100:.10g}".zfill(2).replace(".", "_")
