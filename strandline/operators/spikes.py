"""Implausible readings by state-space forecasting per source.

Each source has a local-level model of the logarithm of its price: the level
moves by a variance ``q`` a row, a reading adds noise of variance ``r``. Both are
estimated from the source's own innovations: those of the noise-free filter,
``d``, have variance ``q + 2 r`` and covariance ``-r`` with the one before. A
Kalman filter forecasts each reading; an innovation above ``threshold`` of its
stationary standard deviations is flagged and its update withheld. Sound returns
are known steps of the level. From a flagged reading two filters go on, one that
withheld it and one that takes it and those after it. Where a reading within ``back_within`` rows has
the smaller innovation under the first, the readings up to it are spikes;
otherwise the level has moved for good and the second filter holds.

A return is a reading of the level's step. One whose own innovation is above the
threshold is wrong unless the filtered step is nearer to it than to none; one
after a withheld price is wrong if its innovation is smaller under the step from
that price than under the filtered step.

Readings are stuck where innovation variance vanishes: the innovations of the
noise-free filter, of prices or of returns, have a root mean square of at most
``vanish`` standard deviations over ``stuck_rows - 1`` rows.

The recursion is sequential per source, so a source is cut into segments of
``segment`` rows with rows of warm-up before and look-ahead after; row numbers
come from per-block counts, never from one sort of a whole source. Daily rows by
block are written to the shared folder once, and segments of arrays once.
Segments are padded into matrices and filtered side by side, one vector step per
row.

Defined results
    Repeated (source, date) rows count once, with the largest values (null only
    if all are null). Rows without source or date are left out; a null or NaN
    reading is no case and breaks a run of stuck readings; returns of zero are
    not stuck. A source without two sound innovations has no variance: only
    impossible and stuck (then: equal) readings are found. Empty tables give an
    empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.joins import join_counted
from strandline.functions.scalars import clean_ticker
from strandline.session import stored

CASE_SCHEMA = "ticker string, day int, impossible boolean, spike boolean, stuck boolean, innovation double"
SEGMENT_SCHEMA = "ticker string, part int, first int, day array<int>, p array<double>, r array<double>"
MOMENT_SCHEMA = "ticker string, kind string, size int, n double, s double, ss double, pairs double, product double"


@dataclass(frozen=True)
class SpikeRule:
    threshold: float = 10.0  #: standard deviations
    back_within: int = 3  #: rows within which a spike returns
    stuck_rows: int = 5  #: consecutive rows that make a run
    vanish: float = 1e-5  #: standard deviations below which innovations have vanished
    segment: int = 512  #: rows of a segment
    warm_up: int = 64  #: rows before it
    block_days: int = 256  #: days of a block in which rows are numbered

    @property
    def look_ahead(self) -> int:
        return max(self.back_within, self.stuck_rows) + 1


#: Natural logarithm of the width of the size classes by which innovations are summed.
CLASS = 0.1


def _logs(price: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isfinite(price) & (price > 0), np.log(np.where(price > 0, price, 1.0)), np.nan)


def _steps(values: np.ndarray) -> np.ndarray:
    """Innovations of the noise-free filter along axis 1; NaN where a reading or the one before is missing."""
    out = np.full_like(values, np.nan)
    out[:, 1:] = values[:, 1:] - values[:, :-1]
    return out


def _moments(price: np.ndarray, ret: np.ndarray, own: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, segment, class, sums) of the own innovations of segments: number, sum, squares, pairs and products of neighbours."""
    for kind, x in (("price", _steps(_logs(price))), ("return", np.where(np.isfinite(ret), ret, np.nan))):
        before = np.full_like(x, np.nan)
        before[:, 1:] = x[:, :-1]
        with np.errstate(invalid="ignore", divide="ignore"):
            size, largest = np.abs(x), np.maximum(np.abs(x), np.abs(before))
            for value, sums in ((size, lambda at: (np.ones(len(at[0])), x[at], x[at] ** 2, None, None)), (largest, lambda at: (None, None, None, np.ones(len(at[0])), x[at] * before[at]))):
                at = np.nonzero(own & (value > 0))
                yield kind, at[0], np.floor(np.log(value[at]) / CLASS).astype(np.int64), np.array([np.zeros(len(at[0])) if v is None else v for v in sums(at)])


def source_variances(moments: DataFrame) -> DataFrame:
    """(ticker, level, noise, spread): variances of level and noise and the standard deviation of returns.

    Innovations count as sound within ten robust deviations (median size /
    0.6745) of zero, and in a second step within eight of the standard
    deviations found so. They are summed by source and size class, classes a
    tenth wide; the limits fall on class edges. A source has some hundred
    classes, whatever its rows.
    """
    keys = ["ticker", "kind"]
    classes = moments.groupBy(*keys, "size").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss", "pairs", "product")))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = classes.withColumns({"reached": F.sum("n").over(upto), "all": F.sum("n").over(whole)})
    out = ranked.withColumn("limit", F.min(F.when(F.col("reached") * 2 >= F.col("all"), F.col("size"))).over(whole) + F.lit(np.log(10 / 0.6745) / CLASS))
    for factor in (8, None):
        n, s, ss, pairs, product = (F.sum(F.when(F.col("size") <= F.col("limit"), F.col(c))).over(whole) for c in ("n", "s", "ss", "pairs", "product"))
        variance = F.when(n > 1, F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0)))
        out = out.withColumns({"variance": variance, "covariance": F.coalesce(product / F.nullif(pairs, F.lit(0.0)) - (s / n) * (s / n), F.lit(0.0))})
        if factor:
            out = out.withColumn("limit", F.floor(F.ln(F.sqrt("variance") * factor) / F.lit(CLASS)))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    found = out.groupBy("ticker").agg(of("price", "variance").alias("v"), of("price", "covariance").alias("c"), of("return", "variance").alias("spread2"))
    v = F.coalesce(F.nullif("v", F.lit(0.0)), "spread2")
    # a level keeps at least a tenth of the variance: noise alone would freeze it
    noise = F.when(F.col("v") > 0, F.least(F.greatest(-F.col("c"), F.lit(0.0)), 0.45 * F.col("v"))).otherwise(0.0)
    return found.select("ticker", (v - 2 * noise).alias("level"), noise.alias("noise"), F.sqrt(F.coalesce(F.nullif("spread2", F.lit(0.0)), v)).alias("spread"))


def _vanished(innovation: np.ndarray, scale: np.ndarray, least: int) -> np.ndarray:
    """Rows of each stretch of ``least`` or more innovations whose mean square is at most ``scale`` squared."""
    n, t = innovation.shape
    out = np.zeros((n, t), bool)
    if t < least:
        return out
    square = np.where(np.isnan(innovation), np.inf, innovation**2)
    # windows by addition, so that one large innovation leaves no rounding in the next window
    total = sum(square[:, k : t - least + 1 + k] for k in range(least))
    small = total <= least * scale[:, None] ** 2
    for k in range(least):
        out[:, k : t - least + 1 + k] |= small
    return out


def _ahead(matrix: np.ndarray, k: int, fill: float | bool) -> np.ndarray:
    out = np.full_like(matrix, fill)
    out[:, : matrix.shape[1] - k] = matrix[:, k:]
    return out


def judge(price: np.ndarray, ret: np.ndarray, level: np.ndarray, noise: np.ndarray, spread: np.ndarray, rule: SpikeRule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(impossible, spike, stuck, standardised innovation) of padded matrices of series; NaN is no reading."""
    n, t = price.shape
    impossible = np.isinf(price) | (price <= 0) | np.isinf(ret)
    y = _logs(price)
    valid = ~np.isnan(y)
    known = np.isfinite(level) & (level > 0) & np.isfinite(spread) & (spread > 0)
    q, noise, spread = np.where(known, level, 1.0), np.where(known, noise, 0.0), np.where(known, spread, 1.0)
    # variance of the filtered level and of innovations once the gain stands still
    settled = (np.sqrt(q * q + 4 * q * noise) - q) / 2
    scale = np.sqrt(settled + q + noise)
    gone = rule.vanish * np.where(known, scale, 0.0), rule.vanish * np.where(known, spread, 0.0)
    with np.errstate(invalid="ignore"):
        moving = np.where(np.isfinite(ret) & (np.abs(ret) > gone[1][:, None]), ret, np.nan)
    stuck = _vanished(_steps(y), gone[0], rule.stuck_rows - 1) | _vanished(_steps(moving), gone[1], rule.stuck_rows - 1)
    # the level starts at the median of the first readings, so that a wrong first reading is seen
    rank = np.cumsum(valid, axis=1)
    with np.errstate(all="ignore"):
        start = np.where(valid & (rank <= 5), y, np.nan)
        middle = np.nanmedian(np.where(rank[:, -1:] > 0, start, 0.0), axis=1)
    first = np.take_along_axis(y, np.argmax(valid, axis=1)[:, None], axis=1)[:, 0]
    limit, far = rule.threshold * scale, rule.threshold * spread
    x, p = np.where(np.abs(first - middle) <= limit, first, middle), settled.copy()
    spike = np.zeros((n, t), bool)
    held = np.zeros((n, t + rule.back_within), bool)  # rows of a spike that has not returned yet
    forecast, innovation = np.full((n, t), np.nan), np.full((n, t), np.nan)
    # a sound return is a known step of the level, unless it starts from a withheld reading
    with np.errstate(invalid="ignore"):
        way = np.where(np.isfinite(ret) & (np.abs(ret) <= far[:, None]), ret, 0.0)
    ahead = [(_ahead(y, k, np.nan), _ahead(valid, k, False)) for k in range(1, rule.back_within + 1)]
    for j in range(t):
        p = p + q
        forecast[:, j] = x
        x = x + np.where(spike[:, j - 1], 0.0, way[:, j]) if j else x
        v = y[:, j] - x
        innovation[:, j] = v / scale
        with np.errstate(invalid="ignore"):
            flagged = valid[:, j] & (np.abs(v) > limit) & ~held[:, j]
        taken = flagged
        if flagged.any():
            returns_at, any_ahead, other = np.zeros(n, np.int64), np.zeros(n, bool), y[:, j]
            with np.errstate(invalid="ignore"):
                for k, (later, there) in enumerate(ahead, 1):
                    withheld, followed = np.abs(later[:, j] - x), np.abs(later[:, j] - other)
                    other = np.where(there[:, j], later[:, j], other)
                    returns_at = np.where((returns_at == 0) & there[:, j] & (withheld < followed), k, returns_at)
                    any_ahead |= there[:, j]
                # nothing follows: the reading's own return decides between the two
                backed = np.abs(ret[:, j] - v) < np.abs(ret[:, j])
            wrong = flagged & np.where(any_ahead, returns_at > 0, ~backed)
            for k in range(1, rule.back_within):
                held[:, j + k] |= wrong & (returns_at > k)
            spike[:, j], taken = wrong, flagged & ~wrong
        spike[:, j] |= held[:, j] & valid[:, j]
        use = valid[:, j] & ~spike[:, j]
        gain = np.where(taken, 1.0, p / (p + noise))
        x = np.where(use, x + gain * np.nan_to_num(v), x)
        p = np.where(use, np.where(taken, noise, (1 - gain) * p), p)
    # the level each return leads to: its own reading, or the next one that was not withheld
    seen = valid & ~spike
    reached = np.where(seen, y, np.nan)
    for k in range(1, rule.back_within + 1):
        reached = np.where(~seen & ~spike & np.isnan(reached), _ahead(np.where(spike, np.nan, y), k, np.nan), reached)
    with np.errstate(invalid="ignore"):
        step = reached - forecast
        far_off = np.isfinite(ret) & (np.abs(ret) > far[:, None])
        unfollowed = far_off & ~(np.abs(ret - step) < np.abs(step))
        before = np.full((n, t), np.nan)
        before[:, 1:] = np.where(spike[:, :-1], y[:, :-1], np.nan)
        derived = np.isfinite(ret) & (np.abs(ret - (y - before)) < np.abs(ret - step))
    return impossible, (spike | unfollowed | derived) & known[:, None], stuck, innovation


def daily_blocks(frame: DataFrame, rule: SpikeRule) -> DataFrame:
    """(ticker, block, day, p, r): each block's days in order as arrays, repeats counted once; one shuffle."""
    nothing = F.lit(float("nan"))
    return (
        frame.select(
            clean_ticker("ticker").alias("ticker"),
            F.datediff(F.col("date").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
            F.col("adj_close").cast("double").alias("p"),
            F.col("log_return").cast("double").alias("r"),
        )
        .where("ticker is not null and day is not null")
        .withColumn("block", F.floor(F.col("day") / F.lit(float(rule.block_days))).cast("int"))
        .repartition("ticker", "block")
        .groupBy("ticker", "block", "day")
        .agg(F.max("p").alias("p"), F.max("r").alias("r"))
        .groupBy("ticker", "block")
        .agg(F.sort_array(F.collect_list(F.struct("day", F.coalesce("p", nothing).alias("p"), F.coalesce("r", nothing).alias("r")))).alias("rows"))
        .select("ticker", "block", *(F.col(f"rows.{x}").alias(x) for x in ("day", "p", "r")))
    )


def segments(blocks: DataFrame, rule: SpikeRule) -> DataFrame:
    """(ticker, part, first, day, p, r): segments of rows by number, with warm-up and look-ahead; ``first`` numbers the first row."""
    sized = blocks.withColumn("rows", F.size("day"))
    earlier = Window.partitionBy("ticker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # blocks of a source, not rows; they join by block, so no source meets itself in one task
    offsets = sized.select("ticker", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("int").alias("offset"))
    length, last = F.lit(float(rule.segment)), F.col("offset") + F.col("rows")
    parts = F.sequence(F.greatest(F.floor((F.col("offset") - rule.look_ahead) / length), F.lit(0)).cast("int"), F.floor((last - 1 + rule.warm_up) / length).cast("int"))
    cut = sized.join(offsets, ["ticker", "block"]).withColumn("part", F.explode(parts))
    low, high = F.greatest(F.col("part") * rule.segment - rule.warm_up, F.col("offset")), F.least((F.col("part") + 1) * rule.segment + rule.look_ahead, last)
    pieces = cut.withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low < high")
    own = lambda c: F.slice(c, F.col("low") - F.col("offset") + 1, F.col("high") - F.col("low")).alias(c)
    gathered = pieces.groupBy("ticker", "part").agg(
        F.sort_array(F.collect_list(F.struct("low", own("day"), own("p"), own("r")))).alias("rows"), F.min("low").alias("first"), F.max("high").alias("high")
    )
    holds = (F.col("high") > F.col("part") * rule.segment) & (F.col("first") < (F.col("part") + 1) * rule.segment)
    return gathered.where(holds).select("ticker", "part", "first", *(F.flatten(f"rows.{x}").alias(x) for x in ("day", "p", "r")))


def _padded(batch: pa.RecordBatch, rule: SpikeRule, together: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part of the batch, price, return, day, own) as matrices of segments."""
    for start in range(0, batch.num_rows, together):
        part = batch.slice(start, together)
        take = lambda x: part.column(part.schema.get_field_index(x))  # noqa: B023, E731
        size = np.diff(take("day").offsets.to_numpy())
        shape = (len(size), int(size.max()))
        inside = np.arange(shape[1]) < size[:, None]
        price, ret, day = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, np.int32)
        for matrix, name in ((price, "p"), (ret, "r"), (day, "day")):
            matrix[inside] = take(name).flatten().to_numpy(zero_copy_only=False)
        number = take("first").to_numpy()[:, None] + np.arange(shape[1]) - take("part").to_numpy()[:, None].astype(np.int64) * rule.segment
        yield part, price, ret, day, inside & (number >= 0) & (number < rule.segment)


def segment_moments(parts: DataFrame, rule: SpikeRule) -> DataFrame:
    """Sums of the innovations of each segment by size class."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, price, ret, _, own in _padded(batch, rule):
                # one number per source of the batch, so that its segments add up here
                source = part.column(part.schema.get_field_index("ticker")).dictionary_encode()
                codes = source.indices.to_numpy()
                for kind, segment, size, sums in _moments(price, ret, own):
                    if not len(size):
                        continue
                    low = int(size.min())
                    keys, at = np.unique(codes[segment].astype(np.int64) * 100_000 + (size - low), return_inverse=True)
                    total = [np.bincount(at, x, len(keys)) for x in sums]
                    yield pa.RecordBatch.from_arrays(
                        [source.dictionary.take(pa.array(keys // 100_000)), pa.array([kind] * len(keys)), pa.array((keys % 100_000 + low).astype(np.int32)), *map(pa.array, total)],
                        names=[x.split()[0] for x in MOMENT_SCHEMA.split(", ")],
                    )

    return parts.mapInArrow(measure, MOMENT_SCHEMA)


def find_cases(frame: DataFrame, rule: SpikeRule | None = None) -> DataFrame:
    """(ticker, date, impossible, spike, stuck, innovation) of every row that is a case."""
    rule = rule or SpikeRule()
    parts = stored(segments(stored(daily_blocks(frame, rule), "blocks"), rule), "segments")
    # one narrow row per source, sent along where counted few: segments of a hot source stay apart
    judged = join_counted(parts, stored(source_variances(segment_moments(parts, rule)), "variances"), ["ticker"], "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, price, ret, day, own in _padded(batch, rule):
                take = lambda x: part.column(part.schema.get_field_index(x))  # noqa: B023, E731
                variances = (take(x).to_numpy(zero_copy_only=False).astype(float) for x in ("level", "noise", "spread"))
                impossible, spike, stuck, innovation = judge(price, ret, *variances, rule)
                row, at = np.nonzero((impossible | spike | stuck) & own)
                got = innovation[row, at]
                yield pa.RecordBatch.from_arrays(
                    [take("ticker").take(pa.array(row)), pa.array(day[row, at]), *(pa.array(x[row, at]) for x in (impossible, spike, stuck)), pa.array(got, mask=np.isnan(got))],
                    names=[x.split()[0] for x in CASE_SCHEMA.split(", ")],
                )

    found = judged.mapInArrow(scan, CASE_SCHEMA)
    return found.select("ticker", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("date"), "impossible", "spike", "stuck", "innovation")
