"""Trailing totals from segment trees per entity and time shard.

An entity's calendar is cut into shards of ``own`` days. Each shard holds one
segment tree over its own days and the ``halo`` days before them, so every
trailing window that ends in the shard lies in one tree: one shuffle on
(entity, shard) serves all windows, and a hot entity is spread over its shards.
A tree is three heap-ordered arrays (sum, count of finite readings, count of
non-finite ones): node ``i`` covers nodes ``2 i`` and ``2 i + 1``, leaves start
at ``leaves``. A late correction rewrites a leaf and its ``log2(leaves)``
ancestors and nothing else.

Defined results
    A day without a reading adds nothing: its total is 0.0 if the window is
    empty, its mean null. Null and NaN readings are no readings. Infinite ones
    are left out of total and mean and counted in ``nonfinite``. Rows without
    entity or date are left out; several rows of one (entity, date) count once,
    with the largest finite value. An empty table gives an empty result. Other
    columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.joins import join_counted
from strandline.session import stored

#: Shards with corrections that may be sent along: some 40 MB with all their days.
MOST_SHARDS = 10_000
TREE_SCHEMA = "entity string, shard int, first_day int, last_day int, sums array<double>, counts array<int>, nonfinite array<int>"


@dataclass(frozen=True)
class TreeLayout:
    """Shape of the trees: ``leaves`` a power of two of at least twice the longest window."""

    windows: tuple[int, ...] = (7, 30)
    leaves: int = 256

    def __post_init__(self) -> None:
        if self.leaves & (self.leaves - 1) or self.leaves < 2:
            raise ValueError("leaves must be a power of two")
        if not self.windows or min(self.windows) < 1 or len(set(self.windows)) != len(self.windows):
            raise ValueError("windows must be distinct positive day counts")
        if self.own < self.halo:
            raise ValueError("a tree must hold twice the longest window, so that a day is in at most two trees")

    @property
    def halo(self) -> int:
        return max(self.windows) - 1

    @property
    def own(self) -> int:
        return self.leaves - self.halo

    def cover(self, left: int, right: int) -> list[int]:
        """The nodes that exactly cover the leaves ``left..right``."""
        nodes: list[int] = []
        low, high = left + self.leaves, right + self.leaves + 1
        while low < high:
            if low & 1:
                nodes.append(low)
                low += 1
            if high & 1:
                high -= 1
                nodes.append(high)
            low >>= 1
            high >>= 1
        return nodes

    def covers(self, window: int) -> np.ndarray:
        """Cover of the window that ends at each own day, padded with node 0, which is always zero."""
        every = [self.cover(p - window + 1, p) for p in range(self.halo, self.leaves)]
        width = max(map(len, every))
        return np.array([x + [0] * (width - len(x)) for x in every], dtype=np.int64)


def _leaf_rows(rows: DataFrame, layout: TreeLayout) -> DataFrame:
    """Each (entity, day, value) at its place in its own shard and, near the end, in the next one's halo."""
    own, halo = layout.own, layout.halo
    shard = F.floor(F.col("day") / F.lit(float(own))).cast("int")
    place = F.col("day") - shard * own + halo
    homes = F.array(
        F.struct(shard.alias("shard"), place.cast("int").alias("place")),
        F.when(place >= own, F.struct((shard + 1).alias("shard"), (place - own).cast("int").alias("place"))),
    )
    return rows.select("entity", F.col("value").cast("double").alias("value"), F.explode(F.array_compact(homes)).alias("home")).select(
        "entity", "home.shard", "home.place", "value"
    )


def _daily(frame: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return frame.select(
        F.col(entity).cast("string").alias("entity"),
        F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
        F.when(~F.isnan(number), number).alias("value"),
    ).where(F.col("entity").isNotNull() & F.col("day").isNotNull())


def _grow(sums: np.ndarray) -> None:
    """Fills the inner nodes from the leaves, level by level."""
    half = sums.shape[1] // 4
    while half:
        sums[:, half : 2 * half] = sums[:, 2 * half : 4 * half].reshape(len(sums), half, 2).sum(axis=2)
        half //= 2


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each element of a list column without null lists."""
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def build_trees(frame: DataFrame, layout: TreeLayout, *, entity: str = "ticker", date: str = "date", value: str = "log_return") -> DataFrame:
    """One row per (entity, shard) from the entity's first to its last day, gaps included."""
    rows = _daily(frame, entity, date, value)
    span = rows.groupBy("entity").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    step = F.lit(float(layout.own))
    shards = F.sequence(F.floor(F.col("first_day") / step).cast("int"), F.floor(F.col("last_day") / step).cast("int"))
    frames = span.select("entity", F.explode(shards).alias("shard"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("value"), "first_day", "last_day")
    nothing = F.lit(None).cast("int")
    leaves = _leaf_rows(rows, layout).withColumns({"first_day": nothing, "last_day": nothing})
    finite = F.abs("value") < F.lit(float("inf"))
    gathered = (
        leaves.unionByName(frames)
        .repartition("entity", "shard")
        .groupBy("entity", "shard", "place")
        .agg(
            F.max(F.when(finite, F.col("value"))).alias("value"),
            F.max(F.when(~finite, F.lit(1))).alias("odd"),
            F.max("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
        .groupBy("entity", "shard")
        .agg(
            F.collect_list(
                F.when(
                    F.col("place").isNotNull() & (F.col("value").isNotNull() | F.col("odd").isNotNull()),
                    F.struct("place", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().cast("int").alias("good"), F.when(F.col("value").isNull(), F.lit(1)).otherwise(0).alias("odd")),
                )
            ).alias("leaf"),
            F.max("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
        .where(F.col("first_day").isNotNull())
        .select("entity", "shard", "first_day", "last_day", *(F.col(f"leaf.{x}").alias(x) for x in ("place", "value", "good", "odd")))
    )
    leaves_n = layout.leaves

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                n = batch.num_rows
                sums, counts, odd = np.zeros((n, 2 * leaves_n)), np.zeros((n, 2 * leaves_n), np.int32), np.zeros((n, 2 * leaves_n), np.int32)
                row, place = _flat(_column(batch, "place"))
                at = (row, place + leaves_n)
                sums[at], counts[at], odd[at] = (_flat(_column(batch, x))[1] for x in ("value", "good", "odd"))
                for tree in (sums, counts, odd):
                    _grow(tree)
                yield pa.RecordBatch.from_arrays(
                    [*(_column(batch, x) for x in ("entity", "shard", "first_day", "last_day")), _lists(sums), _lists(counts), _lists(odd)],
                    names=["entity", "shard", "first_day", "last_day", "sums", "counts", "nonfinite"],
                )

    return gathered.mapInArrow(build, TREE_SCHEMA)


def correct_trees(trees: DataFrame, corrections: DataFrame, layout: TreeLayout, *, entity: str = "ticker", date: str = "date", value: str = "log_return") -> DataFrame:
    """Trees after late rows: each row sets its day's reading (null removes it).

    Only the leaf of the day and its ancestors are recomputed, in the one or
    two trees that hold the day. Other trees pass by untouched: where the shards
    with corrections are counted few they are sent along and no tree is
    shuffled. Corrections move neither first nor last day; a day outside its
    entity's trees is ignored. Of several corrections of one day the largest
    value holds.
    """
    touched, others = _touched(trees, corrections, layout, entity=entity, date=date, value=value)
    return touched.unionByName(others)


def _touched(trees: DataFrame, corrections: DataFrame, layout: TreeLayout, *, entity: str = "ticker", date: str = "date", value: str = "log_return") -> tuple[DataFrame, DataFrame]:
    """The corrected trees and those without corrections."""
    rows = _daily(corrections, entity, date, value)
    late = (
        _leaf_rows(rows, layout)
        .groupBy("entity", "shard", "place")
        .agg(F.max("value").alias("value"))
        .groupBy("entity", "shard")
        .agg(F.collect_list(F.struct("place", F.coalesce("value", F.lit(float("nan"))).alias("value"))).alias("late"))
        .select("entity", "shard", F.col("late.place").alias("place"), F.col("late.value").alias("late"))
    )
    leaves_n = layout.leaves
    late = stored(late, "corrections")
    touched = join_counted(trees, late, ["entity", "shard"], most_rows=MOST_SHARDS)
    others = join_counted(trees, late.select("entity", "shard"), ["entity", "shard"], "left_anti", most_rows=MOST_SHARDS)

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sums, counts, odd = (_flat(_column(batch, x))[1].reshape(n, 2 * leaves_n).copy() for x in ("sums", "counts", "nonfinite"))
            row, place = _flat(_column(batch, "place"))
            new = _flat(_column(batch, "late"))[1]
            good, node = np.isfinite(new), place.astype(np.int64) + leaves_n
            sums[row, node], counts[row, node], odd[row, node] = np.where(good, new, 0.0), good, np.isinf(new)
            while len(node) and node[0] > 1:
                node = node >> 1
                for tree in (sums, counts, odd):
                    tree[row, node] = tree[row, 2 * node] + tree[row, 2 * node + 1]
            yield pa.RecordBatch.from_arrays(
                [*(_column(batch, x) for x in ("entity", "shard", "first_day", "last_day")), _lists(sums), _lists(counts), _lists(odd)],
                names=["entity", "shard", "first_day", "last_day", "sums", "counts", "nonfinite"],
            )

    return touched.mapInArrow(correct, TREE_SCHEMA), others


def store_trees(trees: DataFrame, path: str) -> None:
    """Writes trees as edition 0 of a table over which corrections are laid."""
    trees.write.parquet(f"{path}/edition=0")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Every tree of a stored table in its last edition; only trees of later editions are compared."""
    every = spark.read.schema(f"{TREE_SCHEMA}, edition int").option("basePath", path).parquet(f"{path}/edition=*")
    newest = Window.partitionBy("entity", "shard").orderBy(F.desc("edition"))  # one row per edition
    later = every.where("edition > 0").withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place")
    base = join_counted(every.where("edition = 0"), later.select("entity", "shard"), ["entity", "shard"], "left_anti", most_rows=MOST_SHARDS)
    return base.unionByName(later).drop("edition")


def correct_stored(spark: SparkSession, path: str, corrections: DataFrame, layout: TreeLayout, **names: str) -> int:
    """Lays corrections over a stored table: writes the touched trees alone, as the next edition; its number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    edition = 1 + max(int(f.getPath().getName().partition("=")[2]) for f in listed if f.getPath().getName().startswith("edition="))
    touched, _ = _touched(read_trees(spark, path), corrections, layout, **names)
    touched.write.parquet(f"{path}/edition={edition}")
    return edition


def trailing_totals(trees: DataFrame, layout: TreeLayout) -> DataFrame:
    """One row per entity and calendar day: total, mean, readings and non-finite readings of each window."""
    columns = ", ".join(f"total_{w}d double, mean_{w}d double, readings_{w}d bigint, nonfinite_{w}d bigint" for w in layout.windows)
    covers, own, halo, width = [layout.covers(w) for w in layout.windows], layout.own, layout.halo, 2 * layout.leaves
    names = ["entity", "date", *(f"{x}_{w}d" for w in layout.windows for x in ("total", "mean", "readings", "nonfinite"))]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                n = batch.num_rows
                sums, counts, odd = (_flat(_column(batch, x))[1].reshape(n, width) for x in ("sums", "counts", "nonfinite"))
                shard, first, last = (_column(batch, x).to_numpy().astype(np.int64)[:, None] for x in ("shard", "first_day", "last_day"))
                day = shard * own + np.arange(own)
                keep = (day >= first) & (day <= last)
                out: list[pa.Array] = [
                    _column(batch, "entity").take(pa.array(np.nonzero(keep)[0])),
                    pa.array(day[keep].astype(np.int32)).cast(pa.date32()),
                ]
                for cover in covers:
                    total, count = sums[:, cover].sum(axis=2)[keep], counts[:, cover].sum(axis=2)[keep].astype(np.int64)
                    some = count > 0
                    out += [
                        pa.array(total),
                        pa.array(np.divide(total, count, where=some, out=np.zeros_like(total)), mask=~some),
                        pa.array(count),
                        pa.array(odd[:, cover].sum(axis=2)[keep].astype(np.int64)),
                    ]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return trees.mapInArrow(answer, f"entity string, date date, {columns}")


def rolling_totals(frame: DataFrame, layout: TreeLayout | None = None, *, entity: str = "ticker", date: str = "date", value: str = "log_return") -> DataFrame:
    """Builds the trees and answers every day; see the module's text for nulls, gaps and repeats."""
    layout = layout or TreeLayout()
    return trailing_totals(build_trees(frame, layout, entity=entity, date=date, value=value), layout).withColumnRenamed("entity", entity)
