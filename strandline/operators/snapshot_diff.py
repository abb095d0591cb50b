"""Rows added, removed and changed between consecutive full snapshots.

Every snapshot of a source gets its index in the source's order of delivery.
One window per (source, key), ordered by that index, sees the snapshots that
hold the key: a missing predecessor index is an addition, a missing successor
index a removal, and a lagged content code that differs a change. The content
code is the compared value rounded to ``digits`` = 10 significant digits, in 64
bits: a tolerance of half a unit of the tenth digit, for prices that carry binary
noise. Values on two sides of a rounding edge differ, however close; prices of
fewer digits do not come near one. One shuffle on (source, key) carries everything; a group is one key of
one source, at most as long as the source has snapshots.

Defined results
    The first snapshot of a source gives no rows. A notice without snapshot,
    source or readable instant is left out, as are snapshots without notice.
    Repeated notices of one snapshot count once, at the latest instant written
    (an instant cut to milliseconds is earlier than the full one); equal
    instants are ordered by snapshot id. Repeated rows of one key in a snapshot
    count once, with the largest value (null only if all are null). Null equals
    null and differs from any number. A listed snapshot without rows has lost
    all rows of the one before. Rows without a key part are left out. Empty
    tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import clean_ticker, significant_code


def read_instant(column: Column | str) -> Column:
    """ISO 8601 in its usual notations as TIMESTAMP; without offset it counts as UTC, unreadable text gives null."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.upper(F.btrim(column))
    text = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=T|\s|$)", "$1-$2-$3")
    text = F.regexp_replace(text, r"([T\s])(\d{2})(\d{2})(\d{2})", "$1$2:$3:$4")
    text = F.regexp_replace(text, r"([T\s]\d{2}:\d{2}(?::\d{2})?),(\d+)", "$1.$2")
    text = F.regexp_replace(text, r"([T\s]\d{2}\S*?)\s*([+-]\d{2}):?(\d{2})?$", "$1$2:$3")
    text = F.regexp_replace(text, r"([T\s].*[+-]\d{2}):$", "$1:00")
    text = F.regexp_replace(text, r"([T\s]\d{2}:\d{2})(?=\s?(?:Z|UTC|[+-])|$)", "$1:00")
    text = F.when(text.rlike(r"[T\s]\d{2}.*(Z|UTC|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}Z$"), F.concat(F.substring(text, 1, 10), F.lit("T00:00:00Z"))).otherwise(text)
    return text.try_cast("timestamp")


def delivery_order(manifest: DataFrame, *, source: str = "raw_dir", snapshot: str = "snapshot_id", instant: str = "created_at_utc") -> DataFrame:
    """Snapshots of each source with index, successor and the source's number of snapshots.

    The window spans the notices of one source: one row per delivery, not data.
    """
    order = Window.partitionBy("source").orderBy("instant", "snapshot_id")
    return (
        manifest.select(F.col(source).alias("source"), F.col(snapshot).alias("snapshot_id"), read_instant(instant).alias("instant"))
        .where(F.col("source").isNotNull() & F.col("snapshot_id").isNotNull() & F.col("instant").isNotNull())
        .groupBy("source", "snapshot_id")
        .agg(F.max("instant").alias("instant"))
        .select("source", "snapshot_id", F.row_number().over(order).alias("position"), F.lead("snapshot_id").over(order).alias("next_snapshot"))
    )


def snapshot_changes(
    rows: DataFrame,
    manifest: DataFrame,
    *,
    source: str = "raw_dir",
    snapshot: str = "snapshot_id",
    instant: str = "created_at_utc",
    digits: int = 10,
) -> DataFrame:
    """(snapshot_id, source, ticker, date, change) of each row that differs from the snapshot before."""
    order = delivery_order(manifest, source=source, snapshot=snapshot, instant=instant)
    price = F.col("adj_close").cast("double")
    keyed = (
        rows.select(F.col(snapshot).alias("snapshot_id"), clean_ticker("ticker").alias("ticker"), F.col("date").cast("date").alias("date"), price.alias("adj_close"))
        .where(F.col("ticker").isNotNull() & F.col("date").isNotNull())
        .join(order, "snapshot_id")
        .repartition("source", "ticker", "date")
        .groupBy("source", "ticker", "date", "position", "snapshot_id", "next_snapshot")
        .agg(F.max("adj_close").alias("adj_close"))
        .withColumn("code", significant_code("adj_close", digits))
    )
    key = Window.partitionBy("source", "ticker", "date").orderBy("position")
    before, code_before, after = F.lag("position").over(key), F.lag("code").over(key), F.lead("position").over(key)
    seen = keyed.withColumns({"before": before, "code_before": code_before, "after": after})
    position = F.col("position")
    appeared = (position > 1) & (F.col("before").isNull() | (F.col("before") < position - 1))
    changed = (F.col("before") == position - 1) & (F.col("code") != F.col("code_before"))
    vanished = F.col("next_snapshot").isNotNull() & (F.col("after").isNull() | (F.col("after") > position + 1))
    event = lambda at, what: F.struct(F.col(at).alias("snapshot_id"), F.lit(what).alias("change"))
    events = F.array(
        F.when(appeared, event("snapshot_id", "added")).when(changed, event("snapshot_id", "changed")),
        F.when(vanished, event("next_snapshot", "removed")),
    )
    return seen.select("source", "ticker", "date", F.explode(F.array_compact(events)).alias("event")).select(
        "event.snapshot_id", "source", "ticker", "date", "event.change"
    )
