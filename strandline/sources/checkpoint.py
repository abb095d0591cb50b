"""Fingerprinted, resumable results: one Parquet folder and one JSON per unit of work.

A store belongs to one fingerprint, a hash of everything that determines its
results. A unit counts as done when its JSON is there; that is written last.
Units are independent, so a lost or failed run resumes with the missing ones.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.snapshots import MANIFEST, package_versions
from strandline.sources.storage import Folder, file_records

FORMAT = 1
_DIGEST = re.compile(r"[0-9a-f]{64}")
_UNIT = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def fingerprint(payload: Mapping[str, object]) -> str:
    """SHA-256 of the payload as JSON with sorted keys, with format and library versions."""
    whole = {"format": FORMAT, "software": package_versions(), "payload": payload}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, default=str).encode()).hexdigest()


def canonical(frame: DataFrame) -> Column:
    """A row as text in which no two rows are alike: every value with its length, by the shortest digits that read back, nulls marked."""
    parts = []
    for name, kind in sorted(frame.dtypes):
        column = F.col(f"`{name}`")
        text = F.to_json(F.struct(column)) if kind.startswith(("array", "map", "struct")) else column.cast("string")
        parts.append(F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def content_digest(frame: DataFrame) -> str:
    """SHA-256 of a table's rows, whatever their order: row digests in four parts, summed, and the row count.

    The sums combine across partitions, so nothing is sorted or collected.
    """
    columns = sorted(frame.columns)
    digest = F.sha2(canonical(frame), 256)
    parts = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("string") for x in parts]
    got = frame.agg(F.count("*").cast("string"), *sums).first()
    return hashlib.sha256("|".join([*columns, *got]).encode()).hexdigest()


class CheckpointStore:
    """``root/manifest.json`` with the fingerprint, ``root/units/<name>`` data and ``<name>.json``."""

    def __init__(self, spark: SparkSession, root: object, mark: str) -> None:
        if not _DIGEST.fullmatch(mark):
            raise ValueError("fingerprint must be a SHA-256 digest")
        self.spark, self.mark = spark, mark
        self.folder, self.units = Folder(spark, root), Folder(spark, f"{root}/units")
        self.units.make()
        if self.folder.exists(MANIFEST):
            if self._json(self.folder, MANIFEST).get("fingerprint") != mark:
                raise ValueError("the store belongs to another fingerprint")
        else:
            self.folder.write_text(MANIFEST, json.dumps({"format": FORMAT, "fingerprint": mark}))
        self._check_entries()

    @staticmethod
    def _json(folder: Folder, name: str) -> dict:
        try:
            got = json.loads(folder.read_text(name))
        except (Py4JJavaError, json.JSONDecodeError) as error:
            raise ValueError(f"{name} cannot be read") from error
        if not isinstance(got, dict):
            raise ValueError(f"{name} is malformed")
        return got

    def _check_entries(self) -> None:
        """Only known entries; half-written units (data without JSON) are cleared."""
        for name in self.folder.names():
            if name not in ("units", MANIFEST) and not name.endswith(".tmp"):
                raise ValueError(f"unexpected entry {name}")
        names = self.units.names()
        for name in names:
            if self.units.is_folder(name):
                if f"{name}.json" not in names:
                    self.units.delete(name)
            elif name.endswith(".json"):
                if name.removesuffix(".json") not in names:
                    raise ValueError(f"{name} has no data")
            elif not name.endswith(".tmp"):
                raise ValueError(f"unexpected entry {name}")

    def done(self) -> list[str]:
        return [n.removesuffix(".json") for n in self.units.names() if n.endswith(".json")]

    def save(self, unit: str, frame: DataFrame, extra: Mapping[str, object] | None = None) -> None:
        if not _UNIT.fullmatch(unit):
            raise ValueError("not a unit name")
        path = self.units.child(unit)
        frame.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(frame.schema).parquet(path).count()
        parts = file_records(self.spark, self.units.path, unit)
        record = {"unit": unit, "fingerprint": self.mark, "rows": rows, "columns": frame.columns, "parts": parts, "extra": dict(extra or {})}
        self.units.write_text(f"{unit}.json", json.dumps(record, sort_keys=True, default=str))

    def load(self, unit: str) -> tuple[DataFrame, dict]:
        record = self._json(self.units, f"{unit}.json")
        if record.get("unit") != unit or record.get("fingerprint") != self.mark:
            raise ValueError(f"{unit} was written by another run")
        if record.get("parts") != file_records(self.spark, self.units.path, unit):
            raise ValueError(f"files of {unit} differ from its record")
        frame = self.spark.read.parquet(self.units.child(unit))
        if frame.columns != record.get("columns") or frame.count() != record.get("rows"):
            raise ValueError(f"{unit} differs from its record")
        return frame, record["extra"]

    def run_named(self, family: str, work: Mapping[str, Callable[[], DataFrame]], progress: Callable[[str, bool], None] | None = None, together: int = 4) -> DataFrame:
        """Computes the units of a family that are missing, ``together`` at a time, and returns the union of all, verified."""
        done = set(self.done())
        unknown = {u for u in done if u.startswith(f"{family}-")} - {f"{family}-{name}" for name in work}
        if unknown:
            raise ValueError(f"unknown units: {', '.join(sorted(unknown))}")

        def run(item: tuple[str, Callable[[], DataFrame]]) -> None:
            unit = f"{family}-{item[0]}"
            if unit not in done:
                self.save(unit, item[1]())
            if progress:
                progress(unit, unit in done)

        # units are small jobs: several run side by side, so that one ticker's tail does not hold up the rest
        with ThreadPoolExecutor(together) as pool:
            list(pool.map(run, work.items()))
        return functools.reduce(DataFrame.unionByName, [self.load(f"{family}-{name}")[0] for name in work])

    def keep(self, unit: str, frame: DataFrame) -> DataFrame:
        """Saves a table computed from other units, or, where it is there, computes it again and compares."""
        if unit not in self.done():
            self.save(unit, frame)
        kept, _ = self.load(unit)
        if not same_rows(kept, frame):
            raise ValueError(f"{unit} differs from what its parts give")
        return kept


def missing_units(store: CheckpointStore, units: Iterable[str]) -> list[str]:
    return [u for u in units if u not in set(store.done())]


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, as multisets, by digest."""
    return sorted(left.columns) == sorted(right.columns) and content_digest(left) == content_digest(right)
