"""Verified snapshots: a manifest beside the data, written last and checked on reading.

Data is Parquet by default and CSV where text is wanted (ten significant digits
and ISO dates, as one deterministic file). The manifest holds rows, bytes and
SHA-256 of every file; a file is hashed where it is read, in tasks.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib.metadata
import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.contracts import require_columns, validate_prices
from strandline.operators.returns import model_dataset
from strandline.schema import PRICE_COLUMNS, SPLITS, SplitConfig
from strandline.sources.storage import Folder, file_records

PRICE_DDL = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double, dividends double, stock_splits double"
MANIFEST = "manifest.json"
_NAME = re.compile(r"[/\\\0]")


def normalize_ticker(name: str) -> str:
    """Trimmed upper case; empty names and names that would leave a folder are refused."""
    name = name.strip().upper()
    if not name or _NAME.search(name):
        raise ValueError("not a ticker")
    return name


@dataclass(frozen=True)
class SnapshotConfig:
    tickers: tuple[str, ...]
    start: date
    end: date
    interval: str = "1d"
    min_observations: int = 1
    source: str = "files"

    def __post_init__(self) -> None:
        object.__setattr__(self, "tickers", tuple(dict.fromkeys(map(normalize_ticker, self.tickers))))
        if not self.tickers:
            raise ValueError("no tickers")
        if not self.start < self.end:
            raise ValueError("start must lie before end")
        if type(self.min_observations) is not int or self.min_observations < 1:
            raise ValueError("min_observations must be a positive integer")


class PriceSource(Protocol):
    """Where prices come from; a vendor's client or files."""

    def read(self, spark: SparkSession, config: SnapshotConfig) -> DataFrame: ...


@dataclass(frozen=True)
class FileSource:
    """Prices in files of any format Spark reads, long form with vendor column names."""

    path: str
    format: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, config: SnapshotConfig) -> DataFrame:
        return normalize_vendor(spark.read.format(self.format).options(**self.options).load(self.path))


def normalize_vendor(frame: DataFrame, ticker: str | None = None) -> DataFrame:
    """Vendor columns to the panel's: snake case, dates without time, missing actions zero, known columns only.

    A column named ``<field>|<ticker>`` belongs to one ticker of a wide frame;
    such frames are unpivoted with one pass over the rows.
    """
    wide = [c.split("|", 1) for c in frame.columns if "|" in c]
    if wide:
        date_column = next(c for c in frame.columns if "|" not in c)
        tickers = list(dict.fromkeys(t for _, t in wide))
        fields = list(dict.fromkeys(f for f, _ in wide))
        parts = F.array(
            *(F.struct(F.lit(t).alias("ticker"), *(F.col(f"`{f}|{t}`").cast("double").alias(f) if [f, t] in wide else F.lit(None).cast("double").alias(f) for f in fields)) for t in tickers)
        )
        frame = frame.select(F.col(date_column).alias("date"), F.explode(parts).alias("p")).select("date", "p.*")
    named = frame.toDF(*(re.sub(r"[^0-9a-z]+", "_", c.strip().lower()).strip("_") for c in frame.columns))
    if ticker is not None:
        named = named.withColumn("ticker", F.lit(normalize_ticker(ticker)))
    require_columns(named, ("date", "ticker", "open", "high", "low", "close", "adj_close", "volume"))
    for action in ("dividends", "stock_splits"):
        named = named.withColumn(action, F.coalesce(F.col(action).cast("double"), F.lit(0.0)) if action in named.columns else F.lit(0.0))
    typed = {c: F.col(c).cast("double") for c in PRICE_COLUMNS[2:]} | {"date": F.col("date").cast("date"), "ticker": F.upper(F.trim("ticker"))}
    return named.withColumns(typed).select(*PRICE_COLUMNS)


def package_versions(names: Iterable[str] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    out = {}
    for name in names:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = "absent"
    return out


def csv_line(frame: DataFrame) -> DataFrame:
    """Text columns with ten significant digits and ISO dates."""
    digits = lambda c: F.when(F.col(c).isNotNull(), F.regexp_replace(F.format_string("%.10g", F.col(c)), r"(\.\d*?)0+(e|$)|\.0+(e|$)", "$1$2$3"))
    plain = lambda c: F.regexp_replace(digits(c), r"\.(e|$)", "$1")
    return frame.select(*(plain(c).alias(c) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in frame.dtypes))


class SnapshotStore:
    """A folder with data files and ``manifest.json``, which is written last and atomically."""

    def __init__(self, spark: SparkSession, root: object) -> None:
        self.spark, self.folder = spark, Folder(spark, root)

    def write(self, tables: Mapping[str, DataFrame], metadata: Mapping[str, object], *, force: bool = False, format: str = "parquet", order: Sequence[str] = ("ticker", "date")) -> dict:
        """All tables are computed and written before the manifest; nothing counts as written without it."""
        if self.folder.exists(MANIFEST) and not force:
            raise FileExistsError(f"{self.folder.path} holds a snapshot")
        self.folder.make()
        self.folder.delete(MANIFEST)
        files = {}
        for name, frame in tables.items():
            path = self.folder.child(name)
            if format == "csv":
                # one file by contract: a deterministic text copy for people, not for large tables
                csv_line(frame.orderBy(*order).coalesce(1)).write.mode("overwrite").option("header", True).csv(path)
            else:
                frame.write.mode("overwrite").parquet(path)
            files[name] = {"rows": self._read(name, frame.schema, format).count(), "columns": frame.columns, "parts": file_records(self.spark, self.folder.path, name)}
        manifest = {"created_at_utc": datetime.now(UTC).isoformat(), "format": format, "software": package_versions(), **metadata, "files": files}
        self.folder.write_text(MANIFEST, json.dumps(manifest, indent=2, sort_keys=True, default=str))
        return manifest

    def _read(self, name: str, schema, format: str) -> DataFrame:  # noqa: ANN001
        path = self.folder.child(name)
        return self.spark.read.schema(schema).option("header", True).csv(path) if format == "csv" else self.spark.read.schema(schema).parquet(path)

    def manifest(self) -> dict:
        try:
            manifest = json.loads(self.folder.read_text(MANIFEST))
        except (Py4JJavaError, json.JSONDecodeError) as error:
            raise ValueError("manifest cannot be read") from error
        if not isinstance(manifest, dict) or not isinstance(manifest.get("files"), dict):
            raise ValueError("manifest is malformed")
        return manifest

    def read(self, name: str, schema: str) -> DataFrame:
        """The table if files, bytes, hashes, columns and rows are as the manifest says."""
        manifest = self.manifest()
        record = manifest["files"].get(name)
        if not isinstance(record, dict) or type(record.get("rows")) is not int or record["rows"] < 0 or not isinstance(record.get("parts"), dict):
            raise ValueError(f"manifest has no sound record of {name}")
        if file_records(self.spark, self.folder.path, name) != record["parts"]:
            raise ValueError(f"files of {name} differ from the manifest")
        frame = self._read(name, schema, manifest.get("format", "parquet"))
        if frame.columns != record["columns"]:
            raise ValueError(f"columns of {name} differ from the manifest")
        if frame.count() != record["rows"]:
            raise ValueError(f"rows of {name} differ from the manifest")
        return frame


def build_raw(spark: SparkSession, source: PriceSource, config: SnapshotConfig, root: object, *, force: bool = False) -> dict:
    """Reads, validates and writes a raw snapshot; a failed check writes nothing."""
    window = (F.col("date") >= F.lit(config.start)) & (F.col("date") < F.lit(config.end))
    prices = source.read(spark, config).where(F.col("ticker").isin(*config.tickers) & window)
    validate_prices(prices, config.min_observations)
    found = {r[0] for r in prices.select("ticker").distinct().collect()}
    if found != set(config.tickers):
        raise ValueError("prices lack a ticker")
    described = {"tickers": list(config.tickers), "start": str(config.start), "end": str(config.end), "interval": config.interval, "min_observations": config.min_observations, "source": config.source}
    return SnapshotStore(spark, root).write({"prices": prices}, {"config": described}, force=force)


def build_processed(spark: SparkSession, raw_root: object, root: object, splits: SplitConfig, *, force: bool = False, format: str = "parquet") -> dict:
    """The model dataset of a raw snapshot, with split counts and the raw manifest's hash."""
    raw = SnapshotStore(spark, raw_root)
    dataset = model_dataset(raw.read("prices", PRICE_DDL).select("date", "ticker", "adj_close"), splits, validate=True)
    counts = {r["split"]: r["count"] for r in dataset.groupBy("split").count().collect()}
    bounds = {name: [str(a), str(b)] for name, (a, b) in splits.parts}
    metadata = {"source": {"manifest_sha256": hashlib.sha256(raw.folder.read_text(MANIFEST).encode()).hexdigest()}, "split_basis": "target_date", "split_config": bounds, "split_rows": counts}
    return SnapshotStore(spark, root).write({"dataset": dataset}, metadata, force=force, format=format, order=("ticker", "target_date"))


def parse_args(argv: Sequence[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strandline.sources", description="Build verified snapshots.")
    parts = parser.add_subparsers(dest="command", required=True)
    raw = parts.add_parser("raw")
    raw.add_argument("--input", required=True)
    raw.add_argument("--format", default="parquet")
    raw.add_argument("--tickers", nargs="+", required=True)
    raw.add_argument("--start", type=date.fromisoformat, required=True)
    raw.add_argument("--end", type=date.fromisoformat, required=True)
    raw.add_argument("--min-observations", type=int, default=1)
    processed = parts.add_parser("processed")
    processed.add_argument("--raw", required=True)
    processed.add_argument("--text", action="store_true")
    for name in SPLITS:
        processed.add_argument(f"--{name}", nargs=2, type=date.fromisoformat, metavar=("FIRST", "LAST"), help=f"dates of the {name} split")
    for part in (raw, processed):
        part.add_argument("--output", required=True)
        part.add_argument("--force", action="store_true")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    import sys

    args = parse_args(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "raw":
        options = {"header": "true", "inferSchema": "true"} if args.format == "csv" else {}
        config = SnapshotConfig(tuple(args.tickers), args.start, args.end, min_observations=args.min_observations, source=args.input)
        build_raw(spark, FileSource(args.input, args.format, options), config, args.output, force=args.force)
    else:
        build_processed(spark, args.raw, args.output, replace(SplitConfig(), **{n: tuple(getattr(args, n)) for n in SPLITS if getattr(args, n)}), force=args.force, format="csv" if args.text else "parquet")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
