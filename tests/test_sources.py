"""Snapshots, checkpoints, the final pipeline and streams."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.models.lstm import TrainingConfig
from strandline.operators import returns
from strandline.plans.pipeline import run_final, run_residual_backtest
from strandline.schema import InferenceConfig, NetworkConfig, Protocol, SplitConfig
from strandline.sources import snapshots
from strandline.sources.checkpoint import CheckpointStore, content_digest, fingerprint, missing_units, same_rows
from strandline.sources.storage import Folder, file_records
from strandline.streaming.online import FORECAST_DDL, batch_writer, online_forecasts, windowed_quality

D = date(2020, 1, 1)
VENDOR = "Date timestamp, Ticker string, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint"


def vendor(spark, n=40):
    rng = np.random.default_rng(0)
    rows = []
    for t in ("aaa", "BBB"):
        for k, p in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))):
            rows.append((datetime(2020, 1, 1, 5) + timedelta(k), t, p, p * 1.01, p * 0.99, p, p, 10 + k))
    return spark.createDataFrame([(a, b, *map(float, c[:5]), int(c[5])) for a, b, *c in rows], VENDOR)


@pytest.fixture()
def raw(spark, tmp_path):
    vendor(spark).write.parquet(str(tmp_path / "vendor"))
    config = snapshots.SnapshotConfig((" aaa", "AAA", "bbb"), D, date(2021, 1, 1))
    snapshots.build_raw(spark, snapshots.FileSource(str(tmp_path / "vendor")), config, tmp_path / "raw")
    return tmp_path / "raw"


SPLITS = SplitConfig((D, date(2020, 1, 15)), (date(2020, 1, 16), date(2020, 1, 25)), (date(2020, 1, 26), date(2020, 12, 31)))


def test_vendor_columns(spark):
    got = snapshots.normalize_vendor(vendor(spark))
    assert got.columns == list(snapshots.PRICE_COLUMNS) and got.select("ticker").distinct().count() == 2 and got.first().dividends == 0.0
    wide = spark.createDataFrame([(D, *map(float, range(1, 13)))], ["Date", *(f"{f}|{t}" for f in ("Open", "High", "Low", "Close", "Adj Close", "Volume") for t in ("X", "Y"))])
    rows = {r.ticker: (r.open, r.volume) for r in snapshots.normalize_vendor(wide).collect()}
    assert rows == {"X": (1.0, 11.0), "Y": (2.0, 12.0)}
    for bad in ("", " ", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            snapshots.normalize_ticker(bad)


def test_raw_and_processed_round_trip(spark, raw, tmp_path):
    store = snapshots.SnapshotStore(spark, raw)
    prices = store.read("prices", snapshots.PRICE_DDL)
    assert prices.count() == 80 and store.manifest()["config"]["tickers"] == ["AAA", "BBB"]
    ddl = "date date, target_date date, ticker string, adj_close double, log_return double, target_return double, split string"
    for kind in ("parquet", "csv"):
        made = snapshots.build_processed(spark, raw, tmp_path / kind, SPLITS, format=kind)
        assert sum(made["split_rows"].values()) == 76
        data = snapshots.SnapshotStore(spark, tmp_path / kind).read("dataset", ddl)
        want = returns.model_dataset(prices.select("date", "ticker", "adj_close"), SPLITS)
        gap = data.join(want.withColumnRenamed("target_return", "w"), ["date", "ticker"]).agg(F.max(F.abs(F.col("target_return") - F.col("w")))).first()[0]
        assert gap < 1e-9
    line = next((tmp_path / "csv" / "dataset").glob("*.csv")).read_text().splitlines()[1]
    assert line.split(",")[0] == "2020-01-02" and all(len(x.lstrip("-").replace(".", "").lstrip("0").split("e")[0]) <= 10 for x in line.split(",")[3:6])
    with pytest.raises(FileExistsError):
        snapshots.build_processed(spark, raw, tmp_path / "csv", SPLITS)


def test_tampered_snapshots_are_refused(spark, raw):
    store = snapshots.SnapshotStore(spark, raw)
    path = raw / "manifest.json"
    manifest = json.loads(path.read_text())

    def write(text):
        path.write_text(text)
        (raw / ".manifest.json.crc").unlink(missing_ok=True)

    for change in ({"rows": 79}, {"rows": True}, {"rows": -1}, {"columns": ["x"]}, {"parts": {}}):
        altered = json.loads(json.dumps(manifest))
        altered["files"]["prices"].update(change)
        write(json.dumps(altered))
        with pytest.raises(ValueError):
            store.read("prices", snapshots.PRICE_DDL)
    for text in ("{", "[]", "{}"):
        write(text)
        with pytest.raises(ValueError):
            store.read("prices", snapshots.PRICE_DDL)


def test_command_line(spark, tmp_path):
    vendor(spark).write.parquet(str(tmp_path / "v"))
    assert snapshots.main(["raw", "--input", str(tmp_path / "v"), "--tickers", "AAA", "BBB", "--start", "2020-01-01", "--end", "2020-06-01", "--output", str(tmp_path / "r")], spark) == 0
    with pytest.raises(ValueError):
        snapshots.main(["raw", "--input", str(tmp_path / "v"), "--tickers", "GONE", "--start", "2020-01-01", "--end", "2020-06-01", "--output", str(tmp_path / "x")], spark)
    assert not (tmp_path / "x" / "manifest.json").exists()
    own = ["--train", "2020-01-01", "2020-01-15", "--validation", "2020-01-16", "2020-01-25", "--test", "2020-01-26", "2020-12-31"]
    assert snapshots.main(["processed", "--raw", str(tmp_path / "r"), "--output", str(tmp_path / "p"), *own], spark) == 0
    assert snapshots.SnapshotStore(spark, tmp_path / "p").manifest()["split_config"]["test"] == ["2020-01-26", "2020-12-31"]
    for bad in ({"tickers": ()}, {"start": D, "end": D}, {"min_observations": 0}):
        with pytest.raises(ValueError):
            snapshots.SnapshotConfig(**{"tickers": ("A",), "start": D, "end": date(2021, 1, 1), **bad})


def test_digest_ignores_order_and_sees_changes(spark):
    frame = spark.range(100).withColumn("v", F.rand(1)).withColumn("s", F.lit(None).cast("string"))
    shuffled = frame.orderBy(F.desc("v")).select("s", "v", "id")
    assert content_digest(frame) == content_digest(shuffled) and same_rows(frame, shuffled)
    for other in (frame.union(frame.limit(1)), frame.withColumn("v", F.col("v") + F.when(F.col("id") == 7, 1e-15).otherwise(0.0)), frame.limit(99)):
        assert content_digest(other) != content_digest(frame)
    assert fingerprint({"a": 1, "b": [2]}) == fingerprint({"b": [2], "a": 1}) != fingerprint({"a": 2, "b": [2]})


def test_folders_and_records(spark, tmp_path):
    import hashlib

    folder = Folder(spark, f"file://{tmp_path}/f")
    assert folder.names() == [] and not folder.exists("a")
    folder.make()
    for text in ("one", "zwei ü"):
        folder.write_text("a", text)
        assert folder.read_text("a") == text
    assert folder.names() == ["a"] and not folder.is_folder("a")
    spark.range(10).repartition(3).write.parquet(folder.child("t"))
    files = {p.name: p for p in (tmp_path / "f" / "t").glob("*.parquet")}
    got = file_records(spark, folder.path, "t")
    assert got == {n: {"bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for n, p in files.items()} and len(got) == 3
    folder.delete("t")
    assert folder.names() == ["a"] and not folder.exists("t")


def test_residual_backtest_resumes(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(D + timedelta(k), t, float(p)) for t in ("AAA", "BBB") for k, p in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60))))]
    splits = SplitConfig((D, D + timedelta(40)), (D + timedelta(41), D + timedelta(50)), (D + timedelta(51), D + timedelta(90)))
    data = returns.model_dataset(spark.createDataFrame(rows, "date date, ticker string, adj_close double"), splits)
    protocol = Protocol(("AAA", "BBB"), splits, warm_up=20)
    run = lambda: run_residual_backtest(spark, data, tmp_path / "r", protocol, {"AAA": (0, 0, 0), "BBB": (0, 0, 0)})
    found, residuals = run()
    assert found.count() == residuals.count() + 2 and residuals.columns[:4] == ["date", "target_date", "ticker", "adj_close"]
    again, kept = run()
    assert same_rows(found, again) and same_rows(residuals, kept)
    with pytest.raises(Exception, match="ticker"):
        run_residual_backtest(spark, data, tmp_path / "x", protocol, {"AAA": (0, 0, 0)})


def test_checkpoints_resume_and_verify(spark, tmp_path):
    mark, calls = fingerprint({"x": 1}), []
    work = {n: (lambda n=n: (calls.append(n), spark.range(3).withColumn("unit", F.lit(n)))[1]) for n in ("a", "b")}
    store = CheckpointStore(spark, tmp_path / "s", mark)
    store.save("f-a", work["a"]())
    assert missing_units(store, ["f-a", "f-b"]) == ["f-b"]
    assert store.run_named("f", work).count() == 6 and calls == ["a", "b"]
    again = CheckpointStore(spark, tmp_path / "s", mark)
    assert again.run_named("f", work).count() == 6 and calls == ["a", "b"]
    (tmp_path / "s" / "units" / "half").mkdir()
    CheckpointStore(spark, tmp_path / "s", mark)
    assert not (tmp_path / "s" / "units" / "half").exists()
    with pytest.raises(ValueError):
        again.run_named("f", {"a": work["a"]})
    with pytest.raises(ValueError):
        CheckpointStore(spark, tmp_path / "s", fingerprint({"x": 2}))
    with pytest.raises(ValueError):
        CheckpointStore(spark, tmp_path / "t", "nonsense")
    with pytest.raises(ValueError):
        store.save("../x", spark.range(1))
    record = tmp_path / "s" / "units" / "f-a.json"
    kept = record.read_text()
    crc = record.with_name(f".{record.name}.crc")
    crc.unlink(missing_ok=True)
    record.write_text(kept.replace('"rows": 3', '"rows": 4'))
    with pytest.raises(ValueError):
        again.load("f-a")
    record.write_text(kept)
    part = next((tmp_path / "s" / "units" / "f-a").glob("*.parquet"))
    part.unlink()
    with pytest.raises(ValueError):
        again.load("f-a")
    (tmp_path / "s" / "stray.txt").write_text("")
    with pytest.raises(ValueError):
        CheckpointStore(spark, tmp_path / "s", mark)


def test_final_pipeline(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(D + timedelta(k), t, float(p)) for t in ("AAA", "BBB") for k, p in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 130))))]
    splits = SplitConfig((D, D + timedelta(69)), (D + timedelta(70), D + timedelta(99)), (D + timedelta(100), D + timedelta(300)))
    data = returns.model_dataset(spark.createDataFrame(rows, "date date, ticker string, adj_close double"), splits)
    protocol = Protocol(("AAA", "BBB"), splits, InferenceConfig(lag=4, block=5, repetitions=50), warm_up=20, regime_window=5)
    args = (data, tmp_path / "final", protocol, {"AAA": (0, 0, 0), "BBB": (1, 0, 0)}, {t: NetworkConfig(3, 2, 0.0) for t in ("AAA", "BBB")}, {t: NetworkConfig(2, 2, 0.0) for t in ("AAA", "BBB")}, (0, 1), TrainingConfig(epochs=3, patience=2))
    first = run_final(spark, *args)
    models = {r.model: r.n for r in first.predictions.groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert set(models) == {"naive_zero", "arima", "lstm", "arima_lstm"} and len(set(models.values())) == 1
    assert first.dm_results.count() == 30 and first.return_metrics.count() == 12 and first.price_metrics.count() == 12 and first.regime_metrics.count() > 4
    assert same_rows(first.predictions, run_final(spark, *args).predictions)


def test_online_forecasts_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(D + timedelta(k), t, float(p)) for t in ("A", "B") for k, p in enumerate(np.exp(rng.normal(size=30)))]
    ddl = "date date, ticker string, adj_close double"
    for k, part in enumerate((rows[:20] + rows[30:45], rows[20:30] + rows[45:] + rows[:1])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            online_forecasts(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")))
            .writeStream.foreachBatch(batch_writer(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(120)
    got = {(r.ticker, r.date): r.forecast for r in spark.read.schema(FORECAST_DDL).parquet(*map(str, (tmp_path / "out").glob("batch=*"))).collect()}
    batch = returns.log_returns(spark.createDataFrame(rows, ddl)).where("log_return is not null")
    want = batch.withColumn("m", F.avg("log_return").over(returns.by_date().rangeBetween(Window.unboundedPreceding, 0)))
    assert got == pytest.approx({(r.ticker, r.date): r.m for r in want.collect()})


def test_windowed_quality(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=k), "view", float(k)) for k in range(0, 180, 10)] + [(start, "view", None)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    query = windowed_quality(stream).writeStream.format("memory").queryName("quality").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("quality").orderBy("start").collect()
    assert [(r.rows, r.missing, r.total) for r in got] == [(7, 1, 150.0), (6, 0, 510.0), (6, 0, 870.0)]
