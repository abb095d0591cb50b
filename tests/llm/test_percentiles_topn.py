"""Percentiles and top N against brute force."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandline.llm import queries
from strandline.llm.percentiles import BucketScale, column_of, combine, read_percentiles, sketch
from strandline.llm.topn import best_of_index, cluster, prepared, skipping_report, top_n

PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
INF, NAN = float("inf"), float("nan")
DDL = "g string, part int, v double, bucket string, rows string"


def rows(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        g = "hot" if rng.random() < 0.6 else str(rng.choice(["a", "b"]))
        v = float(rng.choice([rng.normal(), 10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), 0.0, round(rng.normal(), 1)]))
        out.append((g, k % 5, v, "x", "y"))
    return [*out, ("a", 0, None, "", ""), ("a", 0, NAN, "", ""), ("inf", 0, INF, "", ""), ("inf", 1, -INF, "", ""), ("inf", 2, 1.0, "", ""), (None, 1, 2.0, "", ""), ("none", 1, None, "", "")]


@pytest.mark.parametrize("error", [0.001, 0.005, 0.1])
def test_percentiles_keep_their_error(spark, error):
    data, scale = rows(), BucketScale(error)
    frame = spark.createDataFrame(data, DDL)
    found = {r.g: r for r in read_percentiles(sketch(frame, ["g"], "v", scale), ["g"], PROBABILITIES, scale).collect()}
    values = {}
    for g, _, v, *_ in data:
        if v is not None and not math.isnan(v):
            values.setdefault(g, []).append(v)
    assert set(found) == set(values)
    for g, own in values.items():
        own.sort()
        assert found[g].observations == len(own)
        for p in PROBABILITIES:
            exact, got = own[math.floor(p * (len(own) - 1))], found[g][column_of(p)]
            assert got == exact if math.isinf(exact) or exact == 0 else abs(got - exact) <= error * abs(exact), (g, p)


def test_sketches_of_parts_combine_to_the_whole(spark):
    scale = BucketScale()
    frame = spark.createDataFrame(rows(), DDL)
    parts = [sketch(frame.where(f"part = {k}"), ["g"], "v", scale) for k in range(5)]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    as_set = lambda s: {(r.g, r.bucket, r.rows) for r in s.collect()}
    assert as_set(combine(union, ["g"])) == as_set(sketch(frame, ["g"], "v", scale)) == as_set(combine(sketch(frame, ["g", "part"], "v", scale), ["g"]))


def test_published_percentiles_keep_the_stated_error(spark):
    values = {"TINY": 3.4e-9, "LEAST": 7.7e-300, "MINUS": -2.9e-7, "LARGE": 1.234e200}
    frame = spark.createDataFrame([(t, v * (1 + k / 50)) for t, v in values.items() for k in range(11)], "ticker string, v double")
    for r in queries._percentiles(sketch(frame, ["ticker"], "v", BucketScale())).collect():
        own = sorted(values[r.ticker] * (1 + k / 50) for k in range(11))
        for p in queries.PROBABILITIES:
            exact = own[math.floor(p * 10)]
            assert abs(r[column_of(p)] - exact) <= r.relative_error * abs(exact), (r.ticker, p)


def test_percentiles_of_nothing(spark):
    scale = BucketScale()
    assert read_percentiles(sketch(spark.createDataFrame([], DDL), ["g"], "v", scale), ["g"], (0.5,), scale).count() == 0
    with pytest.raises(ValueError):
        BucketScale(0.0)
    with pytest.raises(ValueError):
        read_percentiles(spark.createDataFrame([], "g string, bucket int, rows bigint"), ["g"], (1.5,), scale)


RUN = "g1 bigint, g2 string, id bigint, score double, tie double, path string, group_no string"


def runs(n=4000, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        hot = rng.random() < 0.5
        out.append((1 if hot else int(rng.integers(2, 200)), "hot" if hot else str(rng.choice(["x", "y"])), k, float(round(rng.normal(), 1)), float(rng.integers(3)), "p", "q"))
    out += out[:300]
    return [*out, (5, None, 10_001, 1.0, 1.0, "", ""), (None, None, 10_002, 0.0, -0.0, "", ""), (None, None, 10_003, -0.0, 0.0, "", ""), (7, "x", 10_004, None, 1.0, "", ""), (7, "x", 10_005, NAN, 1.0, "", ""), (7, "x", 10_006, 1.0, INF, "", ""), (7, "x", 10_007, -INF, 1.0, "", "")]


def brute(data, n):
    groups = {}
    for g1, g2, i, s, t, *_ in data:
        if s is None or t is None or not math.isfinite(s) or not math.isfinite(t):
            continue
        groups.setdefault((g1, g2), set()).add((s + 0.0, t + 0.0, i))
    return {(g, i, k + 1) for g, items in groups.items() for k, (_, _, i) in enumerate(sorted(items)[:n])}


@pytest.mark.parametrize(("n", "head", "size"), [(1, 4, 64), (5, 16, 4096), (5, 3, 50), (50, 16, 200)])
def test_top_n_equals_brute_force(spark, n, head, size):
    data = runs()
    got = top_n(spark.createDataFrame(data, RUN), ["g1", "g2"], "score", ["tie", "id"], n, head=head, row_group_rows=size).collect()
    assert {((r.g1, r.g2), r.id, r["rank"]) for r in got} == brute(data, n)
    assert len(got) == len(brute(data, n))


def clustered(spark, tmp_path, data, **layout):
    frame = prepared(spark.createDataFrame(data, RUN), ["g1", "g2"], "score", ["tie", "id"])
    return cluster(frame, ["g1", "g2"], "score", ["tie", "id"], f"file://{tmp_path}/clustered", **layout), frame.schema


def test_row_groups_are_skipped_by_their_runs(spark, tmp_path):
    hot = [(1, "hot", k, float(k), 0.0, "", "") for k in range(60_000)]
    small = [(2 + g, "cold", 100_000 + 40 * g + k, 1000.0 * g + k, 0.0, "", "") for g in range(500) for k in range(40)]
    index, schema = clustered(spark, tmp_path, hot + small, row_group_rows=500)
    total = skipping_report(index, schema, ["g1", "g2"], "score", 5).agg({"row_groups": "sum", "read": "sum", "rows": "sum", "rows_read": "sum"}).first()
    assert total["sum(rows)"] == 80_000 and total["sum(rows_read)"] <= 16 * 501 + 500 and total["sum(read)"] < 30 < total["sum(row_groups)"]
    got = best_of_index(index, schema, ["g1", "g2"], "score", ["tie", "id"], 5).collect()
    assert {((r.g1, r.g2), r.id, r["rank"]) for r in got} == brute(hot + small, 5)


def test_a_file_without_statistics_is_read_whole(spark, tmp_path):
    data = runs(500)
    index, schema = clustered(spark, tmp_path, data, row_group_rows=64)
    for k, row in enumerate(index.collect()):
        path = row.path.removeprefix("file://")
        stored = pq.ParquetFile(path).read()
        pq.write_table(stored.replace_schema_metadata(None) if k % 2 else stored, path, row_group_size=63)
    report = skipping_report(index, schema, ["g1", "g2"], "score", 3).collect()
    assert report and all(r.read == r.row_groups for r in report)
    got = best_of_index(index, schema, ["g1", "g2"], "score", ["tie", "id"], 3).collect()
    assert {((r.g1, r.g2), r.id, r["rank"]) for r in got} == brute(data, 3)


def test_more_than_a_head_and_all_ties(spark):
    data = [(1, "t", k, 1.0, 0.0, "", "") for k in range(900)] + [(2, "u", k, float(k // 30), 0.0, "", "") for k in range(900)]
    for n in (5, 20, 100):
        got = top_n(spark.createDataFrame(data, RUN), ["g1", "g2"], "score", ["tie", "id"], n, head=8, row_group_rows=128).collect()
        assert {((r.g1, r.g2), r.id, r["rank"]) for r in got} == brute(data, n)


def test_top_n_of_nothing(spark):
    assert top_n(spark.createDataFrame([], RUN), ["g1", "g2"], "score", ["tie", "id"], 5).count() == 0
    with pytest.raises(ValueError):
        top_n(spark.createDataFrame([], RUN), ["g1"], "score", ["id"], 0)
