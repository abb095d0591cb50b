"""Rolling totals, snapshot changes and spikes on small fixtures, against brute force."""

import math
from datetime import date, timedelta

import numpy as np
import pytest

from strandline.operators.rolling_tree import TreeLayout, build_trees, correct_stored, correct_trees, read_trees, rolling_totals, store_trees, trailing_totals
from strandline.operators.snapshot_diff import read_instant, snapshot_changes
from strandline.operators.spikes import SpikeRule, daily_blocks, find_cases, judge, segment_moments, segments, source_variances
from strandline.functions.scalars import significant_code

DAY = date(2020, 1, 1)
DDL = "ticker string, date date, log_return double, note string"
NAN, INF = float("nan"), float("inf")


def brute(rows, window):
    values = {}
    for t, d, v, _ in rows:
        if t is None or d is None:
            continue
        values.setdefault(t, {}).setdefault(d, [])
        if v is not None and not math.isnan(v):
            values[t][d].append(v)
    out = {}
    for t, days in values.items():
        first, last = min(days), max(days)
        pick = {d: max([x for x in v if math.isfinite(x)], default=None) for d, v in days.items()}
        for k in range((last - first).days + 1):
            d = first + timedelta(k)
            inside = [pick[x] for x in (d - timedelta(j) for j in range(window)) if pick.get(x) is not None]
            out[t, d] = (sum(inside), sum(inside) / len(inside) if inside else None, len(inside))
    return out


def random_rows(seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(["a", "b", "hot"], p=[0.1, 0.2, 0.7])), DAY + timedelta(int(rng.integers(0, 900))), float(rng.normal()), "x") for _ in range(n)]
    return rows + rows[:20] + [("a", DAY, None, None), ("a", DAY + timedelta(1), NAN, None), ("b", DAY + timedelta(2), INF, None), (None, DAY, 1.0, None), ("a", None, 1.0, None), ("only", DAY, None, None)]


@pytest.mark.parametrize("leaves", [64, 128, 256])
def test_rolling_totals_equal_brute_force(spark, leaves):
    rows = random_rows()
    got = {(r.ticker, r.date): r for r in rolling_totals(spark.createDataFrame(rows, DDL), TreeLayout(leaves=leaves)).collect()}
    for window in (7, 30):
        want = brute(rows, window)
        assert set(got) == set(want)
        for key, (total, mean, n) in want.items():
            r = got[key]
            assert r[f"total_{window}d"] == pytest.approx(total, abs=1e-12) and r[f"readings_{window}d"] == n
            assert (r[f"mean_{window}d"] is None) == (mean is None) and (mean is None or r[f"mean_{window}d"] == pytest.approx(mean, abs=1e-12))
    assert got["b", DAY + timedelta(2)].nonfinite_7d == 1


def test_rolling_totals_of_nothing_and_clashing_columns(spark):
    assert rolling_totals(spark.createDataFrame([], DDL)).count() == 0
    clash = spark.createDataFrame([("a", DAY, 1.0, "s")], "ticker string, date date, log_return double, shard string")
    assert rolling_totals(clash).count() == 1


def test_corrections_update_only_ancestors_and_equal_a_rebuild(spark):
    layout = TreeLayout(leaves=64)
    rows = [r for r in random_rows(5, 200) if r[0] in ("a", "hot") and r[1] and r[2] is not None and math.isfinite(r[2])]
    day = rows[0][1]
    fixed = [r for r in rows if not (r[0] == rows[0][0] and r[1] == day)]
    trees = build_trees(spark.createDataFrame(rows, DDL), layout)
    late = spark.createDataFrame([(rows[0][0], day, 99.0, None)], DDL)
    after = correct_trees(trees, late, layout)
    want = {(r.entity, r.date): r.total_7d for r in trailing_totals(build_trees(spark.createDataFrame([*fixed, (rows[0][0], day, 99.0, None)], DDL), layout), layout).collect()}
    got = {(r.entity, r.date): r.total_7d for r in trailing_totals(after, layout).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    before = {(r.entity, r.shard): r.sums for r in trees.collect()}
    for r in after.collect():
        changed = [k for k, (x, y) in enumerate(zip(r.sums, before[r.entity, r.shard])) if x != y]
        assert len(changed) <= 7  # a leaf and log2(64) ancestors


def test_stored_trees_are_corrected_in_editions_of_touched_trees(spark, tmp_path):
    layout, path = TreeLayout(leaves=64), f"file://{tmp_path}/trees"
    rows = [(t, DAY + timedelta(k), 1.0, None) for t in ("a", "b") for k in range(300)]
    store_trees(build_trees(spark.createDataFrame(rows, DDL), layout), path)
    assert correct_stored(spark, path, spark.createDataFrame([("a", DAY + timedelta(100), 5.0, None), ("gone", DAY, 1.0, None)], DDL), layout) == 1
    assert correct_stored(spark, path, spark.createDataFrame([("a", DAY + timedelta(100), 7.0, None), ("b", DAY + timedelta(9), None, None)], DDL), layout) == 2
    assert 1 <= spark.read.parquet(f"{path}/edition=1").count() <= 2
    got = {(r.entity, r.date): r.total_7d for r in trailing_totals(read_trees(spark, path), layout).collect()}
    fixed = [r for r in rows if r[:2] not in (("a", DAY + timedelta(100)), ("b", DAY + timedelta(9)))] + [("a", DAY + timedelta(100), 7.0, None)]
    assert got == pytest.approx({(r.ticker, r.date): r.total_7d for r in rolling_totals(spark.createDataFrame(fixed, DDL), layout).collect()})


def test_tree_layout_rejects_nonsense():
    for bad in ({"leaves": 100}, {"windows": ()}, {"windows": (7, 7)}, {"leaves": 16}, {"leaves": 32}):
        with pytest.raises(ValueError):
            TreeLayout(**bad)


MANIFEST = "snapshot_id bigint, raw_dir string, created_at_utc string, extra int"
SNAPSHOT = "snapshot_id bigint, date date, ticker string, adj_close double, position string"


def test_snapshot_changes(spark):
    notices = [
        (9, "d", "2026-01-01T10:00:00.500+00:00", 1), (3, "d", "2026-01-01 06:30:00-05:00", 1), (3, "d", "2026-01-01T11:30:00Z", 2),
        (7, "d", "20260101T130000Z", 1), (5, "d", "2026-01-02T00:30:00+09:00", None), (1, "e", "2026-01-01T00:00:00Z", None), (2, "d", None, None), (None, "d", "2026-01-01T00:00:00Z", 1),
    ]
    d1, d2 = DAY, DAY + timedelta(1)
    rows = [
        (9, d1, "AA", 1.0, ""), (9, d2, "AA", 2.0, ""), (9, d1, "BB", None, ""), (9, d1, "CC", 0.1 + 0.2, ""),
        (3, d1, " aa", 1.0 + 1e-13, ""), (3, d1, "aa ", 1.0, ""), (3, d2, "AA", 2.5, ""), (3, d1, "BB", 1.0, ""), (3, d1, "CC", 0.3, ""), (3, d1, None, 1.0, ""), (3, None, "AA", 1.0, ""),
        (5, d1, "AA", 1.0, ""), (5, d1, "BB", None, ""), (1, d1, "AA", 5.0, ""), (77, d1, "AA", 5.0, ""),
    ]
    got = {(r.snapshot_id, r.ticker, r.date, r.change) for r in snapshot_changes(spark.createDataFrame(rows, SNAPSHOT), spark.createDataFrame(notices, MANIFEST)).collect()}
    # order: 9 (10:00), 3 (11:30), 7 (13:00, without rows), 5 (15:30)
    assert got == {
        (3, "AA", d2, "changed"), (3, "BB", d1, "changed"),
        (7, "AA", d1, "removed"), (7, "AA", d2, "removed"), (7, "BB", d1, "removed"), (7, "CC", d1, "removed"),
        (5, "AA", d1, "added"), (5, "BB", d1, "added"),
    }


def test_snapshot_changes_of_nothing(spark):
    assert snapshot_changes(spark.createDataFrame([], SNAPSHOT), spark.createDataFrame([], MANIFEST)).count() == 0


def test_instants(spark):
    texts = ["2026-01-01T05:30:00+05:30", "2026-01-01 00:00:00Z", "2026-01-01T00:00:00", "2026-01-01T00:00:00.000+0000", "20260101T000000Z", "2026-01-01", "2026-01-01T00:00:00,0Z", "2026-01-01T09:00+09"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(read_instant("t").cast("long").alias("s")).collect()
    assert [r.s for r in rows] == [1767225600] * len(texts)
    assert spark.createDataFrame([("soon",), (None,)], "t string").select(read_instant("t").alias("s")).where("s is not null").count() == 0


def test_significant_code(spark):
    values = [None, NAN, 0.0, -0.0, INF, -INF, 1.0, 1.0 + 1e-12, 1.0 + 1e-9, 999.99999999999, 1000.0, 5e-324, 1.7e308, -1.0, 123456.7891, 123456.78910000001]
    code = [r.c for r in spark.createDataFrame([(v,) for v in values], "v double").select(significant_code("v").alias("c")).collect()]
    assert None not in code
    same = lambda a, b: (values[a] is None) == (values[b] is None) and code[a] == code[b]
    assert same(2, 3) and same(6, 7) and same(9, 10) and same(14, 15)
    assert len({code[k] for k in (0, 1, 2, 4, 5, 6, 8, 10, 11, 12, 13, 14)}) == 12


def market(n=400, seed=0, spread=0.01):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, spread, n)
    return 50 * np.exp(np.cumsum(r)), r


def run(spark, price, ret, rule=None):
    rows = [("T", DAY + timedelta(k), None if p is None or p != p else float(p), None if r is None or r != r else float(r)) for k, (p, r) in enumerate(zip(price, ret, strict=True))]
    frame = spark.createDataFrame(rows, "ticker string, date date, adj_close double, log_return double")
    return {(r.date - DAY).days: r for r in find_cases(frame, rule).collect()}


def test_spikes_stuck_and_impossible(spark):
    p, r = market()
    p[50] *= 1.5  # spike with its true return
    p[100] *= 1.4  # spike with the returns computed from it
    r[100] += math.log(1.4)
    r[101] -= math.log(1.4)
    p[150:] *= 1.3  # lasting move with its return
    r[150] += math.log(1.3)
    r[200] = 0.5  # return alone
    p[220:227] = p[220]  # stuck price
    p[240:244] = p[240]  # too short
    r[260:266] = 0.0123
    r[280:290] = 0.0
    p[300], p[301], p[302] = 0.0, -5.0, INF
    r[310] = -INF
    p[320] = r[325] = NAN
    p[340:343] *= 0.7  # three rows, then back
    got = run(spark, p, r)
    want = {50, 100, 101, 200, *range(221, 227), *range(261, 266), 300, 301, 302, 310, 340, 341, 342}
    assert set(got) == want
    assert got[50].spike and not got[50].stuck and got[300].impossible and got[222].stuck


@pytest.mark.parametrize("segment", [64, 128, 512])
def test_segments_do_not_show(spark, segment):
    p, r = market(700, 2)
    for k in range(20, 700, 37):
        p[k] *= 1.6
    for k in range(5, 690, 91):
        p[k : k + 6] = p[k]
    whole = set(run(spark, p, r, SpikeRule(segment=4096)))
    assert set(run(spark, p, r, SpikeRule(segment=segment, warm_up=48))) == whole and len(whole) > 30


def test_spikes_defined_on_odd_tables(spark):
    ddl = "ticker string, date date, adj_close double, log_return double, spread string"
    assert find_cases(spark.createDataFrame([], ddl)).count() == 0
    rows = [("a", DAY, None, None, "x"), (None, DAY, 1.0, 1.0, "x"), ("a", None, 1.0, 1.0, "x"), ("b", DAY, -1.0, None, "x"), ("b", DAY, -1.0, None, "x")]
    assert [(r.ticker, r.impossible) for r in find_cases(spark.createDataFrame(rows, ddl)).collect()] == [("B", True)]


def test_judge_without_variance_finds_no_spikes():
    price, none = np.array([[1.0, 1.0, 1.0, 1.0, 1.0, 9.0]]), np.array([np.nan])
    impossible, spike, stuck, _ = judge(price, np.zeros_like(price), none, none, none, SpikeRule())
    assert not spike.any() and not impossible.any() and stuck.sum() == 4


@pytest.mark.parametrize("jitter", [0.0, 1e-9])
def test_vanishing_innovation_variance_is_stuck(spark, jitter):
    p, r = market()
    p[200:220] = p[200] * (1 + jitter * np.random.default_rng(1).standard_normal(20))
    r[300:310] = 0.02 + jitter * np.random.default_rng(2).standard_normal(10)
    got = run(spark, p, r)
    assert {k for k, x in got.items() if x.stuck} == {*range(201, 220), *range(301, 310)}


def test_variances_of_level_and_noise_are_estimated(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, level, noise in (("CALM", 0.01, 0.0), ("NOISY", 0.01, 0.02)):
        x = np.cumsum(rng.normal(0, level, 4000))
        p = np.exp(x + rng.normal(0, noise, 4000))
        p[777] *= 30
        rows += [(name, DAY + timedelta(k), float(v), float(rng.normal(0, 0.01))) for k, v in enumerate(p)]
    rule = SpikeRule()
    parts = segments(daily_blocks(spark.createDataFrame(rows, "ticker string, date date, adj_close double, log_return double"), rule), rule)
    found = {r.ticker: r for r in source_variances(segment_moments(parts, rule)).collect()}
    assert found["CALM"].level == pytest.approx(1e-4, rel=0.15) and found["CALM"].noise < 1e-5
    assert found["NOISY"].noise == pytest.approx(4e-4, rel=0.15) and found["NOISY"].level == pytest.approx(1e-4, rel=0.5)
    assert found["NOISY"].spread == pytest.approx(0.01, rel=0.05)


def test_doubtful_moves(spark):
    p, r = market()
    steps = np.diff(np.log(p), prepend=np.log(p[0]))
    p[50] *= math.exp(0.12)  # true return, and a step of the level against it
    p[100:] *= math.exp(0.14)  # lasting, halfway back later by ordinary steps
    r[100] = steps[100] + 0.14
    p[150:152] *= math.exp(-0.15)  # two rows with the returns computed from them
    for k in (150, 152):
        r[k] = math.log(p[k] / p[k - 1])
    p[200] *= math.exp(0.2)  # the last reading before a stretch without any
    p[201:205] = NAN
    got = run(spark, p, r)
    assert set(got) == {50, 150, 151, 152, 200}


def test_scratch_tables_need_a_shared_folder_and_are_released(spark, monkeypatch):
    from types import SimpleNamespace

    from strandline import session

    path = session.scratch_table(spark, "test")
    spark.range(3).write.parquet(path)
    assert session.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)
    undefined = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: undefined)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(cluster)
