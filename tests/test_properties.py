"""Properties over random inputs."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.functions.tails import chi_square_upper, levinson
from strandline.operators.inference import resampled_differences
from strandline.operators.rolling_tree import TreeLayout, _grow
from strandline.operators.spikes import _steps, _vanished


@given(st.sampled_from([64, 128, 256]), st.data())
def test_covers_are_exact_and_short(leaves, data):
    layout = TreeLayout(leaves=leaves)
    left = data.draw(st.integers(0, leaves - 1))
    right = data.draw(st.integers(left, leaves - 1))
    seen = []
    for node in layout.cover(left, right):
        low = high = node
        while low < leaves:
            low, high = 2 * low, 2 * high + 1
        seen += range(low - leaves, high - leaves + 1)
    assert sorted(seen) == list(range(left, right + 1))
    assert len(layout.cover(left, right)) <= 2 * int(math.log2(leaves))


@given(st.lists(st.integers(-5, 5), min_size=16, max_size=16), st.integers(0, 15), st.integers(0, 15))
def test_tree_sums(values, a, b):
    layout = TreeLayout(windows=(3,), leaves=16)
    tree = np.zeros((1, 32))
    tree[0, 16:] = values
    _grow(tree)
    left, right = min(a, b), max(a, b)
    assert tree[0, layout.cover(left, right)].sum() == sum(values[left : right + 1])


@given(st.lists(st.sampled_from([1.0, 2.0, float("nan")]), min_size=1, max_size=30), st.integers(2, 6))
def test_runs(values, least):
    row = np.array([values])
    got = _vanished(_steps(row), np.zeros(1), least - 1)[0].tolist()
    want, k = [False] * len(values), 0
    while k < len(values):
        end = k
        while end + 1 < len(values) and values[end + 1] == values[k]:
            end += 1
        if end - k + 1 >= least and values[k] == values[k]:
            for j in range(k + 1, end + 1):
                want[j] = True
        k = end + 1
    assert got == want


@given(st.integers(1, 12), st.floats(0.01, 60))
def test_chi_square_tail_falls(df, x):
    p = chi_square_upper(x, df)
    assert 0 <= p <= 1 and chi_square_upper(x + 1, df) <= p <= chi_square_upper(x, df + 1) + 1e-12


@given(st.floats(-0.95, 0.95), st.integers(2, 10))
def test_levinson_of_geometric_correlations(phi, n):
    got = levinson(phi ** np.arange(n + 1))
    assert abs(got[1] - phi) < 1e-12 and np.abs(got[2:]).max(initial=0) < 1e-8


@settings(max_examples=30)
@given(st.integers(3, 40), st.integers(1, 8), st.integers(0, 10**6))
def test_block_resampling_by_prefix_sums(n, block, seed):
    block = min(block, n)
    rng = np.random.default_rng(seed)
    cells, starts = rng.random((n, 4)), rng.integers(0, n - block + 1, size=(5, -(-n // block)))
    got = resampled_differences(cells, 1, starts.copy(), block)
    for row, (mae, rmse) in zip(starts, got, strict=True):
        picks = np.concatenate([np.arange(s, s + block) for s in row])[:n]
        m = cells[picks].mean(axis=0)
        assert np.allclose((mae, rmse), ((m[0] - m[2]) * 1e4, (np.sqrt(m[1]) - np.sqrt(m[3])) * 1e4))
