import difflib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.functions import kernels, prose, table_metrics


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_least_cost(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 6, (n, m)).astype(float)
    pairs = kernels.assign(cost)
    assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    small = cost if n <= m else cost.T
    best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_assignment_of_nothing():
    assert kernels.assign(np.zeros((0, 3))) == []


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_indel_ratio(a, b):
    def subsequences(s):
        return {"".join(c) for n in range(len(s) + 1) for c in itertools.combinations(s, n)}

    common = max(map(len, subsequences(a) & subsequences(b)))
    assert kernels.indel_ratio(a, b) == pytest.approx(2 * common / (len(a) + len(b)) if a or b else 1)


def test_jaro_winkler_known():
    assert kernels.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert kernels.jaro_winkler("", "a") == 0 and kernels.jaro_winkler("x", "x") == 1


def random_table(rng):
    head = f'<thead><tr><th colspan="{rng.choice([1, 2])}">h</th></tr></thead>' if rng.random() < 0.5 else ""
    row = lambda: "<tr>" + "".join(f"<td>{rng.choice(['a', 'ab', '', 'xyz'])}</td>" for _ in range(rng.randrange(3))) + "</tr>"
    return table_metrics.trees(f"<table>{head}<tbody>{''.join(row() for _ in range(rng.randrange(3)))}</tbody></table>")[0]


def forest_distance(a, b, memo, variant):
    key = (tuple(map(id, a)), tuple(map(id, b)))
    if key not in memo:
        size = lambda f: sum(1 + size(t.children) for t in f)
        if not a or not b:
            memo[key] = size(a) + size(b)
        else:
            change = table_metrics.renames([a[-1]], [b[-1]], variant)[0, 0]
            memo[key] = min(
                forest_distance(a[:-1] + a[-1].children, b, memo, variant) + 1, forest_distance(a, b[:-1] + b[-1].children, memo, variant) + 1,
                forest_distance(a[:-1], b[:-1], memo, variant) + forest_distance(a[-1].children, b[-1].children, memo, variant) + change,
            )
    return memo[key]


@pytest.mark.parametrize("variant", table_metrics.VARIANTS)
def test_tree_distance_against_definition(variant):
    rng = random.Random(4)
    for _ in range(30):
        a, b = random_table(rng), random_table(rng)
        assert table_metrics.tree_distance(a, b, variant) == pytest.approx(forest_distance([a], [b], {}, variant))


def test_grids():
    g = [["a", "b"], ["c", "d"], ["e", "f"]]
    assert kernels.grid_similarity(g, g)["f"] == 1
    part = kernels.grid_similarity(g, g[:2])
    assert part["rows"] == [(0, 0), (1, 1)] and part["f"] == pytest.approx(0.8)
    assert kernels.grid_similarity([], [])["f"] == 1 and kernels.grid_similarity(g, [])["f"] == 0


def test_edit_shares():
    rng = random.Random(7)
    words = ["", "x" * 60, *("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(20))]
    want = [[prose.edit_distance(a, b) / max(len(a), len(b), 1) for b in words[::-1]] for a in words]
    assert kernels.edit_shares(words, words[::-1]) == pytest.approx(np.array(want))


def test_block_ratios():
    rng = random.Random(6)
    words = ["", *("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(30))]
    assert kernels.block_ratios(words, words[::-1]) == pytest.approx(np.array([[difflib.SequenceMatcher(None, a, b).ratio() for b in words[::-1]] for a in words]))


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=7), st.text("abc ", max_size=30))
def test_partial_ratio_and_near_matches(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    parts = [long[i:j] for i in range(len(long) + 1) for j in range(i, len(long) + 1) if j - i == n or (j - i < n and (i == 0 or j == len(long)) and j > i)]
    want = max((prose.ratio(short, p) for p in parts), default=1.0) if short else float(not long)
    assert prose.partial_ratio(a, b) == pytest.approx(want)
    near = prose.near_matches(a, b, 1)  # a pattern of one sign is within an edit of nothing
    exists = any(prose.edit_distance(a, b[i:j]) <= 1 for i in range(len(b) + 1) for j in range(i, len(b) + 1))
    assert bool(near) == exists or len(a) < 2


def test_greedy_match_takes_each_box_once():
    hit = kernels.greedy_match(np.array([[0.9, 0.6], [0.8, 0.55], [0.7, 0.2]]), np.array([0.1, 0.9, 0.5]))
    assert hit.tolist() == [1, 0, -1]
    assert kernels.average_precision(np.array([1, 0, 1]), 2) == pytest.approx((1 + 2 / 3) / 2)


def test_ratios_of_all_pairs():
    rng = random.Random(8)
    words = ["", "x" * 60, *("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(20))]
    got = kernels.indel_ratios(words, words[::-1])
    assert got == pytest.approx(np.array([[kernels.indel_ratio(a, b) for b in words[::-1]] for a in words]))


@pytest.mark.parametrize("signs, most", [("ab", 12), ("abcdefgh0123456789", 7), ("abcde é", 39), ("ab", 60)])
def test_block_ratios_are_those_of_matching_blocks(signs, most):
    rng = random.Random(most)
    a, b = ([("".join(rng.choice(signs) for _ in range(rng.randrange(most + 1)))) for _ in range(n)] for n in (30, 27))
    wanted = [[difflib.SequenceMatcher(None, x, y).ratio() for y in b] for x in a]
    assert np.allclose(kernels.block_ratios(a, b), wanted, atol=1e-12)
