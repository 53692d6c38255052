import math

import numpy as np
import pytest

from tidemark.operators.divergence import measure

EPS = 1e-6
METRICS = ("psi", "js", "hellinger", "ks_approx", "chi_square", "linf")


def brute_force(ref, cur):
    keys = sorted(ref.keys() | cur.keys())

    def side(counts):
        total = sum(counts.values())
        floored = [max(counts.get(k, 0) / total, EPS) for k in keys]
        return np.array(floored) / sum(floored)

    p, q = side(ref), side(cur)
    pe, qe = np.maximum(p, EPS), np.maximum(q, EPS)
    return {
        "psi": float(np.sum((qe - pe) * np.log(qe / pe))),
        "js": float(np.sum(pe * np.log(2 * pe / (pe + qe)) + qe * np.log(2 * qe / (pe + qe))) / 2),
        "hellinger": float(np.sqrt(np.sum((np.sqrt(p) - np.sqrt(q)) ** 2) / 2)),
        "ks_approx": float(np.max(np.abs(np.cumsum(p) - np.cumsum(q)))),
        "chi_square": float(np.sum((q - pe) ** 2 / pe)),
        "linf": float(np.max(np.abs(p - q))),
    }


def counts_table(spark, distributions):
    data = [
        (name, "numeric", "bin", k, str(k), n) for name, counts in distributions.items() for k, n in counts.items()
    ]
    return spark.createDataFrame(data, "feature string, feature_type string, kind string, ord int, key string, n bigint")


@pytest.fixture(scope="module")
def distributions():
    generator = np.random.default_rng(11)
    pairs = {}
    for i in range(40):
        keys = range(-1, int(generator.integers(2, 15)))
        pairs[f"f{i}"] = tuple(
            {k: int(n) for k in keys if (n := generator.integers(0, 50)) > 10} or {0: 1} for _ in range(2)
        )
    pairs["same"] = ({0: 3, 1: 4}, {0: 6, 1: 8})
    pairs["apart"] = ({0: 5}, {1: 5})
    return pairs


def found(spark, distributions, swap=False):
    sides = [counts_table(spark, {f: pair[i] for f, pair in distributions.items()}) for i in (0, 1)]
    if swap:
        sides.reverse()
    return {r["feature"]: r for r in measure(*sides, eps=EPS).collect()}


def test_against_brute_force(spark, distributions):
    rows = found(spark, distributions)
    for feature, (ref, cur) in distributions.items():
        for metric, wanted in brute_force(ref, cur).items():
            assert rows[feature][metric] == pytest.approx(wanted, rel=1e-9, abs=1e-12), (feature, metric)


def test_bounds_and_symmetry(spark, distributions):
    forth, back = found(spark, distributions), found(spark, distributions, swap=True)
    for feature, row in forth.items():
        assert all(row[m] >= -1e-12 for m in METRICS)
        assert row["js"] <= math.log(2) + 1e-9
        assert row["hellinger"] <= 1 and row["ks_approx"] <= 1 + 1e-9 and row["linf"] <= 1
        for m in ("psi", "js", "hellinger", "ks_approx", "linf"):
            assert row[m] == pytest.approx(back[feature][m], abs=1e-9)
    assert all(forth["same"][m] == pytest.approx(0, abs=1e-12) for m in METRICS)


def test_bins_run_in_numeric_order(spark):
    # as text, 10 would come before 2
    ref = {i: 10 for i in range(12)}
    cur = {**ref, 2: 0, 10: 20}
    cur = {k: n for k, n in cur.items() if n}
    row = found(spark, {"x": (ref, cur)})["x"]
    assert row["ks_approx"] == pytest.approx(1 / 12, abs=1e-5)


def test_an_empty_side_has_no_distance(spark):
    empty = counts_table(spark, {"x": {}})
    row = measure(counts_table(spark, {"x": {0: 1, 1: 2}}), empty).collect()[0]
    assert all(row[m] is None for m in METRICS)
