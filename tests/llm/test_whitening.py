import math
import random

import numpy as np
import pytest

from tradewind.llm import whitening
from tradewind.llm.shared import shared_folder

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component int, dims int, total int"


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", 1, 2, 3, 4) for i, v in rows], SCHEMA).repartition(3)
    return whitening.whiten(spark, frame, shared_folder(spark, "whitening"), **options).collect()


def kept(rows):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(got, rows, count=16):
    """Against the singular vectors of the centred fit list; signs are free."""
    left = kept(rows)
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    for d in {len(x) for _, x in left if x}:
        fit = np.array(sorted({tuple(x) for _, x in left if len(x) == d}))
        n, sums = len(fit), fit.sum(axis=0)
        centred = fit - sums / n
        _, sigma, right = np.linalg.svd(centred)  # of the rows themselves, as their covariance loses the small components' digits
        values, vectors = np.pad(sigma, (0, d - len(sigma))) ** 2 / n, right.T
        least, sign = 1e-12 * max(values.max(), 1e-30), {}
        for i, x in left:
            if len(x) != d:
                continue
            deviation = sum((n * a - int(b)) ** 2 for a, b in zip(x, sums, strict=True))
            mine = sorted((r for r in by_row[(i, deviation)] if r["n"] == n), key=lambda r: r["component"])
            mine = mine[:: len(mine) // min(count, d)]  # a repeated row gives its own
            assert [r["component"] for r in mine] == list(range(1, min(count, d) + 1))
            for k, r in enumerate(mine):
                if values[k] <= least:
                    assert r["whitened"] is None and r["explained"] == 0
                    continue
                assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
                wanted = (np.array(x) - sums / n) @ vectors[:, k] / np.sqrt(values[k])
                if abs(wanted) > 1e-6:
                    assert sign.setdefault(k, np.sign(wanted * r["whitened"])) * r["whitened"] == pytest.approx(wanted, rel=1e-7, abs=1e-7)
    assert len(got) == sum(min(count, len(x)) for _, x in left)


def test_against_eigenvectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 3.0 / (k + 1)) + 0.5 * k for k in range(20)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1]), (None, rows[5][1])]  # copies count once in the fit
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] * 20), (2003, [float("inf")] + [0.0] * 19), (2004, [])]
    check(run(spark, rows), rows)


def test_large_mean_and_ill_conditioned(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 8)) * 200
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base + rng.normal(scale=0.02, size=(500, 8)) + 5000)]
    check(run(spark, rows, count=8), rows, count=8)


def test_dimensions_without_variance_and_dependent_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(50):
        a, b = rng.randrange(100), rng.randrange(100)
        rows.append((i, [float(a), float(b), float(a + b), 7.0]))
    got = run(spark, rows)
    check(got, rows)
    assert sum(r["whitened"] is None for r in got) == 100


def test_single_vectors_lengths_and_empty(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0]), (4, [7.0]), (5, [])]
    got = run(spark, rows)
    check(got, rows)
    assert run(spark, [(1, None), (2, [])]) == []


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(2**40, np.array([0, 0]), np.eye(2), np.ones(2), np.ones(2), 0.0)
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[2**24, 1]]), model)
    model.n = 3
    assert whitening.deviations(np.array([[1, 2], [3, -4]]), model).tolist() == [45, 225]
    big = whitening.Whitening(1, np.array([0, 0, 0]), np.eye(3), np.ones(3), np.ones(3), 0.0)
    assert whitening.deviations(np.array([[2_000_000_000, 2, 0]]), big).tolist() == [4 * 10**18 + 4]
