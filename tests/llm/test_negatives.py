"""Hard negatives against plain Python on whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm.negatives import Residues, hard_negatives, primes_for


@pytest.mark.parametrize("depth, most", [(64, 256), (64, 2 ** 27), (3000, 2 ** 20), (1, 5), (5, 2 ** 28), (3, 0)])
def test_scores_are_exact(depth, most):
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-most, most + 1, (n, depth)) for n in (30, 40))
    bound = max(int((x.astype(object) ** 2).sum(1).max()) for x in (a, b))
    primes = primes_for(bound, depth)
    got = Residues(a.astype(float), primes).scores(Residues(b.astype(float), primes))
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()
    half = (max(primes) - 1) // 2
    assert min(depth, 1024) * half * half < 1 << 24 and math.prod(primes) > 2 * bound


def brute(rows, positives=5, negatives=10):
    usable = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
              if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in {(i, y, tuple(q)) for i, y, q in usable if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], q)), i, y) for i, y, q in usable if i != anchor[0])
        for s, p, _ in [x for x in scored if x[2] == anchor[1]][:positives]:
            fits = [x for x in scored if x[2] != anchor[1] and -30 * s <= -100 * x[0] <= -90 * s]
            out += [(anchor[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(rng, n):
    rows = [(i, rng.randint(0, 2), [rng.uniform(-0.2, 1) for _ in range(6)]) for i in range(n)]
    rows += [(n + k, k % 3, [0.5] * 6) for k in range(60)]  # ties
    rows += [(None, 1, [1.0] * 6), (n + 70, None, [1.0] * 6), (n + 71, 1, None), (n + 72, 1, [1.0, None]), (n + 73, 1, [float("nan")] * 6),
             (n + 74, 1, [float("inf")] * 6), (n + 75, 1, []), (n + 76, 1, [0.9] * 9), (100, 1, [0.4] * 6), (100, 1, [0.4] * 6), (7, 2, [0.3] * 6)]
    return rows


SCHEMA = "vec_id bigint, label int, embedding array<double>, id string, q string, score int, anchor int"


@pytest.mark.parametrize("slice_components", [4_000_000, 9])
def test_against_brute_force(spark, slice_components):
    rows = vectors(random.Random(3), 310)
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(5)
    out = hard_negatives(df, F.col("vec_id") % 100 == 0, slice_components=slice_components)
    assert sorted(map(tuple, out.collect())) == brute(rows) and out.columns[0] == "anchor_id"


def test_edges(spark):
    df = spark.createDataFrame([(100, 1, [1.0], "", "", 0, 0), (200, 2, [1.0], "", "", 0, 0)], SCHEMA)
    assert hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(df, F.col("vec_id") < 0).count() == 0
    assert hard_negatives(df, F.lit(True)).count() == 0  # no positives
    far = spark.createDataFrame([(100, 1, [1e30], "", "", 0, 0)], SCHEMA)
    with pytest.raises(ValueError):
        hard_negatives(far, F.lit(True))
    big = spark.createDataFrame([(100 if i == 0 else i, int(i == 2), [2.0 ** 18 * (1 + i / 4 % 1), 2.0 ** 18], "", "", 0, 0) for i in range(3)], SCHEMA)
    rows = [(r.vec_id, r.label, r.embedding) for r in big.collect()]
    assert sorted(map(tuple, hard_negatives(big, F.col("vec_id") == 100).collect())) == brute(rows)
