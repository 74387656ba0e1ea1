"""Centroid clustering against plain Python; the tree against comparison with all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from fieldlens.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, id string, k string"


def plain(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e15 else int(x) * scale for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    cs = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for c in range(len(cs)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                cs[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    fits = lambda x: x if x <= centroids.LONG else None
    return [(i, c, fits(d), fits(sum(e for _, b, e in found if b == c)), fits(sum(e for _, _, e in found)), sha[c]) for i, c, d in found]


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, e, "c", "d", "i", "k") for i, e in rows], SCHEMA)
    return [tuple(r) for r in centroids.cluster(df, **options).drop("centroid").collect()]


key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("k,dims", [(16, 64), (3, 5), (40, 4)])
def test_against_plain_python(spark, k, dims):
    rng = random.Random(k)
    # coarse components make many equal distances and equal vectors
    rows = [(n, [rng.choice([-0.03, -0.015, 0.0, 0.02, 0.5]) for _ in range(dims)]) for n in range(300)]
    rows += [(None, [0.1] * dims), (None, None), (7, []), (8, [0.1] * (dims - 1)), (9, [None] + [0.1] * (dims - 1)), (10, [float("nan")] * dims),
             (11, [float("inf")] * dims), rows[0], rows[0]]
    assert sorted(found(spark, rows, k=k, dims=dims), key=key) == sorted(plain(rows, k=k, dims=dims), key=key)


def test_few_none_and_huge(spark):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []
    few = [(n, [float(n)] * 64) for n in range(5)]
    assert sorted(found(spark, few)) == sorted(plain(few))
    huge = [(n, [random.Random(n).uniform(-1, 1) * 10.0 ** (n % 40) for _ in range(8)]) for n in range(120)]
    assert sorted(found(spark, huge, k=6, dims=8), key=key) == sorted(plain(huge, k=6, dims=8), key=key)


@pytest.mark.parametrize("seed", range(5))
def test_tree(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, (rng.integers(1, 60), 6))
    tree = centroids.Tree(points.tolist())
    rows = rng.integers(-5, 6, (500, 6))
    number, distance = tree.nearest(rows)
    all_pairs = ((rows[:, None] - points[None]) ** 2).sum(2)
    assert (distance == all_pairs.min(1)).all() and (number == all_pairs.argmin(1)).all()
