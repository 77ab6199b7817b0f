"""Operator 12 against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakekit.llm import hardnegatives

FLOATS = "vec_id long, embedding array<double>, label int"


def model(rows, anchors, low=50, high=95, n_positives=5, n_negatives=3, scale=256.0):
    def fine(row):
        return None not in row and all(x is not None and math.isfinite(x) for x in row[1])

    whole = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in filter(fine, rows)]
    out = []
    for anchor in sorted({i for i, _, _ in whole if anchors(i)}):
        _, label, vector = min((anchor, label, v) for i, v, label in whole if i == anchor)
        scored = [(-sum(a * b for a, b in zip(vector, v, strict=False)), i, own == label) for i, v, own in whole if i != anchor]
        for negated, positive, _ in sorted(s for s in scored if s[2])[:n_positives]:
            p = -negated
            fit = sorted(s for s in scored if not s[2] and low * p <= -100 * s[0] <= high * p)[:n_negatives]
            out += [(anchor, positive, rank, i, p, -s) for rank, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.select(*names).collect())


def vectors(n, width, seed, spread):
    """Clusters around a few centres, some labels shared by many, some vectors by more."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = []
    for i in range(n):
        own = int(rng.integers(5))
        v = centres[own] + spread * rng.normal(size=width)
        if i % 3 == 0:
            v, own = centres[0], 0
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], own if i % 4 else 1))
    return rows


@pytest.mark.parametrize(("width", "spread"), [(8, 0.1), (7, 1.0), (2, 0.6)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, width, spread):
    rows = vectors(400, width, width, spread)
    for name, value in (("SHARD_ROWS", 60), ("ANCHORS", 9), ("STEP_ROWS", 16), ("CODES", 4)):
        monkeypatch.setattr(hardnegatives, name, value)
    df = spark.createDataFrame(rows, FLOATS).repartition(3)
    expected = model(rows, lambda i: i % 20 == 0)
    assert expected and found(hardnegatives.mine(df, F.col("vec_id") % 20 == 0)) == expected


def test_windows_ranks_and_scale_are_arguments(spark):
    rows = vectors(150, 6, 3, 0.4)
    df = spark.createDataFrame(rows, FLOATS)
    got = hardnegatives.mine(df, F.col("vec_id") < 10, low=-20, high=60, n_positives=2, n_negatives=4, scale=1000.0)
    assert found(got) == model(rows, lambda i: i < 10, -20, 60, 2, 4, 1000.0)


def test_rows_that_take_no_part_and_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.4], 2), (2, [0.5, 0.4], 2), (3, [0.9, 0.5], 1),
        (4, None, 1), (5, [1.0, None], 2), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [0.6, 0.3], None),
        (None, [0.6, 0.3], 2), (9, [0.7], 2), (10, [], 2), (0, [1.0, 0.6], 3), (11, [-1.0, -1.0], 1), (12, [0.0, 0.0], 1),
        (13, [0.55, 0.4, 0.0], 2), (50, [0.3, 0.3], 7), (100, [0.2, 0.1], 1), (100, [0.2, 0.1], 1),
    ]
    extra = [(*r, "x", "y", "z") for r in rows]
    df = spark.createDataFrame(extra, FLOATS + ", anchor string, id string, vector string")
    assert found(hardnegatives.mine(df, F.col("vec_id") % 50 == 0)) == model(rows, lambda i: i % 50 == 0)
    assert found(hardnegatives.mine(df.where("false"), F.col("vec_id") % 50 == 0)) == []
    assert found(hardnegatives.mine(df, F.lit(None).cast("boolean"))) == []
    renamed = df.selectExpr("vec_id AS `a.b`", "label AS `my label`", "embedding AS `x-y`")
    got = hardnegatives.mine(renamed, F.col("`a.b`") == 0, vec_id="a.b", label="my label", embedding="x-y")
    assert found(got) == model(rows, lambda i: i == 0)


def test_large_components_stay_exact_or_are_clamped(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21) + 3 * i), 1.0 / (i + 1)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, FLOATS)
    assert found(hardnegatives.mine(df, F.col("vec_id") % 10 == 0, high=100)) == model(rows, lambda i: i % 10 == 0, high=100)
    huge = spark.createDataFrame([(i, [1e300, -1e300], i % 2) for i in range(4)], FLOATS)
    assert hardnegatives.mine(huge, F.col("vec_id") == 0, high=100).count() == 2


def test_walk_visits_every_cell_by_falling_bound():
    rng = np.random.default_rng(5)
    data = rng.integers(-200, 200, size=(300, 6))
    books = [hardnegatives.fit(data[:, :3], 4), hardnegatives.fit(data[:, 3:], 4)]
    codes = [hardnegatives._nearest(p, b) for p, b in zip((data[:, :3], data[:, 3:]), books, strict=True)]
    cell = codes[0] * 4 + codes[1]
    order = np.argsort(cell, kind="stable")
    radii = [np.array([np.sqrt(((p[c == k] - b[k]) ** 2).sum(axis=1)).max(initial=0) for k in range(4)]) for p, c, b in zip((data[:, :3], data[:, 3:]), codes, books, strict=True)]
    shard = hardnegatives.Shard(data[order].astype(np.float64), order, order, np.searchsorted(cell[order], np.arange(17)), books, radii)
    for anchor in data[:20]:
        met, last = [], np.inf
        steps = list(shard.walk(anchor))
        for rows, bound in steps:
            # No row of a later step is above the bound that this step gave, and bounds fall.
            assert bound <= last and (hardnegatives.products(shard.vectors[rows], anchor) <= last).all()
            met, last = [*met, *rows.tolist()], bound
        assert sorted(met) == list(range(300)) and last == -np.inf


def test_far_cells_are_not_visited():
    """In well-parted clusters a shard is done long before all its rows are seen."""
    rng = np.random.default_rng(1)
    centres = np.repeat(np.eye(8) * 250, 50, axis=0)
    data = np.floor(centres + rng.normal(size=centres.shape)).astype(np.int64)
    books = [hardnegatives.fit(data[:, :4], 8), hardnegatives.fit(data[:, 4:], 8)]
    codes = [hardnegatives._nearest(p, b) for p, b in zip((data[:, :4], data[:, 4:]), books, strict=True)]
    width = len(books[1])
    cell = codes[0] * width + codes[1]
    order = np.argsort(cell, kind="stable")
    radii = [np.array([np.sqrt(((p[c == k] - b[k]) ** 2).sum(axis=1)).max(initial=0) for k in range(len(b))]) for p, c, b in zip((data[:, :4], data[:, 4:]), codes, books, strict=True)]
    begin = np.searchsorted(cell[order], np.arange(len(books[0]) * width + 1))
    shard = hardnegatives.Shard(data[order].astype(np.float64), order, np.zeros(400, np.int64), begin, books, radii, 32)
    seen, walk = [], shard.walk
    shard.walk = lambda anchor: ((seen.append(len(rows)) or (rows, bound)) for rows, bound in walk(anchor))
    score, ids = hardnegatives.positives(shard, 3, 0, data[3], 5)
    exact = sorted((-int(data[i] @ data[3]), i) for i in range(400) if i != 3)[:5]
    assert list(zip((-score).tolist(), ids.tolist(), strict=True)) == exact and sum(seen) < 200
