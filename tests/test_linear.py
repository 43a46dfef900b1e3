"""The pooled linear arm against plain least squares."""

import numpy as np
import pytest

from loadstone.operators import linear as li

F = ["a", "b"]


def _frame(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        for o in range(n):
            a, b = 1000 + rng.normal(), rng.normal() * 5
            rows.append((f"r{k}", o * 7, float(a), float(b), float(3 + 2 * a - b + rng.normal())))
    return rows, spark.createDataFrame(rows, "region string, o long, a double, b double, target double")


def _lstsq(rows):
    x = np.array([[1, r[2] - 1000, r[3]] for r in rows])
    c, wa, wb = np.linalg.lstsq(x, np.array([r[4] for r in rows]), rcond=None)[0]
    return c - 1000 * wa, wa, wb


def test_folds_by_position_and_fits(spark):
    sizes = (37, 62, 4)  # the last has fewer rows than blocks
    rows, df = _frame(spark, sizes)
    blocks = {(r.region, r.o): r.block for r in li.with_blocks(df, ["region"], "o", 5).collect()}
    out = {r.fold: r for r in li.cross_validate(df, F, "o").collect()}
    assert sorted(out) == [0, 1, 2, 3, 4]
    for fold, r in out.items():
        train, test = [], []
        for k, n in enumerate(sizes):
            own, size = [x for x in rows if x[0] == f"r{k}"], n // 6
            start = n - (5 - fold) * size
            train += own[:start]
            test += own[start : start + size]
        assert all(blocks[x[0], x[1]] == fold + 1 for x in test) and all(blocks[x[0], x[1]] <= fold for x in train)
        c, wa, wb = _lstsq(train)
        assert (r.n_train, r.n_test) == (len(train), len(test))
        assert [r.intercept, r.w_a, r.w_b] == pytest.approx([c, wa, wb], rel=1e-7)
        assert r.mae == pytest.approx(np.mean([abs(x[4] - (c + wa * x[2] + wb * x[3])) for x in test]), rel=1e-7)


def test_awkward_inputs(spark):
    rows, df = _frame(spark, (30,))
    holes = df.unionByName(spark.createDataFrame([("r0", 9999, None, 1.0, 2.0), ("r0", 9998, 1.0, 1.0, None)], df.schema))
    assert li.fit(holes, F).weights == pytest.approx(_lstsq(rows)[1:], rel=1e-7)
    assert li.fit(df.filter("false"), F) is None and li.cross_validate(df.filter("false"), F, "o").count() == 0
    flat = df.selectExpr("region", "o", "a", "1.0D AS b", "2 * a AS c", "target")
    w = li.fit(flat, ["a", "b", "c"])
    assert w.weights[1] == 0 and w.weights[0] + 2 * w.weights[2] == pytest.approx(li.fit(df, ["a"]).weights[0], rel=1e-6)


def test_moments_add_up(spark):
    rows, df = _frame(spark, (20, 30))
    whole = li.moments(df.selectExpr("*", "0 AS g"), [*F, "target"], "g")[0]
    parts = li.moments(df, [*F, "target"], "region")
    both = li.added(parts["r0"], parts["r1"])
    assert both.n == whole.n and np.allclose(both.mean, whole.mean) and np.allclose(both.comoment, whole.comoment)
    assert li.added(None, both) is both and li.added(both, None) is both
