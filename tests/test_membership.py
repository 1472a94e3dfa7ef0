import math

import pytest
from pyspark.sql import functions as F

from softseg.functions import membership as mf
from softseg.operators.fuzzify import SHIFT_WINDOWS


def degrees(spark, shape, xs):
    rows = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in rows.orderBy("i").select(shape.of(F.col("x"))).collect()]
    assert got == pytest.approx([shape.at(float(x)) for x in xs]) or None in xs
    return got


@pytest.mark.parametrize(
    "shape, xs, want",
    [
        (mf.Trapezoid(6, 8, 16, 18), [0, 6, 7, 8, 12, 16, 17, 18, 24], [0, 0, 0.5, 1, 1, 1, 0.5, 0, 0]),
        (mf.Triangle(0, 10, 20), [0, 5, 10, 15, 20], [0, 0.5, 1, 0.5, 0]),
        (mf.Gaussian(30, 10), [30, 40], [1, math.exp(-0.5)]),
        (mf.WrapAround(20, 22, 4, 6), [0, 2, 4, 5, 6, 12, 20, 21, 22, 23.9], [1, 1, 1, 0.5, 0, 0, 0, 0.5, 1, 1]),
        (mf.hour_window(SHIFT_WINDOWS["split"]), [10, 16, 13, 3], [1, 1, 0, 0]),
        (mf.Complement(mf.Triangle(0, 10, 20)), [0, 5, 10], [1, 0.5, 0]),
    ],
)
def test_closed_forms(spark, shape, xs, want):
    assert degrees(spark, shape, xs) == pytest.approx(want)


def test_sigmoid_sides(spark):
    up, = degrees(spark, mf.Sigmoid(0.15, 25), [25])
    assert up == pytest.approx(0.5)
    assert degrees(spark, mf.Sigmoid(0.15, 25), [60])[0] > 0.99
    assert degrees(spark, mf.Sigmoid(-0.15, 25), [60])[0] < 0.01


def test_vertical_edges_and_missing_values(spark):
    assert degrees(spark, mf.Trapezoid(0, 0, 1, 1), [-0.1, 0, 1, 1.1]) == [0, 1, 1, 0]
    rows = spark.sql("select double('NaN') as x union all select null")
    assert [r[0] for r in rows.select(mf.Trapezoid(0, 1, 2, 3).of(F.col("x"))).collect()] == [0.0, 0.0]


def test_bad_parameters():
    for make in (lambda: mf.Trapezoid(3, 2, 4, 5), lambda: mf.Gaussian(0, 0), lambda: mf.membership({"family": "bell", "params": [1]}), lambda: mf.membership({"family": "trimf", "params": [1, 2]}), lambda: mf.alpha_cut(F.lit(1), 1.5)):
        with pytest.raises(ValueError):
            make()


def test_factory_and_windows():
    assert mf.membership({"family": "trapmf", "params": [1, 2, 3, 4]}) == mf.Trapezoid(1, 2, 3, 4)
    assert mf.membership({"c": 1, "sigma": 2}, "gauss") == mf.Gaussian(1, 2)
    assert isinstance(mf.hour_window([20, 22, 4, 6]), mf.WrapAround)
    assert isinstance(mf.hour_window({"a": 6, "b": 8, "c": 16, "d": 18}), mf.Trapezoid)


def test_alpha_interval(spark):
    lo, hi = mf.alpha_interval(spark, mf.Triangle(0, 10, 20), 0.5)
    assert (lo, hi) == pytest.approx((5, 15), abs=0.02)
    assert mf.alpha_interval(spark, mf.Complement(mf.Trapezoid(0, 0, 1, 1)), 1.0) is None


@pytest.mark.parametrize("family", ["triangular", "trapezoidal", "gaussian", "sigmoidal"])
def test_partition_covers_the_range(family):
    terms = mf.partition(family, ["low", "medium", "high"])
    assert list(terms) == ["low", "medium", "high"]
    for x in (0.0, 0.25, 0.5, 0.75, 1.0):
        assert max(m.at(x) for m in terms.values()) > 0.3
    assert terms["low"].at(0.0) > 0.9 and terms["high"].at(1.0) > 0.9
