import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.operators import pyramid as P


def cells(spark, values, level_first=0, kind="double"):
    return spark.createDataFrame([(level_first + i, v) for i, v in enumerate(values)], f"cell_id long, v {kind}")


def out(df):
    return {r["cell_id"]: r["v"] for r in df.collect()}


def test_mean_of_descendants(spark):
    df = cells(spark, [float(i) for i in range(16)], 1600)
    assert out(P.coarsen(df, 7, 6)) == {400: 1.5, 401: 5.5, 402: 9.5, 403: 13.5}
    assert out(P.coarsen(df, 7, 5)) == {100: 7.5}


def test_not_a_mean_of_means(spark):
    df = cells(spark, [9.0, *[float("nan")] * 3, *[1.0] * 12])
    assert out(P.coarsen(df, 3, 1))[0] == pytest.approx(21 / 13)
    assert out(P.mean_levels(df, 3, [2, 1], ["v"])[1])[0] == pytest.approx(21 / 13)


@pytest.mark.parametrize("how,want", [("min", 1), ("max", 10), ("sum", 16), ("mean", 4)])
def test_reducers(spark, how, want):
    assert out(P.coarsen(cells(spark, [1.0, 2.0, 3.0, 10.0]), 2, 1, how)) == {0: want}


def test_missing(spark):
    df = cells(spark, [float("nan")] * 4)
    assert out(P.coarsen(df, 2, 1, "sum")) == {0: 0.0}
    assert out(P.coarsen(df, 2, 1, "mean")) == {0: None} and out(P.coarsen(df, 2, 1, "mode")) == {0: None}


@pytest.mark.parametrize("values,want", [([3, 1, 3, 2], 3), ([5, 2, 2, 5], 2), ([5, 5, 2, 2], 2), ([7, 7, 1, 2], 7), ([0, 3, 3, 0], 0)])
def test_mode(spark, values, want):
    assert out(P.coarsen(cells(spark, values, kind="int"), 2, 1, "mode")) == {0: want}


def test_mode_of_floats_skips_nan(spark):
    nan = float("nan")
    assert out(P.coarsen(cells(spark, [nan, nan, nan, 4.0]), 2, 1, "mode")) == {0: 4.0}


@pytest.mark.parametrize("kind,values,want", [("int", [1, 0, 4, 0], 5), ("tinyint", [-128, 1, 0, 2], -125), ("long", [2**31, None, 1, 1], 2**31 + 1), ("int", [1, None, 8, None], 9)])
def test_bitwise_or(spark, kind, values, want):
    assert out(P.coarsen(cells(spark, values, kind=kind), 2, 1, "bitwise_or")) == {0: want}


def test_bitwise_or_guard(spark):
    with pytest.raises(ValueError):
        P.coarsen(cells(spark, [1.0]), 2, 1, "bitwise_or")
    with pytest.raises(ValueError):
        P.check_bitwise_or(T.LongType(), decoded=True)
    with pytest.raises(ValueError):
        P.check_bitwise_or(T.IntegerType(), packed=True)


def test_round_half_even_and_fill(spark):
    df = cells(spark, [0.5, 1.5, 2.5, None])
    assert [r[0] for r in df.select(P.restore(F.col("v"), T.ShortType(), 255)).collect()] == [0, 2, 2, 255]


def test_half_precision(spark):
    df = cells(spark, [1100.0, 70000.0, None])
    assert [r[0] for r in df.select(P.half_precision(F.col("v"))).collect()] == [1100.0, float("inf"), None]


def test_grouping_sets_and_rollup_agree_with_single_levels(spark):
    rng = np.random.default_rng(42)
    v = rng.normal(size=768)
    v[rng.random(768) < 0.1] = np.nan
    df = cells(spark, v.tolist())
    both = P.all_levels(df, 3, [2, 1, 0], {"v": "mean"})
    rolled = P.mean_levels(df, 3, [2, 1, 0], ["v"])
    for level in (2, 1, 0):
        want = out(P.coarsen(df, 3, level))
        assert out(both.filter(F.col("level") == level)) == pytest.approx(want)
        assert out(rolled[level]) == pytest.approx(want)


def test_extra_dimensions_are_kept(spark):
    df = spark.createDataFrame([(i, t, float(i + t)) for i in range(4) for t in (0, 10)], "cell_id long, time int, v double")
    assert {(r["time"], r["v"]) for r in P.coarsen(df, 2, 1, keys=["time"]).collect()} == {(0, 1.5), (10, 11.5)}


def test_levels(spark):
    assert [P.derived_chunk_level(*x) for x in ((19, 20, 12), (13, 20, 12), (8, 20, 12), (4, 20, 12), (18, 20, 19), (19, 20, 12, 12), (13, 20, 12, 12))] == [11, 5, 0, 0, 14, 12, 12]
    assert [P.chunk_and_shard_levels(l, 9, 8, 7) for l in (20, 19, 18, 17, 16, 14)] == [(11, 8), (10, 8), (9, 8), (8, None), (7, None), (7, None)]
    assert P.coarsest_whole_level(spark.range(3 * 64, 4 * 64).withColumnRenamed("id", "cell_id"), 4) == 1
    assert P.coarsest_whole_level(spark.range(12 * 64).withColumnRenamed("id", "cell_id"), 3) == 0
    native = {3: ["a"], 2: ["a", "b"]}
    assert P.source_level(native, "a", 1) == 2 and P.source_level(native, "a", 1, nearest=False) == 3
    with pytest.raises(ValueError):
        P.source_level(native, "z", 1)
    with pytest.raises(ValueError):
        P.coarsen(cells(spark, [1.0]), 2, 2)


def test_bucketed_pyramid_has_no_shuffle(spark):
    from cellwright.sources.sinks import write_bucketed

    write_bucketed(cells(spark, [float(i) for i in range(768)]), "level3", 3, 1, 4)
    df = spark.table("level3").selectExpr("chunk_id", "cell_id >> 2 as cell_id", "v").groupBy("chunk_id", "cell_id").avg("v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Initial Plan")[0] and df.count() == 192
    spark.sql("drop table level3")
