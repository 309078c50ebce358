"""Trajectories, groups and quantiles that no single task can hold."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.operators import places, quantiles, trajectories, windows


def giant(spark, n, share=0.9):
    """One unit with most rows, small ones, a unit without a name, equal times."""
    k = F.col("id")
    unit = F.when(k % 1000 < 1000 * share, F.lit(-1)).when(k % 1000 == 999, F.lit(None)).otherwise(k % 37)
    value = F.when(F.hash("id", F.lit(2)) % 3 == 0, None).otherwise(F.hash("id", F.lit(3)) % 1000 / 7)
    return spark.range(n, numPartitions=6).select(unit.alias("unit"), (F.pmod(F.hash("id"), F.lit(n // 4))).cast("double").alias("t"), "id", value.alias("x"))


def test_places_equal_a_window_over_whole_units(spark, tmp_path):
    df = giant(spark, 60_000)
    got = places.place_rows(df, ["unit"], ["t", "id"], str(tmp_path / "a"), 12)
    sizes = sorted(r["count"] for r in got.groupBy("part").count().collect())
    assert len(sizes) == 12 and sizes[-1] < 2 * sizes[6]
    order = Window.partitionBy("unit").orderBy("t", "id")
    want = df.select("*", (F.row_number().over(order) - 1).alias("pos"), F.count("*").over(Window.partitionBy("unit")).alias("n_rows"), F.lag("t").over(order).alias("earlier"))
    got = places.row_before(got, ["unit"], "t", "earlier").drop("part")
    assert got.count() == 60_000 and got.exceptAll(want.select(*got.columns)).count() == 0


def test_placed_rows_interpolate_as_whole_units_do(spark, tmp_path):
    df = giant(spark, 20_000).withColumn("x", F.when(F.col("t") > 400, F.col("x")))  # parts without any value
    got = places.place_rows(df.where("unit is not null"), ["unit"], ["t", "id"], str(tmp_path / "a"), 9)
    filled = places.interpolate_placed(got, ["unit"], ["x"]).select("id", "x_filled")
    want = trajectories.interpolate(trajectories.ordered(df.where("unit is not null"), ["unit"], ["t", "id"]), ["unit"], ["x"]).select("id", F.col("x_filled").alias("w"))
    assert filled.join(want, "id").where("not (x_filled <=> w) and abs(x_filled - w) > 1e-9").count() == 0 and filled.count() == want.count()


def test_windows_take_the_lengths_that_are_there(spark, tmp_path):
    df = giant(spark, 6_000).where("unit is not null")
    placed = places.place_rows(df, ["unit"], ["t", "id"], str(tmp_path / "a"), 7)
    whole = trajectories.ordered(df, ["unit"], ["t", "id"])
    keep = ["unit", "id", "w_idx", "w_start", "w_pos"]
    assert windows.tile(placed, ["unit"], 64, 32).select(*keep).exceptAll(windows.tile(whole, ["unit"], 64, 32).select(*keep)).count() == 0
    keep = ["unit", "id", "w_end", "w_pos"]
    a, b = (windows.roll(x, ["unit"], 60, 25, 30).select(*keep) for x in (placed, whole))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    assert "Window" not in windows.tile(placed, ["unit"], 64, 32)._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_places_of_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([], "unit string, t double, id long")
    assert places.place_rows(df, ["unit"], ["t", "id"], str(tmp_path / "a")).count() == 0
    one = spark.createDataFrame([("a", 1.0, 1, [1.0]), ("a", None, 2, None), (None, 1.0, 3, [2.0])], "unit string, t double, id long, x array<double>")
    got = places.place_rows(one, ["unit"], ["t", "id"], str(tmp_path / "b")).collect()
    assert sorted((r.id, r.pos, r.n_rows) for r in got) == [(1, 1, 2), (2, 0, 2), (3, 0, 1)]


@pytest.mark.parametrize("small", [0, quantiles.SMALL])
def test_quantiles_are_exact(spark, monkeypatch, small):
    if not small:  # brackets also for groups of some thousand rows
        monkeypatch.setattr(quantiles, "ACCURACY", 50)
    monkeypatch.setattr(quantiles, "SMALL", small or 200)
    rng = random.Random(small)
    groups = {
        "many": [rng.gauss(0, 1) for _ in range(5000)],
        "ties": [float(rng.randrange(3)) for _ in range(4000)],
        "one value": [7.5] * 3000,
        "wide": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)],
        "mostly one": [0.0] * 1500 + [rng.random() for _ in range(900)],
        "few": [3.0, 1.0, 2.0],
        "alone": [4.0],
        None: [1.0, 2.0],
        "empty": [],
    }
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], F.col("v"), shares).collect()}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, values in groups.items():
        if values:
            ranks = np.sort(values)
            for q, s in zip(got[g].q, shares, strict=True):
                r = (len(values) - 1) * s
                low, high = ranks[int(np.floor(r))], ranks[int(np.ceil(r))]
                assert q == pytest.approx(low + (high - low) * (r - np.floor(r)), rel=1e-12) and got[g].n == len(values)
    whole = quantiles.exact_quantiles(df.where("g = 'few'"), [], F.col("v"), [0.5]).first()
    assert (whole.n, whole.q) == (3, [2.0])
