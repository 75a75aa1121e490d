"""Joins whose sides the planner takes for small, and loops, at sizes that their inputs may have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom import catalogue_splitting
from voxloom.operators import clustering, mesh, records, relaxation, resample
from voxloom.operators.graph import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sheet(spark):
    """Vertices of a small grid, and its triangles."""
    vertices = spark.range(25).select("id", (F.col("id") % 5).cast("double").alias("x"), F.floor(F.col("id") / 5).cast("double").alias("y"), F.lit(0.0).alias("z"))
    triangles = spark.range(19).where("id % 5 < 4").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 5).alias("c"))
    return vertices, triangles


def test_welding_sends_no_mesh_through_the_driver(spark, sheet):
    for df in (mesh.welded(sheet[0], 1e-3), clustering.close_pairs(sheet[0], 1e-3)):
        assert "Broadcast" not in plan(df)
    assert mesh.welded(sheet[0], 1e-3).where("id <> first").count() == 0


def test_simplifying_sends_no_mesh_through_the_driver(sheet):
    assert "Broadcast" not in plan(mesh.simplified(*sheet, 0.1)[1])


def test_smoothing_sends_no_mesh_through_the_driver(sheet):
    assert "Broadcast" not in plan(mesh.smoothed(*sheet))


def test_colouring_sends_no_mesh_through_the_driver(spark, sheet):
    vox = spark.createDataFrame([(0, 0, 0, 1, 1, 200, 3)], "t int, c int, z int, y int, x int, v int, label long")
    vertices = sheet[0].select("*", F.lit(0).alias("t"), F.lit(0).alias("c"))
    assert "Broadcast" not in plan(mesh.coloured(vertices, vox))
    assert mesh.coloured(vertices, vox).where("alpha > 0").count() == 1


def test_pulls_send_no_points_through_the_driver(spark):
    points = spark.range(60).select(F.lit(1).alias("ruler"), "id", (F.col("id") % 7).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).withColumnRenamed("id", "n")
    few = spark.createDataFrame([(1.0, 0.0, 1.0, 0.5)], "x double, y double, z double, w double")
    # Samples of one place are met once, whatever their number, and either side may be the larger.
    many = few.unionByName(few).unionByName(spark.range(90).select((F.col("id") + 100.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.5).alias("w")))
    got = [relaxation.pulls(points, s, 1.0, 2.0) for s in (few, many)]
    assert all("Broadcast" not in plan(df) for df in got)
    rows = [sorted(map(tuple, df.collect())) for df in got]
    assert rows[0] == rows[1] and len(rows[0]) == sum(k % 7 <= 2 for k in range(60))
    assert relaxation.summed(many).count() == 91


@pytest.mark.parametrize("most", [0, 300_000])
def test_profiles_sum_nothing_along_rulers(spark, monkeypatch, most):
    monkeypatch.setattr(resample, "BROADCAST_SAMPLES", most)
    points = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 3, 0, 0), (1, 2, 3, 2, 0), (2, 0, 0, 0, 0)], "ruler long, t int, x int, y int, z int")
    vox = spark.createDataFrame([(0, 1, 0, 0, 1, 7), (0, 1, 0, 1, 3, 9), (1, 0, 0, 0, 2, 5), (1, 0, 9, 9, 9, 1)], "t int, c int, z int, y int, x int, v int")
    df = resample.profiles(points, vox)
    got = {(q.t, q.c, q.ruler, q.bin): (q.n, q["mean"]) for q in df.collect()}
    assert got == {(t, c, 1, b): (1, {(0, 1, 1): 7.0, (0, 1, 4): 9.0, (1, 0, 2): 5.0}.get((t, c, b), 0.0)) for t, c in ((0, 1), (1, 0)) for b in range(5)}
    # Bins are not a key of any aggregation.
    assert not any("bin#" in k.split("]")[0] for k in plan(df).split("keys=[")[1:])


def test_nearest_records_sort_no_pairs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(records, "cut", lambda df: written.append(plan(df)) or cut(df))
    # Equal inputs, ties and a record without input.
    rows = [(i, [i % 7, 1]) for i in range(50)] + [(50, None)]
    df = spark.createDataFrame(rows, "rec_id long, hist array<long>")
    asked = df.where("rec_id % 10 = 0").select(F.col("rec_id").alias("q_id"), F.col("hist").alias("q_hist"))
    got = records.nearest(df, asked, block=2)
    assert {q.q_id: q.rec_id for q in got.collect()} == {0: 49, 10: 45, 20: 48, 30: 44, 40: 47, 50: 50}
    assert not any("SortAggregate" in p for p in [*written, plan(got)])


def test_two_views_are_paired_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalogue_splitting.stereo, "second_camera", lambda pairs: seen.append(plan(pairs)) or np.array([[1.0, 0, 0, -1], [0, 1, 0, 0], [0, 0, 1, 0]]))
    catalogue_splitting.v16_triangulated(spark, "/root/testdata/sf0.001")
    assert "Join" not in seen[0]
