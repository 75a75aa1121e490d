"""Micro goldens: one small volume or table per trap."""

import numpy as np
import pytest

from voxloom.functions import geometry
from voxloom.operators import algebra, clustering, components, graph, records, segmentation, stats, stencil, timeseries
from voxloom.sources import nrrd, text

VOX = "t int, c int, z int, y int, x int, v int, mask int, label long"


def vox(spark, rows):
    return spark.createDataFrame([(0, 0, *r) for r in rows], VOX)


def test_zero_samples_are_no_data_but_count_in_the_mask(spark):
    df = vox(spark, [(0, 0, 0, 0, 255, 1), (0, 0, 1, 5, 255, 1), (0, 0, 2, 7, 0, 1)])
    r = stats.basic(df, ["t"]).first()
    assert (r.n, r.total, r.n_masked, r.least, r.mask_voxels) == (2, 12, 1, 5, 2)
    c = components.component_stats(df).first()
    assert (c.n, c.total, c["mean"], c.sigma) == (2, 12, 6.0, 1.0)


def test_lower_median_and_smallest_mode(spark):
    df = vox(spark, [(0, 0, i, v, 0, 0) for i, v in enumerate([1, 1, 2, 3, 3, 4, 5, 6])])
    r = stats.order_statistics(df, ["t"]).first()
    assert (r.median, r["mode"]) == (3, 1)


def test_thresholds_are_half_open(spark):
    a = vox(spark, [(0, 0, 0, 64, 0, 0), (0, 0, 1, 65, 0, 0)])
    r = stats.colocalization(a).first()
    assert (r.n, r.inside, r.inside_sum) == (2, 1, 65)


def test_touching_blocks_double_their_contact(spark):
    df = vox(spark, [(0, 0, x, 200, 0, 1 + x // 3) for x in range(6)])
    r = components.contacts(df).first()
    assert (r.a, r.b, r.n, r.total) == (1, 2, 2, 400)
    assert components.contacts(df, 0.9).isEmpty()


def test_median_is_one_below_the_middle():
    a = np.arange(1, 28, dtype=float).reshape(3, 3, 3)
    assert stencil.median(a, 1)[0, 0, 0] == 13


@pytest.mark.parametrize("brick", [(2, 2, 2), (8, 16, 32)])
def test_bricks_do_not_change_results(spark, monkeypatch, brick):
    r = np.random.default_rng(1)
    dims = (3, 5, 6)
    grid = r.integers(0, 256, dims)
    df = vox(spark, [(z, y, x, int(grid[z, y, x]), 0, 0) for z in range(3) for y in range(5) for x in range(6)])
    monkeypatch.setattr(stencil, "BRICK", brick)
    got = {(q.z, q.y, q.x): q.v for q in stencil.apply(df, dims, 1, stencil.box_mean).collect()}
    want = np.floor(stencil.box_mean(np.pad(grid / 255.0, 1, mode="edge"), 1) * 255 + 1e-6)
    assert all(got.get(k, 0) == want[k] for k in np.ndindex(dims))


def test_chain_and_pairs_connect(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_growth_joins_diagonals_only(spark):
    df = vox(spark, [(0, 0, 0, 250, 0, 0), (1, 1, 1, 250, 0, 0), (0, 5, 5, 250, 0, 0), (0, 0, 1, 10, 0, 0)])
    got = {(r.z, r.y, r.x): r.label for r in segmentation.grow(df, 100).collect()}
    assert got == {(0, 0, 0): 1, (1, 1, 1): 1, (0, 5, 5): (5 << 20 | 5) + 1}


def test_baseline_divides_by_variance():
    flat = np.array([1.0] * 18 + [9.0, 9.5])
    assert timeseries.constant_baseline(flat) == pytest.approx(1.0)
    slope, _ = timeseries.linear_baseline(np.arange(10.0))
    assert slope == pytest.approx(1.0)


def test_dbscan_border_and_noise(spark):
    pts = spark.createDataFrame([(i, float(x), 0.0, 0.0, 1.0) for i, x in enumerate([0, 1, 2, 3, 50])], "id long, x double, y double, z double, w double")
    got = {r.id: r.cluster for r in clustering.dbscan(pts, 1.5, 3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: None}


def test_nearest_record_takes_the_last_of_ties(spark):
    rec = spark.createDataFrame([(1, [0, 0]), (2, [2, 0]), (3, [0, 0])], "rec_id long, hist array<long>")
    q = spark.createDataFrame([(9, [0, 0])], "q_id long, q_hist array<long>")
    assert records.nearest(rec, q).first().rec_id == 3


def test_mask_algebra(spark):
    a = vox(spark, [(0, 0, 0, 1, 255, 0), (0, 0, 1, 1, 100, 0)])
    b = vox(spark, [(0, 0, 0, 1, 50, 0)])
    at = lambda how: {r.x: r.mask for r in algebra.mask_union(a, b, how).collect()}
    assert at("union") == {0: 255, 1: 100} and at("exclude") == {0: 0, 1: 100} and at("intersect") == {0: 50, 1: 0}


def test_frame_predicate():
    bits = {"rewind": 1, "first": 2, "last": 0x2000, "middle": 0x14000}
    assert geometry.frame_allowed(0, 0, 50, 2, 0xFFFFF, False, bits)
    assert not geometry.frame_allowed(51, 0, 50, 0xFFFFF, 0xFFFFF, False, bits)
    assert geometry.frame_allowed(99, 0, 50, 1, 1, True, bits)


def test_nrrd_round_trip(spark, tmp_path):
    volume = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    for packed in (False, True):
        back, fields = nrrd.decode(nrrd.encode(volume, packed=packed))
        assert (back == volume).all() and fields["sizes"] == "4 3 2"
    (tmp_path / "v_007.nrrd").write_bytes(nrrd.encode(volume))
    rows = nrrd.read(spark, str(tmp_path)).collect()
    assert len(rows) == 23 and all(r.t == 7 and r.v == volume[r.z, r.y, r.x] for r in rows)


def test_text_sources(spark, tmp_path):
    (tmp_path / "walk.csv").write_text("left\n0,1,2\n1,2,3\n4,5,6\n")
    assert {(r.dim, r.frame, r.value) for r in text.gait_csv(spark, str(tmp_path / "walk.csv"), 4).collect()} >= {(0, 0, 1.0), (1, 2, 6.0)}
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\n")
    v, f = text.obj_mesh(spark, str(tmp_path / "m.obj"))
    assert v.count() == 4 and sorted((r.i0, r.i1, r.i2) for r in f.collect()) == [(1, 2, 3), (1, 3, 4)]
    (tmp_path / "pose.csv").write_text("scorer,a,a\nbodyparts,paw,paw\ncoords,x,y\ntime_offset,5\n0,1.5,2.5\n")
    r = text.pose_csv(spark, str(tmp_path / "pose.csv")).first()
    assert (r.ruler, r.t, r.x, r.y) == ("paw", 5, 1.5, 2.5)
    (tmp_path / "a.txt").write_text("Name: n1\nComponents:\nspot\t1\t2\t3\tinfo\n")
    r = text.annotations(spark, str(tmp_path / "a.txt")).first()
    assert (r["name"], r.text, r.z, r["info"]) == ("n1", "spot", 3.0, "info")
    assert text.commands("[a]\niter=3\n[b]\nx=1\n")[0] == {"section": "a", "iter": "3"}
