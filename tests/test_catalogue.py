"""A cross-section of registered queries against their SQL, at the smallest size."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from voxloom import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["a05_median_mode", "a14_a19_colocalization", "c01_component_stats", "c06_surface", "c08_c09_linked_stats", "f21_ray_front", "j04_r02_frame_links", "j07_neighbours_in_reach", "j12_projection", "k14_coordinate_lines", "p08_fill_holes", "t09_t10_key_frames", "r17_link_exclusive", "v01_v03_trilinear_border2", "v06_similarity", "v07_a21_mesh_measures", "v17_ruler_frame", "w01_box", "w20_thin", "w24_tile_interpolation", "w26_distance", "x08_profile", "x13_seed_ids", "z_windows", "c10_consistent_ids", "g01_f14_stop_grow", "m02_dbscan", "r05_contact_bins", "r07_vertex_links", "t02_t03_dff", "t04_line_baseline", "t10_end_extended", "t16_gait_variance", "w06_erode_3d", "x11_boxes", "c07_principal_lengths", "r11_alternating_paths", "r07_r11_settled_links", "r22_path_report", "r23_stencil_tracks", "v04_v06_rigid_scores", "m13_local_extrema", "w19_thinned_once", "m12_local_fits", "r12_r19_split_forks", "s16_bricked_levels", "v16_triangulated", "v15_pulls"]


def plain(v):
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = db.execute(catalogue.SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(plain(r[names.index(k)]) for k in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in cols) for r in got.collect()), key=repr) == want


def test_registry_is_consistent():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
