"""Sampling, registration, distance, density, thinning, track edits and image files against small brute forces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import density, resample, stencil, tracking
from voxloom.sources import images

VOX = "t int, c int, z int, y int, x int, v int, label long"


def volume(spark, a, t=0):
    return spark.createDataFrame([(t, 0, *map(int, k), int(a[k]), int(a[k] > 99)) for k in np.ndindex(a.shape)], VOX)


def dense(df, dims, name="v"):
    a = np.zeros(dims)
    for r in df.collect():
        a[r.z, r.y, r.x] = r[name]
    return a


@pytest.mark.parametrize("how,border", [("nearest", 0), ("trilinear", 0), ("trilinear", 1), ("bilinear", 2), ("box", 1)])
def test_resize_matches_sampling_point_by_point(spark, how, border):
    a = np.random.default_rng(0).integers(0, 256, (3, 4, 5))
    out = (4, 3, 9)

    def at(k):
        k = [resample.bordered(i, n, border) for i, n in zip(k, a.shape, strict=True)]
        return 0 if None in k else a[tuple(k)]

    want = np.zeros(out)
    for p in np.ndindex(out):
        u = [(i + 0.5) / m * n for i, m, n in zip(p, out, a.shape, strict=True)]
        if how == "nearest":
            want[p] = at([int(q) for q in u])
        elif how == "box":
            want[p] = sum(at([int(q) + d for q, d in zip(u, (dz, dy, dx), strict=True)]) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 27
        else:
            low = [int(np.floor(q - 0.5)) for q in u]
            f = [q - 0.5 - l for q, l in zip(u, low, strict=True)]
            for s in np.ndindex(1 if how == "bilinear" else 2, 2, 2):
                w = np.prod([fk if o else 1 - fk for fk, o in list(zip(f, s, strict=True))[1 if how == "bilinear" else 0 :]])
                want[p] += w * at([l + o for l, o in zip(low, s, strict=True)])
    assert dense(resample.resize(volume(spark, a), a.shape, out, how, border), out) == pytest.approx(want)


def test_crop_is_a_part_of_the_whole(spark):
    a = np.random.default_rng(1).integers(0, 256, (3, 4, 5))
    whole = dense(resample.resize(volume(spark, a), a.shape, (6, 8, 10)), (6, 8, 10))
    part = dense(resample.resize(volume(spark, a), a.shape, (6, 8, 10), origin=(1, 2, 3), crop=(2, 3, 4)), (2, 3, 4))
    assert part == pytest.approx(whole[1:3, 2:5, 3:7])


def test_turning_four_times_changes_nothing(spark):
    a = np.random.default_rng(2).integers(1, 256, (2, 4, 4))
    df = volume(spark, a)
    once = resample.turned(df, a.shape, [[1, 0, 0], [0, 0, 1], [0, -1, 0]])
    assert (dense(once, a.shape) != a).any()
    for _ in range(3):
        once = resample.turned(once, a.shape, [[1, 0, 0], [0, 0, 1], [0, -1, 0]])
    assert (dense(once, a.shape) == a).all()


def test_registration_finds_a_planted_shift(spark):
    z, y, x = np.indices((6, 16, 16))
    blob = lambda cz, cy, cx: (255 * np.exp(-((z - cz) ** 2 + (y - cy) ** 2 + (x - cx) ** 2) / 18)).astype(int)
    df = volume(spark, blob(2, 6, 6)).unionByName(volume(spark, blob(3, 9, 8), t=1))
    r = resample.register(df, (6, 16, 16), 10, 1).collect()
    assert [(q.t, q.dz, q.dy, q.dx) for q in r] == [(0, 1, 3, 2)]
    assert resample.register(df.limit(0), (6, 16, 16)).isEmpty()


def test_profile_follows_the_polyline(spark):
    a = np.arange(1, 11).reshape(1, 1, 10) * 10
    pts = spark.createDataFrame([("r", 0, 0, 0, 0), ("r", 1, 4, 0, 0), ("r", 2, 4, 0, 0), ("r", 3, 9, 0, 0), ("one", 0, 1, 0, 0)], "ruler string, t int, x int, y int, z int")
    got = {(r.ruler, r.bin): r["mean"] for r in resample.profile(pts, volume(spark, a)).collect()}
    assert got == {("r", k): 10.0 * (k + 1) for k in range(9)}


def test_distance_is_the_number_of_peeled_layers(spark):
    dims = (7, 9, 9)
    a = (np.random.default_rng(3).random(dims) < 0.9) * 255
    inside = a > 0
    for k in range(3):
        inside[(slice(None),) * k + (0,)] = inside[(slice(None),) * k + (-1,)] = False
    want, left, level = np.zeros(dims), inside.copy(), 0
    while left.any():
        level += 1
        around = np.pad(left, 1)
        keep = np.logical_and.reduce([np.roll(around, s, k)[1:-1, 1:-1, 1:-1] for k in range(3) for s in (1, -1)])
        want[left & ~keep] = level
        left &= keep
    df = volume(spark, a).where("v > 0")
    assert (dense(density.distance(df, dims), dims, "dist") == want).all()
    assert (dense(density.distance(df.unionByName(df), dims, 2), dims, "dist") == np.minimum(want, 2)).all()


def test_tiles_interpolate_to_themselves_where_flat(spark):
    dims, tile = (4, 8, 8), (2, 4, 4)
    df = volume(spark, np.full(dims, 90))
    got = density.interpolated(df, density.tile_field(df, dims, tile), dims, tile).select("mean", "sigma").distinct().collect()
    assert [(r["mean"], r.sigma) for r in got] == [(90, 0)]
    assert density.dense_enough(df, dims, 1, tile, 1.0, 0.0).count() == 256
    assert density.dense_enough(df, dims, 1, tile, 1.0, 0.1).isEmpty()


def test_gated_growth_labels_only_what_passes(spark):
    dims = (3, 8, 8)
    a = np.zeros(dims, int)
    a[1, 2:6, 2:6] = 200
    df = volume(spark, a)
    weighted = density.distance_weighted(df, dims, 100, 0.5, 5)
    got = dense(weighted, dims)
    assert got[1, 2, 2] == (200 + 255) // 2 and got[0, 0, 0] == 0
    assert density.distance_grow(df, dims, 100, 0.5, 5).select("label").distinct().count() == 1


def test_thinning_keeps_a_line_and_drops_a_face(spark):
    line = np.zeros((5, 5, 5), int)
    line[2, 2, :] = 255
    assert (dense(stencil.apply(volume(spark, line), (5, 5, 5), 1, stencil.thin(0.5)), (5, 5, 5)) == line).all()
    block = np.zeros((1, 1, 1)) + 1.0
    assert stencil.thin(0.5)(np.pad(block, 1), 1)[0, 0, 0] == 1.0
    half = np.zeros((3, 3, 3))
    half[:, :2, :2] = 1.0
    rings = sum(bool(half[tuple(1 + np.array(p))]) for p, _ in stencil.RINGS)
    assert rings < 5


def test_deconvolution_leaves_a_flat_volume_flat():
    blur = stencil.gaussian(1.0)
    assert stencil.richardson_lucy(blur, 0.0)(np.full((3, 3, 3), 0.5), 1)[0, 0, 0] == pytest.approx(0.5)


def test_track_edits(spark):
    links = spark.createDataFrame([(0, 0, 1, 1, 5, 50), (0, 0, 1, 2, 3, 30), (0, 0, 2, 2, 4, 40), (1, 0, 2, 3, 6, 60)], "t int, c int, v1 long, v2 long, n long, total long")
    pairs = spark.createDataFrame([(0, 0, 1, 2), (0, 0, 1, 2), (0, 0, 9, 9)], "t int, c int, v1 long, v2 long")
    key = lambda df: sorted((r.t, r.v1, r.v2, r.n) for r in df.collect())
    assert key(tracking.linked(links, pairs)) == [(0, 1, 1, 5), (0, 1, 2, 3), (0, 2, 2, 4), (0, 9, 9, 1), (1, 2, 3, 6)]
    assert key(tracking.linked(links, pairs, True)) == [(0, 1, 2, 1), (0, 9, 9, 1), (1, 2, 3, 6)]
    assert key(tracking.unlinked(links, pairs)) == [(0, 1, 1, 5), (0, 2, 2, 4), (1, 2, 3, 6)]
    cells = spark.createDataFrame([(1, 0, 2, 1)], "t int, c int, label long, into long")
    assert key(tracking.isolated(links, cells)) == [(0, 1, 1, 5)]
    assert key(tracking.combined_cells(links, cells)) == [(0, 1, 1, 8), (0, 2, 1, 4), (1, 1, 3, 6)]
    assert tracking.linked(links.limit(0), pairs.limit(0)).isEmpty()


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_images_round_trip(spark, tmp_path, kind):
    a = np.random.default_rng(4).integers(0, np.iinfo(kind).max, (3, 5, 7)).astype(kind)
    assert (images.decode_png(images.encode_png(a[0])) == a[0]).all()
    for packed in (False, True):
        assert (np.stack(list(images.tiff_pages(images.encode_tiff(a, packed)))) == a).all()
    (tmp_path / "s_t4_ch2.tif").write_bytes(images.encode_tiff(a))
    (tmp_path / "p_t5_c1_z6.png").write_bytes(images.encode_png(a[1]))
    got = {(r.t, r.c, r.z, r.y, r.x): r.v for r in images.read(spark, str(tmp_path)).collect()}
    want = {(4, 2, *map(int, k)): int(a[k]) for k in np.ndindex(a.shape) if a[k]} | {(5, 1, 6, *map(int, k)): int(a[1][k]) for k in np.ndindex(a[1].shape) if a[1][k]}
    assert got == want
    df = volume(spark, a)
    stack = images.encoded(df, a.shape, "tiff", 8 * a.itemsize).collect()
    assert len(stack) == 1 and (np.stack(list(images.tiff_pages(bytes(stack[0].content)))) == a).all()
    slices = {r.z: images.decode_png(bytes(r.content)) for r in images.encoded(df, a.shape, "png", 8 * a.itemsize).collect()}
    assert all((slices[z] == a[z]).all() for z in range(3))


def test_png_filters_and_tiff_codes():
    import struct
    import zlib

    rows = np.random.default_rng(5).integers(0, 256, (5, 6)).astype(np.uint8)
    packed, above = bytearray(), [0] * 6
    for kind, row in enumerate(rows.tolist()):
        packed.append(kind)
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            near = min((a, b, c), key=lambda q: abs(a + b - c - q))
            packed.append((v - [0, a, b, (a + b) // 2, near][kind]) & 255)
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(packed))) + chunk(b"IEND", b"")
    assert (images.decode_png(raw) == rows).all()
    # A fixed sample of the code: clear, 7, first entry, 8, 8, second-entry run, end, in nine bits each.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 257))
    assert images._lzw(int(bits.ljust(64, "0"), 2).to_bytes(8, "big")) == bytes([7, 7, 7, 8, 8, 7, 7])
    assert images._packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    with pytest.raises(ValueError, match="not PNG"):
        images.decode_png(b"x" * 20)
