"""Bricked volumes: round trips, overlapping bricks, ranges of shared files, and that unwanted bricks are not read."""

import os
import zlib

import numpy as np
import pytest

from voxloom.sources import bricks, volumes

VOX = "t int, c int, z int, y int, x int, v int"
DIMS, SIDE = (5, 9, 11), (2, 4, 4)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    rows = [(t, c, z, y, x, int(r.integers(1, 256))) for t in range(2) for c in range(2) for z in range(5) for y in range(9) for x in range(11) if r.random() < 0.6]
    vox = spark.createDataFrame(rows, VOX)
    folder = str(tmp_path_factory.mktemp("bricks"))
    return vox, rows, bricks.save(vox, folder, DIMS, SIDE, levels=2)


def nonzero(df):
    return sorted(tuple(r) for r in df.where("v > 0").collect())


def test_round_trip(spark, saved):
    vox, rows, path = saved
    assert nonzero(bricks.load(spark, path)) == sorted(rows)
    assert nonzero(bricks.load(spark, path, 1)) == nonzero(volumes.level(vox, 1))
    assert bricks.load(spark, path).groupBy("t", "c", "z", "y", "x").count().where("count > 1").isEmpty()
    with pytest.raises(Exception, match="no level 7"):
        bricks.load(spark, path, 7)


def test_only_wanted_bricks_are_read(spark, saved):
    _, rows, path = saved
    folder = os.path.dirname(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kept = {}
    try:
        # All bricks but those of the wanted box are spoilt: reading any would fail.
        for name in os.listdir(folder):
            part = name.removesuffix(".zlib").split("_")
            if name.endswith(".zlib") and not (part[:3] == ["l0", "t1", "c0"] and int(part[3]) >= 1 and part[5] == "0"):
                with open(f"{folder}/{name}", "rb") as f:
                    kept[name] = f.read()
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"spoilt")
        box = bricks.load(spark, path).where("t = 1 and c in (0) and z >= 2 and x < 3")
        assert nonzero(box) == sorted(r for r in rows if r[0] == 1 and r[1] == 0 and r[2] >= 2 and r[4] < 3)
        assert bricks.load(spark, path).where("t > 5").count() == 0
        with pytest.raises(Exception, match="incorrect header|Error -3"):
            bricks.load(spark, path).where("t = 0").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        for name, data in kept.items():
            with open(f"{folder}/{name}", "wb") as f:
                f.write(data)


@pytest.mark.parametrize(("bits", "kind"), [(16, "RAW"), (32, "ZLIB"), (8, "RAW")])
def test_ranges_of_one_file_and_overlaps(spark, tmp_path, bits, kind):
    a = np.arange(2 * 3 * 7).reshape(2, 3, 7).astype(bricks.KINDS[bits]) * (0.5 if bits == 32 else 1)
    a = a.astype(bricks.KINDS[bits])
    blob, files, places = b"head", "", ""
    # Two bricks share the plane x = 3.
    for n, (lo, hi) in enumerate([(0, 4), (3, 7)]):
        data = a[:, :, lo:hi].tobytes()
        data = zlib.compress(data) if kind == "ZLIB" else data
        places += f'<Brick id="{n}" width="{hi - lo}" height="3" depth="2" st_x="{lo}" st_y="0" st_z="0" offset="0" size="0"/>'
        files += f'<File frame="0" channel="0" brickID="{n}" filename="all.bin" offset="{len(blob)}" datasize="{len(data)}" filetype="{kind}"/>'
        blob += data
    (tmp_path / "all.bin").write_bytes(blob)
    (tmp_path / "v.vvd").write_text(f'<BRK nChannel="1" nFrame="1" nLevel="1"><Level lv="0" imageW="7" imageH="3" imageD="2" xspc="1" yspc="1" zspc="1" bitDepth="{bits}"><Bricks brick_baseW="4" brick_baseH="3" brick_baseD="2">{places}</Bricks><Files>{files}</Files></Level></BRK>')
    got = bricks.load(spark, str(tmp_path / "v.vvd")).collect()
    assert len(got) == a.size
    assert {(r["z"], r["y"], r["x"]): r["v"] for r in got} == {p: v for p, v in np.ndenumerate(a)}
