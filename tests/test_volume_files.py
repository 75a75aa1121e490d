"""Saved volumes, sidecars, reduced levels, scan indexes and DICOM against what was written."""

import struct

import numpy as np
import pytest

from voxloom.sources import dicom, images, nrrd, volumes

VOX = "t int, c int, z int, y int, x int, v int, mask int, label long"


def rows(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(t, c, z, y, x, int(rng.integers(1, 256)), 255 * (x % 2), y) for t in range(3) for c in range(2) for z in range(2) for y in range(5) for x in range(6)], VOX)


def as_set(df, *cols):
    return {tuple(r[k] for k in cols) for r in df.collect()}


def element(tag, kind, value, explicit=True):
    value += b"\0" * (len(value) % 2)
    head = struct.pack("<HH", *tag)
    if not explicit and tag[0] != 2:
        return head + struct.pack("<I", len(value)) + value
    if kind in dicom.LONG:
        return head + kind + b"\0\0" + struct.pack("<I", len(value)) + value
    return head + kind + struct.pack("<H", len(value)) + value


def written(a, syntax, instance=1):
    explicit = syntax == dicom.EXPLICIT
    n, h, w = a.shape
    parts = [(dicom.SYNTAX, b"UI", syntax.encode()), (dicom.INSTANCE, b"IS", str(instance).encode())]
    parts += [(dicom.SAMPLES, b"US", struct.pack("<H", 1)), (dicom.FRAMES, b"IS", str(n).encode()), (dicom.ROWS, b"US", struct.pack("<H", h)), (dicom.COLUMNS, b"US", struct.pack("<H", w))]
    parts += [(dicom.BITS, b"US", struct.pack("<H", 8 * a.dtype.itemsize)), (dicom.PIXELS, b"OW", a.tobytes())]
    out = b"\0" * 128 + b"DICM"
    for k, (tag, kind, value) in enumerate(parts):
        if k == 2:
            nested = struct.pack("<HHI", *dicom.ITEM, dicom.OPEN) + element((0x0008, 0x0100), b"SH", b"AB", explicit) + struct.pack("<HHI", *dicom.ITEM_END, 0) + struct.pack("<HHI", *dicom.SEQUENCE_END, 0)
            out += struct.pack("<HH", 0x0020, 0x9999) + (b"SQ\0\0" if explicit else b"") + struct.pack("<I", dicom.OPEN) + nested
        out += element(tag, kind, value, explicit)
    return out


@pytest.mark.parametrize("syntax", [dicom.EXPLICIT, dicom.IMPLICIT])
@pytest.mark.parametrize("kind", ["u1", "<u2"])
def test_dicom_frames(syntax, kind):
    a = np.random.default_rng(2).integers(0, 200, (2, 3, 5)).astype(kind)
    first, planes = dicom.frames(written(a, syntax, 4))
    assert first == 3 and np.array_equal(np.stack(list(planes)), a)


def test_dicom_refuses_compressed():
    with pytest.raises(ValueError):
        dicom.fields(written(np.zeros((1, 2, 2), "u1"), "1.2.840.10008.1.2.4.50"))
    with pytest.raises(ValueError):
        dicom.fields(b"x" * 200)


def test_dicom_scan(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 200, (2, 3, 4)).astype("<u2")
    for k in (0, 1):
        (tmp_path / f"t5_{k}.dcm").write_bytes(written(a[k : k + 1], dicom.EXPLICIT, k + 1))
    got = as_set(images.read(spark, str(tmp_path)), "t", "z", "y", "x", "v")
    assert got == {(5, *map(int, p), int(a[p])) for p in np.ndindex(a.shape) if a[p]}


def test_saved_volume_reads_wanted_frames(spark, tmp_path):
    vox, path = rows(spark).cache(), str(tmp_path / "v")
    volumes.save(vox, path)
    assert as_set(volumes.load(spark, path, [1]), "t", "c", "z", "y", "x", "v", "mask", "label") == as_set(vox.where("t = 1"), "t", "c", "z", "y", "x", "v", "mask", "label")
    volumes.save(vox.drop("mask", "label"), str(tmp_path / "w"), (0, 1, 2), (0, 3, 4))
    got = volumes.load(spark, str(tmp_path / "w"))
    assert as_set(got, "t", "c", "z", "y", "x", "v", "mask", "label") == {(t, c, z, y - 1, x - 2, v, 0, 0) for t, c, z, y, x, v in as_set(vox, "t", "c", "z", "y", "x", "v") if z == 0 and 1 <= y <= 3 and 2 <= x <= 4}


def test_sidecars(spark, tmp_path):
    vox = rows(spark)
    back = volumes.with_sidecar(vox, volumes.sidecar(vox, "label"), "label")
    assert as_set(back, "t", "c", "z", "y", "x", "v", "label") == as_set(vox, "t", "c", "z", "y", "x", "v", "label")
    a = np.zeros((2, 3, 4), "u4")
    a[1, 2, 3] = 70000
    (tmp_path / "s_t2.lbl").write_bytes(nrrd.encode(a, packed=True))
    assert as_set(volumes.sidecar_files(spark, str(tmp_path), "label"), "t", "c", "z", "y", "x", "label") == {(2, 0, 1, 2, 3, 70000)}


def test_levels_read_boxes(spark, tmp_path):
    vox, path, brick = rows(spark).cache(), str(tmp_path / "p"), (1, 2, 2)
    volumes.save_levels(vox, path, 2, brick)
    assert as_set(volumes.load_level(spark, path, 0, (0, 1, 1), (1, 2, 3), brick), "t", "c", "z", "y", "x", "v") == {r for r in as_set(vox, "t", "c", "z", "y", "x", "v") if 1 <= r[3] <= 2 and 1 <= r[4] <= 3}
    groups = {}
    for t, c, z, y, x, v in as_set(vox, "t", "c", "z", "y", "x", "v"):
        groups.setdefault((t, c, z >> 1, y >> 1, x >> 1), []).append(v)
    assert as_set(volumes.load_level(spark, path, 1, (0, 0, 0), (9, 9, 9), brick), "t", "c", "z", "y", "x", "v") == {(*k, sum(g) // len(g)) for k, g in groups.items()}


def test_scan_index(spark, tmp_path):
    a = np.random.default_rng(4).integers(1, 200, (2, 3, 4)).astype("u1")
    (tmp_path / "tif").mkdir()
    for k in (0, 1):
        (tmp_path / "tif" / f"z99_{k}.tif").write_bytes(images.encode_tiff(a[k : k + 1]))
    files = [f'<Frame index="{k + 1}"><File channel="2" filename="z99_{k}.tif"/></Frame>' for k in (0, 1)]
    for name, kind, want in (("s.xml", "ZSeries", lambda k: (2, 1, k)), ("q.xml", "TSeries Timed", lambda k: (k, 1, 0))):
        (tmp_path / name).write_text(f'<PVScan><Sequence type="{kind}" cycle="3">{"".join(files)}</Sequence></PVScan>')
        got = as_set(volumes.scan(spark, str(tmp_path / name), str(tmp_path / "tif")), "t", "c", "z", "y", "x", "v")
        assert got == {(*want(k), y, x, int(a[k, y, x])) for k, y, x in np.ndindex(a.shape)}
