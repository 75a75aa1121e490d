"""Scalar functions: rulers, colours, identities, vectors, transfer functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ruler_lengths(points: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Length of each ruler's polyline in units of ``spacing``."""
    w = Window.partitionBy("ruler").orderBy("t")
    d = F.sqrt(sum((F.pow((F.col(k) - F.lag(k).over(w)) / s, 2) for k, s in zip("xyz", spacing, strict=True)), F.lit(0.0)))
    return points.select("ruler", d.alias("d")).groupBy("ruler").agg(F.count("*").alias("n"), F.sum(F.coalesce("d", F.lit(0.0))).alias("length"))


def elevation(x: Column, y: Column, z: Column) -> Column:
    """Angle of a vector above the ground in degrees, plus 180 where negative; 0 for no vector."""
    a = F.degrees(F.atan2(-y, F.sqrt(x * x + z * z)))
    return F.when((F.abs(x) < 1e-10) & (F.abs(y) < 1e-10) & (F.abs(z) < 1e-10), 0.0).when(a < 0, a + 180).otherwise(a)


Point = tuple[Column, Column, Column]


def _minus(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def _dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def protractor(a: Point, middle: Point, b: Point) -> Column:
    """Angle at ``middle`` in degrees; 0 where an arm has no length."""
    u, v = _minus(a, middle), _minus(b, middle)
    lu, lv = F.sqrt(_dot(u, u)), F.sqrt(_dot(v, v))
    turn = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v) / (lu * lv)))
    return F.when((lu > 1e-10) & (lv > 1e-10), F.degrees(F.acos(turn))).otherwise(0.0)


def ellipse_ends(a: Point, b: Point, view: tuple[float, float, float]) -> tuple[Point, Point]:
    """The other two vertices of an ellipse with the axis from ``a`` to ``b``, seen along ``view``: at right angles to both, as far from the centre."""
    half = tuple((p - q) / 2 for p, q in zip(a, b, strict=True))
    centre = tuple((p + q) / 2 for p, q in zip(a, b, strict=True))
    x, y, z = (float(k) for k in view)
    side = (half[1] * z - half[2] * y, half[2] * x - half[0] * z, half[0] * y - half[1] * x)
    size = F.sqrt(_dot(side, side))
    grow = F.when(size > 0, F.sqrt(_dot(half, half)) / size).otherwise(0.0)
    return tuple(c + s * grow for c, s in zip(centre, side, strict=True)), tuple(c - s * grow for c, s in zip(centre, side, strict=True))


Box = dict[str, Column]


def box(prefix: str = "") -> Box:
    """A box's bounds from columns lo_x, hi_x, ... , with a prefix."""
    return {f"{n}_{k}": F.col(f"{prefix}{n}_{k}") for n in ("lo", "hi") for k in "xyz"}


def joined_box(a: Box, b: Box) -> Box:
    return {k: (F.least if k[:2] == "lo" else F.greatest)(a[k], b[k]) for k in a}


def common_box(a: Box, b: Box) -> Box:
    """What two boxes share; ``boxes_meet`` says whether they do."""
    return {k: (F.greatest if k[:2] == "lo" else F.least)(a[k], b[k]) for k in a}


def boxes_meet(a: Box, b: Box) -> Column:
    both = common_box(a, b)
    return (both["lo_x"] <= both["hi_x"]) & (both["lo_y"] <= both["hi_y"]) & (both["lo_z"] <= both["hi_z"])


def grown_box(a: Box, factor: float) -> Box:
    """A box grown about its centre, each side by ``factor`` of its length."""
    return {k: v + (a[f"hi{k[2:]}"] - a[f"lo{k[2:]}"]) * (factor if k[:2] == "hi" else -factor) for k, v in a.items()}


def label_colour(label: Column, shuffle: int = 0) -> tuple[Column, Column, Column]:
    """r, g, b of a label: its remainder by 253, rotated left as a byte, on six linear hue sextants of 45 steps."""
    v = label % 253
    v = (F.shiftleft(v, shuffle).bitwiseAND(255)).bitwiseOR(F.shiftright(v, 8 - shuffle)) if shuffle else v
    hue = v / 45.0
    i = F.floor(hue).cast("int")
    f = hue - i
    up, down, one, zero = f, 1 - f, F.lit(1.0), F.lit(0.0)
    table = [(one, up, zero), (down, one, zero), (zero, one, up), (zero, down, one), (up, zero, one), (one, zero, down)]

    def pick(k: int) -> Column:
        out = F.when(i == 0, table[0][k])
        for n in range(1, 6):
            out = out.when(i == n, table[n][k])
        return out.otherwise(0.0)

    return pick(0), pick(1), pick(2)


def interleaved_id(x: Column, y: Column, z: Column, bits_xy: int, bits_z: int) -> Column:
    """Seed identity: the reversed bits of x and y interleaved (x at even places), those of z above, plus one."""
    bit = lambda c, k: F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
    out = F.lit(1).cast("long")
    for k in range(bits_xy):
        out = out + F.shiftleft(bit(x, k), 2 * (bits_xy - 1 - k)) + F.shiftleft(bit(y, k), 2 * (bits_xy - 1 - k) + 1)
    for k in range(bits_z):
        out = out + F.shiftleft(bit(z, k), 2 * bits_xy + bits_z - 1 - k)
    return out


def extended_id(brick: Column, label: Column) -> Column:
    """brick * 2**32 or label."""
    return F.shiftleft(brick.cast("long"), 32).bitwiseOR(label.cast("long"))


def parsed_id(text: Column) -> tuple[Column, Column]:
    """brick (null if absent) and label of "brick-id" or "id"."""
    first, second = F.regexp_extract(text, r"(\d+)", 1), F.regexp_extract(text, r"\d+\D+(\d+)", 1)
    two = second != ""
    return F.when(two, first.cast("long")), F.when(two, second.cast("long")).when(first != "", first.cast("long"))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 of two arrays; the largest float when their sizes differ."""
    d = F.aggregate(F.zip_with(a, b, lambda p, q: ((p - q) * (p - q)).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(3.4028234663852886e38))


def fixed(label: Column, size: Column, limit: int) -> Column:
    """Sets bit 31 where the component holds ``limit`` samples or more."""
    return F.when(size >= limit, label.bitwiseOR(F.lit(1 << 31).cast("long"))).otherwise(label.bitwiseAND(F.lit((1 << 31) - 1).cast("long")))


def transferred(value: Column, low: float = 0.0, high: float = 1.0, soft: float = 0.0, offset: float = 1.0, gamma: float = 1.0, invert: bool = False) -> Column:
    """Soft window from ``low`` to ``high``, then offset and gamma, cut to 0..1."""
    v = 1 - value if invert else value
    keep = F.when(v < low, F.when(F.lit(soft > 0) & (v > low - soft), 1 - (low - v) / (soft or 1.0)).otherwise(0.0)).when(v > high, F.when(F.lit(soft > 0) & (v < high + soft), 1 - (v - high) / (soft or 1.0)).otherwise(0.0)).otherwise(1.0)
    base = F.least(F.greatest(v / offset, F.lit(0.0)), F.lit(1.0))
    return keep * F.pow(base, F.lit(1.0 / gamma))


def inside_planes(x: Column, y: Column, z: Column, planes: list[tuple[float, float, float, float]]) -> Column:
    """Whether a unit position is on the inner side of all planes."""
    out = F.lit(True)
    for a, b, c, d in planes:
        out = out & (x * a + y * b + z * c + d >= 0)
    return out


def typed(value: Column, kind: str) -> Column:
    """A stored float as a typed parameter: booleans above a half, integers rounded half away from zero."""
    if kind == "boolean":
        return value > 0.5
    return F.round(value).cast(kind) if kind in ("int", "bigint", "smallint") else value.cast(kind)


def frame_allowed(t: int, start: int, end: int, mode: int, mask: int, rewind: bool, bits: dict[str, int]) -> bool:
    """The frame predicate of a task; ``bits`` holds rewind, first, last and middle."""
    if rewind:
        on = bits["rewind"]
    elif not start <= t <= end:
        return False
    elif end - t < 6:
        on = bits["last"] >> (2 * (end - t))
    elif t - start < 6:
        on = bits["first"] << (2 * (t - start))
    else:
        on = bits["middle"]
    return bool(on & mode & mask)
