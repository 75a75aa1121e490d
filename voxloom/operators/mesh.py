"""Surface meshes: extraction at a level, measures, welding, smoothing, simplification, colour.

A mesh is a table of vertices (id, x, y, z) and one of triangles (a, b, c), or
before welding a table of triangles with three corners each.  Both are packed
so well in files that the planner would take large ones for small, so joins of
them name the merge join: no mesh passes through the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import label_colour
from .clustering import close_pairs
from .graph import cut

AT = ("x", "y", "z")
#: Corners of a cell: bit 0 is a step along x, bit 1 along y, bit 2 along z.
CORNERS = [tuple(k >> b & 1 for b in range(3)) for k in range(8)]


def _faces() -> list[list[int]]:
    """Corners of the six faces, counter-clockwise seen from outside."""
    out = []
    for axis, side in product(range(3), (0, 1)):
        u, w = (axis + 1) % 3, (axis + 2) % 3
        ring = [(0, 0), (1, 0), (1, 1), (0, 1)] if side else [(0, 0), (0, 1), (1, 1), (1, 0)]
        out.append([side << axis | i << u | j << w for i, j in ring])
    return out


def cell_triangles(case: int) -> list[tuple[tuple[int, int], ...]]:
    """Triangles of a cell whose bit k of ``case`` is set where corner k is below the level.

    A triangle is three cell edges, an edge a pair of corners.  On each face,
    a run of corners that are not below is cut off by one segment; the
    segments of all faces close to loops, and a loop is cut into a fan.  Both
    cells at a face cut it alike, so surfaces have no gaps.
    """
    inside = [not case >> k & 1 for k in range(8)]
    follows = {}
    for ring in _faces():
        for i in range(4):
            if inside[ring[i]] and not inside[ring[i - 1]]:
                j = i
                while inside[ring[(j + 1) % 4]]:
                    j += 1
                enter, leave = (ring[i - 1], ring[i]), (ring[j % 4], ring[(j + 1) % 4])
                follows[tuple(sorted(leave))] = tuple(sorted(enter))
    out = []
    while follows:
        first, nxt = follows.popitem()
        loop = [first]
        while nxt != first:
            loop.append(nxt)
            nxt = follows.pop(nxt)
        out += [(loop[0], loop[i + 1], loop[i]) for i in range(1, len(loop) - 1)]
    return out


def surface(vox: DataFrame, level: float, steps: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """t, c, cz, cy, cx, nth and corners ax .. cz3: triangles of the surface at ``level``; absent samples count as 0.

    ``steps`` (z, y, x) thins the grid.  Corners lie on cell edges by linear
    interpolation, shifted by half a step, so a sample's value is at its
    middle.  Each sample is dealt to the eight cells it bounds: one shuffle.
    """
    rows = vox.where("v > 0")
    for k, s in zip("zyx", steps, strict=True):
        rows = rows.where(F.col(k) % s == 0).withColumn(k, F.floor(F.col(k) / s).cast("int"))
    o = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(d).alias(q) for d, q in zip(CORNERS[k], AT, strict=True)]) for k in range(8)]))
    dealt = rows.withColumn("o", o).select("t", "c", *[(F.col(q) - F.col(f"o.{q}")).alias(f"c{q}") for q in "zyx"], "o.k", "v")
    value = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).cast("double") for k in range(8)]
    cells = dealt.groupBy("t", "c", "cz", "cy", "cx").agg(F.array(*value).alias("w"))
    case = reduce(lambda a, b: a + b, [F.when(F.col("w")[k] < level, 1 << k).otherwise(0) for k in range(8)])
    cells = cells.withColumn("case", case).where("case not in (0, 255)")
    spark = vox.sparkSession
    table = [(case, nth, [p for edge in tri for p in edge]) for case in range(1, 255) for nth, tri in enumerate(cell_triangles(case))]
    # A fixed table of less than a thousand rows.
    rows = cells.join(F.broadcast(spark.createDataFrame(table, "case int, nth int, e array<int>")), "case")

    def along(corner: int, axis: int, step: int) -> Column:
        a, b = F.col("e")[2 * corner], F.col("e")[2 * corner + 1]
        va, vb = F.element_at("w", a + 1), F.element_at("w", b + 1)
        bit = lambda k: F.when(k.bitwiseAND(1 << axis) != 0, 1.0).otherwise(0.0)
        share = (F.lit(float(level)) - va) / (vb - va)
        return (F.col(f"c{AT[axis]}") + bit(a) + share * (bit(b) - bit(a)) + 0.5) * float(step)

    places = [along(i, axis, steps[2 - axis]).alias(f"{AT[axis]}{i}") for i in range(3) for axis in range(3)]
    return rows.select("t", "c", "cz", "cy", "cx", "nth", *places)


def _minus(i: int, j: int) -> list[Column]:
    return [F.col(f"{k}{i}") - F.col(f"{k}{j}") for k in AT]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def measures(triangles: DataFrame, by: list[str]) -> DataFrame:
    """Triangles, area and signed volume of each mesh."""
    area = F.sqrt(sum((q * q for q in _cross(_minus(1, 0), _minus(2, 0))), F.lit(0.0))) / 2
    p = [[F.col(f"{k}{i}") for k in AT] for i in range(3)]
    volume = sum((a * b for a, b in zip(p[0], _cross(p[1], p[2]), strict=True)), F.lit(0.0)) / 6
    return triangles.groupBy(*by).agg(F.count("*").alias("triangles"), F.sum(area).alias("area"), F.sum(volume).alias("volume"))


def corners(triangles: DataFrame, key: Column) -> DataFrame:
    """id, x, y, z: all corners; ``key`` names a triangle by a long, and a corner's id is 3 * key + its place."""
    parts = F.array(*[F.struct((key * 3 + i).alias("id"), *[F.col(f"{k}{i}").alias(k) for k in AT]) for i in range(3)])
    return triangles.select(F.inline(parts))


def welded(vertices: DataFrame, tolerance: float) -> DataFrame:
    """id, first: the smallest id within ``tolerance`` of each vertex, itself included (not transitive)."""
    exact = cut(vertices.groupBy(*AT).agg(F.min("id").alias("id")))
    near = close_pairs(exact, tolerance).groupBy("a").agg(F.min("b").alias("first"))
    same = vertices.join(exact.withColumnRenamed("id", "same").hint("merge"), list(AT)).select("id", F.col("same").alias("a"))
    return same.join(near.hint("merge"), "a").select("id", "first")


def _neighbours(triangles: DataFrame) -> DataFrame:
    """a, b: vertices that share an edge, each pair once in each direction."""
    edges = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p in "abc" for q in "abc" if p != q])
    return triangles.select(F.inline(edges)).where("a <> b").distinct()


def _pull(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertices with mx, my, mz: the mean of their neighbours, or their own place where they have none."""
    near = _neighbours(triangles).join(vertices.select(F.col("id").alias("b"), *AT).hint("merge"), "b")
    means = near.groupBy(F.col("a").alias("id")).agg(*[F.avg(k).alias(f"m{k}") for k in AT])
    return vertices.join(means.hint("merge"), "id", "left").select("id", *AT, *[F.coalesce(f"m{k}", k).alias(f"m{k}") for k in AT])


def smoothed(vertices: DataFrame, triangles: DataFrame, strength: float = 0.5, most: float = 0.5) -> DataFrame:
    """Vertices moved towards the mean of their neighbours, by no more than ``most``."""
    rows = _pull(vertices, triangles)
    d = {k: (F.col(f"m{k}") - F.col(k)) * strength for k in AT}
    length = F.sqrt(sum((q * q for q in d.values()), F.lit(0.0)))
    scale = F.when(length > most, F.lit(most) / length).otherwise(1.0)
    return rows.select("id", *[(F.col(k) + d[k] * scale).alias(k) for k in AT])


def simplified(vertices: DataFrame, triangles: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Vertices nearer than ``reach`` to the mean of their neighbours move there; triangles with an edge of no length go."""
    rows = _pull(vertices, triangles)
    length = F.sqrt(sum((F.pow(F.col(f"m{k}") - F.col(k), 2) for k in AT), F.lit(0.0)))
    # Read once for each corner below, so what gave it is run once.
    moved = cut(rows.select("id", *[F.when(length <= reach, F.col(f"m{k}")).otherwise(F.col(k)).alias(k) for k in AT]))
    left = triangles
    for q in "abc":
        left = left.join(moved.select(F.col("id").alias(q), *[F.col(k).alias(f"{k}{q}") for k in AT]).hint("merge"), q)
    for p, q in ("ab", "bc", "ca"):
        left = left.where(sum((F.pow(F.col(f"{k}{p}") - F.col(f"{k}{q}"), 2) for k in AT), F.lit(0.0)) >= 1e-12)
    return moved, left.select("a", "b", "c")


def coloured(vertices: DataFrame, vox: DataFrame, by_label: bool = True) -> DataFrame:
    """id, r, g, b, alpha: colour of the sample that holds each vertex; alpha is its intensity.

    Vertices carry t and c.  Where there is no label the colour is (0.2, 0.4,
    0.4); by intensity alone it is white.
    """
    at = vertices.select("id", "t", "c", *[F.floor(k).cast("int").alias(k) for k in AT])
    rows = at.join(vox.select("t", "c", "z", "y", "x", "v", "label").hint("merge"), ["t", "c", "z", "y", "x"], "left")
    none = F.coalesce("label", F.lit(0)) == 0
    shade = [F.when(none, d).otherwise(q) if by_label else F.lit(1.0) for q, d in zip(label_colour(F.col("label")), (0.2, 0.4, 0.4), strict=True)]
    return rows.select("id", *[q.alias(k) for q, k in zip(shade, "rgb", strict=True)], (F.coalesce("v", F.lit(0)) / 255.0).alias("alpha"))
