"""Clustering of weighted points (id, x, y, z, w)."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected, cut
from .segmentation import scan_code


def _cells(points: DataFrame, eps: float) -> DataFrame:
    return points.select("*", *[F.floor(F.col(k) / eps).cast("long").alias(f"g{k}") for k in "xyz"])


def _apart(weight: float) -> Column:
    """Distance of a pair (a, b), and ``weight`` times the difference of their intensities."""
    d2 = sum((F.pow(F.col(f"a{k}") - F.col(f"b{k}"), 2) for k in "xyz"), F.lit(0.0))
    far = F.sqrt(d2)
    return far if not weight else far + weight * F.abs(F.col("aw") - F.col("bw"))


def close_pairs(points: DataFrame, eps: float, weight: float = 0.0, others: DataFrame | None = None) -> DataFrame:
    """a, b: pairs (each both ways, and each point with itself) nearer than ``eps``, by grid cells of that size.

    ``weight`` adds the difference of intensities to the distance.  With
    ``others``, a is of ``points`` and b of ``others``.  Points are sent to 27
    cells, which the planner's sizes do not count, so both sides are shuffled.
    """
    side = _cells(points, eps).select(F.col("id").alias("a"), *[F.col(k).alias(f"a{k}") for k in "xyz"], (F.col("w") if weight else F.lit(0.0)).alias("aw"), "gx", "gy", "gz")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    a = side.withColumn("n", near).select("a", "ax", "ay", "az", "aw", *[(F.col(f"g{q}") + F.col(f"n.{p}")).alias(f"g{q}") for q, p in zip("xyz", "ijk", strict=True)])
    b = _cells(points if others is None else others, eps).select(F.col("id").alias("b"), *[F.col(k).alias(f"b{k}") for k in "xyz"], (F.col("w") if weight else F.lit(0.0)).alias("bw"), "gx", "gy", "gz")
    return a.join(b.hint("merge"), ["gx", "gy", "gz"]).where(_apart(weight) < eps).select("a", "b")


def _box(at: list[str], place: bool = False) -> Column:
    """The box of the places of a group, or of one place."""
    return F.struct(*[(F.col(k) if place else f(k)).alias(f"{n}{k}") for k in at for n, f in (("lo", F.min), ("hi", F.max))])


def _boxes_apart(p: str, q: str, weight: float, far: bool = False) -> Column:
    """The least (or greatest) distance that places in the boxes of columns p and q can have.

    Each step keeps the order of what it rounds, so bounds hold to the last bit, and for two places are their distance.
    """
    p, q = F.col(p), F.col(q)

    def along(k):
        return F.greatest(p[f"hi{k}"] - q[f"lo{k}"], q[f"hi{k}"] - p[f"lo{k}"]) if far else F.greatest(F.lit(0.0), p[f"lo{k}"] - q[f"hi{k}"], q[f"lo{k}"] - p[f"hi{k}"])

    d = F.sqrt(sum((F.pow(along(k), 2) for k in "xyz"), F.lit(0.0)))
    return d + weight * along("w") if weight else d


def dbscan(points: DataFrame, eps: float, least: int, weight: float = 0.0) -> DataFrame:
    """id, cluster (null for noise): points (id, x, y, z, w) with ``least`` neighbours, themselves included, are cores.

    Cores within ``eps`` share a cluster, named by its smallest core; a border
    point joins the smallest cluster in reach.  ``weight`` adds the difference
    of intensities w to the distance, which makes w a fourth axis.  Points
    without a finite place are noise.

    Points of one place count as one.  Cells are so small that all their
    places are within ``eps`` of each other: in a dense one, of ``least``
    points, all are cores of one cluster, and none of their pairs is made.
    Other cells have fewer than ``least`` places.  These meet each other, but
    dense cells by the boxes of their places; only those that may be no cores
    by then meet places.  Links that boxes leave open are settled by ``_joined``.
    """
    at = ["x", "y", "z", "w"] if weight else ["x", "y", "z"]
    # The diagonal of a cell is just below eps, the sides of a bin of cells above it.
    side = dict.fromkeys("xyz", eps * (0.66 if weight else 1.0) / 1.7321) | ({"w": eps * 0.339 / weight} if weight else {})
    bin_side = 3 if weight else 2
    near = lambda p, q: _boxes_apart(p, q, weight) < eps
    sure = lambda p, q: _boxes_apart(p, q, weight, True) < eps
    spots = points.select("id", *[F.col(k).cast("double").alias(k) for k in at])
    finite = spots.where(" and ".join(f"abs({k}) < double('infinity')" for k in at))
    grid = F.struct(*[F.floor(F.col(k) / side[k]).alias(k) for k in at])
    places = finite.groupBy(*at).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    places = cut(places.select(F.monotonically_increasing_id().alias("place"), "id", "n", *at, grid.alias("grid")))
    off = sum((F.pow(F.col(k) / side[k] - F.col(f"grid.{k}") - 0.5, 2) for k in at), F.lit(0.0))
    cells = places.groupBy("grid").agg(F.min("place").alias("cell"), F.sum("n").alias("n"), _box(at).alias("box"), F.min_by(_box(at, True), off).alias("middle"))
    cells = cut(cells.withColumn("dense", (F.col("n") >= least) & sure("box", "box")))
    places = cut(places.join(cells.select("grid", "cell", "dense"), "grid").drop("grid"))
    thin = places.where("not dense").withColumn("box", _box(at, True))

    # Cells in reach of each other: of those that are not dense all, of dense ones each pair once.
    steps = F.array(*[F.struct(*[F.lit(d).alias(k) for k, d in zip(at, ds, strict=True)]) for ds in product((-1, 0, 1), repeat=len(at))])
    in_bin = [F.floor(F.col(f"grid.{k}") / bin_side).alias(f"g{k}") for k in at]
    ends = lambda s: [F.col(k).alias(f"{s}_{k}") for k in ("n", "dense", "box", "middle")]
    a = cells.select(F.col("cell").alias("a"), *ends("a"), *in_bin, F.explode(steps).alias("step"))
    a = a.select("a", "a_dense", "a_box", "a_middle", *[(F.col(f"g{k}") + F.col(f"step.{k}")).alias(f"g{k}") for k in at])
    b = cells.select(F.col("cell").alias("b"), *ends("b"), *in_bin)
    both = a.join(b.hint("merge"), [f"g{k}" for k in at]).where("not a_dense or b_dense and a < b").where(near("a_box", "b_box"))
    linked = F.col("a_dense") & (sure("a_box", "b_box") | near("a_middle", "b_middle"))
    both = cut(both.select("a", "a_dense", "a_box", "b", "b_n", "b_dense", "b_box", linked.alias("sure")))

    # What places of other cells have in reach: such places, and dense cells, all of them or perhaps some.
    reach = both.where("not a_dense").select("a", "b", "b_n", "b_dense", "b_box").join(thin.select(F.col("cell").alias("a"), F.col("place").alias("p"), F.col("box").alias("p_box")), "a").where(near("p_box", "b_box"))
    thin_b = thin.select(F.col("cell").alias("b"), F.col("place").alias("q"), F.col("n").alias("q_n"), F.col("box").alias("q_box"))
    beside = cut(reach.where("not b_dense").join(thin_b, "b").where(near("p_box", "q_box")).select("p", "q", F.col("q_n").alias("n")))
    looks = cut(reach.where("b_dense").select("p", "p_box", "b", "b_box", F.col("b_n").alias("n"), sure("p_box", "b_box").alias("sure")))
    enough = lambda *found: reduce(DataFrame.unionByName, [f.select("p", "n") for f in found]).groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("p")
    known = cut(enough(beside, looks.where("sure")))
    # Places not known as cores so far meet parts of the dense cells, and the places of parts that are partly in reach.
    thick = places.where("dense").select(F.col("cell").alias("b"), _piece(at, side, 1).alias("piece"), "n", *at)
    parts = thick.groupBy("b", "piece").agg(F.sum("n").alias("n"), _box(at).alias("q_box"))
    some = looks.where("not sure").select("p", "p_box", "b").join(known, "p", "left_anti").join(parts, "b").where(near("p_box", "q_box"))
    some = cut(some.select("p", "p_box", "b", "piece", "n", sure("p_box", "q_box").alias("sure")))
    met = some.where("not sure").drop("n").join(thick.select("b", "piece", "n", _box(at, True).alias("q_box")), ["b", "piece"]).where(near("p_box", "q_box"))
    met = cut(some.where("sure").select("p", "b", "n").unionByName(met.select("p", "b", "n")).groupBy("p", "b").agg(F.sum("n").alias("n")))
    cores = cut(enough(beside, looks.where("sure"), met))

    # Nodes are dense cells, and cores of other cells.
    to_cells = looks.where("sure").select("p", "b").unionByName(met.select("p", "b"))
    edges = beside.join(cores, "p").join(cores.select(F.col("p").alias("q")), "q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    edges = edges.unionByName(to_cells.join(cores, "p").select(F.col("p").alias("a"), "b")).unionByName(both.where("sure").select("a", "b"))
    roots = connected(edges.unionByName(cells.where("dense").select(F.col("cell").alias("a"), F.col("cell").alias("b"))))
    unsure = looks.where("not sure").join(known, "p").select(F.col("p").alias("a"), F.col("p_box").alias("a_box"), "b", "b_box")
    unsure = unsure.unionByName(both.where("a_dense and not sure").select("a", "a_box", "b", "b_box"))
    members = places.where("dense").select(F.col("cell").alias("node"), "place", "id", *at)
    members = cut(members.unionByName(thin.join(cores, F.col("place") == F.col("p")).select(F.col("place").alias("node"), "place", "id", *at)))
    roots = _joined(roots, unsure, members, at, side, eps, weight)
    named = cut(members.join(roots, "node").select("node", "place", "id", "root"))
    clusters = cut(named.groupBy("root").agg(F.min("id").alias("cluster")))
    nodes = cut(roots.join(clusters, "root").select("node", "cluster"))
    named = named.join(clusters, "root").select("place", "cluster")
    border = beside.join(cores.select(F.col("p").alias("q")), "q").select("p", F.col("q").alias("node")).unionByName(met.select("p", F.col("b").alias("node")))
    border = border.join(nodes, "node").groupBy(F.col("p").alias("place")).agg(F.min("cluster").alias("reach"))
    found = cut(places.join(named, "place", "left").join(border, "place", "left").select(*at, F.coalesce("cluster", "reach").alias("cluster")))
    return spots.join(found, at, "left").select("id", "cluster")


def _piece(at: list[str], side: dict[str, float], level: int) -> Column:
    """Which of the pieces of a cell a place is in: each axis is cut into 4, ``level`` times.  Level 0 has one piece."""
    return F.concat_ws(",", *[F.floor(F.col(k) / side[k] * 4**level) for k in at]) if level else F.lit("")


def _joined(roots: DataFrame, unsure: DataFrame, members: DataFrame, at: list[str], side: dict[str, float], eps: float, weight: float) -> DataFrame:
    """``roots`` (node, root) after links between nodes (a, b, and their boxes) whose ``members`` are nearer than ``eps`` somewhere.

    Only nodes of different roots meet.  Their boxes are cut into pieces round
    by round until each pair is linked, out of reach, or joined by others; the
    last round takes places as pieces and leaves nothing open.
    """
    of = lambda s: roots.select(F.col("root").alias(f"{s}_root"), F.col("node").alias(s))
    apart = lambda df: df.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root")
    left, level, deepest = cut(apart(unsure.withColumns({"a_piece": F.lit(""), "b_piece": F.lit("")}))), 0, 6
    while not left.isEmpty():
        level += 1
        piece = _piece(at, side, level) if level <= deepest else F.col("place").cast("string")
        nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        parts = cut(members.join(nodes, "node").groupBy("node", _piece(at, side, level - 1).alias("outer"), piece.alias("piece")).agg(_box(at).alias("box")))
        part = lambda s: parts.select(F.col("node").alias(s), F.col("outer").alias(f"{s}_piece"), F.col("piece").alias(f"{s}_next"), F.col("box").alias(f"{s}_part"))  # noqa: E731, B023
        met = left.join(part("a"), ["a", "a_piece"]).where(_boxes_apart("a_part", "b_box", weight) < eps)
        met = met.join(part("b"), ["b", "b_piece"]).where(_boxes_apart("a_part", "b_part", weight) < eps)
        ends = [F.col(f"{s}_{old}").alias(f"{s}_{new}") for s in "ab" for old, new in (("root", "root"), ("next", "piece"), ("part", "box"))]
        met = cut(met.select("a", "b", *ends, (_boxes_apart("a_part", "b_part", weight, True) < eps).alias("sure")))
        links = connected(met.where("sure").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
        roots = cut(roots.join(links.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        left = cut(apart(met.where("not sure").drop("a_root", "b_root", "sure")))
    return roots


def voxel_points(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """t, c, id, x, y, z, w of masked samples above zero: place times ``spacing``, intensity, and the place in scan order as id."""
    on = vox.where("mask > 0 and v > 0")
    at = [(F.col(k) * float(s)).alias(k) for k, s in zip("xyz", spacing, strict=True)]
    return on.select("t", "c", scan_code().alias("id"), *at, F.col("v").cast("double").alias("w"))


def cluster_labels(vox: DataFrame, t: int, c: int, method: str = "dbscan", k: int = 2, eps: float = 2.0, least: int = 5, first: int = 1, step: int = 1, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``vox`` of one frame and channel with the masked samples' labels replaced by those of their clusters.

    ``method`` is dbscan (noise keeps its label), kmeans or mixture (the
    largest share, of equals the first).  Clusters take unused labels from
    ``first`` in steps of ``step``.
    """
    here = vox.where((F.col("t") == t) & (F.col("c") == c))
    points = cut(voxel_points(here, spacing).drop("t", "c"))
    if method == "dbscan":
        found = dbscan(points, eps, least)
    elif method == "kmeans":
        found = kmeans(points, k)[0].select("id", F.col("cluster").cast("long").alias("cluster"))
    else:
        shares = memberships(points, gaussian_mixture(points, k))
        found = shares.select("id", (F.array_position("p", F.array_max("p")) - 1).cast("long").alias("cluster"))
    found = cut(found.where("cluster is not null"))
    names = fresh_ids(found, here.where("label <> 0").select("label"), first, step)
    new = found.join(names.withColumnRenamed("label", "new"), "cluster").select("id", "new")
    return here.withColumn("id", scan_code()).join(new, "id", "left").withColumn("label", F.coalesce("new", "label")).drop("id", "new")


def kmeans(points: DataFrame, k: int, eps: float = 1e-6, rounds: int = 100) -> tuple[DataFrame, bool]:
    """id, cluster and whether it settled: first centre the heaviest point, each next the farthest from the one before.

    Assignment by distance, ties to the first centre; centres are weighted means.
    """
    at = ["x", "y", "z"]
    points = cut(points.select("id", *at, "w"))
    first = points.orderBy(F.desc("w"), "id").select(*at).first()
    centres = [tuple(float(v) for v in first)]

    def dist2(c):
        return sum((F.pow(F.col(q) - float(v), 2) for q, v in zip(at, c, strict=True)), F.lit(0.0))

    while len(centres) < k:
        centres.append(tuple(float(v) for v in points.orderBy(F.desc(dist2(centres[-1])), "id").select(*at).first()))
    settled = False
    for _ in range(rounds):
        d = F.array(*[dist2(c) for c in centres])
        named = points.withColumn("cluster", F.array_position(d, F.array_min(d)).cast("int") - 1)
        sums = named.groupBy("cluster").agg(F.sum("w").alias("w"), *[F.sum(F.col(q) * F.col("w")).alias(q) for q in at]).collect()
        new = list(centres)
        for r in sums:
            if r["w"]:
                new[r["cluster"]] = tuple(float(r[q]) / float(r["w"]) for q in at)
        shift = max(float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(centres, new, strict=True))
        centres = new
        if shift <= eps:
            settled = True
            break
    d = F.array(*[dist2(c) for c in centres])
    return points.select("id", (F.array_position(d, F.array_min(d)).cast("int") - 1).alias("cluster")), settled


def gaussian_mixture(points: DataFrame, k: int, rounds: int = 300, eps: float = 1e-4) -> list[dict]:
    """Weighted expectation-maximisation; each round is one aggregation of moments.  Parts tell whether the fit ``settled``.

    Starts from the centres of ``kmeans``.  A row whose memberships are all
    zero counts fully for every part; a flat covariance gets a floor of a half.
    """
    at = ["x", "y", "z"]
    points = cut(points.select("id", *at, "w"))
    named, _ = kmeans(points, k)
    start = points.join(named, "id").groupBy("cluster").agg(*[F.avg(q).alias(q) for q in at]).orderBy("cluster").collect()
    parts = [{"tau": 1 / k, "mean": np.array([float(r[q]) for q in at]), "cov": np.eye(3) * 1e4} for r in start]
    last, settled = None, False
    for _ in range(rounds):
        dens = []
        for p in parts:
            cov = p["cov"] if np.linalg.det(p["cov"]) > 1e-9 else p["cov"] + np.eye(3) * 0.5
            inv, norm = np.linalg.inv(cov), 1 / np.sqrt(248.05 * np.linalg.det(cov))
            d = [F.col(q) - float(m) for q, m in zip(at, p["mean"], strict=True)]
            form = sum((d[i] * d[j] * float(inv[i, j]) for i in range(3) for j in range(3)), F.lit(0.0))
            dens.append(F.exp(-0.5 * form) * float(p["tau"] * norm))
        rows = points.select("w", *at, *[c.alias(f"d{i}") for i, c in enumerate(dens)])
        total = sum((F.col(f"d{i}") for i in range(len(parts))), F.lit(0.0))
        rows = rows.withColumn("s", total)
        member = [F.when(F.col("s") > 0, F.col(f"d{i}") / F.col("s")).otherwise(1.0) * F.col("w") for i in range(len(parts))]
        cols = [F.sum(F.col("w") * F.log(F.greatest("s", F.lit(1e-300)))).alias("ll"), F.sum("w").alias("w")]
        for i, m in enumerate(member):
            cols.append(F.sum(m).alias(f"n{i}"))
            cols += [F.sum(m * F.col(q)).alias(f"s{i}{q}") for q in at]
            cols += [F.sum(m * F.col(a) * F.col(b)).alias(f"s{i}{a}{b}") for x, a in enumerate(at) for b in at[x:]]
        r = rows.agg(*cols).first()
        for i, p in enumerate(parts):
            n = float(r[f"n{i}"]) or 1e-300
            mean = np.array([float(r[f"s{i}{q}"]) / n for q in at])
            cov = np.zeros((3, 3))
            for x, a in enumerate(at):
                for y in range(x, 3):
                    cov[x, y] = cov[y, x] = float(r[f"s{i}{a}{at[y]}"]) / n - mean[x] * mean[y]
            p.update(tau=n / float(r["w"]), mean=mean, cov=cov)
        if last is not None and abs(r["ll"] - last) < eps * abs(last):
            settled = True
            break
        last = r["ll"]
    return [{**p, "settled": settled} for p in parts]


def without_noise(points: DataFrame, clusters: DataFrame, reach: float = 1.1) -> DataFrame:
    """id, cluster: noise joins the commonest cluster (of equals the smallest) of the points within ``reach``, until nothing changes.

    With one cluster or none, each noise point founds its own, named by its
    id.  All noise points of a round see the clusters as the round found them.
    """
    named = cut(clusters)
    if named.where("cluster is not null").select("cluster").distinct().limit(2).count() < 2:
        return named.select("id", F.coalesce("cluster", "id").alias("cluster"))
    # Only noise looks around: points that have a cluster are counted by it, those that may get one are kept.
    noise = points.join(named.where("cluster is null").select("id"), "id")
    seen = close_pairs(noise, reach, others=points).where("a <> b").join(named.select(F.col("id").alias("b"), "cluster"), "b")
    seen = cut(seen.groupBy("a", "cluster", F.when(F.col("cluster").isNull(), F.col("b")).alias("b")).agg(F.count("*").alias("n")))
    while True:
        noise = named.where("cluster is null").select(F.col("id").alias("a"))
        late = seen.where("cluster is null").drop("cluster").join(named.where("cluster is not null").select(F.col("id").alias("b"), "cluster"), "b")
        votes = seen.where("cluster is not null").unionByName(late.select(*seen.columns)).join(noise, "a").groupBy("a", "cluster").agg(F.sum("n").alias("n"))
        found = cut(votes.groupBy(F.col("a").alias("id")).agg(F.max(F.struct("n", (-F.col("cluster")).alias("m"))).alias("best")).select("id", (-F.col("best.m")).alias("new")))
        if found.isEmpty():
            return named
        named = cut(named.join(found, "id", "left").select("id", F.coalesce("cluster", "new").alias("cluster")))


def memberships(points: DataFrame, parts: list[dict]) -> DataFrame:
    """id, p: each point's share in every part of a mixture; all ones where no part reaches it."""
    dens = []
    for p in parts:
        cov = p["cov"] if np.linalg.det(p["cov"]) > 1e-9 else p["cov"] + np.eye(3) * 0.5
        inv, norm = np.linalg.inv(cov), 1 / np.sqrt(248.05 * np.linalg.det(cov))
        d = [F.col(q) - float(m) for q, m in zip("xyz", p["mean"], strict=True)]
        form = sum((d[i] * d[j] * float(inv[i, j]) for i in range(3) for j in range(3)), F.lit(0.0))
        dens.append(F.exp(-0.5 * form) * float(p["tau"] * norm))
    rows = points.select("id", F.array(*dens).alias("d")).withColumn("s", F.aggregate("d", F.lit(0.0), lambda a, b: a + b))
    return rows.select("id", F.transform("d", lambda q: F.when(F.col("s") > 0, q / F.col("s")).otherwise(1.0)).alias("p"))


def mixture_quality(members: DataFrame) -> float:
    """Mean of each point's largest share; 0 without points."""
    return members.agg(F.coalesce(F.avg(F.array_max("p")), F.lit(0.0))).first()[0]


def share_histogram(members: DataFrame, k: int, bins: int) -> DataFrame:
    """bin, n: points by their largest share, from 1 / k to 1 in equal bins."""
    low = 1.0 / k
    at = F.floor((F.array_max("p") - low) / (1.0 - low) * bins)
    return members.groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fresh_ids(clusters: DataFrame, used: DataFrame, first: int, step: int) -> DataFrame:
    """cluster, label: the clusters in order take first, first + step, ... , leaving out what ``used`` (label) holds.

    Clusters are counted, so the candidates are as many as clusters and used labels together.
    """
    order = Window.orderBy("cluster")
    names = clusters.where("cluster is not null").select("cluster").distinct().withColumn("nth", F.row_number().over(order))
    taken = used.select(F.col("label").cast("long").alias("label")).distinct()
    n = names.count() + taken.count()
    free = clusters.sparkSession.range(n).select((F.lit(first) + F.col("id") * step).alias("label")).join(taken, "label", "left_anti")
    return names.join(free.withColumn("nth", F.row_number().over(Window.orderBy("label"))), "nth").select("cluster", "label")


def joined_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points of two clusters, each id once."""
    return a.unionByName(b).dropDuplicates(["id"])


def merged_points(points: DataFrame, sets: DataFrame) -> DataFrame:
    """root, size, sums of x, y, z: points whose ids share a set (set, id) become one; the others stay as they are."""
    first = sets.groupBy("set").agg(F.min("id").alias("a"), F.count_distinct("id").alias("n")).where("n >= 2")
    roots = connected(sets.join(first, "set").select("a", F.col("id").alias("b")))
    rows = points.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    return rows.groupBy("root").agg(F.count("*").alias("size"), *[F.sum(k).alias(k) for k in "xyz"])
