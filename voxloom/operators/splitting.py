"""Splits and merges of components by their samples' clusters, for all components at once.

Points (t, c, label, id, x, y, z, w) are the samples of the components that
are to be split.  What is known of a component, its centres or the parts of
its mixture, is one row, so a round of all fits is one join on the component
and one aggregation with partial sums: no component is ever gathered in a
task, however many samples it has.  Components that have settled leave the
rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import dbscan
from .graph import cut
from .segmentation import scan_code

KEY = ["t", "c", "label"]
AT = ["x", "y", "z"]
PAIRS = ["xx", "xy", "xz", "yy", "yz", "zz"]
#: (2 pi)^3 of the normal density in space.
NORM = 248.05021344239853


def component_points(vox: DataFrame, wanted: DataFrame | None = None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Points of the components in ``wanted`` (t, c, label, more), or of all: place times ``spacing``, weight v / 255."""
    rows = vox.where("label <> 0 and v > 0")
    if wanted is not None:
        rows = rows.join(wanted.select(*KEY).distinct(), KEY, "left_semi")
    at = [(F.col(k) * float(s)).alias(k) for k, s in zip(AT, spacing, strict=True)]
    return rows.select(*KEY, scan_code().alias("id"), *at, (F.col("v") / 255.0).alias("w"))


def _apart2(place: Column) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(k) - place[k]) * (F.col(k) - place[k]) for k in AT])


def seed_centres(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """t, c, label, k, centres: the heaviest sample, then each time the farthest from the one before; of equals the first id.

    ``wanted`` holds t, c, label, k.  Components with fewer samples than k
    repeat places.
    """
    place = F.struct(*AT)
    top = F.max(F.struct("w", (-F.col("id")).alias("i"), place.alias("p"))).alias("b")
    found = cut(wanted.select(*KEY, F.col("k").cast("int").alias("k")).join(points.groupBy(*KEY).agg(top), KEY).select(*KEY, "k", F.array("b.p").alias("centres")))
    most = found.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    for n in range(1, most):
        last = found.where(F.col("k") > n).select(*KEY, F.element_at("centres", -1).alias("last"))
        far = F.max(F.struct(_apart2(F.col("last")).alias("d"), (-F.col("id")).alias("i"), place.alias("p"))).alias("b")
        new = points.join(last, KEY).groupBy(*KEY).agg(far).select(*KEY, F.col("b.p").alias("new"))
        grown = F.when(F.col("new").isNotNull(), F.concat("centres", F.array("new"))).otherwise(F.col("centres"))
        found = cut(found.join(new, KEY, "left").select(*KEY, "k", grown.alias("centres")))
    return found


def _nearest(centres: str) -> Column:
    d = F.transform(centres, _apart2)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def clustered(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``points`` with the number of the nearest of their component's centres; of equals the first."""
    return points.join(centres.select(*KEY, "centres"), KEY).withColumn("cluster", _nearest("centres")).drop("centres")


def component_kmeans(points: DataFrame, wanted: DataFrame, eps: float = 1e-6, rounds: int = 100) -> DataFrame:
    """t, c, label, k, centres, settled: weighted k-means inside every component; clusters that go empty keep their centre."""
    state = seed_centres(points, wanted)
    done = None
    for n in range(rounds):
        sums = clustered(points, state).groupBy(*KEY, "cluster").agg(F.sum("w").alias("w"), *[F.sum(F.col(q) * F.col("w")).alias(f"s{q}") for q in AT])
        old = state.select(*KEY, "k", F.posexplode("centres").alias("cluster", "p"))
        new = F.struct(*[F.coalesce(F.col(f"s{q}") / F.col("w"), F.col("p")[q]).alias(q) for q in AT])
        both = old.join(sums, [*KEY, "cluster"], "left").select(*KEY, "k", "cluster", "p", new.alias("q"))
        moved = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col("q")[k] - F.col("p")[k], 2) for k in AT]))
        rows = both.groupBy(*KEY, "k").agg(F.sort_array(F.collect_list(F.struct("cluster", "q"))).alias("l"), F.max(moved).alias("moved"))
        state = cut(rows.select(*KEY, "k", F.col("l.q").alias("centres"), (F.col("moved") <= eps).alias("settled")))
        out = state if n == rounds - 1 else state.where("settled")
        done = out if done is None else done.unionByName(out)
        state = state.where("not settled")
        if state.isEmpty():
            break
    return done


def first_parts(points: DataFrame) -> DataFrame:
    """t, c, label, parts: the weighted means and variances of each cluster of ``points`` (with cluster), all with equal shares."""
    mean = {q: F.sum(F.col(q) * F.col("w")) / F.sum("w") for q in AT}
    rows = points.groupBy(*KEY, "cluster").agg(*[mean[q].alias(q) for q in AT], *[(F.sum(F.col(q) * F.col(q) * F.col("w")) / F.sum("w") - mean[q] * mean[q]).alias(f"s{q}") for q in AT])
    spread = {"xx": "sx", "yy": "sy", "zz": "sz"}
    fields = [F.lit(1.0).alias("tau"), *[F.col(q).alias(f"m{q}") for q in AT], *[(F.greatest(F.lit(0.0), spread[p]) if p in spread else F.lit(0.0)).alias(p) for p in PAIRS]]
    listed = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("cluster", F.struct(*fields).alias("p")))).alias("l")).select(*KEY, F.col("l.p").alias("parts"))
    return listed.withColumn("parts", F.transform("parts", lambda p: p.withField("tau", F.lit(1.0) / F.size("parts"))))


def _determinant(p: Column) -> Column:
    return p["xx"] * (p["yy"] * p["zz"] - p["yz"] * p["yz"]) - p["xy"] * (p["xy"] * p["zz"] - p["yz"] * p["xz"]) + p["xz"] * (p["xy"] * p["yz"] - p["yy"] * p["xz"])


def _firm(p: Column) -> Column:
    """A part whose covariance is flat (determinant of 1e-9 at most) gets a half added to its variances."""
    more = F.when(_determinant(p) > 1e-9, 0.0).otherwise(0.5)
    return p.withField("xx", p["xx"] + more).withField("yy", p["yy"] + more).withField("zz", p["zz"] + more)


def _inverted(p: Column) -> Column:
    """A part's factor before the exponential and its inverse covariance, worked out once a part."""
    det = _determinant(p)
    inverse = {
        "xx": p["yy"] * p["zz"] - p["yz"] * p["yz"],
        "xy": p["xz"] * p["yz"] - p["xy"] * p["zz"],
        "xz": p["xy"] * p["yz"] - p["xz"] * p["yy"],
        "yy": p["xx"] * p["zz"] - p["xz"] * p["xz"],
        "yz": p["xy"] * p["xz"] - p["xx"] * p["yz"],
        "zz": p["xx"] * p["yy"] - p["xy"] * p["xy"],
    }
    return F.struct((p["tau"] / F.sqrt(NORM * det)).alias("f"), *[p[f"m{q}"].alias(f"m{q}") for q in AT], *[(inverse[k] / det).alias(k) for k in PAIRS])


def _density(p: Column) -> Column:
    d = {q: F.col(q) - p[f"m{q}"] for q in AT}
    form = reduce(lambda a, b: a + b, [d[k[0]] * d[k[1]] * p[k] * (1.0 if k[0] == k[1] else 2.0) for k in PAIRS])
    return p["f"] * F.exp(-0.5 * form)


def shares(points: DataFrame, parts: DataFrame) -> DataFrame:
    """``points`` with s, the mixture's density, and p, their share in every part of their component; all ones where no part reaches."""
    ready = parts.select(*KEY, F.transform(F.transform("parts", _firm), _inverted).alias("ready"))
    rows = points.join(ready, KEY).withColumn("d", F.transform("ready", _density)).drop("ready")
    rows = rows.withColumn("s", F.aggregate("d", F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn("p", F.transform("d", lambda q: F.when(F.col("s") > 0, q / F.col("s")).otherwise(1.0))).drop("d")


def mixture_round(points: DataFrame, parts: DataFrame) -> DataFrame:
    """t, c, label, parts, fit: one round of expectation and maximisation of every component's mixture.

    ``fit`` is the weighted log density under the parts given.  Moments are
    summed around the old means.
    """
    rows = shares(points, parts).join(parts.select(*KEY, F.col("parts").alias("old")), KEY)
    fit = F.when(F.col("j") == 0, F.col("w") * F.log(F.greatest("s", F.lit(1e-300)))).otherwise(0.0)
    rows = rows.select(*KEY, *AT, "w", "s", "old", F.posexplode("p").alias("j", "share"))
    rows = rows.select(*KEY, "j", F.element_at("old", F.col("j") + 1).alias("o"), *AT, fit.alias("fit"), "w", (F.col("share") * F.col("w")).alias("m"))
    d = {q: F.col(q) - F.col("o")[f"m{q}"] for q in AT}
    sums = rows.groupBy(*KEY, "j").agg(
        F.first("o").alias("o"), F.sum("fit").alias("fit"), F.sum("w").alias("w"), F.sum("m").alias("n"),
        *[F.sum(F.col("m") * d[q]).alias(f"s{q}") for q in AT], *[F.sum(F.col("m") * d[k[0]] * d[k[1]]).alias(k) for k in PAIRS],
    )
    n = F.greatest("n", F.lit(1e-300))
    mean = {q: F.col(f"s{q}") / n for q in AT}
    part = F.struct((F.col("n") / F.col("w")).alias("tau"), *[(F.col("o")[f"m{q}"] + mean[q]).alias(f"m{q}") for q in AT], *[(F.col(k) / n - mean[k[0]] * mean[k[1]]).alias(k) for k in PAIRS])
    listed = sums.select(*KEY, "j", part.alias("p"), "fit").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("j", "p"))).alias("l"), F.sum("fit").alias("fit"))
    return listed.select(*KEY, F.col("l.p").alias("parts"), "fit")


def component_mixtures(points: DataFrame, start: DataFrame, eps: float = 1e-6, rounds: int = 100) -> DataFrame:
    """t, c, label, parts, settled: every component's mixture from its ``start`` (t, c, label, parts), until its fit changes by less than ``eps`` of itself."""
    state, done = cut(start.select(*KEY, "parts", F.lit(None).cast("double").alias("last"))), None
    for n in range(rounds):
        new = mixture_round(points, state).join(state.select(*KEY, "last"), KEY)
        settled = F.coalesce(F.abs(F.col("fit") - F.col("last")) <= eps * F.abs("fit"), F.lit(False))
        state = cut(new.select(*KEY, "parts", settled.alias("settled"), F.col("fit").alias("last")))
        out = (state if n == rounds - 1 else state.where("settled")).drop("last")
        done = out if done is None else done.unionByName(out)
        state = state.where("not settled").drop("settled")
        if state.isEmpty():
            break
    return done


def split_samples(vox: DataFrame, wanted: DataFrame, trust: float = 0.9, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), rounds: int = 100) -> DataFrame:
    """t, c, label, id, cluster, quality: the samples of the components in ``wanted`` (t, c, label, k) by the parts of their mixtures.

    Mixtures start from k-means.  A sample goes to its greatest share, of
    equals the first; ``quality`` is the mean of these shares in the
    component.  Only components of more than one part and with a quality
    above ``trust`` come back.  A component named twice is taken with its
    largest k; one with a k below 2 or null is left out.  k-means and mixtures
    stop after ``rounds`` at the latest.
    """
    wanted = cut(wanted.where("k >= 2").groupBy(*KEY).agg(F.max("k").alias("k")))
    points = cut(component_points(vox, wanted, spacing))
    start = first_parts(clustered(points, component_kmeans(points, wanted, rounds=rounds)))
    found = shares(points, component_mixtures(points, start, rounds=rounds))
    top = F.array_max("p")
    named = cut(found.select(*KEY, "id", (F.array_position("p", top) - 1).cast("int").alias("cluster"), top.alias("share")))
    good = named.groupBy(*KEY).agg(F.avg("share").alias("quality"), F.min("cluster").alias("a"), F.max("cluster").alias("b")).where((F.col("quality") > trust) & (F.col("a") < F.col("b")))
    return named.drop("share").join(good.select(*KEY, "quality"), KEY)


def split_components(vox: DataFrame, wanted: DataFrame, trust: float = 0.9, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``vox`` where the components in ``wanted`` (t, c, label, k) are cut into the parts of their mixtures.

    Part n of a component takes its label plus n + 1 times the greatest label
    of its frame and channel, which nothing else can have.  Components that
    do not come apart (``split_samples``) keep their label.
    """
    top = vox.where("label <> 0").groupBy("t", "c").agg(F.max("label").alias("top"))
    new = split_samples(vox, wanted, trust, spacing).join(top, ["t", "c"])
    new = new.select(*KEY, "id", (F.col("label") + (F.col("cluster") + 1) * F.col("top")).alias("new"))
    return vox.withColumn("id", scan_code()).join(new, [*KEY, "id"], "left").withColumn("label", F.coalesce("new", "label")).select(*vox.columns)


def forked(links: DataFrame) -> DataFrame:
    """t, c, label, k: components with k >= 2 links that hold (link = 1) to one neighbouring frame; to both, the greater number."""
    held = links.where("link = 1")
    ahead = held.groupBy("t", "c", F.col("v1").alias("label")).agg(F.count_distinct("v2").alias("k"))
    back = held.groupBy((F.col("t") + 1).cast("int").alias("t"), "c", F.col("v2").alias("label")).agg(F.count_distinct("v1").alias("k"))
    return ahead.unionByName(back).groupBy(*KEY).agg(F.max("k").cast("int").alias("k")).where("k >= 2")


def far_ends(links: DataFrame, back: bool = False) -> DataFrame:
    """t, c, set, label: components of the later frame (``back``: the earlier one) that hold links to one component, which names the set, where they are two or more."""
    near, far, step = ("v2", "v1", 0) if back else ("v1", "v2", 1)
    rows = links.where("link = 1").select((F.col("t") + step).cast("int").alias("t"), "c", F.col(near).alias("set"), F.col(far).alias("label")).distinct()
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("t", "c", "set"))).where("n >= 2").drop("n")


def merge_verdicts(vox: DataFrame, sets: DataFrame, eps: float = 2.0, least: int = 5) -> DataFrame:
    """t, c, set, clusters, merge: whether the samples of all components of a set (t, c, set, label) are one cluster by density.

    All sets are clustered at once: each is moved to a place of its own,
    farther from the next than any two samples of a set can be.  Sets whose
    samples are all noise have no cluster and stay apart.
    """
    sets = sets.select("t", "c", "set", "label").distinct()
    rows = vox.where("label <> 0 and v > 0").join(sets, KEY).withColumn("code", scan_code())
    span = [b - a + 4 * eps for a, b in _bounds(vox)]
    move = {"x": F.col("set") * span[0], "y": F.col("c") * span[1], "z": F.col("t") * span[2]}
    points = cut(rows.select("t", "c", "set", F.xxhash64("t", "c", "set", "code").alias("id"), *[(F.col(k) + move[k]).cast("double").alias(k) for k in AT], F.col("v").cast("double").alias("w")))
    named = dbscan(points.select("id", *AT, "w"), eps, least)
    counts = points.select("t", "c", "set", "id").join(named, "id", "left").groupBy("t", "c", "set").agg(F.count_distinct("cluster").cast("int").alias("clusters"))
    return counts.withColumn("merge", F.col("clusters") == 1)


def _bounds(vox: DataFrame) -> list[tuple[float, float]]:
    r = vox.agg(*[f(k).alias(f"{n}{k}") for k in AT for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    return [(float(r[f"a{k}"] or 0), float(r[f"b{k}"] or 0)) for k in AT]


def first_fit(points: DataFrame) -> DataFrame:
    """t, c, label, and one part (mx ... zz): each component's weighted mean and variances, without covariances."""
    return first_parts(points.withColumn("cluster", F.lit(0))).select(*KEY, F.col("parts")[0].alias("o"))


def fit_round(points: DataFrame, fits: DataFrame) -> DataFrame:
    """t, c, label, o, shift: each component's one Gaussian ``o`` fitted again, samples weighing by density and the square of their weight.

    ``shift`` is how far the mean went.  Components that their Gaussian does not reach stay.
    """
    ready = fits.select(*KEY, "o", _inverted(_firm(F.col("o"))).alias("p"))
    rows = points.join(ready, KEY).withColumn("m", _density(F.col("p")) * F.col("w") * F.col("w"))
    d = {q: F.col(q) - F.col("o")[f"m{q}"] for q in AT}
    sums = rows.groupBy(*KEY).agg(F.first("o").alias("o"), F.sum("m").alias("n"), *[F.sum(F.col("m") * d[q]).alias(f"s{q}") for q in AT], *[F.sum(F.col("m") * d[k[0]] * d[k[1]]).alias(k) for k in PAIRS])
    mean = {q: F.col(f"s{q}") / F.col("n") for q in AT}
    part = F.struct(F.lit(1.0).alias("tau"), *[(F.col("o")[f"m{q}"] + mean[q]).alias(f"m{q}") for q in AT], *[(F.col(k) / F.col("n") - mean[k[0]] * mean[k[1]]).alias(k) for k in PAIRS])
    shift = F.sqrt(reduce(lambda a, b: a + b, [mean[q] * mean[q] for q in AT]))
    on = F.col("n") > 0
    return sums.select(*KEY, F.when(on, part).otherwise(F.col("o")).alias("o"), F.when(on, shift).otherwise(0.0).alias("shift"))


def local_centres(points: DataFrame, eps: float = 1e-3, rounds: int = 30) -> DataFrame:
    """t, c, label, mx, my, mz, x, y, z, shift: the weighted mean of each component, and where its densest part pulls it.

    The one Gaussian is fitted again and again on samples that weigh by its
    density, so it closes in on the component's main part.  A component stops
    when its mean moves by ``eps`` or less, or for the fourth time did not move
    less than the round before.  x, y, z are the last mean if its last move was below
    a half, else the first one.
    """
    points = cut(points)
    firsts = cut(first_fit(points))
    state = firsts.select(*KEY, "o", F.lit(0.0).alias("last"), F.lit(0).alias("risen"))
    done = None
    for n in range(rounds):
        new = fit_round(points, state).join(state.select(*KEY, "last", "risen"), KEY)
        risen = F.col("risen") + F.when(F.col("shift") >= F.col("last"), 1).otherwise(0)
        state = cut(new.select(*KEY, "o", F.col("shift").alias("last"), risen.alias("risen"), ((F.col("shift") <= eps) | (risen > 3)).alias("over")))
        out = (state if n == rounds - 1 else state.where("over")).select(*KEY, "o", F.col("last").alias("shift"))
        done = out if done is None else done.unionByName(out)
        state = state.where("not over").drop("over")
        if state.isEmpty():
            break
    both = done.join(firsts.select(*KEY, F.col("o").alias("f")), KEY)
    at = [F.when(F.col("shift") < 0.5, F.col("o")[f"m{q}"]).otherwise(F.col("f")[f"m{q}"]).alias(q) for q in AT]
    return both.select(*KEY, *[F.col("f")[f"m{q}"].alias(f"m{q}") for q in AT], *at, "shift")
