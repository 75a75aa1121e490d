"""Rulers that relax onto bright samples: pulled by what lies around their points, held by springs along their order."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

AT = ("x", "y", "z")


def _length(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def _unit(parts: list[Column]) -> list[Column]:
    """Parts over their length; zeros where that is zero."""
    size = _length(*parts)
    return [F.when(size > 0, p / size).otherwise(0.0) for p in parts]


def summed(samples: DataFrame) -> DataFrame:
    """``samples`` (x, y, z, w) above zero, those of one place as one of their summed w: they draw alike."""
    return samples.where("w > 0").groupBy(*[F.col(k).cast("double").alias(k) for k in AT]).agg(F.sum(F.col("w").cast("double")).alias("w"))


def pulls(points: DataFrame, samples: DataFrame, rest: float, reach: float) -> DataFrame:
    """ruler, n, px, py, pz: the mean pull on each point of the samples (x, y, z, w) within ``reach``, weighed by w and the inverse square of the distance.

    Distances below ``rest`` count as ``rest``.  A range join over cells of
    side ``reach``; the side of fewer rows, places of samples or points, is sent to 27
    cells and the other to its own alone, and pulls are summed before they are
    shuffled.  Points without samples are left out.
    """
    return _drawn(points, cut(summed(samples)), rest, reach)


def _drawn(points: DataFrame, samples: DataFrame, rest: float, reach: float) -> DataFrame:
    """``pulls`` of samples that ``summed`` gave."""
    cell = lambda k: F.floor(F.col(k) / reach).cast("long")
    step = F.explode(F.array(*[F.struct(*[F.lit(q).alias(k) for k, q in zip(AT, d, strict=True)]) for d in product((-1, 0, 1), repeat=3)])).alias("d")

    def celled(rows: DataFrame, names: list[str], around: bool) -> DataFrame:
        rows = rows.select(*rows.columns, *[cell(k).alias(f"g{q}") for k, q in zip(names, AT, strict=True)])
        if around:
            rows = rows.select("*", step)
            rows = rows.withColumns({f"g{k}": F.col(f"g{k}") + F.col(f"d.{k}") for k in AT}).drop("d")
        return rows

    few = samples.count() <= points.count()
    spots = celled(points.select("ruler", "n", *[F.col(k).alias(f"p{k}") for k in AT]), [f"p{k}" for k in AT], not few)
    # The planner's sizes do not count the 27 cells, so the join is named.
    near = spots.join(celled(samples.select(*AT, "w"), list(AT), few).hint("merge"), [f"g{k}" for k in AT])
    gap = {k: F.col(k) - F.col(f"p{k}") for k in AT}
    near = near.withColumn("dist", _length(*gap.values())).where(F.col("dist") <= reach)
    far = F.greatest("dist", F.lit(float(rest)))
    return near.groupBy("ruler", "n").agg(*[(F.sum(gap[k] * F.col("w") / far / far) / F.sum("w")).alias(f"p{k}") for k in AT])


def sprung(points: DataFrame) -> DataFrame:
    """``points`` (ruler, n, x, y, z, locked) with back and ahead: the lengths of their springs to the neighbours, null at the ends and where points coincide."""
    order = Window.partitionBy("ruler").orderBy("n")
    rows = points.select("ruler", "n", *[F.col(k).cast("double").alias(k) for k in AT], "locked")
    gap = lambda f: _length(*[F.col(k) - f(k).over(order) for k in AT])
    return rows.withColumns({"back": F.nullif(gap(F.lag), F.lit(0.0)), "ahead": F.nullif(gap(F.lead), F.lit(0.0))})


def relax_round(state: DataFrame, samples: DataFrame, rest: float = 1.0, reach: float = 10.0, pull: float = 1.0, stretch: float = 2.0, bend: float = 3.0) -> DataFrame:
    """One round of ``relaxed``: ``state`` is what ``sprung`` gives, with its points moved, ``samples`` what ``summed`` gives."""
    order = Window.partitionBy("ruler").orderBy("n")
    rows = state.join(_drawn(state.where("not locked"), samples, rest, reach), ["ruler", "n"], "left")
    away = {side: [f(k).over(order) - F.col(k) for k in AT] for side, f in (("back", F.lag), ("ahead", F.lead))}
    rows = rows.withColumns({f"{side}_{k}": F.coalesce(d, F.lit(0.0)) for side, ds in away.items() for k, d in zip(AT, ds, strict=True)})
    to = {side: [F.col(f"{side}_{k}") for k in AT] for side in away}
    unit = {side: _unit(ds) for side, ds in to.items()}
    other = {"back": "ahead", "ahead": "back"}
    # A spring at the end of a ruler is five times as soft.
    force = {side: F.when(F.col(side).isNotNull(), (_length(*to[side]) - F.col(side)) * F.when(F.col(other[side]).isNull(), 0.2).otherwise(1.0)).otherwise(0.0) for side in away}
    both = F.col("back").isNotNull() & F.col("ahead").isNotNull()
    cosine = reduce(lambda a, b: a + b, [a * b for a, b in zip(unit["back"], unit["ahead"], strict=True)])
    rows = rows.withColumns({"sharp": F.when(both, cosine + 1.0).otherwise(0.0), **{f"m{k}": a + b for k, a, b in zip(AT, unit["back"], unit["ahead"], strict=True)}})
    middle = _unit([F.col(f"m{k}") for k in AT])
    rows = rows.withColumns({f"s{k}": stretch * (unit["back"][i] * force["back"] + unit["ahead"][i] * force["ahead"]) + bend * F.col("sharp") * middle[i] for i, k in enumerate(AT)})
    norm = F.greatest(F.lit(0.01), (F.coalesce("back", F.lit(0.0)) + F.coalesce("ahead", F.lit(0.0))) / 100.0)
    drawn = _unit([F.coalesce(f"p{k}", F.lit(0.0)) for k in AT])
    held = _unit([F.col(f"s{k}") for k in AT])
    moved = {k: F.when(F.col("locked"), F.col(k)).otherwise(F.col(k) + norm * (pull * drawn[i] + 2.0 * stretch * held[i])) for i, k in enumerate(AT)}
    return rows.select("ruler", "n", *[moved[k].alias(k) for k in AT], "locked", "back", "ahead")


def relaxed(points: DataFrame, samples: DataFrame, rounds: int = 10, rest: float = 1.0, reach: float = 10.0, pull: float = 1.0, stretch: float = 2.0, bend: float = 3.0) -> DataFrame:
    """ruler, n, x, y, z: rulers' points after ``rounds`` rounds; all points of a round see the others as the round found them.

    A point is drawn towards the bright samples around it by a step of a
    hundredth of its springs' lengths; its springs, which keep their first
    lengths, and its bend, which they straighten, move it by twice
    ``stretch`` of that.  Locked points (locked; null is free) stay.  Without samples springs act alone.
    """
    free = points.withColumn("locked", F.coalesce("locked", F.lit(False))) if "locked" in points.columns else points.withColumn("locked", F.lit(False))
    state, samples = cut(sprung(free)), cut(summed(samples))
    for _ in range(rounds):
        state = cut(relax_round(state, samples, rest, reach, pull, stretch, bend))
    return state.select("ruler", "n", *AT)
