"""Series over frames: speeds, baselines, key frames, gait cycles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def speeds(points: DataFrame, dt: float) -> DataFrame:
    """Change of each ruler point since the frame before, by time; the first frame has none."""
    w = Window.partitionBy("ruler").orderBy("t")
    rows = points.select("ruler", "t", *[((F.col(k) - F.lag(k).over(w)) / dt).alias(f"v{k}") for k in "xyz"])
    return rows.where("vx is not null")


def over_background(series: DataFrame, background: str) -> DataFrame:
    """roi, t, ratio: each series over the background's value of the frame, itself where that is not positive or missing."""
    bg = series.where(F.col("roi") == background).select("t", F.col("v").alias("bg"))
    j = series.where(F.col("roi") != background).join(bg, "t", "left")
    return j.select("roi", "t", F.when(F.col("bg") > 0, F.col("v") / F.col("bg")).otherwise(F.col("v").cast("double")).alias("ratio"))


def _trimmed(v: np.ndarray, cut: float, fit):
    """What ``fit`` (values -> mean, variance, result) gives last, while values far above the mean are removed.

    Values go whose distance above the mean exceeds the variance z times, z
    being the largest of 1, 1/2, ... 1/64 that any value exceeds.  Ends when
    the variance is below ``cut``, when nothing is removed, or when a tenth of
    the values or fewer are left; the last removal is then not fitted again.
    """
    least = max(1, len(v) // 10)
    while True:
        mean, spread, found = fit(v)
        if spread < cut or spread <= 0:
            return found
        far = (v - mean) / spread
        z = next((0.5**k for k in range(7) if far.max() > 0.5**k), None)
        if z is None:
            return found
        v = v[far <= z]
        if len(v) <= least:
            return found


def constant_baseline(v: np.ndarray, cut: float = 0.001) -> float:
    """Mean of the values, high outliers trimmed (see ``_trimmed``); 0 without values."""
    return _trimmed(v, cut, lambda x: (x.mean(), x.var(), float(x.mean()))) if len(v) else 0.0


def linear_baseline(v: np.ndarray, cut: float = 0.001) -> tuple[float, float]:
    """Slope and intercept of the least-squares line over the values' order; the variance is that of the residuals.

    Trimmed like the constant; what is left is numbered anew after each removal.
    """

    def fit(x: np.ndarray):
        i = np.arange(len(x))
        line = tuple(float(q) for q in np.polyfit(i, x, 1)) if len(x) > 1 else (0.0, float(x[0]))
        return x.mean(), float(np.mean((x - np.polyval(line, i)) ** 2)), line

    return _trimmed(v, cut, fit) if len(v) else (0.0, 0.0)


def dff(series: DataFrame, background: str, cut: float = 0.001) -> DataFrame:
    """roi, t, dff: (v - f) / f with f = baseline * background; v where f is not positive.  One series is one group."""
    bg = series.where(F.col("roi") == background).select("t", F.col("v").cast("double").alias("bg"))
    rows = series.where(F.col("roi") != background).select("roi", "t", F.col("v").cast("double").alias("v")).join(bg, "t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        ratio = np.where(pdf.bg > 0, pdf.v / pdf.bg.where(pdf.bg > 0, 1.0), pdf.v)
        f = constant_baseline(np.asarray(ratio, float), cut) * pdf.bg
        return pdf[["roi", "t"]].assign(dff=np.where(f > 0, (pdf.v - f) / f.where(f > 0, 1.0), pdf.v))

    return rows.groupBy("roi").applyInPandas(run, "roi string, t int, dff double")


def at_frames(keys: DataFrame, frames: DataFrame, mode: str = "linear", beyond: str = "hold") -> DataFrame:
    """ruler, t and the position there from key frames: step, linear, smooth (both ends eased), start or end (one end eased).

    As-of by windows over keys and frames together.  Before the first key and
    after the last, ``beyond`` "hold" keeps the nearest key and "extend"
    carries the nearest two on; a single key holds either way.
    """
    cols = ["kt", *"xyz"]
    step = Window.partitionBy("ruler").orderBy("t")
    put = lambda f, n: [f(F.col(k)).alias(f"{n}_{k}") for k in cols]
    known = keys.select("ruler", "t", F.col("t").alias("kt"), *[F.col(k).cast("double").alias(k) for k in "xyz"])
    known = known.select("*", *put(lambda k: F.lag(k).over(step), "b"), *put(lambda k: F.lead(k).over(step), "a"))
    none = [F.lit(None).cast("int" if n.endswith("kt") else "double").alias(n) for n in known.columns[2:]]
    rows = known.withColumn("ask", F.lit(0)).unionByName(frames.select("ruler", "t", F.lit(1).alias("ask"), *none))
    back = Window.partitionBy("ruler").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("ruler").orderBy("t", "ask").rowsBetween(0, Window.unboundedFollowing)
    # The keys on both sides, and those one further out.
    last = [F.last(k, True).over(back).alias(f"p_{k}") for k in cols] + [F.last(f"b_{k}", True).over(back).alias(f"pp_{k}") for k in cols]
    first = [F.first(k, True).over(ahead).alias(f"n_{k}") for k in cols] + [F.first(f"a_{k}", True).over(ahead).alias(f"nn_{k}") for k in cols]
    rows = rows.select("ruler", "t", "ask", *last, *first).where("ask = 1")
    out = beyond == "extend"
    late, early = F.col("n_kt").isNull() & F.col("pp_kt").isNotNull() & F.lit(out), F.col("p_kt").isNull() & F.col("nn_kt").isNotNull() & F.lit(out)
    one = lambda k: F.when(late, F.col(f"pp_{k}")).when(early, F.col(f"n_{k}")).otherwise(F.coalesce(f"p_{k}", f"n_{k}"))
    two = lambda k: F.when(late, F.col(f"p_{k}")).when(early, F.col(f"nn_{k}")).otherwise(F.coalesce(f"n_{k}", f"p_{k}"))
    f = F.when(two("kt") > one("kt"), (F.col("t") - one("kt")) / (two("kt") - one("kt"))).otherwise(0.0)
    f2, f3 = f * f, f * f * f
    s = {"step": F.lit(0.0), "linear": f, "smooth": 3 * f2 - 2 * f3, "start": 2 * f2 - f3, "end": f + f2 - f3}[mode]
    return rows.select("ruler", "t", *[(one(k) + s * (two(k) - one(k))).alias(k) for k in "xyz"])


def resampled(series: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, len(series) - 1, n), np.arange(len(series)), series)


def cycle_match(series: np.ndarray, cycle: np.ndarray) -> tuple[int, float]:
    """Width, from half to one and a half cycles, whose resampled start correlates best with the cycle; ties take the shortest."""
    best = (0, -np.inf)
    for width in range(max(2, len(cycle) // 2), min(len(series), 3 * len(cycle) // 2) + 1):
        c = float((resampled(series[:width], len(cycle)) * cycle).sum())
        if c > best[1]:
            best = (width, c)
    return best


def gait_windows(walk: DataFrame, cycle: list[float], overlap: int = 1) -> DataFrame:
    """series, start, width, corr: consecutive best windows of each series.  One series is one group."""
    wave = np.asarray(cycle, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at, rows = pdf.sort_values("frame")["value"].to_numpy(float), 0, []
        while len(v) - at >= max(2, len(wave) // 2):
            width, corr = cycle_match(v[at:], wave)
            rows.append((pdf["series"].iloc[0], at, width, corr))
            at += max(1, width - overlap)
        return pd.DataFrame(rows, columns=["series", "start", "width", "corr"])

    return walk.groupBy("series").applyInPandas(run, "series string, start int, width int, corr double")


def synthetic_walk(cycle: DataFrame, frames: int, direction: tuple[float, float, float]) -> DataFrame:
    """t (1 to ``frames``) and position of a point that moves by direction * cycle value at each phase (cycle: phase from 0, value).

    Whole cycles count by their sum, so only the cycle's own rows are added up one by one.
    """
    so_far = F.sum("value").over(Window.orderBy("phase"))
    parts = cycle.select("phase", so_far.alias("part"), F.sum("value").over(Window.partitionBy()).alias("whole"), F.count("*").over(Window.partitionBy()).alias("period"))
    steps = cycle.sparkSession.range(1, frames + 1).select(F.col("id").cast("int").alias("t"))
    period = cycle.count()
    rows = steps.withColumn("phase", ((F.col("t") - 1) % period).cast("int")).join(F.broadcast(parts), "phase")
    run = F.floor((F.col("t") - 1) / F.col("period")) * F.col("whole") + F.col("part")
    return rows.select("t", *[(run * d).alias(k) for k, d in zip("xyz", direction, strict=True)])


def window_scores(walk: DataFrame, cycle: list[list[float]]) -> DataFrame:
    """series, start, width, corr: how each window of half to one and a half cycles correlates with the cycle, over all its rows.

    ``walk``: series, dim, frame (from 0, without gaps), value; ``cycle`` has a
    row for each dim.  A window is resampled to the cycle's length.
    """
    period = len(cycle[0])
    low, high = max(2, period // 2), 3 * period // 2
    # Each start sees the values ahead that its windows may hold; sums for all widths are made in one row.
    order = Window.partitionBy("series", "dim").orderBy("frame")
    ahead = F.transform(F.collect_list(F.struct("value")).over(order.rowsBetween(0, high - 1)), lambda q: q["value"])
    rows = walk.repartition("series").select("series", "dim", (F.row_number().over(order) - 1).alias("start"), ahead.alias("v")).where(F.size("v") >= low)
    waves = F.array(*[F.array(*[F.lit(float(q)) for q in row]) for row in cycle])
    rows = rows.withColumn("wave", F.element_at(waves, F.col("dim") + 1))
    part = """aggregate(sequence(0, {p} - 1), 0D, (a, j) -> a + wave[j] * (
        v[cast(floor(j * (width - 1) / {q}) as int)] + (j * (width - 1) / {q} - floor(j * (width - 1) / {q})) * (
        v[least(width - 1, cast(floor(j * (width - 1) / {q}) as int) + 1)] - v[cast(floor(j * (width - 1) / {q}) as int)])))""".format(p=period, q=f"{period - 1}D")
    widths = range(low, high + 1)
    held = lambda width: F.size("v") >= width
    sums = rows.groupBy("series", "start").agg(*[F.sum(F.when(held(w), F.expr(part.replace("width", str(w))))).alias(f"c{w}") for w in widths], F.max(F.size("v")).alias("most"))
    found = F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"c{w}").alias("corr")) for w in widths])
    return sums.select("series", "start", F.inline(F.slice(found, 1, F.col("most") - (low - 1))))


def _windows(length: int, cycle: np.ndarray, data: np.ndarray, overlap: int) -> list[tuple[int, int, float]]:
    """(start, width, corr) of consecutive best windows over all rows of ``data`` at once.

    Correlations are rounded to 9 decimals before they are compared, and of equal ones the shortest window counts.
    """
    period, at, out = cycle.shape[1], 0, []
    while at + period <= length:
        best = (max(2, period // 2), 0.0)
        for width in range(max(2, period // 2), min(length - at, 3 * period // 2) + 1):
            c = float(np.round(sum((resampled(row[at : at + width], period) * w).sum() for row, w in zip(data, cycle, strict=True)), 9))
            if c > best[1]:
                best = (width, c)
        out.append((at, *best))
        at += max(1, best[0] - overlap)
    return out


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, list[int]]:
    wide = pdf.pivot_table(index="dim", columns="frame", values="value", aggfunc="max").sort_index().fillna(0.0)
    return wide.to_numpy(float), list(wide.index)


def gait_cycle(walk: DataFrame, cycle: list[list[float]], overlap: int = 1, weight: float = 0.0) -> DataFrame:
    """series, dim, phase, value: the cycle averaged over a walk's windows, weighted by correlation.

    ``walk``: series, dim, frame, value.  ``cycle`` has a row for each dim; it
    counts with ``weight``.  One walk is one group.
    """
    wave = np.asarray(cycle, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, dims = _matrix(pdf)
        total, out = weight, wave * weight
        for at, width, corr in _windows(data.shape[1], wave, data, overlap):
            out = out + corr * np.stack([resampled(r[at : at + width], wave.shape[1]) for r in data])
            total += corr
        out = out / total if total else out
        return pd.DataFrame([(pdf["series"].iloc[0], d, j, v) for d, row in zip(dims, out, strict=True) for j, v in enumerate(row)], columns=["series", "dim", "phase", "value"])

    return walk.groupBy("series").applyInPandas(run, "series string, dim int, phase int, value double")


def gait_compared(walk: DataFrame, cycle: list[list[float]], overlap: int = 1) -> DataFrame:
    """series, dim, start, width, score: sign times log2(1 + |window . cycle / cycle . cycle|) for each window and dim."""
    wave = np.asarray(cycle, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, dims = _matrix(pdf)
        rows = []
        for at, width, _ in _windows(data.shape[1], wave, data, overlap):
            for d, r, w in zip(dims, data, wave, strict=True):
                v, own = float((r[at : at + width] * resampled(w, width)).sum()), float((w * w).sum())
                v = v / own if own else v
                rows.append((pdf["series"].iloc[0], d, at, width, float(np.sign(v) * np.log2(1 + abs(v)))))
        return pd.DataFrame(rows, columns=["series", "dim", "start", "width", "score"])

    return walk.groupBy("series").applyInPandas(run, "series string, dim int, start int, width int, score double")


def gait_aligned(walk: DataFrame, cycle: list[list[float]], overlap: int = 1) -> DataFrame:
    """series, dim, frame, value: all windows resampled to the cycle's length and laid end to end; the later one counts where they overlap."""
    wave = np.asarray(cycle, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, dims = _matrix(pdf)
        period, rows = wave.shape[1], {}
        for k, (at, width, _) in enumerate(_windows(data.shape[1], wave, data, overlap)):
            for d, r in zip(dims, data, strict=True):
                for j, v in enumerate(resampled(r[at : at + width], period)):
                    rows[d, k * (period - overlap) + j] = v
        return pd.DataFrame([(pdf["series"].iloc[0], d, f, v) for (d, f), v in sorted(rows.items())], columns=["series", "dim", "frame", "value"])

    return walk.groupBy("series").applyInPandas(run, "series string, dim int, frame int, value double")


def gait_variance(walk: DataFrame, cycle: list[list[float]], overlap: int = 1) -> DataFrame:
    """series, cycles, diff2: over the windows, squared sums of the differences from the cycle."""
    wave = np.asarray(cycle, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, _ = _matrix(pdf)
        found = _windows(data.shape[1], wave, data, overlap)
        diff = [sum(float((r[at : at + n] - resampled(w, n)).sum()) for r, w in zip(data, wave, strict=True)) ** 2 for at, n, _ in found]
        return pd.DataFrame([(pdf["series"].iloc[0], len(found), float(sum(diff)))], columns=["series", "cycles", "diff2"])

    return walk.groupBy("series").applyInPandas(run, "series string, cycles int, diff2 double")


def gait_frames(walk: DataFrame, cycle: list[list[float]], least: float, leading: int, overlap: int = 1) -> DataFrame:
    """series, cycles, frames: windows in which the ``leading`` first rows have a mean beyond ``least`` in size, and their frames less the overlap."""
    wave = np.asarray(cycle, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, _ = _matrix(pdf)
        moved = [n - overlap for at, n, _ in _windows(data.shape[1], wave, data, overlap) if abs(data[:leading, at : at + n].mean()) > least]
        return pd.DataFrame([(pdf["series"].iloc[0], len(moved), sum(moved))], columns=["series", "cycles", "frames"])

    return walk.groupBy("series").applyInPandas(run, "series string, cycles int, frames long")


def axis_corrected(walk: DataFrame, dims: int) -> DataFrame:
    """x rows (dim mod ``dims`` = 0) divided by the largest row sum, the others less their row mean."""
    rows = walk.withColumn("_axis", F.col("dim") % dims)
    each = rows.groupBy("series", "dim", "_axis").agg(F.sum("value").alias("_sum"), F.avg("value").alias("_mean"))
    largest = each.where("_axis = 0").groupBy("series").agg(F.max("_sum").alias("_top"))
    rows = rows.join(each, ["series", "dim", "_axis"]).join(largest, "series", "left")
    value = F.when(F.col("_axis") == 0, F.when(F.col("_top") != 0, F.col("value") / F.col("_top")).otherwise(F.col("value"))).otherwise(F.col("value") - F.col("_mean"))
    return rows.select("series", "dim", "frame", value.alias("value"))


def line_baseline(series: DataFrame, cut: float = 0.001) -> DataFrame:
    """roi, slope, base: the trimmed least-squares line of each series (roi, t, v) over its frames' order.  One series is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slope, base = linear_baseline(pdf.sort_values("t")["v"].to_numpy(float), cut)
        return pd.DataFrame([(pdf["roi"].iloc[0], slope, base)], columns=["roi", "slope", "base"])

    return series.groupBy("roi").applyInPandas(run, "roi string, slope double, base double")
