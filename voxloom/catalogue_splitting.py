"""Registered queries of component splits, merges and local fits, of bricked files, two cameras and relaxation, and their DuckDB SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from .catalogue import query
from .catalogue_matching import _SETTLED
from .operators import matching, relaxation, splitting, stereo, tracking
from .operators.graph import cut, shared_folder
from .operators.segmentation import BITS
from .plans.adapters import DIMS, RULERS, VOX, ruler_points, voxels
from .sources import bricks

_PAIRS = splitting.PAIRS
_ID = f"((CAST(z AS BIGINT)<<{2 * BITS})|(CAST(y AS BIGINT)<<{BITS})|CAST(x AS BIGINT))"
_PTS = f"{_ID} AS id,CAST(x AS DOUBLE) x,CAST(y AS DOUBLE) y,CAST(z AS DOUBLE) z,v/255.0::DOUBLE AS w"
_DET = "(xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz))"
_COFACTORS = {"xx": "yy*zz-yz*yz", "xy": "xz*yz-xy*zz", "xz": "xy*yz-xz*yy", "yy": "xx*zz-xz*xz", "yz": "xy*xz-xx*yz", "zz": "xx*yy-xy*xy"}


def _ready_sql(name: str, parts: str) -> str:
    """CTEs that end in ``name``: parts with firm covariances, the factor f and the inverse ixx ... izz."""
    firm = ",".join(f"{p}+CASE WHEN {_DET}>1e-9::DOUBLE THEN 0 ELSE 0.5::DOUBLE END AS {p}" if p[0] == p[1] else p for p in _PAIRS)
    inverse = ",".join(f"({_COFACTORS[p]})/{_DET} AS i{p}" for p in _PAIRS)
    return f"{name}f AS (SELECT t,c,label,j,tau,mx,my,mz,{firm} FROM {parts}), {name} AS MATERIALIZED (SELECT t,c,label,j,mx,my,mz,tau/sqrt({splitting.NORM!r}::DOUBLE*{_DET}) AS f,{inverse} FROM {name}f)"


_FORM = "+".join(f"{1 if p[0] == p[1] else 2}*(p.{p[0]}-r.m{p[0]})*(p.{p[1]}-r.m{p[1]})*r.i{p}" for p in _PAIRS)


def _moments_sql(weight: str) -> str:
    mean = {q: f"sum({weight}*{q})/sum({weight})" for q in "xyz"}
    return ",".join([*[f"{m} AS m{q}" for q, m in mean.items()], *[f"sum({weight}*({p[0]}-o{p[0]})*({p[1]}-o{p[1]}))/sum({weight})-({mean[p[0]]}-any_value(o{p[0]}))*({mean[p[1]]}-any_value(o{p[1]})) AS {p}" for p in _PAIRS]])


def _spread_sql(source: str, by: str) -> str:
    """Weighted means and variances, no covariances, of ``source`` by ``by``."""
    mean = {q: f"sum({q}*w)/sum(w)" for q in "xyz"}
    return f"SELECT {by},{','.join(f'{m} AS m{q}' for q, m in mean.items())},{','.join(f'greatest(0,sum({p[0]}*{p[0]}*w)/sum(w)-({mean[p[0]]})*({mean[p[0]]})) AS {p}' if p[0] == p[1] else f'0::DOUBLE AS {p}' for p in _PAIRS)} FROM {source} GROUP BY ALL"


def _fits_sql(rounds: int) -> str:
    steps = [f"g0 AS MATERIALIZED (SELECT *,1::DOUBLE AS tau FROM ({_spread_sql('pts', 't,c,label,0 AS j')}))"]
    for n in range(rounds):
        steps.append(_ready_sql(f"r{n}", f"g{n}"))
        steps.append(f"d{n} AS (SELECT p.*,r.mx ox,r.my oy,r.mz oz,r.f*exp(-0.5::DOUBLE*({_FORM}))*p.w*p.w AS m FROM pts p JOIN r{n} r ON r.t=p.t AND r.c=p.c AND r.label=p.label)")
        steps.append(f"g{n + 1} AS MATERIALIZED (SELECT t,c,label,0 AS j,1::DOUBLE AS tau,{_moments_sql('m')} FROM d{n} GROUP BY t,c,label)")
    last = rounds
    gone = "sqrt(" + "+".join(f"(a.m{q}-b.m{q})*(a.m{q}-b.m{q})" for q in "xyz") + ")"
    return f"""WITH {VOX}, pts AS MATERIALIZED (SELECT t,c,label,{_PTS} FROM vox WHERE label<>0 AND v>0), {', '.join(steps)}
SELECT a.t,a.c,a.label,{','.join(f'round(a.m{q}+1e-8,5) m{q}' for q in 'xyz')},{','.join(f'round(a.{p}+1e-8,5)+0 AS {p}' for p in _PAIRS)},round({gone}+1e-8,5)+0 AS shift FROM g{last} a JOIN g{last - 1} b USING (t,c,label)"""


@query(_fits_sql(2))
def m12_local_fits(spark, sf_dir):
    """Every component's local Gaussian after two rounds."""
    points = splitting.component_points(voxels(spark, sf_dir))
    fits = splitting.first_fit(points)
    for _ in range(2):
        fits = splitting.fit_round(points, fits)
    found = fits.select("t", "c", "label", *[F.col("o")[k].alias(k) for k in ("mx", "my", "mz", *_PAIRS)], "shift")
    return found.withColumns({k: F.round(F.col(k) + 1e-8, 5) for k in found.columns[3:]})


@query()
def m12_local_centres(spark, sf_dir):
    """Where every component's densest part pulls its centre, until all have stopped."""
    return splitting.local_centres(splitting.component_points(voxels(spark, sf_dir)))


_FORKS = f"""{_SETTLED}, fk AS (SELECT t,c,v1 AS label,count(DISTINCT v2) n FROM e4 WHERE link=1 GROUP BY 1,2,3 UNION ALL SELECT t+1,c,v2,count(DISTINCT v1) FROM e4 WHERE link=1 GROUP BY 1,2,3),
forks AS MATERIALIZED (SELECT CAST(t AS INT) t,c,label,CAST(least(max(n),3) AS INT) k FROM fk GROUP BY t,c,label HAVING max(n)>=2),
pts AS MATERIALIZED (SELECT f.t,f.c,f.label,f.k,{_PTS.replace('CAST(x AS', 'CAST(o.x AS').replace('CAST(y AS', 'CAST(o.y AS').replace('CAST(z AS', 'CAST(o.z AS')} FROM vox o JOIN forks f ON f.t=o.t AND f.c=o.c AND f.label=o.label WHERE o.v>0)"""


def _split_sql(rounds: int, trust: float) -> str:
    key = "t,c,label"
    on = lambda a, b: f"{a}.t={b}.t AND {a}.c={b}.c AND {a}.label={b}.label"
    apart = lambda a, b: "+".join(f"({a}.{q}-{b}.{q})*({a}.{q}-{b}.{q})" for q in "xyz")
    steps = [f"s0 AS MATERIALIZED (SELECT {key},k,0 AS j,x,y,z FROM pts QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY w DESC,id)=1)"]
    for j in (1, 2):
        steps.append(f"s{j} AS MATERIALIZED (SELECT p.t,p.c,p.label,p.k,{j} AS j,p.x,p.y,p.z FROM pts p JOIN s{j - 1} s ON {on('p', 's')} WHERE p.k>{j} QUALIFY row_number() OVER (PARTITION BY p.t,p.c,p.label ORDER BY {apart('p', 's')} DESC,p.id)=1)")
    steps.append("c0 AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)")
    near = lambda n: f"a{n} AS MATERIALIZED (SELECT p.*,s.j FROM pts p JOIN c{n} s ON {on('p', 's')} QUALIFY row_number() OVER (PARTITION BY p.t,p.c,p.label,p.id ORDER BY {apart('p', 's')},s.j)=1)"
    for n in range(rounds):
        steps.append(near(n))
        sums = ",".join(f"sum({q}*w)/sum(w) AS {q}" for q in "xyz")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT o.t,o.c,o.label,o.k,o.j,{','.join(f'coalesce(a.{q},o.{q}) AS {q}' for q in 'xyz')} FROM c{n} o LEFT JOIN (SELECT {key},j,{sums} FROM a{n} GROUP BY {key},j) a ON {on('a', 'o')} AND a.j=o.j)")
    steps.append(near(rounds))
    steps.append(f"g0 AS MATERIALIZED (SELECT *,1/CAST(count(*) OVER (PARTITION BY {key}) AS DOUBLE) AS tau FROM ({_spread_sql(f'a{rounds}', 't,c,label,j')}))")
    for n in range(rounds + 1):
        steps.append(_ready_sql(f"r{n}", f"g{n}"))
        steps.append(f"d{n} AS (SELECT p.*,r.j,r.mx ox,r.my oy,r.mz oz,r.f*exp(-0.5::DOUBLE*({_FORM})) AS d FROM pts p JOIN r{n} r ON {on('r', 'p')})")
        steps.append(f"h{n} AS MATERIALIZED (SELECT *,CASE WHEN sum(d) OVER q>0 THEN d/sum(d) OVER q ELSE 1 END AS share FROM d{n} WINDOW q AS (PARTITION BY {key},id))")
        if n < rounds:
            steps.append(f"g{n + 1} AS MATERIALIZED (SELECT {key},j,sum(share*w)/sum(w) AS tau,{_moments_sql('share*w')} FROM h{n} GROUP BY {key},j)")
    steps.append(f"best AS (SELECT {key},id,j,share FROM h{rounds} QUALIFY row_number() OVER (PARTITION BY {key},id ORDER BY share DESC,j)=1)")
    steps.append(f"good AS (SELECT {key},avg(share) AS quality FROM best GROUP BY {key} HAVING avg(share)>{trust}::DOUBLE AND count(DISTINCT j)>1)")
    return f"{_FORKS}, {', '.join(steps)} SELECT b.t,b.c,b.label,b.id,CAST(b.j AS INT) AS cluster,round(g.quality+1e-8,5) AS quality FROM best b JOIN good g ON {on('g', 'b')}"


@query(_split_sql(3, 0.6))
def r12_r19_split_forks(spark, sf_dir):
    """Components where several links of one side meet come apart: three rounds of k-means, then three of their mixtures."""
    vox = voxels(spark, sf_dir)
    forks = splitting.forked(matching.settled_links(tracking.frame_links(vox))).withColumn("k", F.least("k", F.lit(3)))
    return splitting.split_samples(vox, forks, 0.6, rounds=3).withColumn("quality", F.round(F.col("quality") + 1e-8, 5))


@query()
def r12_r19_merge_verdicts(spark, sf_dir):
    """Whether the components that a track runs out into are one cluster by density."""
    vox = voxels(spark, sf_dir)
    return splitting.merge_verdicts(vox, splitting.far_ends(matching.settled_links(tracking.frame_links(vox))))


@query(f"""WITH {VOX} SELECT 0 AS level,t,c,z,y,x,v FROM vox WHERE v>0 AND y>=5 UNION ALL
SELECT * FROM (SELECT 1 AS level,t,c,z>>1 AS z,y>>1 AS y,x>>1 AS x,CAST(floor(avg(v)) AS INT) AS v FROM vox GROUP BY ALL) WHERE v>0 AND y>=5""")
def s16_bricked_levels(spark, sf_dir):
    """The volume written as zlib bricks of two levels, and all of both that lies beyond a plane read back."""
    folder = f"{shared_folder(spark).removeprefix('file:')}/bricks-{uuid.uuid4().hex}"
    path = bricks.save(voxels(spark, sf_dir), folder, DIMS, (4, 16, 16), levels=2)
    both = [bricks.load(spark, path, k).where("v > 0 and y >= 5").select(F.lit(k).alias("level"), "t", "c", "z", "y", "x", "v") for k in (0, 1)]
    return both[0].unionByName(both[1])


_PLACES = {"x": "(x % 97 - 48) / 10.0", "y": "(y - 48) / 10.0", "z": "z / 10.0 + 8.0"}
#: The second camera's rows: turned about y, one unit away.
_SECOND = np.array([[0.96, 0.0, 0.28, -0.8], [0.0, 1.0, 0.0, 0.0], [-0.28, 0.0, 0.96, 0.6]])


@query(f"WITH {RULERS} SELECT ruler,0 AS n,t,{','.join(f'round(({p})::DOUBLE,4)+0 AS {k}' for k, p in _PLACES.items())} FROM rul")
def v16_triangulated(spark, sf_dir):
    """Points as two cameras see them; the second camera is found from the views alone, then the points come back."""
    # Read for both views.
    points = cut(ruler_points(spark, sf_dir).select("ruler", F.lit(0).alias("n"), "t", *[F.expr(p).cast("double").alias(k) for k, p in _PLACES.items()]))

    def seen(camera):
        row = lambda i: sum((F.col(k) * float(camera[i, j]) for j, k in enumerate("xyz")), F.lit(float(camera[i, 3])))
        return points.select("ruler", "n", "t", (row(0) / row(2)).alias("x"), (row(1) / row(2)).alias("y"))

    # Calibration reads the pairs three times, and the points come from them.
    pairs = cut(stereo.paired(seen(stereo.FIRST), seen(_SECOND)))
    found = stereo.triangulated(pairs, stereo.FIRST, stereo.second_camera(pairs))
    return found.withColumns({k: F.round(k, 4) + 0.0 for k in "xyz"})


_PULL = ",".join(f"round(sum((v.{k}-p.{k})*v.w/f/f)/sum(v.w)+1e-8,5)+0 AS p{k}" for k in "xyz")


@query(f"""WITH {VOX}, {RULERS}, p AS (SELECT ruler,t AS n,CAST(x%50 AS DOUBLE) x,CAST(y AS DOUBLE) y,CAST(z AS DOUBLE) z FROM rul), v AS (SELECT CAST(x AS DOUBLE) x,CAST(y AS DOUBLE) y,CAST(z AS DOUBLE) z,v/255.0::DOUBLE AS w FROM vox WHERE v>0),
g AS (SELECT CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(d AS DOUBLE) d FROM range(-3,4) i(a), range(-3,4) j(b), range(-3,4) k(d) WHERE a*a+b*b+d*d<=9),
n AS (SELECT p.*,x+a AS qx,y+b AS qy,z+d AS qz,greatest(1.0::DOUBLE,sqrt(a*a+b*b+d*d)) AS f FROM p, g)
SELECT p.ruler,p.n,{_PULL} FROM n p JOIN v ON v.x=qx AND v.y=qy AND v.z=qz GROUP BY p.ruler,p.n""")
def v15_pulls(spark, sf_dir):
    """How the samples of all frames within three of each ruler point draw it."""
    points, samples = _relaxation_inputs(spark, sf_dir)
    return relaxation.pulls(points, samples, 1.0, 3.0).withColumns({f"p{k}": F.round(F.col(f"p{k}") + 1e-8, 5) + 0.0 for k in "xyz"})


@query()
def v15_relaxed(spark, sf_dir):
    """Rulers after three rounds of pulls and springs."""
    points, samples = _relaxation_inputs(spark, sf_dir)
    return relaxation.relaxed(points, samples, rounds=3, reach=3.0)


def _relaxation_inputs(spark, sf_dir):
    points = ruler_points(spark, sf_dir).select("ruler", F.col("t").alias("n"), (F.col("x") % 50).cast("double").alias("x"), "y", "z")
    return points, voxels(spark, sf_dir).where("v > 0").select("x", "y", "z", (F.col("v") / 255.0).alias("w"))
