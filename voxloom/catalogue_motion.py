"""Registered queries of registration, stencil tracking, floods and thinning, and their DuckDB SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from .catalogue import query
from .operators import extremum, rigid, stencil, thinning
from .plans.adapters import DIMS, VOX, voxels

_TURNS = [(0.0, 0.0, 0.0), (8.0, 0.0, 0.0), (-8.0, 0.0, 0.0), (4.0, 3.0, -2.0)]


def _score_sql() -> str:
    centred = [f"({k}+{0.5 - n / 2!r}::DOUBLE)" for k, n in zip("zyx", DIMS, strict=True)]
    parts = []
    for m, angles in enumerate(_TURNS):
        at = []
        for row, n in zip(rigid.rotation(angles), DIMS, strict=True):
            at.append("+".join([f"{n / 2!r}::DOUBLE", *[f"{c}*({w!r}::DOUBLE)" for c, w in zip(centred, row, strict=True)]]))
        places = ",".join(f"CAST(floor({a}+d{k}+1e-9::DOUBLE) AS INT) {k}1" for a, k in zip(at, "zyx", strict=True))
        parts.append(f"SELECT t,c,{m} AS move,dz,dy,dx,v,{places} FROM vox, s WHERE v>0")
    return f"""WITH {VOX}, s AS (SELECT dz,dy,dx FROM range(0,1) a(dz), range(-1,2) b(dy), range(-1,2) d(dx)), g AS ({' UNION ALL '.join(parts)}),
f AS (SELECT DISTINCT t,c FROM vox WHERE v>0), p AS (SELECT f.* FROM f JOIN f n ON n.t=f.t+1 AND n.c=f.c), q AS (SELECT p.*,move,dz,dy,dx FROM p, range(0,{len(_TURNS)}) m(move), s),
k AS (SELECT g.t,g.c,move,dz,dy,dx,CAST(sum(g.v*b.v) AS BIGINT) AS total FROM g JOIN vox b ON b.t=g.t+1 AND b.c=g.c AND b.z=z1 AND b.y=y1 AND b.x=x1 AND b.v>0 GROUP BY ALL)
SELECT q.t,q.c,CAST(q.move AS INT) AS move,CAST(q.dz AS INT) AS dz,CAST(q.dy AS INT) AS dy,CAST(q.dx AS INT) AS dx,coalesce(total,0) AS total FROM q LEFT JOIN k USING (t,c,move,dz,dy,dx)"""


@query(_score_sql())
def v04_v06_rigid_scores(spark, sf_dir):
    """The totals of one round: four turns with nine shifts each, for all pairs of frames."""
    vox = voxels(spark, sf_dir)
    frames = vox.where("v > 0").select("t", "c").distinct()
    pairs = frames.join(frames.select((F.col("t") - 1).cast("int").alias("t"), "c"), ["t", "c"])
    moves = [F.struct(F.lit(m).alias("move"), F.lit(0).alias("dz"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for m, y, x in product(range(len(_TURNS)), (-1, 0, 1), (-1, 0, 1))]
    return rigid.rigid_scores(vox, DIMS, _TURNS, pairs.select("t", "c", F.explode(F.array(*moves)).alias("m")).select("t", "c", "m.*"))


@query()
def v04_v05_rigid_registration(spark, sf_dir):
    """Turn about z and shift of every pair of frames; planted motions are found in the tests."""
    return rigid.register_rigid(voxels(spark, sf_dir), DIMS, reach=6.0, step=3.0, shift=1, rounds=3)


def _stencil_track_sql(first: int, last: int) -> str:
    steps = [f"n{first} AS (SELECT c,label,z,y,x,v,0 dz,0 dy,0 dx,0::BIGINT total FROM vox WHERE t={first} AND label<>0)"]
    for t in range(first + 1, last + 1):
        steps.append(f"""b{t} AS (SELECT * FROM (SELECT m.c,m.label,s.dz,s.dy,s.dx,CAST(sum(m.v*w.v) AS BIGINT) total FROM n{t - 1} m CROSS JOIN s JOIN vox w ON w.t={t} AND w.v>0 AND w.c=m.c AND w.z=m.z+s.dz AND w.y=m.y+s.dy AND w.x=m.x+s.dx GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY c,label ORDER BY total DESC,abs(dz)+abs(dy)+abs(dx),dz,dy,dx)=1)""")
        steps.append(f"""a{t} AS (SELECT m.c,m.label,m.z+coalesce(b.dz,0) z,m.y+coalesce(b.dy,0) y,m.x+coalesce(b.dx,0) x,coalesce(b.dz,0) dz,coalesce(b.dy,0) dy,coalesce(b.dx,0) dx,coalesce(b.total,0) total FROM n{t - 1} m LEFT JOIN b{t} b ON b.c=m.c AND b.label=m.label),
n{t} AS MATERIALIZED (SELECT a.c,a.label,a.z,a.y,a.x,coalesce(w.v,0) v,dz,dy,dx,total FROM a{t} a LEFT JOIN vox w ON w.t={t} AND w.v>0 AND w.c=a.c AND w.z=a.z AND w.y=a.y AND w.x=a.x)""")
    rows = " UNION ALL ".join(f"SELECT {t} t,c,label,z,y,x,dz,dy,dx,total FROM n{t}" for t in range(first, last + 1))
    return f"WITH {VOX}, s AS (SELECT CAST(dz AS INT) dz,CAST(dy AS INT) dy,CAST(dx AS INT) dx FROM range(0,1) a(dz), range(-2,3) b(dy), range(-2,3) d(dx)), {', '.join(steps)}, o AS ({rows}) SELECT t,c,label,CAST(z AS INT) z,CAST(y AS INT) y,CAST(x AS INT) x,CAST(dz AS INT) dz,CAST(dy AS INT) dy,CAST(dx AS INT) dx,total FROM o"


@query(_stencil_track_sql(0, 6))
def r23_stencil_tracks(spark, sf_dir):
    """The masks of the first frame through all later ones."""
    return rigid.track_stencils(voxels(spark, sf_dir), 0, 6)


@query(f"""WITH RECURSIVE {VOX}, l AS MATERIALIZED (SELECT t,c,label,z,y,x,v,max(v) OVER (PARTITION BY t,c,label)-min(v) OVER (PARTITION BY t,c,label) AS r,row_number() OVER (PARTITION BY t,c,label ORDER BY v DESC,z,y,x) k FROM vox WHERE label<>0 AND v>0),
o AS (SELECT CAST(a AS INT) dz,CAST(b AS INT) dy,CAST(d AS INT) dx FROM range(-1,2) p(a), range(-1,2) q(b), range(-1,2) s(d)),
w(t,c,label,z,y,x,v) AS (SELECT t,c,label,z,y,x,v FROM l WHERE k=1 UNION SELECT l.t,l.c,l.label,l.z,l.y,l.x,l.v FROM (SELECT w.*,z+dz nz,y+dy ny,x+dx nx FROM w CROSS JOIN o) w JOIN l ON l.t=w.t AND l.c=w.c AND l.label=w.label AND l.z=nz AND l.y=ny AND l.x=nx AND 100*(l.v-w.v)<l.r),
g AS (SELECT *,v-min(v) OVER (PARTITION BY t,c,label) AS u,min(v) OVER (PARTITION BY t,c,label) AS low FROM w),
m AS (SELECT t,c,label,low,count(*) n,CAST(sum(u) AS DOUBLE) s,sum(u*x)/nullif(CAST(sum(u) AS DOUBLE),0) mx,sum(u*y)/nullif(CAST(sum(u) AS DOUBLE),0) my,sum(u*z)/nullif(CAST(sum(u) AS DOUBLE),0) mz,
  sum(u*x*x)/nullif(CAST(sum(u) AS DOUBLE),0) qx,sum(u*y*y)/nullif(CAST(sum(u) AS DOUBLE),0) qy,sum(u*z*z)/nullif(CAST(sum(u) AS DOUBLE),0) qz FROM g GROUP BY 1,2,3,4)
SELECT l.t,l.c,l.label,l.v AS peak,l.z AS pz,l.y AS py,l.x AS px,m.low,n,round(mx+1e-8,5) mx,round(my+1e-8,5) my,round(mz+1e-8,5) mz,round(qx-mx*mx+1e-8,5) vx,round(qy-my*my+1e-8,5) vy,round(qz-mz*mz+1e-8,5) vz FROM l JOIN m USING (t,c,label) WHERE k=1""")
def m13_local_extrema(spark, sf_dir):
    found = extremum.local_extrema(voxels(spark, sf_dir))
    return found.withColumns({f"{a}{k}": F.round(F.col(f"{a}{k}") + 1e-8, 5) for a in "mv" for k in "xyz"})


def _thin_sql() -> str:
    """One pass: each sample's neighbours on as the bits of a number, and a list of templates to match."""
    bits = ",".join(f"({b},{z},{y},{x})" for (z, y, x), b in thinning.BITS.items())
    masks = ",".join(f"({on}::BIGINT,{off}::BIGINT,{some}::BIGINT)" for on, off, some in thinning.templates())
    near, ends = thinning.mask(thinning.NEAR), ",".join(f"({thinning.mask(list(p))}::BIGINT)" for p in thinning.CORNERS)
    at = [f"greatest(0,least({n - 1},a.{k}+d{k}))" for k, n in zip("zyx", DIMS, strict=True)]
    return f"""WITH {VOX}, s AS MATERIALIZED (SELECT t,c,z,y,x,v FROM vox WHERE v>=26), o(b,dz,dy,dx) AS (VALUES {bits}), m(m_on,m_off,m_any) AS (VALUES {masks}), e(pair) AS (VALUES {ends}),
g AS (SELECT a.*,b,{at[0]} nz,{at[1]} ny,{at[2]} nx FROM s a CROSS JOIN o),
k AS MATERIALIZED (SELECT g.t,g.c,g.z,g.y,g.x,any_value(g.v) v,bit_or(1::BIGINT<<b) AS code FROM g JOIN s ON s.t=g.t AND s.c=g.c AND s.z=nz AND s.y=ny AND s.x=nx GROUP BY 1,2,3,4,5),
d AS (SELECT DISTINCT t,c,z,y,x FROM k JOIN m ON code&m_on=m_on AND code&m_off=0 AND (m_any=0 OR code&m_any<>0)
  WHERE NOT (bit_count(code&{near}::BIGINT)=2 OR (bit_count(code&{near}::BIGINT)=3 AND EXISTS (SELECT 1 FROM e WHERE code&pair=pair))))
SELECT t,c,z,y,x,v FROM k ANTI JOIN d USING (t,c,z,y,x)"""


@query(_thin_sql())
def w19_thinned_once(spark, sf_dir):
    return stencil.apply(voxels(spark, sf_dir), DIMS, 2, thinning.thin_once(0.1))


@query()
def w19_skeleton(spark, sf_dir):
    """Passes until nothing goes any more."""
    return thinning.skeleton(voxels(spark, sf_dir), DIMS)
